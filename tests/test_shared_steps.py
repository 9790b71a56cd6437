from shiftwright.operators import order
from shiftwright.plans import migrate, queries_checks, queries_report

SMALL = "/root/testdata/sf0.001"


def kept(monkeypatch, module, found):
    cut = module.cut
    monkeypatch.setattr(module, "cut", lambda df, label: found.append((label, df)) or cut(df, label))


def test_rounds_of_the_order_carry_numbers_only(spark, monkeypatch):
    found = []
    kept(monkeypatch, order, found)
    files = spark.createDataFrame([("p", x) for x in "abcd"], "project string, path string")
    edges = spark.createDataFrame([("p", *x) for x in ("ab", "bc", "cb", "da")], "project string, path string, target string")
    assert order.migration_order(files, edges).count() == 4
    rounds = [df for label, df in found if label != "order-nodes"]
    assert rounds and all(kind in ("bigint", "int", "boolean") for df in rounds for _, kind in df.dtypes)


def test_a_report_checks_texts_once_and_dealt_out(spark, monkeypatch):
    found = []
    for module in (queries_checks, queries_report):
        kept(monkeypatch, module, found)
    queries_report.report_files(spark, SMALL)
    checked = [df for label, df in found if label == "checks"]
    assert len(checked) == 1
    assert "hashpartitioning(run_id" in checked[0]._jdf.queryExecution().executedPlan().toString()


def test_a_run_writes_what_its_checks_found(spark, monkeypatch):
    found = []
    kept(monkeypatch, migrate, found)
    queries_report.migrate_records(spark, SMALL)
    labels = [label for label, _ in found]
    assert labels.count("checks") == labels.count("attempts") > 1
