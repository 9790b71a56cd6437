import pytest

from shiftwright.catalog import Rule
from shiftwright.operators import rewrite, scan
from shiftwright.plans import migrate
from shiftwright.plans.queries_report import _mixed_catalog, _plain_model

FILES = "project string, path string, content string"
KEYED = FILES + ", framework string, migration string"


@pytest.fixture(scope="module")
def mixed():
    return _mixed_catalog()


TEXTS = [
    ("a", "x.html", '<p *ngIf="a">say(1) old</p>', "angular", "control_flow"),
    ("a", "none.html", "say(1)", "angular", "control_flow"),
    ("c", "x.cls", '<p *ngIf="a">say(1)</p>', "classic", "modern"),
    ("c", "old.cls", "say(1) old", "classic", "modern"),
    ("r", "x.jsx", '<p *ngIf="a">say(1)</p>', "react", "class_to_hooks"),
    ("n", "x.html", '<p *ngIf="a">say(1)</p>', None, None),
    ("c", None, None, "classic", "modern"),
]


def test_every_file_meets_its_own_rules(spark, mixed):
    files = spark.createDataFrame(TEXTS, KEYED)
    found = {(r.project, r.path, r.pattern_id, r.rule_idx, r.start) for r in scan.find_matches_by_key(files, mixed).collect()}
    expected = set()
    for framework, migration in (("angular", "control_flow"), ("classic", "modern")):
        own = spark.createDataFrame([t for t in TEXTS if t[3:] == (framework, migration)], KEYED)
        rules = mixed.rules_for(framework, migration)
        expected |= {(r.project, r.path, r.pattern_id, r.rule_idx, r.start) for r in scan.find_matches(own, rules).collect()}
    assert found == expected and ("c", "x.cls", "say", 0, 13) in found and len(found) == 4


def test_tasks_need_no_shuffle(spark, mixed):
    files = spark.createDataFrame(TEXTS, KEYED)
    tasks = scan.file_tasks_by_key(files, mixed, keep=["content"])
    assert "Exchange" not in tasks._jdf.queryExecution().executedPlan().toString()
    assert {(r.project, r.path, r.framework, r.strategy) for r in tasks.collect()} == {
        ("a", "x.html", "angular", "deterministic"), ("c", "x.cls", "classic", "deterministic"),
        ("c", "old.cls", "classic", "ambiguous"),
    }


def test_rewrites_by_key(spark, mixed):
    files = spark.createDataFrame(TEXTS, KEYED)
    after = {(r.project, r.path): (r.after, r.error) for r in rewrite.rewrite_by_key(files, mixed).collect()}
    assert len(after) == len(TEXTS)
    assert after["a", "x.html"] == ("@if (a) {\n  <p>say(1) old</p>\n}", None)
    assert after["c", "x.cls"] == ('<p *ngIf="a">tell(1)</p>', None)
    assert after["r", "x.jsx"] == after["n", "x.html"] == ('<p *ngIf="a">say(1)</p>', None)
    assert after["c", None] == (None, "unreadable text")


def test_a_migration_with_both_kinds_of_rules(spark):
    """Element edits come first; a plug-in rule that does not settle leaves the file as it was."""
    catalog = _mixed_catalog()
    catalog.register_rule("angular", "control_flow", Rule("at", "at-if becomes at-when", "simple", "@if", "@when", "@if"))
    catalog.register_rule("angular", "control_flow", Rule("grow", "never settles", "simple", "g", "gg", "g"))
    rows = [("a", "x.html", '<p *ngIf="a">1</p>', "angular", "control_flow"),
            ("a", "g.html", '<p *ngIf="a">g</p>', "angular", "control_flow"), ("c", "x.cls", "@if say(", "classic", "modern")]
    after = {r.path: r for r in rewrite.rewrite_by_key(spark.createDataFrame(rows, KEYED), catalog).collect()}
    assert after["x.html"].before == rows[0][2] and after["x.html"].after == "@when (a) {\n  <p>1</p>\n}"
    assert after["g.html"].after == rows[1][2] and "grow" in after["g.html"].error
    assert after["x.cls"].after == "@if tell("


def test_one_run_over_many_projects(spark, mixed):
    rows = [
        ("a", "package.json", '{"dependencies": {"@angular/core": "1"}}'), ("a", "src/x.html", '<p *ngIf="a">say(1)</p>'),
        ("c", "classic.json", "{}"), ("c", "x.cls", "say(2)"), ("c", "old.cls", "old"), ("c", "x.html", "say(3)"),
        ("r", "package.json", '{"dependencies": {"react": "1"}}'), ("r", "x.jsx", "say(4)"), ("n", "x.html", "say(5)"),
    ]
    run = migrate.Run("run_1", max_retries=1)
    tables = migrate.migrate_projects(spark.createDataFrame(rows, FILES), mixed, run, _plain_model())
    assert {tuple(r) for r in tables["by_migration"].collect()} == {
        ("run_1", "angular", "control_flow", 1, 1, 0), ("run_1", "classic", "modern", 2, 1, 1)}
    after = {(r.project, r.path): r.after for r in tables["texts"].collect()}
    assert after == {("a", "src/x.html"): "@if (a) {\n  <p>say(1)</p>\n}", ("c", "x.cls"): "tell(2)", ("c", "old.cls"): "done old"}
    assert tables["attempts"].filter("path = 'old.cls'").count() == 2
