import pytest
from pyspark.sql import functions as F

import shiftwright as sw
from shiftwright.operators import report
from shiftwright.sources import commits, sinks
from shiftwright.streaming import incremental


def test_tables_appear_together_and_once(spark, tmp_path):
    root, schema = f"{tmp_path}/c", "n long"
    assert commits.committed(spark, root, "a", schema).collect() == []
    commits.commit(spark, root, "k1", {"a": spark.range(2).toDF("n"), "b": spark.range(3).toDF("n")})
    with pytest.raises(Exception):  # breaks off between its two tables
        commits.commit(spark, root, "k2", {"a": spark.range(9).toDF("n"), "b": spark.range(3).select(F.raise_error(F.lit("x")))})
    assert commits.committed(spark, root, "a", schema).count() == 2
    commits.commit(spark, root, "k1", {"a": spark.range(5).toDF("n")})
    assert commits.committed(spark, root, "a", schema).count() == 5  # replaced
    assert commits.committed(spark, root, "b", schema).count() == 0  # the last record has no such table
    assert [r.key for r in commits.commits(spark, root).collect()] == ["k1"]


def test_committed_history_rolls_back(spark, corpus, tmp_path):
    files = corpus({"a": "1", "b": "2"})
    first = files.select("project", "path", F.col("content").alias("before"), F.concat("content", F.lit("x")).alias("after"))
    path = f"{tmp_path}/h"
    for _ in range(2):
        sinks.commit_history(spark, first, path, "run_1", 0)
    history = sinks.committed_history(spark, path)
    assert history.count() == 2
    migrated = sinks.apply_history(files, history)
    assert {r.content for r in migrated.collect()} == {"1x", "2x"}
    assert {(r.content, r.restored) for r in sinks.rollback(migrated, history, "run_1").collect()} == {("1", True), ("2", True)}


def test_a_run_in_micro_batches_equals_a_batch_run(spark, corpus, catalog, tmp_path):
    texts = {f"src/{k}.component.html": t for k, t in enumerate([
        '<p *ngIf="a">1</p>', '<li *ngFor="let x of xs">2</li>', '<p *ngIf="a$ | async as a">3</p>', "<p>4</p>"])}
    run = sw.Run("run_1", "angular", "control_flow")
    files, source = corpus(texts), f"{tmp_path}/files"
    for path in texts:
        files.where(F.col("path") == path).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(source)
    root = f"{tmp_path}/out"
    incremental.migrate_new(stream, catalog, run, root, f"{tmp_path}/state").awaitTermination()
    whole = sw.migrate(files, catalog, run)
    assert commits.commits(spark, root).count() == len(texts)
    for name in ("results", "records", "texts"):
        found = commits.committed(spark, root, name, whole[name].schema)
        assert sorted(map(str, found.collect())) == sorted(map(str, whole[name].collect()))
    results = commits.committed(spark, root, "results", whole["results"].schema)
    assert sorted(map(str, report.summaries(results).collect())) == sorted(map(str, whole["summary"].collect()))
