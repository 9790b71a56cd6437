import datetime
import random

import pytest
from pyspark.sql import functions as F

from shiftwright.operators import score
from shiftwright.streaming import attempts, incremental

BEGIN = datetime.datetime(2026, 1, 1)
SCHEMA = "project string, path bigint, ts timestamp, n bigint, passed boolean, category string, _at string"
KEYS = ["project", "path"]


def steps(count, files, seed):
    """Attempts of a few files, half of them of one, with ties in time and null keys."""
    rng = random.Random(seed)
    rows = []
    for n in range(count):
        passed = rng.random() < 0.2
        category = rng.choice([None, "lint_error", "lint_error", "lint_error", "secrets_detected"])
        path = 0 if rng.random() < 0.5 else rng.choice([None, *range(1, files)])
        at = BEGIN + datetime.timedelta(minutes=rng.randrange(count // 2))
        rows.append(("p", path, at, n, passed, None if passed else category, "x"))
    return rows


def streamed(spark, tmp_path, batches, late):
    source, out = tmp_path / "in", tmp_path / "out"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(source / f"part={i:03}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(
        str(source / "*"))
    decided = attempts.retry_decisions(stream, KEYS, "ts", "n", late)
    query = incremental.process_new(decided, lambda b: b, str(out), str(tmp_path / "state"), "update")
    assert query.awaitTermination(240)
    return incremental.written(spark, str(out), decided.schema)


def decisions(rows):
    return sorted(map(tuple, rows.select(
        *KEYS, F.inline("decisions")).select(*KEYS, "at", "id", "attempt", "retry_count", "action").collect()), key=str)


def batch(spark, rows):
    routed = score.retry_routing(spark.createDataFrame(rows, SCHEMA), KEYS, ["ts", "n"]).filter("action <> 'closed'")
    return sorted(map(tuple, routed.select(*KEYS, "ts", "n", "attempt", "retry_count", "action").collect()), key=str)


@pytest.mark.parametrize("parts", [1, 5])
def test_equals_batch_whatever_the_micro_batches(spark, tmp_path, parts):
    rows = steps(300, 25, 1)
    random.Random(parts).shuffle(rows)
    written = streamed(spark, tmp_path, [rows[i::parts] for i in range(parts)], "100 days")
    assert decisions(incremental.latest_rows(written, KEYS)) == batch(spark, rows)


def test_timer_settles_files_and_later_attempts_change_nothing(spark, tmp_path):
    def at(path, minutes, n, passed):
        return ("p", path, BEGIN + datetime.timedelta(minutes=minutes), n, passed, None, "x")

    batches = [
        [at(1, 5, 1, True), at(2, 5, 2, False)],
        # Before the decision of file 1, and not late: it moves the decision.
        [at(1, 3, 3, False), at(2, 6, 4, False)],
        [at(3, 600, 5, False)],
        [at(1, 601, 6, False), at(2, 601, 7, True)],
        [at(3, 602, 8, True), at(3, 602, 9, True)],
    ]
    written = streamed(spark, tmp_path, batches, "1 hour")
    rows = [r for b in batches for r in b]
    assert decisions(incremental.latest_rows(written, KEYS)) == batch(spark, rows)
    settled = {r.path: r.settled for r in incremental.latest_rows(written, KEYS).collect()}
    assert settled == {1: True, 2: False, 3: False}
    # File 1 was reported when it was decided, when the late attempt came, and when the timer fired.
    assert written.filter("path = 1").count() == 3


def test_attempts_without_instant_or_id_are_left_out(spark, tmp_path):
    rows = [("p", 1, None, 1, True, None, "x"), ("p", 1, BEGIN, None, True, None, "x"), ("p", 1, BEGIN, 2, None, None, "x")]
    written = streamed(spark, tmp_path, [rows], "1 hour")
    assert decisions(written) == [("p", 1, BEGIN, 2, 1, 0, "retry")]
