import datetime
import random

import pytest
from pyspark.sql import functions as F

from shiftwright.streaming.attempts import failure_sessions

BEGIN = datetime.datetime(2026, 1, 1)
SCHEMA = "user string, other string, ts timestamp, passed boolean, _scan_run int"
GAP = 60


@pytest.fixture(autouse=True)
def many_partitions(spark):
    """Small partitions are not merged, so that sessions cross their edges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def table(spark, seconds_by_user, parts=7):
    rows = [
        (user, None, None if s is None else BEGIN + datetime.timedelta(seconds=s), i % 3 != 0, 1)
        for user, seconds in seconds_by_user.items() for i, s in enumerate(seconds)
    ]
    random.Random(5).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def brute(rows):
    by_user = {}
    for r in rows:
        if r.ts is not None:
            by_user.setdefault((r.user, r.other), []).append((r.ts, r.passed))
    out = []
    for key, steps in by_user.items():
        held = []
        for at, passed in sorted(steps):
            if held and (at - held[-1][1]).total_seconds() <= GAP:
                held[-1][1:] = [at, held[-1][2] + 1, held[-1][3] + (not passed)]
            else:
                held.append([at, at, 1, int(not passed)])
        out += [(*key, a, b + datetime.timedelta(seconds=GAP), n, f) for a, b, n, f in held]
    return sorted(out, key=str)


def found(df):
    out = failure_sessions(df, ["user", "other"], "ts", f"{GAP} seconds")
    assert out.columns == ["user", "other", "session_start", "session_end", "steps", "failures"]
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("spread", [300, 40_000, 4_000_000])
def test_equals_brute_force_with_a_hot_key(spark, spread):
    """From one session of all rows, over many partitions, to a session per row."""
    rng = random.Random(spread)
    df = table(spark, {
        "hot": [rng.randrange(spread) for _ in range(4000)], "b": [rng.randrange(spread) for _ in range(50)],
        None: [0, 1, 500], "none": [None, None], "edge": [0, GAP, 2 * GAP, 3 * GAP + 1],
    })
    assert found(df) == brute(df.collect())


def test_equals_spark_sessions(spark):
    """The same edges as the session windows that a stream uses."""
    df = table(spark, {"edge": [0, GAP, 2 * GAP, 3 * GAP + 1, 3 * GAP + 1, 1000], "b": [5]}).filter("user is not null")
    spans = df.groupBy("user", "other", F.session_window("ts", f"{GAP} seconds").alias("w")).agg(F.count("*").alias("n"))
    expected = sorted(tuple(r) for r in spans.select("user", "w.start", "w.end", "n").collect())
    assert expected == sorted((r[0], r[2], r[3], r[4]) for r in found(df))


def test_one_instant_and_no_rows(spark):
    """All rows at one instant are one session; an empty table has none."""
    assert [r[4] for r in found(table(spark, {"hot": [7] * 3000}))] == [3000]
    assert found(table(spark, {"hot": [1]}).filter("passed is null")) == []


def test_a_hot_key_fills_many_partitions(spark):
    import shiftwright.operators.state as state

    sizes = []
    original = state.cut

    def watched(df, label):
        out = original(df, label)
        sizes.extend(r["count"] for r in out.groupBy("_scan_part").count().collect())
        return out

    state.cut = watched
    try:
        rows = found(table(spark, {"hot": [i * 1000 for i in range(4000)]}))
    finally:
        state.cut = original
    assert len(rows) == 4000 and len(sizes) > 3 and max(sizes) < 2000
