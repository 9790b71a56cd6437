"""Registered queries: streams over the given tables, run until all input is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftwright.operators import scan
from shiftwright.plans.queries_checks import ORACLES as CHECK_ORACLES, with_outcome
from shiftwright.plans.queries_scan import MATCHES_SQL, ORACLES as SCAN_ORACLES, PAGE_RULES
from shiftwright.plans.tables import pages, read
from shiftwright.session import shared_path
from shiftwright.sources import commits
from shiftwright.streaming import attempts, incremental


def _finished(spark, stream, step, keys, mode):
    """Run a stream to its end and read what it wrote."""
    out, checkpoint = shared_path(spark, "stream"), shared_path(spark, "stream-state")
    incremental.process_new(stream, step, out, checkpoint, mode).awaitTermination()
    rows = incremental.written(spark, out, step(stream).schema)
    return incremental.latest_rows(rows, keys) if keys else rows.drop("batch")


def _steps(spark, sf):
    schema = read(spark, sf, "events").schema
    return incremental.stream_table(spark, f"{sf}/events.parquet", schema).withColumn(
        "passed", F.col("event_type") != "error"
    )


def attempts_stream(spark, sf):
    stream = attempts.attempt_state(_steps(spark, sf), ["user_id"], ["ts", "event_id"], "event_type")
    return _finished(spark, stream, lambda b: b, ["user_id"], "update")


def retry_stream(spark, sf):
    """The retry budget kept as the state of a stream, decisions as rows."""
    schema = read(spark, sf, "events").schema
    steps = with_outcome(incremental.stream_table(spark, f"{sf}/events.parquet", schema))
    # The rows come in no order of time, so none of the table is late.
    stream = attempts.retry_decisions(steps, ["user_id"], "ts", "event_id", "400 days")
    files = _finished(spark, stream, lambda b: b, ["user_id"], "update")
    return files.select("user_id", F.inline("decisions")).select(
        F.col("id").alias("event_id"), "user_id", "attempt", "retry_count", "action")


def failure_windows_stream(spark, sf):
    stream = attempts.failure_windows(_steps(spark, sf), "ts", "6 hours", late="40 days")
    out = _finished(spark, stream, lambda b: b, ["window_start", "window_end"], "update")
    return _texts(out, ["window_start", "window_end"])


def _texts(df, columns):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in columns})


def failure_windows_sliding(spark, sf):
    steps = read(spark, sf, "events").withColumn("passed", F.col("event_type") != "error")
    return _texts(attempts.failure_windows(steps, "ts", "1 day", "12 hours"), ["window_start", "window_end"])


def failure_sessions(spark, sf):
    steps = read(spark, sf, "events").withColumn("passed", F.col("event_type") != "error")
    return attempts.failure_sessions(steps, ["user_id"], "ts", "2 hours").select(
        "user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "steps", "failures"
    )


def incremental_stream(spark, sf):
    """Pages as they arrive: matches per file of each micro-batch."""
    out = _finished(spark, _page_stream(spark, sf), lambda b: scan.count_matches(b, PAGE_RULES), [], "append")
    return out.withColumn("rank", F.col("rank").cast("bigint"))


def _page_stream(spark, sf):
    schema = read(spark, sf, "pages").schema
    return incremental.stream_table(spark, f"{sf}/pages.parquet", schema).select(
        F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("project"),
        F.concat(F.lit("p"), F.col("page_id"), F.lit(".html")).alias("path"),
        F.col("html").alias("content"),
    )


def incremental_summary(spark, sf):
    """The scan summary of pages that came in a stream, from the committed files and matches of its micro-batches."""
    root = shared_path(spark, "committed")

    def tables(batch):
        return {"files": batch.select("project", "path"), "matches": scan.find_matches(batch, PAGE_RULES)}

    incremental.process_together(_page_stream(spark, sf), tables, root, shared_path(spark, "stream-state")).awaitTermination()
    files = commits.committed(spark, root, "files", "project string, path string")
    matches = commits.committed(spark, root, "matches", "project string, path string, classification string")
    kind = F.col("classification")
    found = matches.groupBy("project").agg(
        F.count(F.lit(1)).alias("patterns_found"), F.count_if(kind == "deterministic").alias("deterministic_count"),
        F.count_if(kind == "ambiguous").alias("ambiguous_count"),
    )
    counts = ["patterns_found", "deterministic_count", "ambiguous_count"]
    return files.groupBy("project").agg(F.count(F.lit(1)).alias("files_scanned")).join(found, "project", "left").fillna(0, counts)


QUERIES = {
    "incremental_summary": incremental_summary,
    "attempts_stream": attempts_stream,
    "retry_stream": retry_stream,
    "failure_windows_stream": failure_windows_stream,
    "failure_windows_sliding": failure_windows_sliding,
    "failure_sessions": failure_sessions,
    "incremental_stream": incremental_stream,
}

ORACLES = {
    "incremental_summary": SCAN_ORACLES["scan_summary"],
    "attempts_stream": """
SELECT user_id, count(*) AS steps, count(*) FILTER (event_type = 'error') AS failures,
  arg_max(event_type, (ts, event_id)) AS latest, greatest(3 - count(*) FILTER (event_type = 'error'), 0)::BIGINT AS retries_left
FROM events GROUP BY user_id""",
    "retry_stream": f"SELECT * FROM ({CHECK_ORACLES['retry_routing']}) WHERE action <> 'closed'",
    "failure_windows_stream": """
SELECT strftime(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2000-01-01'), '%Y-%m-%d %H:%M:%S') AS window_start,
  strftime(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2000-01-01') + INTERVAL '6 hours', '%Y-%m-%d %H:%M:%S') AS window_end,
  count(*) AS steps, count(*) FILTER (event_type = 'error') AS failures
FROM events GROUP BY ALL""",
    "failure_windows_sliding": """
WITH w AS (
  SELECT event_type, unnest([time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '2000-01-01'),
    time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '2000-01-01') - INTERVAL '12 hours']) AS s FROM events)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(s + INTERVAL '1 day', '%Y-%m-%d %H:%M:%S') AS window_end,
  count(*) AS steps, count(*) FILTER (event_type = 'error') AS failures
FROM w GROUP BY ALL""",
    "failure_sessions": """
WITH g AS (
  SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL '2 hours' THEN 0 ELSE 1 END AS new_session
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new_session) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS steps,
  count(*) FILTER (event_type = 'error') AS failures
FROM s GROUP BY user_id, nth""",
    "incremental_stream": MATCHES_SQL + """
SELECT project, path, count(rule_idx) AS matches, count(*) FILTER (classification = 'deterministic') AS deterministic,
  count(*) FILTER (classification = 'ambiguous') AS ambiguous, coalesce(max(rank), 0)::BIGINT AS rank
FROM pages_corpus LEFT JOIN matches USING (project, path) GROUP BY project, path""",
}
