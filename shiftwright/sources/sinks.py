"""Sinks: reports, tickets, scan documents, file history, and the roll-back of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftwright.operators.report import in_text_order
from shiftwright.sources import commits


def run_id(at: Column) -> Column:
    """Run id of minute resolution."""
    return F.date_format(at, "'run_'yyyy_MM_dd_HHmm")


def write_reports(reports: DataFrame, path: str) -> None:
    """Report rows as JSON, a folder per run.

    Two runs of a minute share an id; project and part keep their rows apart.
    """
    reports.withColumn("_run", F.col("run_id")).write.mode("append").partitionBy("_run").json(path)


def write_markdown(lines: DataFrame, path: str) -> None:
    """Report lines as text, a folder per run, in part order."""
    ordered = in_text_order(lines).select("run_id", "line")
    ordered.write.mode("append").partitionBy("run_id").text(path)


def write_tickets(tickets: DataFrame, path: str) -> None:
    """Review tickets as rows of (project, path, ticket, body), a folder per run."""
    tickets.write.mode("append").partitionBy("run_id").parquet(path)


def write_scan(documents: DataFrame, path: str) -> None:
    """Nested scan documents, one JSON text per line."""
    documents.select(F.col("document").alias("value")).write.mode("append").text(path)


def write_history(rewrites: DataFrame, path: str, run: str, attempt: int = 0) -> None:
    """Before and after images of changed files. Nothing is overwritten."""
    history_rows(rewrites, run, attempt).write.mode("append").partitionBy("run_id").parquet(path)


HISTORY = "run_id string, attempt int, project string, path string, before string, after string"


def commit_history(spark: SparkSession, rewrites: DataFrame, path: str, run: str, attempt: int = 0) -> None:
    """The same as one commit for each attempt: readers see it whole or not at all, and a repeated one replaces it."""
    commits.commit(spark, path, f"{run}/{attempt}", {"history": history_rows(rewrites, run, attempt)})


def committed_history(spark: SparkSession, path: str) -> DataFrame:
    """The history of all committed attempts, for apply_history and rollback."""
    return commits.committed(spark, path, "history", HISTORY)


def history_rows(rewrites: DataFrame, run: str, attempt: int = 0) -> DataFrame:
    changed = F.col("after").isNotNull() & (F.col("after") != "") & ~F.col("before").eqNullSafe(F.col("after"))
    return rewrites.filter(changed).select(
        F.lit(run).alias("run_id"), F.lit(attempt).alias("attempt"), "project", "path", "before", "after"
    )


def apply_history(files: DataFrame, history: DataFrame) -> DataFrame:
    """Files with the last after-image of the history."""
    last = history.groupBy("project", "path").agg(F.max_by("after", "attempt").alias("_after"))
    return files.join(last, ["project", "path"], "left").select(
        *[F.coalesce("_after", "content").alias("content") if c == "content" else F.col(c) for c in files.columns]
    )


def rollback(files: DataFrame, history: DataFrame, run: str | None = None) -> DataFrame:
    """Files as before the run, with ``restored``: the earliest before-image wins."""
    if run is not None:
        history = history.filter(F.col("run_id") == run)
    first = history.groupBy("project", "path").agg(
        F.min_by(F.struct("before"), F.struct("run_id", "attempt"))["before"].alias("_before"),
        F.lit(True).alias("restored"),
    )
    return files.join(first, ["project", "path"], "left").select(
        *[F.coalesce("_before", "content").alias("content") if c == "content" else F.col(c) for c in files.columns],
        F.coalesce("restored", F.lit(False)).alias("restored"),
    )


def append_doc(spark: SparkSession, framework: str, migration: str, text: str, path: str) -> None:
    """Write a guide as a document row."""
    spark.createDataFrame(
        [(framework, migration, text)], "framework STRING, migration STRING, text STRING"
    ).write.mode("append").parquet(path)
