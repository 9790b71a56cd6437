"""Incremental runs: only files that arrived since the last run are processed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shiftwright.catalog import Catalog
from shiftwright.plans.migrate import Run, migrate
from shiftwright.session import cut
from shiftwright.sources import commits


def stream_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet folder, or a single file, as a stream of rows.

    The last letter of the path is written as a pattern: a file source takes a
    single file only through a pattern, and a folder either way.
    """
    path = path.rstrip("/")
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def process_new(
    stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Run ``step`` on everything new and write its rows to ``out``, then stop.

    Each micro-batch owns the folder ``batch=<id>`` and replaces it when it is
    repeated after a failure, so a lost executor or driver leaves no duplicates.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def process_together(
    stream: DataFrame, tables: Callable[[DataFrame], dict], root: str, checkpoint: str
) -> StreamingQuery:
    """Make several tables of everything new, commit those of a micro-batch together, then stop.

    ``tables`` turns a micro-batch into tables by name. The record of a micro-batch names all of them, so that readers
    see a batch whole or not at all, and a batch that is repeated after a failure replaces what it committed before.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        # Written once, so that the tables come from the same rows and the source is read once.
        spark = batch.sparkSession
        commits.commit(spark, root, f"batch={batch_id:012}", tables(cut(batch, "batch")))

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def migrate_new(
    stream: DataFrame, catalog: Catalog, run: Run, root: str, checkpoint: str, model=None,
    external: DataFrame | None = None, tests: DataFrame | None = None,
) -> StreamingQuery:
    """A whole run, from scan to report, over the files of each micro-batch.

    Committed are results, records, texts and tickets; summaries and totals follow from all committed results, with
    operators.report. A file that comes again in a later batch has a row in each.
    """
    def tables(batch: DataFrame) -> dict:
        made = migrate(batch, catalog, run, model, external, tests)
        return {name: made[name] for name in ("results", "records", "texts", "tickets")}

    return process_together(stream, tables, root, checkpoint)


def written(spark: SparkSession, out: str, schema) -> DataFrame:
    """Rows of all batches, with their ``batch``."""
    from pyspark.sql.types import LongType, StructField, StructType

    fields = [f for f in schema.fields if f.name != "batch"]
    full = StructType([*fields, StructField("batch", LongType())])
    return spark.read.schema(full).option("basePath", out).parquet(out)


def latest_rows(batches: DataFrame, keys: list) -> DataFrame:
    """Per key the row of the last batch that updated it."""
    rest = [c for c in batches.columns if c not in (*keys, "batch")]
    return batches.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")
