"""Tables that appear together or not at all: staged folders, and a record that names them.

Tables are written to a folder of their own first. One record then commits the folder under a key; readers go by the
records and never list the data. Work that breaks off leaves a folder that nobody reads, and work that is repeated
commits its key again: the last record of a key counts. A record is one small file, which Spark's writer puts in place
by a rename.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RECORD = "key string, at long, folder string, tables array<string>"


def commit(spark: SparkSession, root: str, key: str, tables: dict) -> None:
    """Write the tables of a key, and then the record that makes them visible in place of earlier ones."""
    folder = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/data/{folder}/{name}")
    record = spark.createDataFrame([(key, time.time_ns(), folder, sorted(tables))], RECORD)
    # A folder for each record, so that writers do not meet.
    record.coalesce(1).write.json(f"{root}/commits/{folder}")


def commits(spark: SparkSession, root: str) -> DataFrame:
    """(key, at, folder, tables): the last record of every key; none if nothing was ever committed."""
    try:
        records = spark.read.schema(RECORD).option("recursiveFileLookup", True).json(f"{root}/commits")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RECORD)
    return records.groupBy("key").agg(F.max_by(F.struct("at", "folder", "tables"), F.struct("at", "folder")).alias("r")).select(
        "key", "r.*")


def committed(spark: SparkSession, root: str, table: str, schema: StructType | str) -> DataFrame:
    """All rows of a table under the last record of every key. One small row per key comes to the driver."""
    found = commits(spark, root).where(F.array_contains("tables", table)).orderBy("key").collect()
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/data/{r.folder}/{table}" for r in found])
