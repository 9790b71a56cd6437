"""What the corpus operators share: reading tables, words as the contracts define them, hashes, row keys."""

from __future__ import annotations

import string

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space of the contracts: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
# Rows of one Arrow batch. Texts may be long, so batches are kept well below Spark's default of 10,000 rows.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def passed(rows: DataFrame, *results: str) -> list[Column]:
    """The columns that pass through: all but those whose names results take."""
    return [F.col(f"`{c}`") for c in rows.columns if c not in results]


def small_batches(spark: SparkSession) -> None:
    """Let Python workers get few rows at a time, so that a batch of long texts fits in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def crc_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def with_row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add ``_k1`` and ``_k2``, never null, which tell rows of different (id, text) apart.

    Rows that agree in both get the same key; what is computed from id and text alone may be joined back by it.
    """
    return docs.withColumn("_k1", F.coalesce(F.col(id_col).cast("long"), F.lit(-1))).withColumn(
        "_k2", F.xxhash64(F.lit(17), F.col(id_col).cast("string"), F.col(text_col))
    )


def words_of(text: str | None) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+`` of the text with A-Z in lower case, as UTF-8."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def hash_words(words: list[bytes]) -> np.ndarray:
    """A keyed 64-bit hash (SipHash) of every word."""
    if not words:
        return np.zeros(0, np.uint64)
    column = np.empty(len(words), dtype=object)
    column[:] = words
    return pd.util.hash_array(column, categorize=False)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, from the hashes of the words; of fewer words, none."""
    count = len(hashes) - size + 1
    if count < 1:
        return np.zeros(0, np.uint64)
    out = np.full(count, size, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + count])
    return out


# 2 MB. While a tenth of it is filled, a tenth of other values pass as well.
BITMAP_BITS = 1 << 24


def hash_bitmap(rows: DataFrame, column: str) -> np.ndarray:
    """The bits that hashes in a long column set, as bytes: a filter of fixed size that may be sent to every task.

    It passes every value of the column, and others whose bits are set by chance; a join must follow.
    """
    bit = F.pmod(F.col(column), F.lit(BITMAP_BITS)) + 1  # buckets and positions count from 1
    blocks = (
        rows.select(F.bitmap_bucket_number(bit).alias("block"), F.bitmap_bit_position(bit).alias("at"))
        .groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits"))
    ).collect()
    found = np.zeros(BITMAP_BITS // 8, np.uint8)
    for row in blocks:
        at = (row["block"] - 1) * 4096
        found[at : at + 4096] |= np.frombuffer(bytes(row["bits"]), np.uint8)
    return found


def marked(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places of the 64-bit hashes whose bits are set."""
    at = hashes.view(np.int64) % np.int64(BITMAP_BITS)
    return np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)
