r"""Removal of lines that many documents share.

Lines are exploded, normalised and hashed; a count of distinct documents per hash finds the shared ones; the decisions
come back to the documents by line position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftwright.llm.common import SPACE, lower_ascii, passed, with_row_key
from shiftwright.session import cut


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashes(text: Column, min_chars: int) -> Column:
    """For every line two 64-bit hashes of its key, or null for a short key."""
    def of(line: Column) -> Column:
        key = F.btrim(line, F.lit(SPACE))
        return F.when(
            F.length(key) >= min_chars,
            F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")),
        )

    return F.transform(_lines(lower_ascii(text)), of)


def shared_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(h1, h2, keeper): line keys in at least ``min_docs`` documents, and the largest id that holds each.

    Most keys occur once. Counting rows first needs no set per key; only keys with enough rows are then counted by
    distinct id, so that rows which repeat an id count once.
    """
    held = docs.select(
        F.col("doc_id"),
        F.explode(F.array_distinct(F.filter(_hashes(F.col("text"), min_chars), lambda h: h.isNotNull()))).alias("h"),
    ).select("doc_id", "h.h1", "h.h2")
    counted = held.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    return (
        counted.groupBy("h1", "h2")
        .agg(F.count("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
    )


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, prefix: str = "") -> DataFrame:
    r"""``docs`` with the columns n_lines, n_dropped and kept_text, after the prefix.

    A line's key is the line, stripped of ``[\x20\x09-\x0D]`` and with A-Z in lower case. Keys of ``min_chars`` code
    points or more that ``min_docs`` documents or more hold lose their lines, but in the largest doc_id that holds
    them (all its lines with that key stay).

    Null or empty text: one empty line, kept. Rows that repeat a doc_id count as one document. A null doc_id counts as
    no document and is never the keeper, so its shared lines go. Equal rows get equal results. An empty table gives an
    empty table. Other columns pass through; one with the name of a result is replaced.
    """
    keyed = with_row_key(docs.select("doc_id", "text"))
    shared = cut(shared_lines(docs, min_chars, min_docs).select("h1", "h2", "keeper"), "shared-lines")
    placed = keyed.select(
        "_k1", "_k2", "doc_id", F.posexplode(_hashes(F.col("text"), min_chars)).alias("pos", "h")
    ).where(F.col("h").isNotNull())
    dropped = (
        placed.select("_k1", "_k2", "doc_id", "pos", "h.h1", "h.h2")
        .join(shared, ["h1", "h2"])
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .select("_k1", "_k2", "pos")
    )
    # Positions may repeat when equal rows repeat; a set per document has at most as many members as it has lines.
    marks = dropped.groupBy("_k1", "_k2").agg(F.array_sort(F.collect_set("pos")).alias("_gone"))
    joined = with_row_key(docs).join(marks, ["_k1", "_k2"], "left")
    # Walk lines between the dropped positions: each run of kept lines is one slice, so the work is linear.
    lines = F.col("_lines")
    edges = F.concat(F.array(F.lit(-1)), F.col("_gone"), F.array(F.size(lines)))
    runs = F.transform(
        F.sequence(F.lit(1), F.size(edges) - 1),
        lambda i: F.slice(
            lines,
            F.element_at(edges, i) + 2,
            F.element_at(edges, i + 1) - F.element_at(edges, i) - 1,
        ),
    )
    out = joined.withColumn("_lines", _lines(F.col("text")))
    return out.select(
        *passed(docs, *(prefix + c for c in ("n_lines", "n_dropped", "kept_text"))),
        F.size(lines).cast("long").alias(prefix + "n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias(prefix + "n_dropped"),
        F.when(F.col("_gone").isNull(), F.coalesce(F.col("text"), F.lit("")))
        .otherwise(F.array_join(F.flatten(runs), "\n"))
        .alias(prefix + "kept_text"),
    )
