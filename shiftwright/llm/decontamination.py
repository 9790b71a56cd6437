r"""Benchmark decontamination: a prefix-filtered set join of document and item shingles.

An item-sized window occurs in a document only if all its shingles do, so one shingle of each window, the rarest in
the corpus, is its necessary prefix. Corpus counts of the items' shingles come from all documents. Documents then emit
only positions of prefix shingles, with the words around them; the join on the shingle applies the bounds of position
and length, and compares the words of the whole window.

What is sent to every task is a bitmap of fixed size (``common.BITMAP_BITS``) of the wanted shingles' hashes, however many
items there are. A bit that is set by chance only costs a row in the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shiftwright.llm.common import hash_bitmap, hash_shingles, hash_words, marked, with_row_key
from shiftwright.session import cut

WINDOW_WORDS = 13
SHINGLE_WORDS = 3

# Bytes of words are 0-9, a-z and everything above ASCII; A-Z become a-z, all others become blanks.
_TO_WORDS = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)


def item_words(text: str | None) -> list[bytes]:
    r"""Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the text with A-Z in lower case."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


def _size(words: int, shingle_words: int) -> int:
    return min(words, shingle_words)


def benchmark_windows(benchmark: DataFrame, window_words: int, shingle_words: int) -> DataFrame:
    """(item_id, window, words, size, offset, shingle): every shingle of every window of every item.

    Items with null or no words have none. Windows that an item repeats come once.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("item_id", "window", "words", "size", "offset", "shingle")}
            for item, text in zip(batch["item_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words = item_words(text)
                width = min(window_words, len(words))
                if not width:
                    continue
                size = _size(width, shingle_words)
                hashed = hash_shingles(hash_words(words), size).view(np.int64).tolist()
                for at in {tuple(words[i : i + width]): i for i in range(len(words) - width + 1)}.values():
                    window = b" ".join(words[at : at + width]).decode("utf-8", "surrogatepass")
                    for offset in range(width - size + 1):
                        for k, v in zip(out, (item, window, width, size, offset, hashed[at + offset]), strict=True):
                            out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([
        ("item_id", pa.string()), ("window", pa.string()), ("words", pa.int32()), ("size", pa.int32()),
        ("offset", pa.int32()), ("shingle", pa.int64()),
    ])
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(
        rows, "item_id string, window string, words int, size int, offset int, shingle long"
    )


def corpus_counts(docs: DataFrame, bits, sizes: list[int]) -> DataFrame:
    """(shingle, n): how often the marked shingles occur in all documents, summed within tasks first."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch["text"]:
                hashed = hash_words(item_words(text.as_py()))
                for size in sizes:
                    shingles = hash_shingles(hashed, size)
                    found.append(shingles[marked(shingles, bits.value)])
            values, counts = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], ["shingle", "n"]
            )

    return docs.select("text").mapInArrow(rows, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def document_positions(docs: DataFrame, bits, widest: dict[int, int]) -> DataFrame:
    """One row per document: doc_id, n_words, and the marked positions with the words around each.

    ``widest`` has, for each length of shingles, the words of the longest window with such: no window reaches further.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, places = [], []
            for text in batch["text"]:
                words = item_words(text.as_py())
                hashed, found = hash_words(words), []
                for size, window in widest.items():
                    shingles = hash_shingles(hashed, size)
                    reach = window - size
                    for p in marked(shingles, bits.value).tolist():
                        first = max(0, p - reach)
                        around = b" ".join(words[first : p + size + reach]).decode("utf-8", "surrogatepass")
                        found.append((int(shingles[p].view(np.int64)), size, p, first, around))
                counts.append(len(words))
                places.append([dict(zip(("shingle", "size", "at", "first", "around"), x, strict=True)) for x in found])
            yield pa.RecordBatch.from_arrays(
                [batch["_k1"], batch["_k2"], batch["doc_id"], pa.array(counts, pa.int64()), pa.array(places, kind)],
                ["_k1", "_k2", "doc_id", "n_words", "places"],
            )

    kind = pa.list_(pa.struct([
        ("shingle", pa.int64()), ("size", pa.int32()), ("at", pa.int64()), ("first", pa.int64()), ("around", pa.string()),
    ]))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("_k1", "_k2", "doc_id", "text").mapInArrow(
        rows,
        f"_k1 long, _k2 long, doc_id {id_type}, n_words long, "
        "places array<struct<shingle: bigint, size: int, at: bigint, first: bigint, around: string>>",
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window_words: int = WINDOW_WORDS,
    shingle_words: int = SHINGLE_WORDS,
    share: int = 20,
) -> DataFrame:
    """One row per row of ``docs``: _k1, _k2, doc_id, n_words, n_hit, items (sorted ids), contaminated.

    A window is ``window_words`` consecutive words of an item; an item of fewer words, but not none, is one window. A
    document word inside any occurrence of any window is hit; a document is contaminated if it has hits and at least
    one word in ``share`` is hit.

    Null or wordless texts have no words and no hits. Rows that repeat an id keep results of their own text; equal
    rows get equal results. Null item ids take no part in ``items``, but their windows hit. An empty benchmark hits
    nothing; an empty documents table gives an empty result. Columns beyond doc_id, text and item_id are not read.
    """
    spark = docs.sparkSession
    keyed = with_row_key(docs.select("doc_id", "text"))
    windows = cut(benchmark_windows(benchmark, window_words, shingle_words), "windows")
    widest = dict(sorted(tuple(r) for r in windows.groupBy("size").agg(F.max("words")).collect()))
    sizes = list(widest)
    all_bits = spark.sparkContext.broadcast(hash_bitmap(windows, "shingle"))
    counts = corpus_counts(keyed, all_bits, sizes)
    # The rarest shingle of a window is its prefix; ties go to the smaller hash, then the earlier offset.
    rarity = F.struct(F.coalesce("n", F.lit(0)), F.col("shingle"), F.col("offset"))
    prefixes = cut(
        windows.join(counts, "shingle", "left")
        .groupBy("window", "words", "size").agg(F.min(rarity).alias("rarest"), F.collect_set("item_id").alias("items"))
        .select("window", "words", "size", "items", F.col("rarest.shingle").alias("shingle"), F.col("rarest.offset").alias("offset")),
        "prefixes",
    )
    bits = spark.sparkContext.broadcast(hash_bitmap(prefixes, "shingle"))
    found = cut(
        document_positions(keyed, bits, widest).withColumn("_row", F.monotonically_increasing_id()),
        "positions",
    )
    start = F.col("at") - F.col("offset")
    hits = (
        found.select("_row", "n_words", F.explode("places").alias("p")).select("_row", "n_words", "p.*")
        .join(prefixes, ["shingle", "size"])
        .where((start >= F.col("first")) & (start >= 0) & (start + F.col("words") <= F.col("n_words")))
        .where(F.array_join(
            F.slice(F.split("around", " "), (start - F.col("first") + 1).cast("int"), F.col("words")), " "
        ) == F.col("window"))
        .select("_row", start.alias("start"), (start + F.col("words")).alias("end"), "items")
    )
    before = W.partitionBy("_row").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end").over(before), F.lit(0))
    covered = (
        hits.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("start", reached)))
        .groupBy("_row").agg(F.sum("new").alias("n_hit"))
    )
    items = (
        hits.select("_row", F.explode("items").alias("item")).distinct()
        .groupBy("_row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    per_doc = covered.join(items, "_row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return (
        found.select("_row", "_k1", "_k2", "doc_id", "n_words").join(per_doc, "_row", "left")
        .select(
            "_k1", "_k2", "doc_id", "n_words", n_hit.alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
        )
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    bad = contamination(docs, benchmark, **options).where("contaminated").select("_k1", "_k2").distinct()
    return with_row_key(docs).join(bad, ["_k1", "_k2"], "left_anti").select(*docs.columns)


def digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ","), 256)
