"""Documents packed into token sequences of a fixed length, with a fixed number of open windows per partition.

Each task streams its documents and holds ``open_windows`` windows. A document goes into the open window that it fills
best. Where none has room for it, the fullest one gets as much of it as it holds and is emitted, and the rest goes on;
so a window is always emitted full. What is left open when a partition ends is merged in rounds: the open windows of
``fan_in`` partitions meet in one group, whose pieces are packed in the same way, until a single group is left. The
bound on what a group holds is ``fan_in * open_windows`` windows, whatever the input. The last tokens become sequences
whose lengths are powers of two, which need no padding.

Every round is written to the shared folder: emitted and open pieces come from one run of a task, and no piece can be
lost or doubled when a task is repeated.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shiftwright.llm.bpe import byte_symbols
from shiftwright.session import cut

CAPACITY, OPEN_WINDOWS, FAN_IN = 2048, 16, 32
# Pieces that a task holds before it passes them on.
HELD_PIECES = 512
# Fixed value: how byte-level vocabulary files cut a text.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Texts of old and stable characters without very long runs, on which all readers of the pattern agree.
_PLAIN = re.compile(
    "(?:[\x21-\x7e\xa1-ɏ‐-‧€]{1,400}+(?:[\t-\r \xa0]{1,100}+|\\Z)|[\t-\r \xa0]{1,100}+(?![\t-\r \xa0]))*+"
)


class Encoder:
    """Ids of texts by the tokenizers library; by a faster one of the same merges where both surely agree."""

    def __init__(self, vocabulary: str):
        self.library = Tokenizer.from_str(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        self.fast = self._fast(json.loads(vocabulary))

    @staticmethod
    def _fast(data: dict) -> tiktoken.Encoding | None:
        """None unless the vocabulary is a plain byte-level one whose merges are in the order of their ids."""
        model, cutter = data["model"], data.get("pre_tokenizer") or {}
        added = data.get("added_tokens") or []
        plain = (
            model.get("type", "BPE") == "BPE" and not data.get("normalizer") and cutter.get("type") == "ByteLevel"
            and not cutter.get("add_prefix_space") and cutter.get("use_regex", True)
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            and not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        )
        merges = [m if isinstance(m, str) else " ".join(m) for m in model.get("merges", ())]
        ids = [model["vocab"].get(m.replace(" ", ""), -1) for m in merges]
        if not plain or ids != sorted(set(ids)):
            return None
        byte = {s: b for b, s in enumerate(byte_symbols())}
        special = {t["content"]: t["id"] for t in added}
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        return tiktoken.Encoding("file", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if self.fast and _PLAIN.fullmatch(text):
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")


class Piece:
    """Ids of a document from ``start`` on."""

    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start: int, ids: np.ndarray, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def split(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[:at], self.total), Piece(self.doc, self.start + at, self.ids[at:], self.total)


class Windows:
    """A bounded number of open windows. ``add`` returns the windows that a piece fills up."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.open: list[list[Piece]] = []
        self.room: list[int] = []

    def add(self, piece: Piece) -> list[list[Piece]]:
        full = []
        while (size := len(piece.ids)) >= self.capacity:
            head, piece = piece.split(self.capacity)
            full.append([head])
        while size := len(piece.ids):
            fits = [r for r in self.room if r >= size]
            if not fits and len(self.open) < self.limit:
                self.open.append([piece])
                self.room.append(self.capacity - size)
                break
            # The best fit; else the fullest, which takes what it has room for.
            at = self.room.index(min(fits or self.room))
            head, piece = piece.split(min(size, self.room[at]))
            self.open[at].append(head)
            self.room[at] -= len(head.ids)
            if not self.room[at]:
                full.append(self.open.pop(at))
                self.room.pop(at)
        return full


def last_windows(pieces: list[Piece], capacity: int) -> list[list[Piece]]:
    """The last pieces as full windows, and below them one for each power of two in what remains."""
    total = sum(len(p.ids) for p in pieces)
    rest = total % capacity
    sizes = [capacity] * (total // capacity) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
    out, rest_of = [], sorted(pieces, key=lambda p: -len(p.ids))[::-1]
    for size in sizes:
        window = []
        while size:
            head, tail = rest_of.pop().split(size)
            window.append(head)
            size -= len(head.ids)
            if len(tail.ids):
                rest_of.append(tail)
        out.append(window)
    return out


def _schema(doc: pa.DataType) -> pa.Schema:
    return pa.schema([
        ("doc_id", doc), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32())), ("part", pa.int64()),
    ])


class Writer:
    """Rows of pieces. Emitted windows get a sequence_id of the round, the part and their number; open ones have none."""

    def __init__(self, schema: pa.Schema, step: int, part: int, with_ids: bool):
        self.schema, self.part, self.with_ids = schema, part, with_ids
        self.next, self.rows = step << 56 | part << 28, []

    def window(self, pieces: list[Piece], is_open: bool = False) -> None:
        at = 0
        for p in pieces:
            raw = np.ascontiguousarray(p.ids, "<u4")
            ids = raw.view("<i4") if is_open or self.with_ids else None
            place = (None, None) if is_open else (self.next, at)
            self.rows.append((p.doc, p.start, len(raw), zlib.crc32(raw), p.total, *place, ids, self.part))
            at += len(raw)
        self.next += not is_open

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(self.schema)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)


def pack(
    docs: DataFrame, path: str, capacity: int = CAPACITY, open_windows: int = OPEN_WINDOWS, end_id: int = 1,
    with_ids: bool = True, fan_in: int = FAN_IN,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): one row per piece of a document.

    A document is the ids of its text by the vocabulary file ``path``, which the driver reads, and then ``end_id``; a null or empty text has
    that one alone. Documents are cut at will: a piece holds ``length`` ids from ``start`` on and lies at ``offset`` of
    its sequence, without gaps. Sequences hold ``capacity`` ids, but for the last few, whose lengths are powers of two.
    Rows that repeat an id or a text, and null ids, are documents of their own. Other columns of ``docs`` play no part.
    An empty table gives an empty result. Sequences depend on how the input is partitioned; ids and totals do not.
    """
    spark = docs.sparkSession
    if capacity < 1 or open_windows < 1 or fan_in < 2:
        raise ValueError("capacity and open_windows must be 1 at least, fan_in 2")
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    types = (
        f"doc_id {doc_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
        "ids array<int>, part long"
    )

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, windows, writer = Encoder(vocabulary.value), Windows(capacity, open_windows), None
        for batch in batches:
            writer = writer or Writer(_schema(batch.schema.field("doc_id").type), 0, TaskContext.get().partitionId(), with_ids)
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.append(encode(text.as_py()), np.array([end_id], "<u4"))
                for full in windows.add(Piece(doc.as_py(), 0, ids, len(ids))):
                    writer.window(full)
                if len(writer.rows) >= HELD_PIECES:
                    yield writer.batch()
        if writer:
            for pieces in windows.open:
                writer.window(pieces, is_open=True)
            yield writer.batch()

    def merge(step: int, last: bool):
        def one(key: tuple, table: pa.Table) -> pa.Table:
            writer, windows = Writer(table.schema, step, key[0].as_py(), with_ids), Windows(capacity, open_windows)
            left = [
                Piece(doc.as_py(), start.as_py(), ids.values.to_numpy(zero_copy_only=False).astype("<u4"), total.as_py())
                for doc, start, ids, total in zip(*(table[c] for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True)
            ]
            left.sort(key=lambda p: (-len(p.ids), str(p.doc), p.start))
            full = [w for piece in left for w in windows.add(piece)]
            for window in full + (last_windows([p for w in windows.open for p in w], capacity) if last else []):
                writer.window(window)
            for window in [] if last else windows.open:
                writer.window(window, is_open=True)
            return pa.Table.from_batches([writer.batch()])
        return one

    # A vocabulary file has a fixed size.
    with open(path, encoding="utf-8") as file:
        vocabulary = spark.sparkContext.broadcast(file.read())
    found = cut(docs.select("doc_id", "text").mapInArrow(first, types), "packed")
    closed = [found]
    parts, step = found.agg(F.max("part")).first()[0], 0
    while parts is not None:
        step, last = step + 1, parts < fan_in
        left = closed[-1].where("sequence_id IS NULL").withColumn("part", F.floor(F.col("part") / fan_in).cast("long"))
        closed.append(cut(left.groupBy("part").applyInArrow(merge(step, last), types), "packed"))
        parts = None if last else parts // fan_in
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    out = out.where("sequence_id IS NOT NULL").drop("part")
    return out if with_ids else out.drop("ids")
