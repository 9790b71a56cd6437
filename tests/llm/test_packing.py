import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shiftwright.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


@pytest.fixture(scope="module")
def encode():
    with open(PATH, encoding="utf-8") as file:
        return packing.Encoder(file.read())


def test_ids_equal_the_library(library, encode):
    rng = random.Random(5)
    parts = ["it's", " we'll", "  ", "\n\n", "\t", "é", "ß", "Ω", "中文", "…", "“", "1234", "½", "\xa0", "\x85", "\x1c", "€",
             "<|endoftext|>", "<|endof", "a" * 500, " " * 300, " ", "🙂", "naïve", "Ƿ", "é", "\x00", "?!", "x", " "]
    assert encode.fast
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_old_characters_go_either_way(library, encode):
    chars = [chr(c) for c in [*range(9, 14), *range(0x20, 0x7F), *range(0xA0, 0x250), *range(0x2010, 0x2028), 0x20AC]]
    rng = random.Random(7)
    for _ in range(2000):
        text = "".join(rng.choice(chars) for _ in range(40))
        assert encode.fast.encode(text, allowed_special="all") == library.encode(text, add_special_tokens=False).ids


def test_long_runs_leave_the_fast_way(encode):
    assert packing._PLAIN.fullmatch("a word, and\n another  ")
    assert not packing._PLAIN.fullmatch("a" * 401)
    assert not packing._PLAIN.fullmatch("a" + " " * 1000 + "b")
    assert len(encode("ab" * 200_000)) > 0


def check(rows, wanted, capacity):
    """Every id of every document once, without gaps; returns the lengths of the sequences."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(docs) == set(wanted)
    for doc, pieces in docs.items():
        pieces.sort(key=lambda r: r.start)
        at = 0
        for r in pieces:
            assert r.start == at and r.length > 0 and r.doc_tokens == len(wanted[doc])
            ids = np.array(wanted[doc][at : at + r.length], "<u4")
            assert r.ids_crc32 == zlib.crc32(ids.tobytes())
            at += r.length
        assert at == len(wanted[doc])
    lengths = []
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity and (at == capacity or at & (at - 1) == 0)
        lengths.append(at)
    return lengths


def test_whole_table(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    wanted = {k: library.encode(t or "", add_special_tokens=False).ids + [1] for k, t in texts.items()}
    rows = queries.op11_packing(spark, SMALL).collect()
    lengths = check(rows, wanted, 2048)
    assert sum(n < 2048 for n in lengths) <= 11


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_many_partitions_merge_in_rounds(spark, library, parts):
    texts = {k: f"text {k} " * (k % 60 + 1) for k in range(400)} | {400: None, 401: "", 402: "long " * 5000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(parts)
    wanted = {k: library.encode(t or "", add_special_tokens=False).ids + [1] for k, t in texts.items()}
    out = packing.pack(docs, PATH, capacity=64, open_windows=3, fan_in=4)
    rows = out.collect()
    lengths = check(rows, wanted, 64)
    assert sum(n < 64 for n in lengths) <= 6
    assert all(r.ids == wanted[r.doc_id][r.start : r.start + r.length] for r in rows)


def test_bounded_windows_take_the_best_fit():
    def piece(n):
        return packing.Piece("d", 0, np.zeros(n, "<u4"), n)

    windows = packing.Windows(10, 2)
    assert windows.add(piece(6)) == [] and windows.add(piece(7)) == []
    assert windows.add(piece(2)) == [] and windows.room == [4, 1]
    full = windows.add(piece(5))  # none has room: the fullest gets one id, the rest fits the other
    assert [sum(len(p.ids) for p in w) for w in full] == [10, 10]
    assert windows.open == []
    assert [[len(p.ids) for p in w] for w in windows.add(piece(25))] == [[10], [10]] and windows.room == [5]


def test_edges(spark):
    schema = "doc_id long, text string, sequence_id string, ids int, part int, offset int"
    empty = packing.pack(spark.createDataFrame([], schema), PATH)
    assert empty.collect() == []
    rows = [(None, None, "s", 1, 2, 3), (None, "", "s", 1, 2, 3), (2**62 + 1, "a", "s", 1, 2, 3), (2**62 + 1, "a", None, 1, 2, 3)]
    found = packing.pack(spark.createDataFrame(rows, schema), PATH, with_ids=False).collect()
    assert sorted((r.doc_id or 0, r.start, r.doc_tokens) for r in found if r.start == 0) == [
        (0, 0, 1), (0, 0, 1), (2**62 + 1, 0, 2), (2**62 + 1, 0, 2)]
    assert sum(r.length for r in found) == 6 and len({(r.sequence_id, r.offset) for r in found}) == len(found)
