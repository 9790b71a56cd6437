import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shiftwright.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
CODER = bpe.Coder(bpe.Vocabulary.load(PATH))
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()


def same(text):
    ids = CODER.encode(text)
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids
    assert CODER.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", [
    "", " ", "\n\t", "Hello, World! It's 2024; they'll've", "<|endoftext|>", "a<|startoftext|>b<|endoftext|>c",
    "ΣΊΣΥΦΟΣ ΟΔΟΣ", "İstanbul", "été", "日本語テキスト", "👩‍👩‍👧 ok", "a b c\x85d\x1ce", "x" * 5000,
    "ab" * 3000, "!?" * 2000, "³½Ⅷ٣", "\u0000\u0001", "'S 'T 'RE", "it's'd", "<|endoftext", "ǅ ǆ Ǆ", "﻿bom",
])
def test_like_the_library(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_like_the_library(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="thein ro'sdlv19!?é", max_size=80))
def test_common_letters_like_the_library(text):
    same(text)


def test_cuts_change_nothing():
    for word in ("strawberries", "qzxjkq", "naïveté", "thththeioning", "a" * 40):
        symbols = [CODER.byte[b] for b in word.encode()]
        symbols[-1] += bpe.WORD_END
        whole = bpe.merge(symbols, CODER.vocabulary.ranks)
        parts = [t for part in CODER.fragments_of(symbols) for t in bpe.merge(part, CODER.vocabulary.ranks)]
        assert whole == parts


def test_table(spark):
    rows = [(1, "Hello world", "x"), (2, None, "y"), (2, "", None), (None, "Hello world", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids_note string")
    out = bpe.digests(bpe.encode_decode(docs, PATH), "doc_id", "ids_note").collect()
    assert len(out) == 4
    assert [r.n_tokens for r in out] == [2, 0, 0, 2]
    assert out[0].ids_sha256 == out[3].ids_sha256
    assert bpe.encode_decode(docs.limit(0), PATH).count() == 0
