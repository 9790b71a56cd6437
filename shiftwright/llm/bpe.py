"""Byte-pair encoding by forced boundaries, for vocabularies with word ends.

Two neighbouring symbols that no vocabulary token has side by side can never be merged, nor can a merge reach over
them: between them is a certain cut. A word is cut there first, its fragments are encoded on their own, and the ids are
put one after the other. Fragments are short and repeat across words, so most are encoded once per worker.

The vocabulary file is a parameter. It is read where the query is defined and sent to the tasks; its size is fixed.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftwright.llm.common import passed

# Letters and digits of newer Unicode versions than that by which the pattern is read.
NEWER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 "
    "10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 "
    "16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 "
    "1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED "
    "1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
_NEWER = "".join("-".join(f"\\U{int(c, 16):08x}" for c in part.split("-")) for part in NEWER.split())
# The pattern that cuts a text into words in the format of the vocabulary file; without letters that are
# newer, and for ASCII, simpler patterns do the same.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+"
NEWER_PATTERN = (
    rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{_NEWER}]]+|[\p{{N}}--[{_NEWER}]]"
    rf"|[[^\p{{White_Space}}\p{{L}}\p{{N}}]||[{_NEWER}]]+"
)
# Lower case of letters newer than Python's tables, as first capital, last capital, first small letter.
NEWER_LOWER = [
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B),
    (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
]
_NEWER_LOWER = {c: small + c - first for first, last, small in NEWER_LOWER for c in range(first, last + 1)}
_HAS_NEWER = regex.compile("[" + "".join(map(chr, _NEWER_LOWER)) + "]").search
WORD_END = "</w>"
CACHE_WORDS = 400_000
# Longer words are not kept, so that the bound on their number bounds their size.
CACHE_CHARS = 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in vocabulary files: itself, or the next one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, free = [], 0x100
    for b in range(256):
        out.append(chr(b if b in printable else free))
        free += b not in printable
    return out


def lower_each(text: str) -> str:
    """Lower case character by character: a sigma at a word's end stays an ordinary one."""
    if text.isascii():
        return text.lower()
    if _HAS_NEWER(text):
        text = text.translate(_NEWER_LOWER)
    return text.lower() if "Σ" not in text else "σ".join(part.lower() for part in text.split("Σ"))


@dataclass
class Vocabulary:
    """Tokens, merge ranks and special tokens of a vocabulary file, and the symbol pairs inside its tokens."""

    ids: dict[str, int]
    ranks: dict[tuple[str, str], int]
    special: dict[str, int]
    inside: set[tuple[str, str]] = field(default_factory=set)

    def __post_init__(self):
        for token in self.ids:
            symbols = self.symbols(token)
            self.inside.update(zip(symbols, symbols[1:], strict=False))

    @staticmethod
    def symbols(word: str) -> list[str]:
        """Symbols of a token or of a word that carries its end mark."""
        if word.endswith(WORD_END) and len(word) > len(WORD_END):
            body = word[: -len(WORD_END)]
            return [*body[:-1], body[-1] + WORD_END]
        return list(word)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        return cls(
            model["vocab"], {m: i for i, m in enumerate(merges)},
            {t["content"]: t["id"] for t in data.get("added_tokens") or [] if t.get("special")},
        )


_NONE = 1 << 60


def merge(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Apply merges, the lowest rank first and of equal ones the leftmost, until none applies."""
    if len(symbols) > 48:
        return _merge_long(symbols, ranks)
    parts, get = list(symbols), ranks.get
    costs = [get(pair, _NONE) for pair in zip(parts, parts[1:], strict=False)]
    while costs and (low := min(costs)) < _NONE:
        i = costs.index(low)
        parts[i] += parts.pop(i + 1)
        del costs[i]
        if i:
            costs[i - 1] = get((parts[i - 1], parts[i]), _NONE)
        if i < len(costs):
            costs[i] = get((parts[i], parts[i + 1]), _NONE)
    return parts


def _merge_long(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The same with a heap, for n log n steps."""
    after = [*range(1, len(symbols)), -1]
    before = list(range(-1, len(symbols) - 1))
    parts: list[str | None] = list(symbols)
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := ranks.get((a, b))) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j < 0 or parts[j] != b:
            continue
        parts[i], parts[j] = a + b, None
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
        for left, right in ((before[i], i), (i, k)):
            if left >= 0 and right >= 0 and (r := ranks.get((parts[left], parts[right]))) is not None:
                heapq.heappush(heap, (r, left, parts[left], parts[right]))
    return [p for p in parts if p is not None]


class Coder:
    """Encodes and decodes texts; what it has encoded before it keeps, within bounds."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.tokens = {i: t for t, i in vocabulary.ids.items()} | {i: t for t, i in vocabulary.special.items()}
        self.byte = byte_symbols()
        self.find_ascii = re.compile(ASCII_PATTERN).findall
        self.find = regex.compile(WORD_PATTERN).findall
        self.find_newer = regex.compile(NEWER_PATTERN).findall
        self.has_newer = regex.compile(f"[{_NEWER}]").search
        names = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.words: dict[str, tuple[int, ...]] = {}
        self.fragments: dict[tuple[str, ...], tuple[int, ...]] = {}

    def fragments_of(self, symbols: list[str]) -> Iterator[list[str]]:
        """The parts between certain cuts."""
        inside, start = self.vocabulary.inside, 0
        for i in range(1, len(symbols)):
            if (symbols[i - 1], symbols[i]) not in inside:
                yield symbols[start:i]
                start = i
        yield symbols[start:]

    def encode_word(self, word: str) -> tuple[int, ...]:
        found = self.words.get(word)
        if found is None:
            byte = self.byte
            symbols = [byte[b] for b in word.encode("utf-8", "surrogatepass")]
            symbols[-1] += WORD_END
            out: list[int] = []
            for part in self.fragments_of(symbols):
                key = tuple(part)
                ids = self.fragments.get(key)
                if ids is None:
                    ids = tuple(self.vocabulary.ids[t] for t in merge(part, self.vocabulary.ranks))
                    if len(key) <= CACHE_CHARS:
                        if len(self.fragments) >= CACHE_WORDS:
                            self.fragments.clear()
                        self.fragments[key] = ids
                out += ids
            found = tuple(out)
            if len(word) <= CACHE_CHARS:
                if len(self.words) >= CACHE_WORDS:
                    self.words.clear()
                self.words[word] = found
        return found

    def _encode_plain(self, text: str, out: list[int]) -> None:
        if text.isascii():
            words = self.find_ascii(text.lower())
        else:
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = lower_each(text)
            words = (self.find_newer if self.has_newer(text) else self.find)(text)
        known, encode = self.words, self.encode_word
        for word in words:
            out += known.get(word) or encode(word)

    def encode(self, text: str | None) -> list[int]:
        """Ids of the text; none for a null or blank one. Special tokens written in the text are their own ids."""
        out: list[int] = []
        if text is None:
            return out
        at = 0
        for match in self.special.finditer(text) if self.special else ():
            self._encode_plain(text[at : match.start()], out)
            out.append(self.vocabulary.special[match[0]])
            at = match.end()
        self._encode_plain(text[at:], out)
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens with blanks between them: the vocabulary file names no decoder."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])


def codec(spark: SparkSession, path: str):
    """A function from a text column to a column of (ids, decoded)."""
    shared = spark.sparkContext.broadcast(Vocabulary.load(path))

    @F.pandas_udf("ids array<int>, decoded string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = Coder(shared.value)
        for texts in batches:
            ids = [coder.encode(t) for t in texts]
            yield pd.DataFrame({"ids": ids, "decoded": [coder.decode(x) for x in ids]})

    return both


def encode_decode(docs: DataFrame, path: str, text: Column | None = None) -> DataFrame:
    """``docs`` with the columns ids (array<int>) and decoded (string).

    A null, empty or blank text has no ids and decodes to the empty text. Equal texts get equal results; other
    columns pass through, one with the name of a result is replaced. ``path`` is a file the driver can read.
    """
    both = codec(docs.sparkSession, path)
    out = docs.withColumn("_c", both(F.col("text") if text is None else text))
    return out.select(*passed(docs, "ids", "decoded"), F.col("_c.ids").alias("ids"), F.col("_c.decoded").alias("decoded"))


def digests(encoded: DataFrame, *columns: str) -> DataFrame:
    """The given columns, n_tokens, and the SHA-256 of the ids as text and of the decoded text."""
    return encoded.select(
        *columns, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
