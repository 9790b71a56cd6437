"""Language identification: known words first, then ever shorter character n-grams.

A word the model knows scores its log frequency in each language. A word it does not know is cut into character
n-grams, with its ends marked: the longest length of which the model knows at least one n-gram scores the word by the
mean over its known n-grams, so only words without any known letter say nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shiftwright.llm.common import passed

# Documents of each language the model is fitted on, about: rows are chosen by a hash of their id.
DOCS_PER_LANG = 2_000
# Languages the model learns: the most frequent ones. Their counts are sent to every task.
MAX_LANGS = 1_000
# What the model keeps: about so many words, and n-grams of each length. Every language has an equal part of them for
# the most frequent ones of its own, and at least MIN_ITEMS.
MAX_WORDS, MAX_GRAMS, MAX_LENGTH, MIN_ITEMS = 60_000, 15_000, 4, 50
CACHE_WORDS = 300_000
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")
# Numbers that the pattern takes for letters, such as fractions and Roman numerals.
_NUMBERS = frozenset(c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) in ("No", "Nl"))
_NO_NUMBERS = dict.fromkeys(map(ord, _NUMBERS), " ")


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case."""
    text = text.lower()
    if not text.isascii() and not _NUMBERS.isdisjoint(text):
        text = text.translate(_NO_NUMBERS)
    return _WORD.findall(text)


def grams_of(word: str, length: int) -> list[str]:
    """Character n-grams of the word with its ends marked; single letters carry no marks."""
    marked = word if length == 1 else f"<{word}>"
    return [marked[i : i + length] for i in range(len(marked) - length + 1)]


@dataclass
class Model:
    """Log frequencies per language of words, and of n-grams by their length."""

    langs: list[str]
    words: dict[str, np.ndarray]
    grams: dict[str, np.ndarray]
    _row: dict[str, int] = field(default_factory=dict)
    _scores: np.ndarray | None = None

    def word_scores(self, word: str) -> np.ndarray:
        found = self.words.get(word)
        if found is not None:
            return found
        for length in range(MAX_LENGTH, 0, -1):
            known = [g for g in map(self.grams.get, grams_of(word, length)) if g is not None]
            if known:
                return np.mean(known, axis=0)
        return np.zeros(len(self.langs), np.float32)

    def _place(self, word: str) -> int:
        """The row of the word's scores; words seen before are not scored again, up to ``CACHE_WORDS`` of them."""
        at = self._row.get(word)
        if at is None:
            if self._scores is None or len(self._row) >= CACHE_WORDS:
                self._row.clear()
                self._scores = np.zeros((1024, len(self.langs)), np.float32)
            at = self._row[word] = len(self._row)
            if at >= len(self._scores):
                self._scores = np.concatenate([self._scores, np.zeros_like(self._scores)])
            self._scores[at] = self.word_scores(word)
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its share of the likelihood; ties go to the first in alphabetical order."""
        words = words_of(text) if text is not None else []
        if not words or not self.langs:
            return UNKNOWN, 0.0
        total = np.zeros(len(self.langs), np.float64)
        for i in range(0, len(words), 10_000):
            part = words[i : i + 10_000]
            if len(self._row) + len(part) >= CACHE_WORDS:
                self._row.clear()
            known = self._row
            places = [known[w] if w in known else self._place(w) for w in part]
            total += self._scores[places].sum(axis=0, dtype=np.float64)
        share = np.exp(total - total.max())
        share /= share.sum()
        best = int(share.argmax())
        return self.langs[best], float(share[best])


def training_rows(docs: DataFrame, docs_per_lang: int) -> DataFrame:
    """About ``docs_per_lang`` documents of every language, chosen by a hash of their id without exchanging texts."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_of"))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) / F.lit(1 << 20)
    return rows.select("lang", "text", place.alias("_place")).join(
        F.broadcast(sizes.orderBy(F.desc("_of"), "lang").limit(MAX_LANGS)), "lang"
    ).where(
        F.col("_place") * F.col("_of") < docs_per_lang
    ).select("lang", "text")


def fit(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> Model:
    """A model from (doc_id, text, lang); rows with a null in any of them say nothing. No rows give an empty model."""
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
                for word, n in Counter(words_of(text.as_py())).items():
                    found[lang, word] += n
        yield counted(found)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for lang, word, n in zip(*(batch[c].to_pylist() for c in ("lang", "item", "n")), strict=True):
                for length in range(1, MAX_LENGTH + 1):
                    for gram in grams_of(word, length):
                        found[lang, gram] += n
            yield counted(found)

    def counted(found: Counter) -> pa.RecordBatch:
        lang, item = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(item, pa.string()), pa.array(list(found.values()), pa.int64())],
            ["lang", "item", "n"],
        )

    def most_frequent(rows: DataFrame, most: int) -> list:
        """Items that are among the ``most`` of a language, of their length, with their counts in all."""
        each = max(MIN_ITEMS, most // max(1, rows.select("lang").distinct().count()))
        order = W.partitionBy("lang", "length").orderBy(F.desc("n"), "item")
        return (
            rows.withColumn("rank", F.row_number().over(order)).groupBy("item")
            .agg(F.sum("n").alias("n"), F.min("rank").alias("rank"), F.collect_list(F.struct("lang", "n")).alias("by_lang"))
            .where(F.col("rank") <= each).orderBy(F.desc("n"), "item").collect()
        )

    def total(rows: DataFrame) -> DataFrame:
        return rows.groupBy("item", "lang").agg(F.sum("n").alias("n")).select("lang", "item", "n")

    kind = "lang string, item string, n long"
    by_word = total(training_rows(docs, docs_per_lang).mapInArrow(words, kind)).persist()
    word_rows = most_frequent(by_word.withColumn("length", F.lit(0)), MAX_WORDS)
    gram_rows = most_frequent(total(by_word.mapInArrow(grams, kind)).withColumn("length", F.length("item")), MAX_GRAMS)
    by_word.unpersist()
    langs = sorted({x["lang"] for row in gram_rows for x in row["by_lang"]})

    def logs(rows: list) -> dict[str, np.ndarray]:
        if not rows:
            return {}
        at = {lang: i for i, lang in enumerate(langs)}
        table = np.zeros((len(rows), len(langs)))
        for i, row in enumerate(rows):
            for x in row["by_lang"]:
                table[i, at[x["lang"]]] = x["n"]
        # What a language lacks costs the same in each, however little of it was seen.
        total = np.maximum(table.sum(axis=0), 1)
        table = np.log(np.where(table > 0, table / total, 0.5 / total.max())).astype(np.float32)
        return {row["item"]: table[i] for i, row in enumerate(rows)}

    by_length = {}
    for length in range(1, MAX_LENGTH + 1):
        by_length |= logs([row for row in gram_rows if len(row["item"]) == length])
    return Model(langs, logs(word_rows), by_length)


def predictor(docs: DataFrame, model: Model):
    """A function from a text column to a column of (lang, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for texts in batches:
            yield pd.DataFrame([known.predict(t) for t in texts], columns=["lang", "score"])

    return predict


def identify(docs: DataFrame, training: DataFrame, prefix: str = "", **options) -> DataFrame:
    """``docs`` with the columns lang_pred and score, after the prefix, from a model of ``training`` (doc_id, text, lang).

    ``und`` with score 0 for a null text, a text without letters, or a model without languages. A text of which
    nothing is known gets the first language with an even share. Equal texts get equal results. Other columns pass
    through; one with the name of a result is replaced.
    """
    predict = predictor(docs, fit(training, **options))
    out = docs.withColumn("_p", predict(F.col("text")))
    lang, score = prefix + "lang_pred", prefix + "score"
    return out.select(*passed(docs, lang, score), F.col("_p.lang").alias(lang), F.col("_p.score").alias(score))
