"""Toxicity of documents: a learned lexicon, found in texts even when misspelled, and the context of each find.

Lexicon terms are kept in a trie. A word that is no term itself runs as a Levenshtein automaton over the trie: the
automaton's states for one more letter are computed while the trie is walked, and branches in which no state is left
are not entered. Each find is weighed by its context window: quoted or reported speech counts less, address counts
more. A logistic model turns the finds of a document into a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftwright.llm.common import hash_words, passed
from shiftwright.session import cut

# Labelled documents the model is fitted on, about, of each label; chosen by a hash of their id.
TOXIC_DOCS, CLEAN_DOCS = 4_000, 8_000
MAX_TERMS = 2_000
# A term's evidence (a likelihood ratio statistic) and how much more frequent it must be in toxic documents.
MIN_EVIDENCE, MIN_RATIO = 24.0, 6.0
EDITS = 1
FUZZY_FACTOR = 0.8
WINDOW_WORDS = 8
QUOTED_FACTOR, ADDRESS_FACTOR = 0.35, 1.15
CACHE_WORDS = 150_000

# Words that report speech, and words of address.
REPORTING = frozenset((
    "said says wrote writes called calls quote quoted quotes word term slur sagte schrieb nannte zitat wort "
    "dit écrit appelé cite mot dijo escribió llamó cita palabra"
).split())
ADDRESS = frozenset("you your you're youre ur du dich dein ihr euch tu toi ton vous votre usted tú eres vosotros".split())

_WORD = re.compile(r"[^\W_]+(?:[@$*][^\W_]+)*")
_QUOTE = re.compile(r"[\"“”«»„]")
_LEET = str.maketrans("013457@$", "oieastas")
_RUN = re.compile(r"(.)\1{2,}")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def build_trie(terms) -> dict:
    """Nested dictionaries by letter; the empty string holds the term that ends there."""
    root: dict = {}
    for term in terms:
        node = root
        for letter in term:
            node = node.setdefault(letter, {})
        node[""] = term
    return root


def automaton_matches(word: str, trie: dict, edits: int, swaps: bool = False) -> list[tuple[str, int]]:
    """Terms of the trie within so many edits of the word, and how many it takes; two swapped letters may be one edit.

    State sets are bit masks over positions of the word, one for each number of edits so far. Others hold the positions
    from which the second letter of a swap has been read.
    """
    masks: dict[str, int] = {}
    for i, letter in enumerate(word):
        masks[letter] = masks.get(letter, 0) | 1 << i
    full = 1 << len(word)
    start = [(1 << (e + 1)) - 1 for e in range(edits + 1)]
    found: list[tuple[str, int]] = []
    stack = [(trie, start, [0] * (edits + 1))]
    while stack:
        node, states, half = stack.pop()
        for letter, child in node.items():
            if letter == "":
                used = next((e for e, s in enumerate(states) if s & full), None)
                if used is not None:
                    found.append((child, used))
                continue
            mask = masks.get(letter, 0)
            after, begun = [], [0] * (edits + 1)
            for e, state in enumerate(states):
                now = (state & mask) << 1
                if e:
                    # An inserted, a replaced, and a left-out letter.
                    now |= states[e - 1] | states[e - 1] << 1 | after[e - 1] << 1
                    if swaps:
                        now |= (half[e] & mask) << 2
                        begun[e] = states[e - 1] & mask >> 1
                after.append(now & (2 * full - 1))
            if any(after) or any(begun):
                stack.append((child, after, begun))
    return sorted(found, key=lambda x: (x[1], x[0]))


@dataclass
class Lexicon:
    """Weighted terms, and forms near a term that are known from clean documents."""

    weights: dict[str, float]
    clean: frozenset[str] = frozenset()
    edits: int = EDITS
    _known: dict[str, tuple | None] = field(default_factory=dict)
    _trie: dict | None = None

    def _prepare(self) -> None:
        self._trie = build_trie(self.weights)
        # Halves by the length of their term, and terms whose two letters in the middle are swapped.
        self._heads, self._tails, self._swapped = {}, {}, set()
        for t in self.weights:
            at = len(t) // 2
            self._heads.setdefault(len(t), set()).add(t[:at])
            self._tails.setdefault(len(t), set()).add(t[at:])
            self._swapped.add(t[: max(0, at - 1)] + t[at : at + 1] + t[max(0, at - 1) : at] + t[at + 1 :])

    def _near(self, word: str) -> bool:
        """With one edit, a half of the term stands at its end of the word, unless the edit swaps letters of both."""
        if self.edits != 1 or word in self._swapped:
            return True
        size = len(word)
        for n in (size - 1, size, size + 1):
            if n in self._heads:
                if word[: n // 2] in self._heads[n] or word[max(0, size - (n - n // 2)) :] in self._tails[n]:
                    return True
        return False

    def look_up(self, word: str) -> tuple | None:
        """(term, edits, weight) of the best term for the word, or None."""
        if word in self._known:
            return self._known[word]
        if self._trie is None:
            self._prepare()
        if len(self._known) >= CACHE_WORDS:
            self._known.clear()
        found = None
        if word in self.weights:
            found = (word, 0, self.weights[word])
        elif word not in self.clean:
            plain = word if word.isalpha() else word.translate(_LEET)
            forms = dict.fromkeys((plain, _RUN.sub(r"\1", plain)))
            term = next((f for f in forms if f in self.weights), None)
            if term:
                found = (term, 1, FUZZY_FACTOR * self.weights[term])
            for form in forms:
                if found is None and form not in self.clean and self._near(form):
                    terms = automaton_matches(form, self._trie, self.edits, swaps=True)
                    if terms:
                        term, edits = max(terms, key=lambda t: (-t[1], self.weights[t[0]], t[0]))
                        found = (term, edits, FUZZY_FACTOR * self.weights[term])
        self._known[word] = found
        return found

    def hits(self, text: str | None) -> tuple[list[dict], int]:
        """Finds with their place, term, edits, whether quoted, and weight in context; and the number of words."""
        if not text:
            return [], 0
        out, count = [], 0
        known, look = self._known, self.look_up
        for line in text.split("\n"):
            words = words_of(line)
            held = [i for i, w in enumerate(words) if (known[w] if w in known else look(w)) is not None]
            if held:
                spans = [m.span() for m in _WORD.finditer(line.lower())]
                marks = [m.start() for m in _QUOTE.finditer(line)]
                for i in held:
                    term, edits, weight = look(words[i])
                    around = words[max(0, i - WINDOW_WORDS) : i] + words[i + 1 : i + 1 + WINDOW_WORDS]
                    opened = sum(m < spans[i][0] for m in marks)
                    quoted = opened % 2 == 1 and opened < len(marks) or not REPORTING.isdisjoint(around)
                    factor = QUOTED_FACTOR if quoted else ADDRESS_FACTOR if not ADDRESS.isdisjoint(around) else 1.0
                    out.append({
                        "at": count + i, "word": words[i], "term": term, "edits": edits, "quoted": quoted,
                        "weight": weight * factor,
                    })
            count += len(words)
        return out, count


def features(hits: list[dict], words: int) -> list[float]:
    """What the model sees of a document: sums, density, variety and the strongest window of its finds."""
    weights = np.array([h["weight"] for h in hits])
    places = np.array([h["at"] for h in hits])
    total = float(weights.sum()) if hits else 0.0
    strongest = 0.0
    if hits:
        sums = np.concatenate([[0.0], np.cumsum(weights)])
        strongest = float((sums[np.searchsorted(places, places + 2 * WINDOW_WORDS, "right")] - sums[:-1]).max())
    return [
        float(np.log1p(total)), float(np.log1p(100 * total / (words + 20))), float(bool(hits)),
        float(np.log1p(len({h["term"] for h in hits}))), float(np.log1p(strongest)),
        float(np.log1p(max(weights.max() if hits else 0, 0))),
    ]


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton's method; the first coefficient is the constant."""
    x = np.hstack([np.ones((len(x), 1)), x])
    beta = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (y - p)) - penalty @ beta
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + penalty, grad)
        beta += step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return beta


@dataclass
class Model:
    lexicon: Lexicon
    beta: np.ndarray

    def score(self, text: str | None) -> tuple[float, list[dict]]:
        hits, words = self.lexicon.hits(text)
        z = float(self.beta[0] + np.dot(self.beta[1:], features(hits, words)))
        return float(1 / (1 + np.exp(-min(max(z, -30), 30)))), hits


def training_sample(docs: DataFrame, labels: DataFrame, toxic_docs: int, clean_docs: int) -> tuple[DataFrame, dict]:
    """(toxic, text) of about so many labelled documents, and the share of each label's documents that it has.

    Only ids and labels are counted; the ids of the sample are as many as the parameters say, about, and are sent to
    the scan of the documents.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {k: min(1.0, most / max(1, sizes.get(k, 0))) for k, most in ((0, clean_docs), (1, toxic_docs))}
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) / F.lit(1 << 20)
    wanted = known.where(place < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    sample = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(
        F.broadcast(wanted.limit(2 * (toxic_docs + clean_docs))), "doc_id"
    )
    return cut(sample.select("toxic", "text"), "toxicity-sample"), share


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Terms by how much more toxic than clean documents have them. Near copies of a document count once."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, words = [], []
            for text in batch["text"]:
                own = sorted(set(words_of(text.as_py())))
                low = np.sort(hash_words([w.encode() for w in own]))[:3]
                keys.append(low.tobytes())
                words.append(own)
            yield pa.RecordBatch.from_arrays(
                [batch["toxic"].cast(pa.int32()), pa.array(keys, pa.binary()), pa.array(words, pa.list_(pa.string()))],
                ["toxic", "copy", "words"],
            )

    once = sample.mapInArrow(rows, "toxic int, copy binary, words array<string>").dropDuplicates(["toxic", "copy"])
    once = cut(once.select("toxic", "words"), "toxicity-words")
    sizes = {r["toxic"]: r["n"] for r in once.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic_all, clean_all = max(1, sizes.get(1, 0)), max(1, sizes.get(0, 0))
    t, c = F.col("t"), F.col("c")
    share = toxic_all / (toxic_all + clean_all)

    def part(count: Column, expected: float) -> Column:
        return F.when(count > 0, count * F.log(count / ((t + c) * F.lit(expected)))).otherwise(F.lit(0.0))

    ratio = ((t + 0.5) / (toxic_all + 1)) / ((c + 0.5) / (clean_all + 1))
    counted = cut(
        once.select("toxic", F.explode("words").alias("word"))
        .groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
        .withColumn("evidence", 2 * (part(t, share) + part(c, 1 - share))).withColumn("ratio", ratio),
        "toxicity-counts",
    )
    terms = counted.where((F.col("evidence") >= MIN_EVIDENCE) & (F.col("ratio") >= MIN_RATIO) & (F.length("word") >= 3))
    weights = {
        r["word"]: float(np.log(r["ratio"]))
        for r in terms.orderBy(F.desc("evidence"), "word").limit(MAX_TERMS).select("word", "ratio").collect()
    }
    lexicon = Lexicon(weights)

    def clean_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Lexicon(weights)
        for batch in batches:
            words = [w for w in batch["word"].to_pylist() if w not in weights and near.look_up(w) is not None]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], ["word"])

    if weights:
        seen = counted.where((c > 0) & (F.col("ratio") < MIN_RATIO)).select("word").mapInArrow(clean_forms, "word string")
        lexicon.clean = frozenset(r["word"] for r in seen.collect())
    return lexicon


def fit(docs: DataFrame, labels: DataFrame, toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, toxic).

    Labels other than 0 and 1, null ids and null texts say nothing; of labels that repeat an id the largest counts.
    Without labels the lexicon is empty and every score is one half.
    """
    sample, share = training_sample(docs, labels, toxic_docs, clean_docs)
    lexicon = learn_lexicon(sample)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(*lexicon.hits(t.as_py())) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [batch["toxic"].cast(pa.int32()), pa.array(found, pa.list_(pa.float64()))], ["toxic", "x"]
            )

    seen = sample.mapInArrow(rows, "toxic int, x array<double>").collect()
    y = np.array([r["toxic"] for r in seen], float)
    x = np.array([r["x"] for r in seen], float).reshape(len(seen), len(features([], 0)))
    weight = np.where(y == 1, 1 / share[1], 1 / share[0])
    return Model(lexicon, fit_logistic(x, y, weight * len(y) / max(weight.sum(), 1e-9)) if len(y) else np.zeros(1 + x.shape[1]))


_HITS = "array<struct<at: int, word: string, term: string, edits: int, quoted: boolean, weight: double>>"


def scorer(docs: DataFrame, model: Model, with_hits: bool = True):
    """A function from a text column to a column of (score, hits)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(f"score double, hits {_HITS}")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for texts in batches:
            found = [known.score(t) for t in texts]
            yield pd.DataFrame({"score": [s for s, _ in found], "hits": [h if with_hits else [] for _, h in found]})

    return score


def assess(docs: DataFrame, training: DataFrame, labels: DataFrame, with_hits: bool = True, **options) -> DataFrame:
    """``docs`` with the columns score (0 to 1) and hits, from a model of the training documents and their labels.

    Null and empty texts have no finds and get the score of a text without any. Equal texts get equal results. Other
    columns pass through; one with the name of a result is replaced. An empty table gives an empty result.
    """
    score = scorer(docs, fit(training, labels, **options), with_hits)
    out = docs.withColumn("_s", score(F.col("text")))
    return out.select(*passed(docs, "score", "hits"), F.col("_s.score").alias("score"), F.col("_s.hits").alias("hits"))
