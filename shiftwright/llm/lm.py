"""Scores of texts by a causal self-attention model over subword ids, beside a unigram score of their words.

Words are cut into the longest tokens of a public vocabulary, left to right. The model reads windows of ``2 * STEP``
inputs that overlap by half; the later half of each window is scored, so every token is scored once, with at least
``STEP`` tokens before it in view where the text has them. All windows of a batch run as one masked attention.

The next subword's distribution is a mixture of ``CLASSES`` distributions over the vocabulary, weighted by what the
attention finds: p(subword) = sum_c softmax(logits)_c E_c(subword). Where a word or the end begins, it may also come
whole: documents fall into ``KINDS`` kinds by their words, frequent words have a distribution W_k for each
kind, counted over all training documents, and a word without a whole form may be drawn by its count over all training
documents, which a join brings. So p(word) = whole * sum_k softmax(other logits)_k W_k(word) + counted * n(word) / rare
tokens + spelled * (the product over its subwords); the three shares add up to one, and the last is the share of words
that were seen once. The network learns by gradients, E by expected counts, smoothed by those of all training documents,
and both from the spelling of rare words alone. Every training document is read once, whole, in one of ``SLICES`` slices:
tasks go on from the same network, each over its share of a slice, and a grouping adds up what they changed.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftwright.llm.bpe import WORD_END, byte_symbols
from shiftwright.llm.common import words_of
from shiftwright.session import cut

# Slices of the training documents, by a hash of their text; after each the tasks' networks become one again.
SLICES = 8
TRAINING_WINDOWS = 256
# Changes of the network are added as whole numbers of this share of one, so that the order of a sum does not matter.
CHANGE_UNIT = 2.0**-16
STEP, DIM, HIDDEN, CLASSES, KINDS = 16, 16, 32, 32, 8
# Common words that tell kinds of documents apart.
KIND_WORDS = 2_000
BATCH_WINDOWS = 256
CACHE_WORDS = 300_000
# Counts that a task holds before it passes them on.
COUNTED_WORDS = 600_000
# A word with at least this share of all training tokens is looked up in the task; there are at most 1 / share.
HEAD_SHARE = 1e-6
# Words with at most so many tokens, and those without a whole form, teach the network to spell.
RARE_TIMES = 3
END = b"\n"  # no word holds white space


class _Numbered(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Subwords:
    """Ids of a word: the longest vocabulary tokens from left to right, the last one with the end mark.

    Tokens stand in a tree of their bytes, where a line feed is the end mark. All places of all words go down the tree at
    once: ``keys`` holds node * 256 + byte in order and ``nodes`` where that leads, ``token`` the id that ends at a node.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        vocab = data["model"]["vocab"]
        byte = {ord(symbol): value for value, symbol in enumerate(byte_symbols())}
        special = [t["id"] for t in data.get("added_tokens") or []]
        self.start, self.end = (special + [len(vocab), len(vocab) + 1])[:2]
        self.size = max([*vocab.values(), self.start, self.end]) + 1
        tree: dict[int, int] = {}
        token = [-1]
        for text, number in vocab.items():
            ends = text.endswith(WORD_END)
            codes = [byte.get(ord(c), -1) for c in (text[: -len(WORD_END)] if ends else text)]
            if not codes or min(codes) < 0 or END[0] in codes:
                continue
            node = 0
            for code in [*codes, END[0]] if ends else codes:
                at = node * 256 + code
                node = tree.get(at, 0)
                if not node:
                    node = tree[at] = len(token)
                    token.append(-1)
            token[node] = number
        self.keys = np.array(sorted(tree), np.int64)
        self.nodes = np.array([tree[k] for k in self.keys.tolist()], np.int64)
        self.token = np.array(token, np.int32)
        # The first two bytes without a search.
        self.first = np.zeros(256, np.int64)
        self.first[self.keys[self.keys < 256]] = self.nodes[self.keys < 256]
        self.second = self._down(np.repeat(self.first, 256), np.tile(np.arange(256), 256))
        self.whole: dict[bytes, int] = {}
        self.whole_end = -1
        self._forget()

    def _forget(self) -> None:
        self.known = _Numbered()
        self.cut_ids, self.cut_begin, self.place = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _down(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The nodes below, 0 where there are none."""
        key = node * 256 + byte
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (node > 0), self.nodes[at], 0)

    def cut(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in turn, and how many each has."""
        text = np.frombuffer(END.join(words) + END, np.uint8)
        ends = np.flatnonzero(text == END[0])
        # From every place the longest token and what comes behind it.
        token, length = self.token[self.first[text]], np.ones(len(text), np.int32)
        at = np.flatnonzero(text[:-1] != END[0])
        node, depth = self.second[text[at].astype(np.int64) << 8 | text[at + 1]], 2
        while True:
            below = np.flatnonzero(node)
            if not len(below):
                break
            at, node = at[below], node[below]
            found = self.token[node]
            held = found >= 0
            token[at[held]], length[at[held]] = found[held], depth
            more = at + depth < len(text)
            at, node = at[more], node[more]
            node = self._down(node, text[at + depth])
            depth += 1
        # All words go on from token to token.
        begins = np.append(0, ends[:-1] + 1)
        counts, steps, order = np.zeros(len(words), np.int64), [], []
        own, now = np.arange(len(words)), begins
        while True:
            left = np.flatnonzero(now < ends[own])
            if not len(left):
                break
            own, now = own[left], now[left]
            steps.append(token[now])
            order.append(own)
            counts[own] += 1
            now = now + length[now]
        if not steps:
            return np.zeros(0, np.int32), counts
        return np.concatenate(steps)[np.argsort(np.concatenate(order), kind="stable")], counts

    def all_ids(self, texts: list[list[bytes]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Subword ids of each text; for each of its words where they begin, and its place among ``whole`` or -1."""
        if len(self.known) > CACHE_WORDS:
            self._forget()
        before = len(self.known)
        words = list(chain.from_iterable(texts))
        number = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if len(self.known) > before:
            new = list(islice(self.known, before, None))
            ids, counts = self.cut(new)
            self.cut_ids = np.concatenate([self.cut_ids, ids])
            self.cut_begin = np.concatenate([self.cut_begin, self.cut_begin[-1] + np.cumsum(counts)])
            self.place = np.concatenate([self.place, np.array([self.whole.get(w, -1) for w in new], np.int32)])
        first = self.cut_begin[number]
        counts = self.cut_begin[number + 1] - first
        begins = np.cumsum(counts) - counts
        ids = self.cut_ids[np.repeat(first - begins, counts) + np.arange(counts.sum())]
        place, found, at = self.place[number], [], 0
        begins = np.append(begins, len(ids))
        for text in texts:
            to = at + len(text)
            found.append((ids[begins[at] : begins[to]], begins[at:to] - begins[at], place[at:to]))
            at = to
        return found

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of one text."""
        return self.all_ids([words])[0]


Text = tuple[np.ndarray, np.ndarray, np.ndarray]


def windows(texts: list[Text], start: int, end: int, whole_end: int = -1) -> tuple[np.ndarray, ...]:
    """Inputs (windows, 2 STEP), targets and whole words that begin there (windows, STEP), -1 where there is nothing.

    Also, of all words and ends in turn, their places among the targets and the texts they are of.
    """
    inputs, targets, whole, places, owner, before = [], [], [], [], [], 0
    for k, (ids, begins, words) in enumerate(texts):
        count = -(-(len(ids) + 1) // STEP)
        x = np.full((count + 1) * STEP, -1, np.int32)
        x[STEP] = start
        x[STEP + 1 : STEP + 1 + len(ids)] = ids
        y = np.full(count * STEP, -1, np.int32)
        y[: len(ids)], y[len(ids)] = ids, end
        w = np.full(count * STEP, -1, np.int32)
        w[begins], w[len(ids)] = words, whole_end
        halves = x.reshape(-1, STEP)
        inputs.append(np.hstack([halves[:-1], halves[1:]]))
        targets.append(y.reshape(-1, STEP))
        whole.append(w.reshape(-1, STEP))
        places.append(before + np.append(begins, len(ids)))
        owner.append(np.full(len(begins) + 1, k))
        before += count * STEP
    none = [np.zeros((0, 2 * STEP), np.int32), *[np.zeros((0, STEP), np.int32)] * 2, *[np.zeros(0, np.int64)] * 2]
    return tuple(np.concatenate([z[:0], *more]) for z, more in zip(none, (inputs, targets, whole, places, owner), strict=True))


def halves(texts: list[Text], start: int, end: int, whole_end: int = -1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same inputs once each, in runs of STEP: window i is made of the runs i and i + 1 and scores row i.

    A text's first run is empty, and the window that reaches over to the next text scores nothing. Also the places of
    all words and ends in turn among the targets.
    """
    counts = [-(-(len(ids) + 1) // STEP) for ids, _, _ in texts]
    total = sum(counts) + len(texts)
    x, y, w = (np.full((total + 1) * STEP, -1, np.int32) for _ in range(3))
    places, at = [], 0
    for (ids, begins, words), count in zip(texts, counts, strict=True):
        x[at + STEP] = start
        x[at + STEP + 1 : at + STEP + 1 + len(ids)] = ids
        y[at : at + len(ids)], y[at + len(ids)] = ids, end
        w[at + begins], w[at + len(ids)] = words, whole_end
        places.append(at + np.append(begins, len(ids)))
        at += (count + 1) * STEP
    shape = (-1, STEP)
    return x.reshape(shape), y.reshape(shape)[:-1], w.reshape(shape)[:-1], np.concatenate([np.zeros(0, np.int64), *places])


def log10_sum(a, b):
    """log10 of the sum of two numbers given by their log10, safe for very small ones."""
    high = np.maximum(a, b)
    return high + np.log10(10 ** (a - high) + 10 ** (b - high))


def _softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=-1, keepdims=True)
    np.exp(z, out=z)
    z /= z @ np.ones((z.shape[-1], 1), z.dtype)
    return z


def _bounded(z: np.ndarray) -> np.ndarray:
    """Between -1 and 1, cheaper than a hyperbolic tangent."""
    return z / (1 + np.abs(z))


def _by_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers, each once, and the sums of their values."""
    order = np.argsort(rows)
    rows = rows[order]
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    return rows[starts], np.add.reduceat(values.take(order, axis=0), starts, axis=0) if len(starts) else values[:0]


# From a scored place to an earlier input of its window.
_GAP = (STEP + np.arange(STEP))[:, None] - np.arange(2 * STEP)[None, :]
_FUTURE = _GAP < 0


class Attention:
    """One layer of causal self-attention with distance terms, and a mixture of token distributions on top."""

    def __init__(self, size: int, seed: int = 3):
        rng = np.random.default_rng(seed)

        def normal(*shape, scale):
            return (rng.normal(size=shape) * scale).astype(np.float32)

        self.w = {
            "emb": normal(size, DIM, scale=0.3),
            "q": normal(DIM, DIM, scale=DIM**-0.5), "k": normal(DIM, DIM, scale=DIM**-0.5), "v": normal(DIM, DIM, scale=DIM**-0.5),
            "gap": np.zeros(2 * STEP, np.float32),
            "x": normal(DIM, HIDDEN, scale=DIM**-0.5), "c": normal(DIM, HIDDEN, scale=DIM**-0.5), "b": np.zeros(HIDDEN, np.float32),
            "o": normal(HIDDEN, CLASSES, scale=HIDDEN**-0.5), "bo": np.zeros(CLASSES, np.float32),
            "g": np.zeros((HIDDEN, KINDS), np.float32), "bg": np.zeros(KINDS, np.float32),
        }
        self.emit = np.full((size, CLASSES), 1 / size, np.float32)  # E, by token
        self.words = np.zeros((0, KINDS), np.float32)  # W, by word
        # Shares of the ways a word may come about: whole, by its count, spelled.
        self.ways = (0.0, 0.0, 1.0)
        self.windows_read = 0  # of all training texts

    def forward(self, x: np.ndarray, begins: np.ndarray, keep: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Class weights (windows, STEP, CLASSES) at every scored place, and kind weights where a whole word begins."""
        w = self.w
        real = x >= 0
        e = w["emb"][np.where(real, x, 0)]
        own = e[:, STEP:]
        q, k, v = own @ w["q"], e @ w["k"], e @ w["v"]
        s = q @ k.transpose(0, 2, 1)
        s *= DIM**-0.5
        s += np.where(_FUTURE, np.float32(-1e9), w["gap"][np.maximum(_GAP, 0)])
        s += np.where(real, np.float32(0), np.float32(-1e9))[:, None, :]
        a = _softmax(s)
        c = a @ v
        h = _bounded(own @ w["x"] + c @ w["c"] + w["b"])
        mix, kind = _softmax(h @ w["o"] + w["bo"]), _softmax(h[begins] @ w["g"] + w["bg"])
        if keep is not None:
            keep.update(real=real, e=e, own=own, q=q, k=k, v=v, a=a, c=c, h=h, mix=mix, kind=kind)
        return mix, kind

    def tables(self) -> dict[str, np.ndarray | bool]:
        """What the network takes from each vocabulary id, computed once, so that texts only look it up."""
        w = self.w
        padded = np.vstack([w["emb"], np.zeros((1, DIM), np.float32)])  # a place without a token reads the last row
        q, k = padded @ (w["q"] * np.float32(DIM**-0.5)), padded @ w["k"]
        longest = np.sqrt((q**2).sum(axis=1).max() * (k**2).sum(axis=1).max()) + np.abs(w["gap"]).max()
        # The states lie between -1 and 1, which bounds what comes of them.
        out, bias = np.hstack([w["o"], w["g"]]), np.append(w["bo"], w["bg"])
        mixed = bool((np.abs(out).sum(axis=0) + np.abs(bias)).max() < 60)
        weight = np.exp(bias) if mixed else np.ones_like(bias)
        totals = np.zeros((CLASSES + KINDS, 2), np.float32)
        totals[:CLASSES, 0], totals[CLASSES:, 1] = weight[:CLASSES], weight[CLASSES:]
        return {
            "q": q, "kv": np.hstack([k, padded @ w["v"] @ w["c"]]), "x": padded @ w["x"] + w["b"],
            "emit": self.emit * weight[:CLASSES], "words": self.words * weight[CLASSES:], "totals": totals,
            "out": out, "bias": bias, "mixed": mixed, "safe": bool(longest < 60),
            "gap": np.where(_FUTURE, np.float32(-1e9), w["gap"][np.maximum(_GAP, 0)]),
        }

    def log10(self, halves: np.ndarray, y: np.ndarray, whole: np.ndarray, tables: dict) -> tuple[np.ndarray, np.ndarray]:
        """For each scored place: log10 of its subword's probability, and the probability of the whole word there.

        ``halves`` are the inputs in runs of STEP, a text's first one empty; window i is made of the halves i and
        i + 1, and ``y`` and ``whole`` are what it scores. All products have the shape of one window, and all batches
        the same number of them, so that a text's scores do not depend on the texts around it.
        """
        count = len(y)
        spelled, direct = np.ones(y.shape, np.float32), np.zeros(y.shape, np.float32)
        for i in range(0, count, BATCH_WINDOWS):
            part = slice(i, min(i + BATCH_WINDOWS, count))
            x = np.full((BATCH_WINDOWS + 1, STEP), -1, np.int32)
            x[: part.stop - i + 1] = halves[i : part.stop + 1]
            z = self._hidden(x, tables) @ tables["out"]
            if not tables["mixed"]:
                z += tables["bias"]
                z[..., :CLASSES] -= z[..., :CLASSES].max(axis=2, keepdims=True)
                z[..., CLASSES:] -= z[..., CLASSES:].max(axis=2, keepdims=True)
            np.exp(z, out=z)
            total = (z @ tables["totals"]).reshape(-1, 2)
            z = z.reshape(-1, CLASSES + KINDS)
            self._chosen(z[:, :CLASSES], total[:, 0], tables["emit"], y[part], spelled[part])
            if len(self.words):
                self._chosen(z[:, CLASSES:], total[:, 1], tables["words"], whole[part], direct[part])
        return np.log10(spelled.astype(np.float64)), direct.astype(np.float64)

    @staticmethod
    def _chosen(z: np.ndarray, total: np.ndarray, shares: np.ndarray, target: np.ndarray, out: np.ndarray) -> None:
        """Put the mixture's share of every target that there is into ``out``."""
        target = target.ravel()
        there = np.flatnonzero(target >= 0)
        given = np.einsum("pc,pc->p", shares.take(target[there], axis=0), z.take(there, axis=0))
        out.ravel()[there] = given / total[there]

    def _hidden(self, x: np.ndarray, tables: dict) -> np.ndarray:
        """The hidden states at every place of all halves but the first, as in forward."""
        step = STEP
        # Each window sees two halves: views that overlap. Places without a token take the last row.
        empty = x < 0
        at = np.where(empty, len(tables["q"]) - 1, x)
        kv = tables["kv"].take(at, axis=0)
        both = np.lib.stride_tricks.as_strided(kv, (len(kv) - 1, 2 * step, kv.shape[2]), kv.strides, writeable=False)
        s = tables["q"].take(at[1:], axis=0) @ both[:, :, :DIM].transpose(0, 2, 1)
        s += tables["gap"]
        gaps = np.flatnonzero(empty[:-1].any(axis=1) | empty[1:].any(axis=1))
        s[gaps] += np.where(np.hstack([empty[gaps], empty[gaps + 1]]), np.float32(-1e9), np.float32(0))[:, None, :]
        if not tables["safe"]:
            s -= s.max(axis=2, keepdims=True)
        np.exp(s, out=s)
        c = s @ both[:, :, DIM:]
        c /= np.maximum(s @ np.ones((2 * step, 1), np.float32), np.float32(1e-30))
        c += tables["x"].take(at[1:], axis=0)
        return _bounded(c)

    def gradients(self, x: np.ndarray, y: np.ndarray, whole: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the mean log loss, and how much each class is held to have made each target that is there.

        Single precision throughout; what follows the hidden states is worked out only where something is to be told.
        """
        w, count = self.w, len(x)
        real = x >= 0
        ids = np.where(real, x, 0)
        e = w["emb"].take(ids, axis=0)
        flat, own = e.reshape(-1, DIM), e[:, STEP:].reshape(-1, DIM)
        scale = np.float32(DIM**-0.5)
        wkv = np.hstack([w["k"], w["v"]])
        q, kv = (own @ (w["q"] * scale)).reshape(count, STEP, DIM), (flat @ wkv).reshape(count, 2 * STEP, 2 * DIM)
        k, v = kv[:, :, :DIM], kv[:, :, DIM:]
        a = q @ k.transpose(0, 2, 1)
        bound = max(a.max(initial=0), -a.min(initial=0)) + np.abs(w["gap"]).max()
        a += np.where(_FUTURE, np.float32(-1e9), w["gap"][np.maximum(_GAP, 0)])
        gaps = np.flatnonzero(~real.all(axis=1))
        a[gaps] += np.where(real[gaps], np.float32(0), np.float32(-1e9))[:, None, :]
        if not bound < 60:
            a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
        total = (a.reshape(-1, 2 * STEP) @ np.ones(2 * STEP, np.float32)).reshape(count, STEP, 1)
        a /= np.maximum(total, np.float32(1e-30))
        c = (a @ v).reshape(-1, DIM)
        h = _bounded(own @ w["x"] + c @ w["c"] + w["b"])
        y, whole = y.ravel(), whole.ravel()
        there, begins = np.flatnonzero(y >= 0), np.flatnonzero(whole >= 0)
        per = np.float32(1 / max(1, len(there)))
        spelling, begin = h[there], h[begins]
        mix = _softmax(spelling @ w["o"] + w["bo"])
        made = mix * self.emit.take(y[there], axis=0)
        made /= made @ np.ones((CLASSES, 1), np.float32)
        dz = (mix - made) * per
        kind = _softmax(begin @ w["g"] + w["bg"])
        drew = kind * self.words.take(whole[begins], axis=0)
        drew /= np.maximum(drew @ np.ones((KINDS, 1), np.float32), np.float32(1e-30))
        dg = (kind - drew) * per
        g = {"o": spelling.T @ dz, "bo": dz.sum(axis=0), "g": begin.T @ dg, "bg": dg.sum(axis=0)}
        dh = np.zeros_like(h)
        dh[there] = dz @ w["o"].T
        dh[begins] += dg @ w["g"].T
        dh *= (1 - np.abs(h)) ** 2
        g |= {"x": own.T @ dh, "c": c.T @ dh, "b": dh.sum(axis=0)}
        dc = dh @ w["c"].T
        # The mean of what the places seen would change, for each place that sees them.
        mean = np.einsum("pd,pd->p", dc, c).reshape(count, STEP, 1)
        dc = dc.reshape(count, STEP, DIM)
        dkv = np.empty_like(kv)
        np.matmul(a.transpose(0, 2, 1), dc, out=dkv[:, :, DIM:])
        ds = dc @ v.transpose(0, 2, 1)
        ds -= mean
        ds *= a
        told = (np.ones(count, np.float32) @ ds.reshape(count, -1)).reshape(STEP, 2 * STEP)
        g["gap"] = np.bincount(np.maximum(_GAP, 0).ravel(), (told * ~_FUTURE).ravel(), 2 * STEP).astype(np.float32)
        np.matmul(ds.transpose(0, 2, 1), q, out=dkv[:, :, :DIM])
        dq = (ds @ k).reshape(-1, DIM) * scale
        dkv = dkv.reshape(-1, 2 * DIM)
        g["q"], both = own.T @ dq, flat.T @ dkv
        g["k"], g["v"] = both[:, :DIM], both[:, DIM:]
        de = (dkv @ wkv.T).reshape(count, 2 * STEP, DIM)
        de[:, STEP:] += (dq @ w["q"].T + dh @ w["x"].T).reshape(count, STEP, DIM)
        at = np.flatnonzero(real)
        g["emb"] = _by_row(ids.ravel()[at], de.reshape(-1, DIM).take(at, axis=0))
        return g, made

    def begin(self, counts: np.ndarray, words: np.ndarray) -> None:
        """The distributions before any training text is read.

        ``counts`` are those of subwords in the rare words of all training texts, ``words`` those of the whole words in
        each kind.
        """
        self.share = (counts + 0.5) / (counts + 0.5).sum()
        if len(words):
            overall = words.sum(axis=1, keepdims=True) / words.sum()
            each = words.sum(axis=0)
            self.words = ((words + 0.03 * each * overall) / np.maximum(1.03 * each, 1e-30)).astype(np.float32)
            self.words[:, each == 0] = overall
        rng = np.random.default_rng(13)
        # Classes begin as the overall shares, disturbed for each token and class.
        self.expected = self.share[:, None] * rng.gamma(0.5, 2.0, (len(self.share), CLASSES)) * 1e5
        self.emit = (self.expected / self.expected.sum(axis=0)).astype(np.float32)

    def smooth(self, expected: np.ndarray) -> None:
        """E from expected counts."""
        smooth = expected + 2.0 * self.share[:, None]
        self.emit = (smooth / smooth.sum(axis=0)).astype(np.float32)

    def learn(self, parts: Iterator[tuple[np.ndarray, ...]], rate: float) -> tuple[int, np.ndarray]:
        """Adam for the network, expected counts for E, over the windows of ``parts``; how many, and the counts made."""
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        own, held = np.zeros_like(self.expected), []
        step = count = 0

        def add() -> None:
            if held:
                rows, made = _by_row(*(np.concatenate(z) for z in zip(*held, strict=True)))
                own[rows] += made
                held.clear()

        for x, y, whole in parts:
            step, count = step + 1, count + len(x)
            g, made = self.gradients(x, y, whole)
            for name, grad in g.items():
                part = ...
                if name == "emb":
                    part, grad = grad
                one, two = (z[name] if part is ... else z[name].take(part, axis=0) for z in (first, second))
                one, two = 0.9 * one + 0.1 * grad, 0.98 * two + 0.02 * grad**2
                first[name][part], second[name][part] = one, two
                up = (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.98**step)) + 1e-8)
                self.w[name][part] -= (rate * up).astype(np.float32)
            held.append((y[y >= 0], made))
            if step % 32 == 0:
                add()
                self.smooth(self.expected + own)
        add()
        return count, own


class Kinds:
    """Kinds of documents by their common words: a mixture of multinomials, by hard assignment."""

    def __init__(self, names: list[bytes]):
        self.place = {w: i for i, w in enumerate(names)}
        self.logs = np.zeros((len(names), KINDS))

    def of(self, places: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
        """The kinds of ``rows`` texts, by the places of all their words in turn, -1 for words without one."""
        if not len(self.place):
            return np.zeros(rows, np.int64)
        held = places >= 0
        return _sums(self.logs[places[held]], owner[held], rows).argmax(axis=1)


KIND_ROUNDS = 20


def _tallies(training: DataFrame, kinds: Kinds | None = None) -> DataFrame:
    """How often each text holds every word that tells kinds apart, by place; without ``kinds`` how many texts have a word."""
    shared = training.sparkSession.sparkContext.broadcast(kinds)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = shared.value, Counter()
        for batch in batches:
            texts = [words_of(t.as_py()) for t in batch["text"]]
            if own is None:
                held.update(chain.from_iterable(map(set, texts)))
                if len(held) > COUNTED_WORDS:
                    yield texts_with(held)
                    held.clear()
                continue
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            place = np.fromiter(map(own.place.get, chain.from_iterable(texts), repeat(-1)), np.int64, sizes.sum())
            row, width = np.repeat(np.arange(len(texts)), sizes), max(1, len(own.place))
            # By place, so that equal texts have equal rows whatever their order of words.
            cells, times = np.unique((row * width + place)[place >= 0], return_counts=True)
            ends = pa.array(np.searchsorted(cells, np.arange(len(texts) + 1) * width), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(ends, pa.array(z, pa.int32())) for z in (cells % width, times)], ["words", "times"])
        if own is None:
            yield texts_with(held)

    def texts_with(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    return training.select("text").mapInArrow(rows, "word binary, n long" if kinds is None else "words array<int>, times array<int>")


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and times of a batch in turn, and the row each is of."""
    words = batch["words"]
    owner = np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
    return words.flatten().to_numpy(), batch["times"].flatten().to_numpy(), owner


def _sums(values: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    return np.stack([np.bincount(owner, column, rows) for column in values.T], axis=1)


def fit_kinds(training: DataFrame) -> Kinds:
    """Kinds of all training texts: seeds far from one another, then rounds of assignment, each a pass over all rows."""
    common = _tallies(training).groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(KIND_WORDS)
    kinds = Kinds([bytes(r["word"]) for r in common.collect()])
    if not kinds.place:
        return kinds
    # Every round reads the table, so it has no more tasks than can run at once; each holds one batch.
    table = cut(_tallies(training, kinds).where(F.size("words") > 0), "lm-tallies")
    table = table.coalesce(training.sparkSession.sparkContext.defaultParallelism)
    size = F.aggregate("times", F.lit(0).cast("long"), lambda a, b: a + b)
    middle = table.agg(F.percentile(size, 0.5)).first()[0]
    # A text's words and times, as square roots of their shares; equal texts cannot be told apart, nor need they be.
    text = F.struct(F.col("words"), F.col("times"))
    at = table.withColumn("size", size).agg(F.max_by(text, F.struct("size", "words", "times"))).first()[0]
    seeds: list[np.ndarray] = []

    def unit(row) -> np.ndarray:
        x = np.zeros(len(kinds.place))
        x[list(row["words"])] = np.sqrt(np.array(row["times"]) / sum(row["times"]))
        return x

    def nearness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, times, owner = _matrix(batch)
            sizes = np.bincount(owner, times, len(batch))
            near = _sums(np.sqrt(times / sizes[owner])[:, None] * seeds_now.value[words], owner, len(batch)).max(axis=1)
            near[sizes < middle] = 2
            yield pa.RecordBatch.from_arrays([batch["words"], batch["times"], pa.array(near)], ["words", "times", "near"])

    context = training.sparkSession.sparkContext
    seeds.append(unit(at))
    while len(seeds) < KINDS:
        seeds_now = context.broadcast(np.stack(seeds, axis=1))
        near = table.mapInArrow(nearness, "words array<int>, times array<int>, near double")
        seeds.append(unit(near.agg(F.min_by(text, F.struct("near", "words", "times"))).first()[0]))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, roots = weights.value
        total = np.zeros(by.size, np.int64)
        for batch in batches:
            words, times, owner = _matrix(batch)
            kind = _sums((np.sqrt(times) if roots else times)[:, None] * by[words], owner, len(batch)).argmax(axis=1)
            total += np.bincount(words * KINDS + kind[owner], times, by.size).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["cell", "n"])

    weights, before = context.broadcast((np.stack(seeds, axis=1), True)), None
    for _ in range(KIND_ROUNDS):
        cells = table.mapInArrow(tally, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        sums = np.zeros(kinds.logs.size, np.int64)
        sums[cells["cell"].to_numpy()] = cells["n"].to_numpy()
        if before is not None and (before == sums).all():
            break
        before, sums = sums, sums.reshape(-1, KINDS)
        smooth = sums + 50 * (sums.sum(axis=1) / sums.sum())[:, None]
        kinds.logs = np.log(smooth / smooth.sum(axis=0))
        weights = context.broadcast((kinds.logs, False))
    return kinds


def word_counts(training: DataFrame, kinds: Kinds) -> DataFrame:
    """(word, n, k0, k1, ...) of all training texts and of their ends, overall and by kind; summed within tasks first."""
    shared = training.sparkSession.sparkContext.broadcast(kinds)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        numbers, common = _Numbered(), np.zeros(0, np.int64)
        total = np.zeros(KINDS, np.int64)  # by word and kind, with room for more words
        for batch in batches:
            texts = [[*words_of(t.as_py()), END] for t in batch["text"]]
            before, sizes = len(numbers), np.fromiter(map(len, texts), np.int64, len(texts))
            number = np.fromiter(map(numbers.__getitem__, chain.from_iterable(texts)), np.int64, sizes.sum())
            new = [own.place.get(w, -1) for w in islice(numbers, before, None)]
            common = np.append(common, np.array(new, np.int64))
            kind = own.of(common[number], np.repeat(np.arange(len(texts)), sizes), len(texts))
            while len(total) < len(numbers) * KINDS:
                total = np.append(total, np.zeros_like(total))
            np.add.at(total, number * KINDS + np.repeat(kind, sizes), 1)
            if len(numbers) > COUNTED_WORDS:
                yield out(numbers, total)
                numbers, common = _Numbered(), common[:0]
                total[:] = 0
        yield out(numbers, total)

    def out(numbers: dict, total: np.ndarray) -> pa.RecordBatch:
        each = total[: len(numbers) * KINDS].reshape(-1, KINDS)
        sums = [pa.array(z) for z in (each.sum(axis=1), *each.T.copy())]
        return pa.RecordBatch.from_arrays([pa.array(list(numbers), pa.binary()), *sums], ["word", *names])

    names = ["n", *[f"k{k}" for k in range(KINDS)]]
    types = "word binary, " + ", ".join(f"{name} long" for name in names)
    return training.select("text").mapInArrow(rows, types).groupBy("word").agg(*[F.sum(name).alias(name) for name in names])


def _subword_counts(counts: DataFrame, subwords: Subwords) -> np.ndarray:
    """How often each vocabulary token occurs in the training texts; only so many counts as it has tokens are collected."""
    path = counts.sparkSession.sparkContext.broadcast(subwords)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = path.value, np.zeros(path.value.size)
        for batch in batches:
            words, times = batch["word"].to_pylist(), batch["n"].to_numpy()
            ends = np.array([word == END for word in words], bool)
            total[own.end] += times[ends].sum()
            ids, counts = own.cut([word for word in words if word != END])
            total += np.bincount(ids, np.repeat(times[~ends], counts), len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    summed = counts.mapInArrow(rows, "id long, n double").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    found = np.zeros(subwords.size)
    found[summed["id"].to_numpy()] = summed["n"].to_numpy()
    return found


def _training_windows(texts: list[Text], cutter: Subwords, common: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows of the texts. Only rare words teach spelling, as only such and unseen ones depend on it."""
    x, y, whole, _, _ = windows(texts, cutter.start, cutter.end, cutter.whole_end)
    if len(common):
        at, flat = 0, y.reshape(-1)
        for ids, begins, place in texts:
            skip = np.repeat((place >= 0) & common[place], np.diff(np.append(begins, len(ids))))
            flat[at : at + len(ids)][skip] = -1
            if cutter.whole_end >= 0:
                flat[at + len(ids)] = -1
            at += -(-(len(ids) + 1) // STEP) * STEP
    return x, y, whole


def fit(
    training: DataFrame, rare: DataFrame, subwords: Subwords, head: np.ndarray, common: np.ndarray, ways: tuple,
    rate: float = 0.03,
) -> Attention:
    """The network, from counts over all training texts and one pass over all of their windows.

    ``common`` marks the whole words that are not rare. What tasks change in a row of a matrix is averaged over those
    that changed it, weighted by their windows; counts for E add up, and those of earlier slices fade.
    """
    context = training.sparkSession.sparkContext
    model = Attention(subwords.size)
    model.begin(_subword_counts(rare, subwords), head)
    model.ways = ways
    width = max(CLASSES, HIDDEN, DIM, 2 * STEP, KINDS)
    cutter = context.broadcast((subwords, common))
    place = F.pmod(F.xxhash64("text"), F.lit(SLICES))
    texts = training.where(F.col("text").isNotNull()).select("text")
    tasks = max(context.defaultParallelism, texts.rdd.getNumPartitions() // SLICES)
    for k in range(SLICES):
        now = context.broadcast((model, rate * (1 - k / SLICES)))

        def rows(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            own, marks = cutter.value
            given, speed = now.value
            net = Attention.__new__(Attention)
            net.__dict__.update(given.__dict__, w={n: v.copy() for n, v in given.w.items()})

            def parts() -> Iterator[tuple[np.ndarray, ...]]:
                rng = np.random.default_rng(13)
                for batch in batches:
                    found = _training_windows(own.all_ids([words_of(t.as_py()) for t in batch["text"]]), own, marks)
                    order = rng.permutation(len(found[0]))
                    for i in range(0, len(order), TRAINING_WINDOWS):
                        yield tuple(z[order[i : i + TRAINING_WINDOWS]] for z in found)

            count, made = net.learn(parts(), speed)
            changed = {n: (v.astype(np.float64) - given.w[n]) * count for n, v in net.w.items()}
            changed |= {"made": made, "read": np.full((1, 1), min(count, 1))}
            for name, change in changed.items():
                change = np.rint(change.reshape(-1, change.shape[-1]) / CHANGE_UNIT).astype(np.int64)
                at = np.flatnonzero(change.any(axis=1))
                columns = [pa.array(change[at, i] if i < change.shape[1] else np.zeros(len(at), np.int64)) for i in range(width)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(np.full(len(at), count)), *columns],
                    ["part", "id", "windows", *[f"v{i}" for i in range(width)]])

        types = "part string, id long, windows long, " + ", ".join(f"v{i} long" for i in range(width))
        summed = texts.where(place == k).coalesce(tasks).mapInArrow(rows, types).groupBy("part", "id").agg(
            *[F.sum(c).alias(c) for c in ("windows", *[f"v{i}" for i in range(width)])]).toArrow()
        if not len(summed):
            continue
        values = np.stack([summed[f"v{i}"].to_numpy() for i in range(width)], axis=1) * CHANGE_UNIT
        part, at, count = np.array(summed["part"].to_pylist()), summed["id"].to_numpy(), summed["windows"].to_numpy()
        model.w = {n: v.copy() for n, v in model.w.items()}
        for name, v in model.w.items():
            mine = part == name
            v.reshape(-1, v.shape[-1])[at[mine]] += (values[mine, : v.shape[-1]] / count[mine, None]).astype(np.float32)
        model.windows_read += int(count[part == "read"].sum())
        mine = part == "made"
        model.expected = 0.5 * model.expected
        model.expected[at[mine]] += values[mine, :CLASSES]
        model.smooth(model.expected)
        now.destroy()
    if not model.windows_read:
        model.emit = np.repeat(model.share[:, None], CLASSES, axis=1).astype(np.float32)
    return model


# Log scores are added as whole numbers of this share of one, so that the order of a sum does not matter.
UNIT = 1e-10


def _exact_sum(value: Column) -> Column:
    return F.sum(F.round(value / UNIT).cast("long")) * UNIT


def scored(docs: DataFrame, training: DataFrame, path: str) -> DataFrame:
    """One row per row of ``docs``: its columns but text, and n_tokens, n_known, train_tokens, base_score, score, seen_score.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, and one end. base_score is the sum of
    log10((c + 1) / (N + V + 1)) over tokens, with counts over all training texts; score is the model's log10
    probability of the words and the end. seen_score is that with all words never seen as one class, as base_score has
    them; it does not see their spelling. Null and empty texts have only their end. A column with the name of a result
    is replaced. Equal texts get equal results. Without training texts all counts are 0 and the model knows nothing, but
    scores. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    subwords = Subwords(path)
    counts = cut(word_counts(training, fit_kinds(training)), "word-counts")
    totals = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    total, distinct = totals[0] or 0, totals[1]
    head = counts.where(F.col("n") >= F.lit(max(1.0, total * HEAD_SHARE))).orderBy("word").toArrow()
    names = head["word"].to_pylist()
    subwords.whole = {word: i for i, word in enumerate(names)}
    subwords.whole_end = subwords.whole.get(END, -1)
    by_kind = np.stack([head[f"k{k}"].to_numpy() for k in range(KINDS)], axis=1).astype(float)
    sizes = head["n"].to_numpy().astype(float)
    # The share of words never seen is about that of words seen once; only those must be spelled.
    once = counts.where("n = 1").count()
    unseen = min(0.5, max(once / total, 1e-4)) if total else 1.0
    by_head = float(sizes.sum()) / total if total else 0.0
    ways = ((1 - unseen) * by_head, (1 - unseen) * (1 - by_head), unseen)
    is_rare = (F.col("n") <= max(RARE_TIMES, int(total * HEAD_SHARE))) | (F.col("word") == F.lit(END))
    model = fit(training, counts.where(is_rare), subwords, by_kind, sizes > RARE_TIMES, ways)
    model.expected = model.share = None  # not needed by the tasks that score
    by_whole, by_count, by_spelling = model.ways
    others = total - float(sizes.sum())
    shared = spark.sparkContext.broadcast((subwords, model.tables(), model, np.log10(sizes + 1)))
    ends = float(sizes[subwords.whole_end]) if subwords.whole_end >= 0 else 0.0
    results = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "seen_score")
    kept = [c for c in docs.columns if c not in ("text", *results)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, tables, net, logs = shared.value
        for batch in batches:
            words = [words_of(t.as_py()) for t in batch["text"]]
            texts = cutter.all_ids(words)
            *parts, places = halves(texts, cutter.start, cutter.end, cutter.whole_end)
            each, direct = net.log10(*parts, tables)
            spelled = np.add.reduceat(each.ravel(), places) if len(places) else np.zeros(0)
            direct = direct.ravel()[places]
            with np.errstate(divide="ignore"):
                whole = np.log10(by_whole * direct)
                final = log10_sum(whole, np.log10(by_spelling) + spelled)
                seen = np.where(direct > 0, whole, final)
            at, scores, classes, bases, rare, far, ends_at = 0, [], [], [], [], [], [0]
            for own, (_, _, place) in zip(words, texts, strict=True):
                held = np.flatnonzero(place >= 0)
                others = np.flatnonzero(place < 0)
                scores.append(float(final[at + held].sum() + final[at + len(own)]))
                classes.append(float(seen[at + held].sum() + seen[at + len(own)]))
                bases.append(float(logs[place[held]].sum() + np.log10(ends + 1)))
                rare += [own[i] for i in others.tolist()]
                far.append(spelled[at + others])
                ends_at.append(len(rare))
                at += len(own) + 1
            told = pa.StructArray.from_arrays(
                [pa.array(rare, pa.binary()), pa.array(np.concatenate([np.zeros(0), *far]))], ["word", "spelled"])
            yield pa.RecordBatch.from_arrays(
                [batch["kept"], pa.array([len(w) + 1 for w in words], pa.int64()), pa.array(bases, pa.float64()),
                 pa.array(scores, pa.float64()), pa.array(classes, pa.float64()), pa.ListArray.from_arrays(pa.array(ends_at, pa.int32()), told)],
                ["kept", "n_tokens", "base", "score", "seen", "rare"],
            )

    # The caller's columns travel as one, so that none can meet a name in use here.
    whole_rows = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in kept]).alias("kept"), "text")
    types = f"kept {whole_rows.schema['kept'].dataType.simpleString()}, n_tokens long, base double, score double, seen double, "
    found = cut(
        whole_rows.mapInArrow(rows, types + "rare array<struct<word: binary, spelled: double>>")
        .withColumn("row", F.monotonically_increasing_id()),
        "lm-scores",
    )
    # Other words meet their counts by a join; within tasks a document's words add up before they are exchanged.
    n = F.coalesce(F.col("n"), F.lit(0))
    a = F.col("spelled") + F.lit(float(np.log10(by_spelling)))
    b = F.log10(F.lit(by_count / max(1.0, others)) * n)  # null for words never seen
    high = F.coalesce(F.greatest(a, b), a)
    both = high + F.log10(F.pow(F.lit(10.0), a - high) + F.coalesce(F.pow(F.lit(10.0), b - high), F.lit(0.0)))
    met = (
        found.select("row", F.explode("rare").alias("r")).select("row", "r.*").join(counts.select("word", "n"), "word", "left")
        .groupBy("row").agg(
            F.count("n").alias("known"), F.count(F.lit(1)).alias("others"), _exact_sum(F.log10(n + 1)).alias("rest"),
            _exact_sum(both).alias("more"), _exact_sum(F.coalesce(b, F.lit(float(np.log10(by_spelling))))).alias("classed"),
        )
    )
    zero = F.lit(0.0)
    end_known = F.lit(0 if ends else 1)
    base = F.col("base") + F.coalesce("rest", zero) - F.col("n_tokens") * float(np.log10(total + distinct + 1))
    return found.drop("rare").join(met, "row", "left").select(
        *[F.col(f"kept.`{c}`").alias(c) for c in kept], "n_tokens",
        (F.col("n_tokens") - F.coalesce("others", F.lit(0)) + F.coalesce("known", F.lit(0)) - end_known).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"),
        (F.col("score") + F.coalesce("more", zero)).alias("score"),
        (F.col("seen") + F.coalesce("classed", zero)).alias("seen_score"),
    )
