"""Main text of web pages: a recurrent labeller over the page's text blocks.

A page is cut into leaf blocks in page order. Every block becomes a vector of its hashed tag path, its hashed words and
a few measures. A bidirectional LSTM reads the vectors of the whole page from both ends, so each block is labelled with
the document around it in view. Blocks labelled as main text are joined.

The model is trained here, on a bounded sample of the pages: their blocks are labelled by the elements they stand in,
and variants of these pages, with other element and class names and with added notices, forms, sidebars and comments,
teach it what the sample lacks.
"""

from __future__ import annotations

import bisect
import html
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Pages the labeller is trained on, about, chosen by a hash of their id, and the longest of them.
TRAINING_PAGES, TRAINING_CHARS = 300, 1 << 16
PATH_CELLS, WORD_CELLS, MEASURES = 96, 32, 5
WIDTH = PATH_CELLS + WORD_CELLS + MEASURES
HIDDEN = 16

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head title script style noscript template svg iframe object canvas".split())
RAW = frozenset("script style title textarea noscript iframe".split())
BLOCK = frozenset((
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul option select button textarea legend label caption"
).split())
ENDS_ITSELF = {
    "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"},
}
SCOPES = frozenset("ul ol dl table select".split())
# Names, of elements, classes and ids, by what stands in them.
MAIN_NAMES = frozenset("article main content post entry story text body-text articlebody maincontent".split())
OTHER_NAMES = frozenset((
    "nav footer aside form menu navbar navigation breadcrumb breadcrumbs sidebar ad ads advert advertisement banner "
    "promo sponsored cookie cookies notice consent popup modal newsletter subscribe share social related comment "
    "comments commentlist reply widget toolbar masthead copyright button select option textarea label legend"
).split())

_OPEN = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
_COMMENT_END = re.compile(r"--!?>")
_ENDS = re.compile(r"[>\"']")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I | re.A) for name in RAW}
_SCRIPT_MARK = re.compile(r"(<!(?=--))|(-->)|<(/?)script(?=[\s/>])", re.I | re.A)
_ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CUT_OFF = re.compile(r"<[/!?a-zA-Z][^<>]*\Z")
_NAME = re.compile(r"[^\s_-]+(?:-[^\s_-]+)*|[^\s_-]+")

Element = tuple[str, tuple[str, ...]]


class Node:
    """An open element and the one around it. Pages may nest deeply, so a block keeps the innermost one only."""

    __slots__ = ("around", "element", "cells")

    def __init__(self, around: Node | None, element: Element):
        self.around, self.element = around, element
        self.cells: np.ndarray | None = None


@dataclass
class Block:
    """A leaf block: its text, the innermost element it stands in, and how many of its characters are links."""

    text: str
    inside: Node | None
    linked: int

    @property
    def path(self) -> tuple[Element, ...]:
        """All elements around, the outermost first."""
        out, node = [], self.inside
        while node:
            out.append(node.element)
            node = node.around
        return tuple(out[::-1])


def nested(path: Iterable[Element]) -> Node | None:
    node = None
    for element in path:
        node = Node(node, element)
    return node


class TagEnds:
    """Where tags end: at the first > outside of quotes, or if there is none, at the first of all. One pass per page."""

    def __init__(self, page: str):
        self.page, self.at = page, [m.start() for m in _ENDS.finditer(page)]
        # From each of these characters on, read outside of quotes, behind " and behind '.
        plain, double, single = -1, -1, -1
        self.found = [-1] * (len(self.at) + 1)
        for i in range(len(self.at) - 1, -1, -1):
            char = page[self.at[i]]
            if char == ">":
                plain = self.at[i]
            elif char == '"':
                plain, double = double, plain
            else:
                plain, single = single, plain
            self.found[i] = plain

    def of(self, start: int) -> int:
        """The end of a tag whose attributes begin at ``start``; -1 if the page ends first."""
        end = self.found[bisect.bisect_left(self.at, start)]
        return end if end >= 0 else self.page.find(">", start)


def _names(attributes: str) -> tuple[str, ...]:
    """Classes, ids and roles, whole and by their parts."""
    found: dict[str, None] = {}
    for match in _ATTRIBUTE.finditer(attributes):
        for name in (match[1] or match[2] or match[3] or "").lower().split():
            found[name] = None
            found.update(dict.fromkeys(re.split(r"[-_]+", name)))
    return tuple(x for x in found if x)


def _raw_end(name: str, page: str, at: int) -> int:
    """Where the closing tag of a raw element begins, or the end of the page. Nothing else in it is a tag or a comment.

    In a script, what looks like a comment may hold a script element, whose closing tag does not count.
    """
    if name != "script":
        found = _RAW_END[name].search(page, at)
        return found.start() if found else len(page)
    escaped = inner = False
    for match in _SCRIPT_MARK.finditer(page, at):
        if match[1]:
            escaped = True
        elif match[2]:
            escaped = inner = False
        elif not match[3]:
            inner = inner or escaped
        elif inner:
            inner = False
        else:
            return match.start()
    return len(page)


class Stack:
    """Open elements, with what is asked of them at every step at hand."""

    def __init__(self):
        self.names: list[str] = []
        self.nodes: list[Node | None] = []  # the innermost block element
        self.blocks: list[int] = []  # places of block elements
        self.open: dict[str, int] = {}
        self.hidden = 0

    def push(self, name: str, attributes: str) -> None:
        node = self.nodes[-1] if self.nodes else None
        if name in BLOCK:
            node = Node(node, (name, _names(attributes) if attributes else ()))
            self.blocks.append(len(self.names))
        self.names.append(name)
        self.nodes.append(node)
        self.open[name] = self.open.get(name, 0) + 1
        self.hidden += name in UNSEEN

    def pop_to(self, place: int) -> None:
        for name in self.names[place:]:
            self.open[name] -= 1
            self.hidden -= name in UNSEEN
        del self.names[place:], self.nodes[place:]
        while self.blocks and self.blocks[-1] >= place:
            self.blocks.pop()

    def close(self, name: str) -> None:
        """Close the innermost element of the name and all inside it; nothing if none is open."""
        if self.open.get(name):
            place = len(self.names) - 1
            while self.names[place] != name:
                place -= 1
            self.pop_to(place)

    def make_room(self, name: str) -> None:
        """Close what the start of an element ends by itself."""
        ends = ENDS_ITSELF.get(name, ()) if name in ENDS_ITSELF else ({"p"} if name in BLOCK else ())
        for place in reversed(self.blocks):
            if self.names[place] in ends:
                self.pop_to(place)
                return
            if self.names[place] not in ("p", "li", "dd", "dt", "td", "th"):
                return


def blocks_of(page: str | None) -> list[Block]:
    """Leaf blocks with text, in page order. Character references are decoded; white space becomes one blank.

    Every step takes as long as what it reads, so that a page takes as long as it is.
    """
    if not page:
        return []
    page = _CUT_OFF.sub("", page)
    out: list[Block] = []
    stack, ends, last = Stack(), TagEnds(page), page.rfind(">")
    parts: list[str] = []
    linked, inside, at, search = 0, None, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, inside, linked))
            parts.clear()
            linked = 0

    def add(text: str) -> None:
        nonlocal linked, inside
        if text and not stack.hidden:
            if not parts:
                if text.isspace():
                    return
                inside = stack.nodes[-1] if stack.nodes else None
            parts.append(text)
            if stack.open.get("a"):
                linked += len(text)

    while match := _OPEN.search(page, search):
        start = match.start()
        if match[1]:
            end = _COMMENT_END.search(page, match.end())
            add(page[at:start])
            at = search = end.end() if end else len(page)
            continue
        if start > last:
            # No tag can end any more; only a comment, which needs no end, may still hide text.
            search = page.find("<!--", start)
            if search < 0:
                break
            continue
        name = (match[3] or "").lower()
        end = ends.of(match.end()) if name else page.find(">", match.end())
        add(page[at:start])
        attributes, at = page[match.end() : end], end + 1
        search = at
        if not name:
            continue
        block = name in BLOCK or name in UNSEEN
        if match[2]:
            if block:
                flush()
            stack.close(name)
            continue
        if name == "br":
            if parts:
                parts.append(" ")
            continue
        if block or name in VOID and name == "hr":
            flush()
        if name in VOID:
            continue
        if block:
            stack.make_room(name)
        stack.push(name, attributes)
        if name in RAW:
            at = search = _raw_end(name, page, at)
    add(page[at:])
    flush()
    return out


def _cell(text: str, cells: int) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % cells


class Vectors:
    """Vectors of blocks. The part of an element's path is that of the one around it and its own cells."""

    def __init__(self):
        self.own: dict[Element, list[int]] = {}

    def cells(self, element: Element) -> list[int]:
        found = self.own.get(element)
        if found is None:
            half, names = PATH_CELLS // 2, (element[0], *element[1])
            # A second cell, so that names that meet in one differ in the other.
            found = [_cell(n, half) for n in names] + [half + _cell("2" + n, half) for n in names]
            if len(self.own) >= 20_000:
                self.own.clear()
            self.own[element] = found
        return found

    def path(self, node: Node | None) -> np.ndarray:
        new = []
        while node and node.cells is None:
            new.append(node)
            node = node.around
        found = node.cells if node else np.zeros(PATH_CELLS, np.float32)
        for node in reversed(new):
            cells = self.cells(node.element)
            if not found[cells].all():
                found = found.copy()
                found[cells] = 1
            node.cells = found
        return found

    def page(self, blocks: list[Block]) -> np.ndarray:
        out = np.zeros((len(blocks), WIDTH), np.float32)
        for i, block in enumerate(blocks):
            out[i, :PATH_CELLS] = self.path(block.inside)
            words = block.text.lower().encode("utf-8", "surrogatepass").split()
            cells = np.bincount([zlib.crc32(w) % WORD_CELLS for w in words], minlength=WORD_CELLS)
            out[i, PATH_CELLS : PATH_CELLS + WORD_CELLS] = 0.25 * np.log1p(cells)
            size = len(block.text)
            out[i, PATH_CELLS + WORD_CELLS :] = (
                0.2 * np.log1p(size), min(1.0, block.linked / size), i / len(blocks), block.text[-1] in ".!?:;", 1.0,
            )
        return out


class Labeller:
    """A bidirectional LSTM with one output per block, in numpy."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.weights: dict[str, np.ndarray] = {}
        for way in "fb":
            self.weights["x" + way] = (rng.normal(size=(WIDTH, 4 * HIDDEN)) / np.sqrt(WIDTH)).astype(np.float32)
            self.weights["h" + way] = (rng.normal(size=(HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1  # remember at first
            self.weights["c" + way] = bias
        self.weights["out"] = (rng.normal(size=2 * HIDDEN) / np.sqrt(2 * HIDDEN)).astype(np.float32)
        self.weights["bias"] = np.zeros(1, np.float32)

    @staticmethod
    def batch(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(steps, pages, width) with zeros at the end of short pages, and the mask of real blocks."""
        steps = max(len(p) for p in pages)
        x, mask = np.zeros((steps, len(pages), WIDTH), np.float32), np.zeros((steps, len(pages)), np.float32)
        for k, page in enumerate(pages):
            x[: len(page), k], mask[: len(page), k] = page, 1
        return x, mask

    def _run(self, way: str, x: np.ndarray, mask: np.ndarray, keep: list | None):
        steps, count = mask.shape
        given = x @ self.weights["x" + way] + self.weights["c" + way]
        recur = self.weights["h" + way]
        h, c = np.zeros((count, HIDDEN), np.float32), np.zeros((count, HIDDEN), np.float32)
        out = np.zeros((steps, count, HIDDEN), np.float32)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = given[t] + h @ recur
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            cell = (f * c + i * g) * m
            bent = np.tanh(cell)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, bent, m))
            h, c = o * bent * m, cell
            out[t] = h
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Probability of main text for every block."""
        states = []
        for way in "fb":
            steps = None if keep is None else keep.setdefault(way, [])
            states.append(self._run(way, x, mask, steps))
        both = np.concatenate(states, axis=2)
        if keep is not None:
            keep["both"] = both
        return 1 / (1 + np.exp(-(both @ self.weights["out"] + self.weights["bias"][0])))

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        keep: dict = {}
        p = self.forward(x, mask, keep)
        d = (p - y) * mask / mask.sum()
        grads = {"out": np.einsum("tkh,tk->h", keep["both"], d), "bias": np.array([d.sum()], np.float32)}
        down = d[:, :, None] * self.weights["out"]
        for side, way in enumerate("fb"):
            recur = self.weights["h" + way]
            part = down[:, :, side * HIDDEN : (side + 1) * HIDDEN]
            dh, dc = np.zeros_like(part[0]), np.zeros_like(part[0])
            gx, gh = np.zeros_like(self.weights["x" + way]), np.zeros_like(recur)
            gc = np.zeros(4 * HIDDEN, np.float32)
            for t, h, c, i, f, o, g, bent, m in reversed(keep[way]):
                dh = (dh + part[t]) * m
                dcell = (dc + dh * o * (1 - bent**2)) * m
                dz = np.concatenate(
                    [dcell * g * i * (1 - i), dcell * c * f * (1 - f), dh * bent * o * (1 - o), dcell * i * (1 - g**2)], axis=1
                )
                gx += x[t].T @ dz
                gh += h.T @ dz
                gc += dz.sum(axis=0)
                dh, dc = dz @ recur.T, dcell * f
            grads |= {"x" + way: gx, "h" + way: gh, "c" + way: gc}
        return grads

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], rounds: int = 12, size: int = 24, rate: float = 0.01) -> None:
        """Adam over batches of pages of like length."""
        order = sorted(range(len(pages)), key=lambda k: len(pages[k]))
        batches = [order[i : i + size] for i in range(0, len(order), size)]
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        rng, step = np.random.default_rng(11), 0
        for _ in range(rounds):
            for b in rng.permutation(len(batches)):
                x, mask = self.batch([pages[k] for k in batches[b]])
                y = np.zeros_like(mask)
                for place, k in enumerate(batches[b]):
                    y[: len(labels[k]), place] = labels[k]
                step += 1
                for name, grad in self.gradients(x, mask, y).items():
                    first[name] = 0.9 * first[name] + 0.1 * grad
                    second[name] = 0.99 * second[name] + 0.01 * grad**2
                    self.weights[name] = (
                        self.weights[name] - rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-6)
                    ).astype(np.float32)

    def label(self, pages: list[np.ndarray], size: int = 64) -> list[np.ndarray]:
        """For every page, which of its blocks are main text."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        for i in range(0, len(order), size):
            some = order[i : i + size]
            p = self.forward(*self.batch([pages[k] for k in some]))
            for place, k in enumerate(some):
                out[k] = p[: len(pages[k]), place] >= 0.5
        return out


def taught_labels(blocks: list[Block]) -> np.ndarray:
    """Labels by the elements a block stands in; without any main element, by its length and links."""
    def names(block: Block) -> set[str]:
        return {n for tag, more in block.path for n in (tag, *more)}

    found = [names(b) for b in blocks]
    marked = any(n & MAIN_NAMES for n in found)
    return np.array([
        not n & OTHER_NAMES and (bool(n & MAIN_NAMES) if marked else len(b.text) >= 60 and 3 * b.linked < len(b.text) and "header" not in n)
        for b, n in zip(blocks, found, strict=True)
    ], dtype=np.float32)


# Other shapes that parts of pages have.
_ARTICLES: list[Element] = [("article", ()), ("main", ()), ("div", ("content",)), ("div", ("post",)), ("section", ("article",)),
                            ("div", ("entry-content", "entry", "content")), ("div", ("story",)), ("div", ("main",))]
_MENUS: list[Element] = [("nav", ()), ("div", ("menu",)), ("ul", ("navigation",)), ("div", ("navbar",)), ("header", ()),
                         ("div", ("breadcrumbs",)), ("div", ("toolbar",))]
_FOOTERS: list[Element] = [("footer", ()), ("div", ("footer",)), ("div", ("site-footer", "site", "footer")), ("div", ("copyright",))]
_ADVERTS: list[Element] = [("div", ("ad",)), ("div", ("ads",)), ("div", ("advert",)), ("aside", ("promo",)), ("div", ("sponsored",)),
                           ("div", ("banner",)), ("aside", ()), ("div", ("advertisement",))]
_EXTRAS: list[Element] = [("section", ("comments",)), ("div", ("comments",)), ("ol", ("commentlist",)), ("div", ("comment",)),
                          ("aside", ()), ("div", ("sidebar",)), ("div", ("cookie",)), ("div", ("notice",)), ("form", ()),
                          ("div", ("newsletter",)), ("div", ("related",)), ("div", ("share",)), ("div", ("widget",)),
                          ("header", ()), ("div", ("popup",)), ("div", ("subscribe",)), ("div", ("consent",))]


def variant(blocks: list[Block], labels: np.ndarray, rng) -> tuple[list[Block], np.ndarray]:
    """The page with other elements for its parts, and parts added that are no main text."""
    def pick(some: list[Element]) -> Element:
        return some[int(rng.integers(len(some)))]

    swap = {"article": pick(_ARTICLES), "nav": pick(_MENUS), "footer": pick(_FOOTERS), "div": pick(_ADVERTS)}
    out = [
        Block(b.text, nested(swap.get(e[0], e) if e[0] != "div" or set(e[1]) & OTHER_NAMES else e for e in b.path), b.linked)
        for b in blocks
    ]
    marks = list(labels)
    if blocks:
        for _ in range(int(rng.integers(0, 4))):
            extra, inner = pick(_EXTRAS), [("p", ()), ("div", ()), ("li", ()), ("h3", ())][int(rng.integers(4))]
            at = int(rng.integers(0, len(out) + 1))
            outer = out[min(at, len(out) - 1)].path if rng.random() < 0.4 else out[0].path[:2]
            outer = tuple(e for e in outer if e[0] != "p")
            for _ in range(int(rng.integers(1, 4))):
                text = blocks[int(rng.integers(len(blocks)))].text
                out.insert(at, Block(text, nested((*outer, extra, inner)), 0 if rng.random() < 0.7 else len(text)))
                marks.insert(at, 0.0)
    return out, np.array(marks, np.float32)


def fit(pages: DataFrame, training_pages: int = TRAINING_PAGES, variants: int = 3) -> Labeller:
    """A labeller from a bounded sample of (page_id, html). No pages give an untrained one."""
    place = F.pmod(F.xxhash64(F.col("page_id").cast("string")), F.lit(1 << 20)) / F.lit(1 << 20)
    some = pages.where(F.col("html").isNotNull() & (F.length("html") <= TRAINING_CHARS) & (place * pages.count() < training_pages))
    sample = sorted(r["html"] for r in some.select("html").limit(2 * training_pages).collect())
    rng, vectors = np.random.default_rng(5), Vectors()
    x, y = [], []
    for page in sample:
        blocks = blocks_of(page)
        if blocks:
            labels = taught_labels(blocks)
            for own, marks in ((blocks, labels), *(variant(blocks, labels, rng) for _ in range(variants))):
                x.append(vectors.page(own))
                y.append(marks)
    labeller = Labeller()
    if x:
        labeller.train(x, y)
    return labeller


def extractor(pages: DataFrame, labeller: Labeller):
    """A function from a column of HTML to a column of main texts."""
    shared = pages.sparkSession.sparkContext.broadcast(labeller)

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vectors = Vectors()
        for pages in batches:
            cut = [blocks_of(p) for p in pages]
            marks = shared.value.label([vectors.page(b) for b in cut])
            yield pd.Series([
                "\n".join(b.text for b, m in zip(blocks, main, strict=True) if m) for blocks, main in zip(cut, marks, strict=True)
            ], dtype=object)

    return extract


def main_text(pages: DataFrame, training: DataFrame | None = None, page: Column | None = None, **options) -> DataFrame:
    """``pages`` with the column text: the blocks of the main text, in page order, one per line.

    Null or empty html, and pages without main text, give the empty text. A page that breaks off in a tag is read up to
    there. Equal pages get equal texts. Other columns pass through; a column ``text`` is replaced. An empty table
    gives an empty result.
    """
    extract = extractor(pages, fit(pages if training is None else training, **options))
    return pages.withColumn("text", F.coalesce(extract(F.col("html") if page is None else page), F.lit("")))
