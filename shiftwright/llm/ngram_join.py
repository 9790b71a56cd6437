"""Near duplicates by the Jaccard similarity of word n-gram sets: a prefix-tree join.

All sets follow one global order: rare n-grams first, by a sketch of how often each occurs in all documents. Two
similar sets share an n-gram among the first few of each (the prefix), at places that leave enough to share behind.

1. Documents with equal sets are one class from the start.
2. Classes that share a prefix n-gram, of fitting size, position and bit signature, are candidates. A signature has the
   parity of the set's hashes in each of its bits, so it differs in at most as many bits as the sets differ in members:
   it drops no similar pair. Each group of classes yields a star for each of its clusters, never all its pairs.
3. Clusters of candidates, cut into blocks of bounded size, are joined by prefix trees, which decide by exact overlap.

A task never holds more than two blocks of a group: larger groups are dealt out by pairs of blocks.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftwright.llm.common import hash_bitmap, hash_shingles, hash_words, marked, with_row_key, words_of
from shiftwright.llm.components import components
from shiftwright.session import cut

# Counters of the frequency sketch; it only sets the order, so its size has no bearing on results.
SKETCH_CELLS = 1 << 18
SIGNATURE_BITS = 512
POSTING_BLOCK = 20_000
SET_BLOCK = 500


def ngram_set(text: str | None, size: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``size`` words; of fewer words, but not none, the whole as one."""
    hashed = hash_words(words_of(text))
    return np.unique(hash_shingles(hashed, min(size, len(hashed)))) if len(hashed) else np.zeros(0, np.uint64)


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SKETCH_CELLS - 1)).astype(np.int64)


def in_order(hashes: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The set in the global order: by the sketch's count, then by hash."""
    return hashes[np.lexsort((hashes, sketch[_cells(hashes)]))]


def needed(n1, n2, percent: int):
    """The smallest overlap with which sets of these sizes are similar: 100 I >= percent (n1 + n2 - I)."""
    return -(-percent * (n1 + n2) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    """So many first members of a set meet those of every similar set."""
    return n + percent * -n // 100 + 1


def signature(hashes: np.ndarray) -> bytes:
    """The parity of the set's members in each of its bits: SIGNATURE_BITS, or twice, four times ... as many.

    There is at least one bit for two members, so that unlike sets differ in more bits than similar ones may.
    """
    bits = SIGNATURE_BITS
    while 2 * bits < len(hashes):
        bits *= 2
    count = np.bincount(((hashes >> np.uint64(20)) % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8)).tobytes()


def fold(sign: bytes, size: int) -> np.ndarray:
    """The signature as 64-bit words, brought to ``size`` bytes: the parity in fewer bits."""
    return np.bitwise_xor.reduce(np.frombuffer(sign, np.uint64).reshape(-1, size // 8), axis=0)


class Signatures:
    """Signatures of some rows, of the same size for a first look and whole for a second."""

    def __init__(self, whole: list[bytes]):
        self.whole = whole
        self.short = np.stack([fold(x, SIGNATURE_BITS // 8) for x in whole])

    def part(self, a: int, b: int) -> Signatures:
        out = Signatures.__new__(Signatures)
        out.whole, out.short = self.whole[a:b], self.short[a:b]
        return out

    def differ(self, a: int, b: int) -> int:
        x, y = self.whole[a], self.whole[b]
        size = min(len(x), len(y))
        return int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum(dtype=np.int64))


def _set_rows(docs: DataFrame, size: int) -> DataFrame:
    """kind 0: a document's set size and set id. kind 1: counts of a task for cells of the sketch."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH_CELLS, np.int64)
        for batch in batches:
            sizes, ids, cells = [], [], []
            for text in batch["text"]:
                found = ngram_set(text.as_py(), size)
                cells.append(_cells(found))
                sizes.append(len(found))
                ids.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
            count = len(sizes)
            if count:
                sketch += np.bincount(np.concatenate(cells), minlength=SKETCH_CELLS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(count, np.int32)), batch["_k1"], batch["_k2"], batch["doc_id"].cast(pa.int64()),
                 pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], names,
            )
        used = np.flatnonzero(sketch)
        for i in range(0, len(used), 50_000):
            cells = used[i : i + 50_000]
            none = pa.nulls(len(cells), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(len(cells), np.int32)), pa.array(cells), none, none, pa.array(sketch[cells]),
                 pa.nulls(len(cells), pa.binary())], names,
            )

    names = ["kind", "_k1", "_k2", "doc_id", "n", "set_id"]
    return docs.select("_k1", "_k2", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        rows, "kind int, _k1 long, _k2 long, doc_id long, n long, set_id binary"
    )


def _read_sketch(cells: DataFrame) -> np.ndarray:
    """At most ``SKETCH_CELLS`` counts reach the driver."""
    summed = cells.groupBy("_k1").agg(F.sum("n").alias("n")).toArrow()
    sketch = np.zeros(SKETCH_CELLS, np.int64)
    sketch[summed["_k1"].to_numpy()] = summed["n"].to_numpy()
    return sketch


def _prefixes(docs: DataFrame, size: int, percent: int, sketch) -> DataFrame:
    """(_k1, _k2, sign, prefix) of every document whose set is not empty."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs, prefixes = [], []
            for text in batch["text"]:
                found = ngram_set(text.as_py(), size)
                signs.append(signature(found))
                prefixes.append(in_order(found, sketch.value)[: prefix_length(len(found), percent)].view(np.int64) if len(found) else [])
            yield pa.RecordBatch.from_arrays(
                [batch["_k1"], batch["_k2"], pa.array(signs, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))],
                ["_k1", "_k2", "sign", "prefix"],
            )

    return docs.select("_k1", "_k2", "text").mapInArrow(rows, "_k1 long, _k2 long, sign binary, prefix array<long>")


def _in_block_pairs(rows: DataFrame, key: str, count: str, block: int) -> DataFrame:
    """Deal rows of a key to (key, i, j): each row's block meets every block of its key once, and itself in (i, i).

    Keys with at most ``block`` rows have one block, so their rows come once.
    """
    blocks = F.ceil(F.col(count) / block).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    return (
        rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", count)
    )


class Forest:
    """Union of numbered members; every cluster's root is its smallest member."""

    def __init__(self, count: int):
        self.root = np.arange(count)

    def join(self, member: int, others: np.ndarray) -> None:
        roots = np.unique(self.root[np.append(others, member)])
        if len(roots) > 1:
            self.root[np.isin(self.root, roots)] = roots[0]

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """Edges from each root to its other members."""
        members = np.flatnonzero(self.root != np.arange(len(self.root)))
        return self.root[members], members


def may_be_similar(a: np.ndarray, b: np.ndarray, n: np.ndarray, pos: np.ndarray, signs: Signatures, percent: int) -> np.ndarray:
    """Which pairs of rows that meet at a prefix n-gram pass the bounds of size, position and signature."""
    need = needed(n[a], n[b], percent)
    spare = n[a] + n[b] - 2 * need
    ok = (np.minimum(n[a], n[b]) >= need) & (np.minimum(n[a] - pos[a], n[b] - pos[b]) >= need)
    ok &= np.bitwise_count(signs.short[a] ^ signs.short[b]).sum(axis=-1, dtype=np.int64) <= spare
    for k in np.flatnonzero(ok & (np.minimum(n[a], n[b]) > 2 * SIGNATURE_BITS)).tolist():
        ok[k] = signs.differ(a[k], b[k]) <= spare[k]
    return ok


def candidate_stars(n: np.ndarray, pos: np.ndarray, signs: Signatures, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Clusters of the classes of one prefix n-gram that may be similar. Rows come in the order of n.

    A class is compared only with those outside its cluster.
    """
    forest = Forest(len(n))
    for i in range(1, len(n)):
        near = np.arange(np.searchsorted(n[:i], -(-percent * n[i] // 100)), i)
        # The last ones are likely to be of the same cluster; when they are, the rest of it needs no look.
        for part in (near[-8:], near[:-8]):
            part = part[forest.root[part] != forest.root[i]]
            if len(part):
                part = part[may_be_similar(part, np.full(len(part), i), n, pos, signs, percent)]
            if len(part):
                forest.join(i, part)
    return forest.stars()


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole groups of rows with equal keys, and where groups begin and end; the input is sorted by the keys."""
    def split(table: pa.Table) -> list[int]:
        codes = np.stack([table[k].to_numpy() for k in keys], axis=1)
        return [0, *(np.flatnonzero((codes[1:] != codes[:-1]).any(axis=1)) + 1).tolist(), len(codes)]

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and all(batch[k][batch.num_rows - 1] == held[0][k][0] for k in keys):
            held.append(batch)  # a large group goes on
            continue
        table = pa.Table.from_batches([*held, batch])
        cuts = split(table)
        if len(cuts) > 2:
            yield table.slice(0, cuts[-2]).combine_chunks(), cuts[:-1]
        held = table.slice(cuts[-2]).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, split(table)


def _edges_out(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def candidates(postings: DataFrame, percent: int) -> DataFrame:
    """(a, b): stars of candidate classes from postings (token, i, j, node, n, pos, sign) sorted by token, i, j, n."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in _whole_groups(batches, ["token", "i", "j"]):
            node, n, pos = (table[c].to_numpy() for c in ("node", "n", "pos"))
            signs = Signatures(table["sign"].to_pylist())
            begins, ends = np.array(cuts[:-1]), np.array(cuts[1:])
            # Most groups are pairs; they are looked at together.
            one = begins[ends - begins == 2]
            one = one[may_be_similar(one, one + 1, n, pos, signs, percent)]
            out = [(node[one], node[one + 1])]
            for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
                if b - a > 2:
                    root, member = candidate_stars(n[a:b], pos[a:b], signs.part(a, b), percent)
                    if len(root):
                        out.append((node[a + root], node[a + member]))
            yield _edges_out(out)

    return postings.mapInArrow(rows, "a long, b long")


class Trie:
    """A prefix tree of globally ordered sets. Runs of members without a branch are one edge."""

    def __init__(self, sets: list[np.ndarray], order: list[int]):
        self.sets = sets
        self.root = self._node(order, 0)

    def _node(self, order: list[int], depth: int) -> tuple:
        """(members of the edge, sets that end, children, shortest, longest) of the sets in ``order``, alike before depth."""
        sets = self.sets
        first, last = sets[order[0]], sets[order[-1]]
        end = min(len(first), len(last))
        alike = first[depth:end] != last[depth:end]
        stop = depth + int(alike.argmax()) if alike.any() else end
        ends = [k for k in order if len(sets[k]) == stop]
        rest = [k for k in order if len(sets[k]) > stop]
        children, at = [], 0
        while at < len(rest):
            to = at
            while to < len(rest) and sets[rest[to]][stop] == sets[rest[at]][stop]:
                to += 1
            children.append(self._node(rest[at:to], stop))
            at = to
        sizes = [len(sets[k]) for k in order]
        return first[depth:stop], ends, children, min(sizes), max(sizes)


def trie_join(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the clusters of similar sets, by exact overlap.

    Members are ranks in the global order. The walk keeps the overlap of the path with every set, so sets with a
    common beginning share that work. A subtree is left when the sets that can still reach the overlap they need, with
    what is left of both sides, are all of one cluster already.
    """
    sys.setrecursionlimit(20_000)
    count = len(sets)
    forest = Forest(count)
    sizes = np.array([len(s) for s in sets], np.int64)
    holders: dict[int, list[int]] = {}
    for k, members in enumerate(sets):
        for member in members.tolist():
            holders.setdefault(member, []).append(k)
    lists = {member: np.array(ks) for member, ks in holders.items()}
    overlap = np.zeros(count, np.int64)

    def walk(node: tuple, depth: int) -> None:
        members, ends, children, shortest, longest = node
        met = [lists[m] for m in members.tolist()]
        step = np.bincount(np.concatenate(met), minlength=count) if met else 0
        np.add(overlap, step, out=overlap)
        depth += len(members)
        for k in ends:
            linked = np.flatnonzero(overlap >= needed(sizes[k], sizes, percent))
            forest.join(k, linked)
        if children and (forest.root != forest.root[0]).any():
            # What is left of both sides bounds the overlap; a set has at most its size less what it shared.
            reach = overlap + np.minimum(longest - depth, sizes - overlap)
            alive = forest.root[reach >= needed(shortest, sizes, percent)]
            if (alive != alive[:1]).any():
                for child in children:
                    walk(child, depth)
        np.subtract(overlap, step, out=overlap)

    walk(Trie(sets, sorted(range(count), key=lambda k: sets[k].astype(">u4").tobytes())).root, 0)
    return forest.stars()


def _ordered_sets(docs: DataFrame, size: int, sketch, bits) -> DataFrame:
    """(_k1, _k2, members) of the rows whose key is marked: the whole set in the global order."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.take(pa.array(marked(batch["_k2"].to_numpy(), bits.value)))
            members = [in_order(ngram_set(t.as_py(), size), sketch.value).view(np.int64) for t in wanted["text"]]
            yield pa.RecordBatch.from_arrays(
                [wanted["_k1"], wanted["_k2"], pa.array(members, pa.list_(pa.int64()))], ["_k1", "_k2", "members"]
            )

    return docs.select("_k1", "_k2", "text").mapInArrow(rows, "_k1 long, _k2 long, members array<long>")


def links(blocks: DataFrame, percent: int, sketch) -> DataFrame:
    """(a, b): stars of exactly similar classes from (cluster, i, j, node, members) sorted by cluster, i, j."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in _whole_groups(batches, ["cluster", "i", "j"]):
            nodes = table["node"].to_numpy()
            for a, b in zip(cuts, cuts[1:], strict=False):
                # Rows that repeat id and text come as often.
                node, place = np.unique(nodes[a:b], return_index=True)
                members = [np.asarray(m.values).view(np.uint64) for m in table["members"].take(pa.array(a + place))]
                # Ranks in the global order within the block.
                known = in_order(np.unique(np.concatenate(members)), sketch.value)
                by_hash = np.argsort(known)
                ranked = [by_hash[np.searchsorted(known, m, sorter=by_hash)] for m in members]
                root, member = trie_join(ranked, percent)
                yield _edges_out([(node[root], node[member])])

    return blocks.mapInArrow(rows, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: _k1, _k2, doc_id, n_shingles, component_id.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; a document's set has its distinct runs of ``size``
    words, or the whole sequence if it has fewer. Documents with 100 |A and B| >= percent |A or B| are linked;
    component_id is the smallest doc_id that links lead to, its own included.

    Null or wordless texts have an empty set and are linked with nothing: their component is their own id. Null ids
    take part, but never name a component unless all its ids are null; then it is null. Rows that repeat an id are
    documents of their own texts. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    keyed = with_row_key(docs.select("doc_id", "text"))
    rows = cut(_set_rows(keyed, size), "sets")
    sketch = spark.sparkContext.broadcast(_read_sketch(rows.where("kind = 1")))
    per_doc = rows.where("kind = 0").drop("kind")
    # The row that stands for a class is the one with the smallest key.
    classes = cut(
        per_doc.where("n > 0").groupBy("set_id", "n")
        .agg(F.min("doc_id").alias("low_id"), F.min(F.struct("_k1", "_k2")).alias("key"))
        .select("set_id", "n", "low_id", "key.*", F.monotonically_increasing_id().alias("node")),
        "classes",
    )
    prefixes = (
        _prefixes(keyed, size, percent, sketch).join(classes.select("_k1", "_k2", "node", "n"), ["_k1", "_k2"])
        .dropDuplicates(["_k1", "_k2"])
    )
    stated = cut(prefixes.select("node", "n", "sign", "prefix"), "prefixes")
    postings = stated.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
    shared = postings.groupBy("token").agg(F.count(F.lit(1)).alias("of")).where("of > 1")
    dealt = _in_block_pairs(postings.join(shared, "token"), "token", "of", POSTING_BLOCK)
    signed = dealt.join(stated.select("node", "sign"), "node").select(
        "token", "i", "j", "node", F.col("n").cast("long").alias("n"), F.col("pos").cast("long").alias("pos"), "sign"
    )
    stars = candidates(
        signed.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "n", "node"), percent
    )
    clusters = components(stars).withColumnRenamed("component", "cluster")
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("of"))
    wanted = cut(
        clusters.join(sizes, "cluster").join(classes.select("node", "_k1", "_k2"), "node"), "clusters"
    )
    bits = spark.sparkContext.broadcast(hash_bitmap(wanted, "_k2"))
    sets = _ordered_sets(keyed, size, sketch, bits).join(wanted, ["_k1", "_k2"])
    blocks = _in_block_pairs(sets, "cluster", "of", SET_BLOCK).select("cluster", "i", "j", "node", "members")
    found = components(
        links(blocks.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j"), percent, sketch)
    )
    labelled = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = labelled.groupBy("component").agg(F.min("low_id").alias("component_id"))
    named = labelled.join(lowest, "component").select("set_id", "n", "component_id")
    return per_doc.join(named, ["set_id", "n"], "left").select(
        "_k1", "_k2", "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stand for their component: the one of the smallest id, and all without words.

    Of rows that repeat both id and text one stays; rows of a component without any id all stay. Null and empty texts
    have no words, so they all stay. Other columns pass through, whatever their names. An empty table stays empty.
    """
    # The caller's other columns travel as one, so that none can meet a name in use here.
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    caller = F.struct(F.lit(0).alias("no column"), *[F.col(f"`{c}`") for c in others]).alias("caller")
    found = near_duplicates(docs.select("doc_id", "text"), **options)
    keepers = found.where(
        (F.col("n_shingles") == 0) | F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id"))
    ).select("_k1", "_k2", "n_shingles").dropDuplicates(["_k1", "_k2"])
    kept = with_row_key(docs.select("doc_id", "text", caller)).join(keepers, ["_k1", "_k2"])
    out = kept.where("n_shingles > 0").dropDuplicates(["_k1", "_k2"]).unionByName(kept.where("n_shingles = 0"))
    return out.select(*[F.col(f"caller.`{c}`").alias(c) if c in others else F.col(c) for c in docs.columns])
