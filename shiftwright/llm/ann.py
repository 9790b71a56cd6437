"""Nearest neighbours by inner product: vantage-point trees per shard.

The largest inner product is the smallest distance once every vector gets one more component, which brings all to the
same length, and queries get a zero there. Each shard of vectors gets a tree over these points: a node has a vantage
point, and its two children hold the points nearer and farther than the median distance, with the range of distances
of each. By the triangle inequality a child can be left out if its range is farther from the query's distance to the
vantage point than the query's k-th best so far. ``factor`` divides that best radius: with 1 the search is exact, a
larger factor leaves out more.

Copies of a vector are one point: a query's answer has at most k of them, so a point keeps its k + 1 smallest ids.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shiftwright.session import cut

SHARD_ROWS = 16_384
QUERY_ROWS = 2_048
LEAF = 256
# Measured on the given vectors, where it still finds every neighbour; see the README.
FACTOR = 1.0


def usable(embedding: Column) -> Column:
    """Not null or empty, no null or non-finite component, not all zero."""
    value = F.transform(embedding, lambda x: x.cast("double"))
    odd = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & (F.size(embedding) > 0) & ~F.coalesce(odd, F.lit(True)) & F.exists(value, lambda x: x != 0)


def inner(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, the same for equal rows wherever they stand."""
    return (rows * query).sum(axis=1)


class Tree:
    """A vantage-point tree over one shard's distinct vectors, in arrays."""

    def __init__(self, vectors: np.ndarray, ids: list[np.ndarray], seed: int = 0):
        self.vectors, self.ids = vectors, ids
        norms = (vectors**2).sum(axis=1)
        self.points = np.hstack([vectors, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]])
        self.longest = float(norms.max())
        rng = np.random.default_rng(seed)
        self.order = np.arange(len(vectors))
        # vantage point, start and end of the leaf or -1, children and their ranges of distances
        self.nodes: list[tuple] = []
        self._build(0, len(vectors), rng)

    def _build(self, start: int, end: int, rng) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if end - start <= LEAF:
            self.nodes[at] = (-1, start, end)
            return at
        pick = int(rng.integers(start, end))
        vantage = self.order[pick]
        part = self.order[start:end]
        gaps = np.sqrt(((self.points[part] - self.points[vantage]) ** 2).sum(axis=1))
        by_gap = np.argsort(gaps, kind="stable")
        part, gaps = part[by_gap], gaps[by_gap]
        self.order[start:end] = part
        middle = (end - start) // 2
        near = self._build(start, start + middle, rng)
        far = self._build(start + middle, end, rng)
        self.nodes[at] = (int(vantage), near, far, gaps[0], gaps[middle - 1], gaps[middle], gaps[-1])
        return at

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float) -> tuple[list, list]:
        """The k nearest of every query: ids and scores, by score and then by id."""
        padded = np.hstack([queries, np.zeros((len(queries), 1))])
        lengths = (queries**2).sum(axis=1)
        # The best inner products, ascending; one more than k, as the query's own vector may be among them.
        best = np.full((len(queries), k + 1), -np.inf)
        found: list[list[np.ndarray]] = [[] for _ in queries]

        def visit(node: int, asked: np.ndarray) -> None:
            kind = self.nodes[node]
            if kind[0] < 0:
                self._leaf(kind[1], kind[2], asked, queries, best, found)
                return
            vantage, near, far, low, inner_edge, outer_edge, high = kind
            gap = np.sqrt(((padded[asked] - self.points[vantage]) ** 2).sum(axis=1))
            first_near = gap <= (inner_edge + outer_edge) / 2
            for child, edges, mine in (
                (near, (low, inner_edge), first_near), (far, (outer_edge, high), ~first_near),
                (far, (outer_edge, high), first_near), (near, (low, inner_edge), ~first_near),
            ):
                # The radius of the k-th best by now; rounding may not leave out a tie.
                radius = np.sqrt(np.maximum(lengths[asked] + self.longest - 2 * best[asked, 0], 0)) / factor + 1e-9
                bound = np.maximum(np.maximum(edges[0] - gap, gap - edges[1]), 0)
                go = mine & (bound <= radius)
                if go.any():
                    visit(child, asked[go])

        visit(0, np.arange(len(queries)))
        return self._ranked(queries, own, found, best, k)

    def _leaf(self, start, end, asked, queries, best, found) -> None:
        points = self.order[start:end]
        products = queries[asked] @ self.vectors[points].T
        for row, q in enumerate(asked.tolist()):
            new = products[row]
            at = np.flatnonzero(new >= best[q, 0] - 1e-9)
            if len(at):
                found[q].append(points[at])
                best[q] = np.sort(np.concatenate([best[q], new[at]]))[-best.shape[1] :]

    def _ranked(self, queries, own, found, best, k) -> tuple[list, list]:
        ids, scores = [], []
        for q, parts in enumerate(found):
            points = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            exact = inner(self.vectors[points], queries[q])
            keep = exact >= best[q, 0] - 1e-9
            points, exact = points[keep], exact[keep]
            names = [self.ids[p][self.ids[p] != own[q]] for p in points]
            flat = np.concatenate(names) if names else np.zeros(0, np.int64)
            each = np.repeat(exact, [len(x) for x in names]) if names else np.zeros(0)
            top = np.lexsort((flat, -each))[:k]
            ids.append(flat[top])
            scores.append(each[top])
        return ids, scores

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(
            out, vectors=self.vectors, points=self.points, order=self.order, longest=self.longest,
            ids=np.concatenate(self.ids), ends=np.cumsum([len(x) for x in self.ids]),
            nodes=np.array([n + (0,) * (7 - len(n)) for n in self.nodes], np.float64),
        )
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        kept = np.load(io.BytesIO(data))
        tree = cls.__new__(cls)
        tree.vectors, tree.points, tree.order = kept["vectors"], kept["points"], kept["order"]
        tree.longest = float(kept["longest"])
        tree.ids = np.split(kept["ids"], kept["ends"][:-1])
        tree.nodes = [
            (-1, int(n[1]), int(n[2])) if n[0] < 0 else (int(n[0]), int(n[1]), int(n[2]), *n[3:]) for n in kept["nodes"]
        ]
        return tree


def build_index(vectors: DataFrame, k: int, shard_rows: int) -> DataFrame:
    """(dim, shard, tree): every vector of (vec_id, embedding) in one shard's tree.

    Copies of a vector are put together first, by rank within the vector; only their k + 1 smallest ids go on.
    """
    copies = W.partitionBy("key").orderBy("vec_id")
    kept = (
        vectors.withColumn("key", F.col("embedding")).withColumn("rank", F.row_number().over(copies))
        .where(F.col("rank") <= k + 1).groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        .select(F.size("key").alias("dim"), F.col("key").alias("embedding"), "ids")
    )
    points = cut(kept, "points")
    shards = points.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ids", key=lambda c: c.map(lambda x: x[0]))
        tree = Tree(np.stack(rows["embedding"].to_list()), [np.asarray(x) for x in rows["ids"]])
        return pd.DataFrame({"dim": [rows["dim"].iloc[0]], "shard": [rows["shard"].iloc[0]], "tree": [tree.dump()]})

    return (
        points.join(shards, "dim")
        .withColumn("shard", F.pmod(F.xxhash64("embedding"), F.col("shards")).cast("int"))
        .select("dim", "shard", "embedding", "ids")
        .groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, tree binary")
    )


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = FACTOR, shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every query of (vec_id, embedding) its k nearest other rows.

    Vectors that are null, empty or zero, or hold a null or non-finite component, take no part on either side; neither
    do null ids. Vectors of another length are no candidates. Fewer than k candidates are all returned, ties go to the
    smaller vec_id. Rows that repeat an id and a vector are one; a query's own id is never its neighbour. Empty tables
    give an empty result.
    """
    def clean(rows: DataFrame) -> DataFrame:
        return rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("embedding"),
        )

    index = cut(build_index(clean(vectors).distinct(), k, shard_rows), "index")
    asked = clean(queries).distinct().withColumn("dim", F.size("embedding"))
    blocks = asked.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("blocks"))
    dealt = (
        asked.join(blocks, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
        .join(index.select("dim", "shard"), "dim")
        .select("dim", "shard", "block", F.col("vec_id").alias("query_id"), "embedding")
    )
    trees = index.join(blocks, "dim").select(
        F.col("dim").alias("tree_dim"), F.col("shard").alias("tree_shard"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("tree_block"), "tree",
    )

    def search(some: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        if some.empty or tree.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
                {"query_id": "int64", "vec_id": "int64", "score": "float64"}
            )
        names = some["query_id"].to_numpy()
        ids, scores = Tree.load(tree["tree"].iloc[0]).search(np.stack(some["embedding"].to_list()), names, k, factor)
        return pd.DataFrame({
            "query_id": np.repeat(names, [len(x) for x in ids]), "vec_id": np.concatenate(ids),
            "score": np.concatenate(scores),
        })

    found = dealt.groupBy("dim", "shard", "block").cogroup(trees.groupBy("tree_dim", "tree_shard", "tree_block")).applyInPandas(
        search, "query_id long, vec_id long, score double"
    )
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
