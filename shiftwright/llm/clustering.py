"""Clusters by centroids in whole numbers, with ns-bounds.

Vectors are packed into blocks of rows once. A block keeps, for each of its vectors and each centroid, the distance when
it was last evaluated and the round of that. The history of all centroids is kept, so that a stored distance is loosened
by the norm of the centroid's total displacement since that round, and not by the sum of its moves. A vector whose
loosened bounds leave no doubt about its cluster is not looked at again; for the others the distance to their own
centroid is evaluated anew and then, where bounds still fail, those to the centroids concerned, in whole numbers.

A round reads the blocks, writes them with their new bounds and the sums of their clusters to the shared folder, and
sums the clusters; blocks are not exchanged. The centroids and their history are of a fixed size: they travel with the
tasks, and only sums of clusters come back to the driver. The blocks of a round are deleted when the next are written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftwright.llm.common import delete_folder
from shiftwright.session import shared_path

BLOCK_ROWS = 512
# Larger components count as these, so that squared distances of vectors of 64 components fit into 64 bits.
LIMIT = 1 << 27
# Below it, squared distances by matrix products are whole numbers below 2**53.
EXACT = 1 << 20
# Room that bounds leave for rounding.
SLACK = 1e-9


def whole_numbers(embedding: Column, scale: int) -> Column:
    """floor(scale * x) of every component, within LIMIT."""
    return F.transform(embedding, lambda x: F.floor(
        F.greatest(F.least(x.cast("double") * scale, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("long"))


def usable(embedding: Column, dim: int) -> Column:
    """Exactly ``dim`` components, none null or non-finite."""
    value = F.transform(embedding, lambda x: x.cast("double"))
    odd = F.exists(value, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    return F.coalesce((F.size(embedding) == dim) & ~odd, F.lit(False))


def squares(rows: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Squared distances, exact."""
    gap = rows - centroid
    if len(gap) and max(int(gap.max()), -int(gap.min())) < EXACT:
        gap = gap.astype(np.float64)
        return np.einsum("nd,nd->n", gap, gap).astype(np.int64)
    return (gap * gap).sum(axis=1)


def moved(history: np.ndarray) -> np.ndarray:
    """(rounds, k): how far each centroid is now from where it was in each round."""
    return np.sqrt(((history[-1:] - history).astype(np.float64) ** 2).sum(axis=2))


def reassign(
    rows: np.ndarray, own: np.ndarray, last: np.ndarray, when: np.ndarray, history: np.ndarray, shift: np.ndarray,
) -> int:
    """Move every row to its nearest centroid; returns how many distances were evaluated.

    ``own`` (n), ``last`` (n, k) and ``when`` (n, k) are the cluster, the distances and the rounds in which they were
    evaluated; they are changed in place. Rounds below 0 mean never.
    """
    now, k = len(history) - 1, history.shape[1]
    every, nearest = np.arange(len(rows)), history[-1]
    loose = shift[np.maximum(when, 0), np.arange(k)]
    lower = np.where(when < 0, -1.0, last - loose) * (1 - SLACK) - SLACK
    lower[every, own] = np.inf
    upper = np.where(when[every, own] < 0, np.inf, last[every, own] + loose[every, own]) * (1 + SLACK) + SLACK
    some = np.flatnonzero(lower.min(axis=1) <= upper)
    count = 0

    def evaluate(at: np.ndarray, cluster: int) -> np.ndarray:
        found = squares(rows[at], nearest[cluster])
        last[at, cluster], when[at, cluster] = np.sqrt(found), now
        return found

    # The own centroid first: with its distance known, most of the bounds that failed hold again.
    best = np.full(len(rows), np.iinfo(np.int64).max)
    for c in range(k):
        at = some[own[some] == c]
        best[at] = evaluate(at, c)
        count += len(at)
    upper[some] = last[some, own[some]] * (1 + SLACK) + SLACK
    fails = lower[some] <= upper[some][:, None]
    winner = own[some].copy()
    for c in range(k):
        place = np.flatnonzero(fails[:, c])
        at = some[place]
        found = evaluate(at, c)
        count += len(at)
        nearer = (found < best[at]) | ((found == best[at]) & (c < winner[place]))
        best[at[nearer]] = found[nearer]
        winner[place[nearer]] = c
    own[some] = winner
    return count


_BLOCK = "ids array<{id}>, rows binary, own binary, last binary, at binary, sums array<long>, counts array<long>, evaluated long"


def _totals(rows: np.ndarray, own: np.ndarray, k: int) -> tuple[list, list]:
    sums = np.zeros((k, rows.shape[1]), np.int64)
    for c in range(k):
        sums[c] = rows[own == c].sum(axis=0)
    return sums.ravel().tolist(), np.bincount(own, minlength=k).tolist()


def _pack(dim: int, k: int, id_type: pa.DataType):
    """Blocks of BLOCK_ROWS rows from (vec_id, x); nothing is known of distances yet."""
    def block(ids: list, rows: np.ndarray) -> pa.RecordBatch:
        n = len(rows)
        return pa.RecordBatch.from_arrays([
            pa.array([ids], pa.list_(id_type)), pa.array([rows.astype("<i4").tobytes()]), pa.array([np.zeros(n, "<i2").tobytes()]),
            pa.array([np.zeros((n, k), "<f8").tobytes()]), pa.array([np.full((n, k), -1, "<i2").tobytes()]),
            pa.array([[0] * (k * dim)], pa.list_(pa.int64())), pa.array([[0] * k], pa.list_(pa.int64())), pa.array([0], pa.int64()),
        ], ["ids", "rows", "own", "last", "at", "sums", "counts", "evaluated"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        parts: list = []
        for batch in batches:
            ids += batch["vec_id"].to_pylist()
            parts.append(batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
            if len(ids) >= BLOCK_ROWS:
                rows = np.concatenate(parts)
                whole = len(ids) // BLOCK_ROWS * BLOCK_ROWS
                for i in range(0, whole, BLOCK_ROWS):
                    yield block(ids[i : i + BLOCK_ROWS], rows[i : i + BLOCK_ROWS])
                ids, parts = ids[whole:], [rows[whole:]]
        if ids:
            yield block(ids, np.concatenate(parts))

    return pack


def _round(history: np.ndarray):
    """Blocks with new bounds, clusters and sums."""
    k, dim = history.shape[1:]
    shift = moved(history)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for n, raw, own, last, at in zip(*(batch[c] for c in ("ids", "rows", "own", "last", "at")), strict=True):
                size = len(n.values)
                rows = np.frombuffer(raw.as_py(), "<i4").reshape(size, dim).astype(np.int64)
                own = np.frombuffer(own.as_py(), "<i2").astype(np.int64)
                last = np.frombuffer(last.as_py(), "<f8").reshape(size, k).copy()
                at = np.frombuffer(at.as_py(), "<i2").reshape(size, k).copy()
                count = reassign(rows, own, last, at, history, shift)
                values = (raw.as_py(), own.astype("<i2").tobytes(), last.tobytes(), at.tobytes(), *_totals(rows, own, k), count)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            types = [*[pa.binary()] * 4, *[pa.list_(pa.int64())] * 2, pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch["ids"], *(pa.array(c, t) for c, t in zip(out, types, strict=True))],
                ["ids", "rows", "own", "last", "at", "sums", "counts", "evaluated"],
            )

    return step


def _unpack(centroids: np.ndarray, id_type: pa.DataType):
    """(vec_id, cluster, distance) of every row of the blocks."""
    dim = centroids.shape[1]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, raw, own in zip(batch["ids"], batch["rows"], batch["own"], strict=True):
                own = np.frombuffer(own.as_py(), "<i2").astype(np.int32)
                rows = np.frombuffer(raw.as_py(), "<i4").reshape(len(own), dim).astype(np.int64)
                distance = np.zeros(len(own), np.int64)
                for c in np.unique(own):
                    distance[own == c] = squares(rows[own == c], centroids[c])
                yield pa.RecordBatch.from_arrays(
                    [ids.values.cast(id_type), pa.array(own), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return rows_of


def cluster(
    vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: str = "3:",
    report: list | None = None,
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) for the vectors of (vec_id, embedding).

    Kept are vectors with exactly ``dim`` components, none null or non-finite; components become floor(scale * x), and
    such beyond 2**27 count as that. Centroids begin as the k kept vectors whose ids have the smallest SHA-256 behind
    ``seed``, ties broken by the vector; with fewer kept vectors there are as many centroids. A round assigns every
    vector to the nearest centroid, ties to the smaller number, and replaces each centroid that has vectors by the floor
    of their mean; a last assignment follows. ``distance`` is squared. Rows that repeat an id or a vector are vectors of
    their own; a null id counts as the text ``null``. Sums beyond 64 bits are null. An empty table gives an empty
    result. ``report`` gets, for each assignment, how many distances were evaluated.
    """
    spark = vectors.sparkSession
    kept = vectors.where(usable(F.col("embedding"), dim)).select("vec_id", whole_numbers(F.col("embedding"), scale).alias("x"))
    key = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))).cast("binary"), 256)
    first = kept.orderBy(key, "x").limit(k).select("x").collect()
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    result = f"vec_id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    if not first:
        return spark.createDataFrame([], result)
    history = np.array([[r["x"] for r in first]], np.int64)
    k = history.shape[1]
    arrow_id = spark.createDataFrame([], f"vec_id {id_type}").toArrow().schema.field("vec_id").type
    types = _BLOCK.format(id=id_type)
    blocks, folder = kept.mapInArrow(_pack(dim, k, arrow_id), types), None
    for turn in range(rounds + 1):
        path = shared_path(spark, "blocks")
        blocks.mapInArrow(_round(history), types).write.parquet(path)
        blocks = spark.read.schema(types).parquet(path)
        if folder:
            delete_folder(spark, folder)
        folder = path
        if report is not None:
            report.append(blocks.agg(F.sum("evaluated")).first()[0])
        if turn == rounds:
            break
        sums = blocks.select(F.posexplode(F.concat("counts", "sums")).alias("at", "n")).groupBy("at").agg(
            F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()
        flat = {r["at"]: int(r["n"]) for r in sums}
        after = history[-1].copy()
        for c in range(k):
            if flat[c]:
                after[c] = [flat[k + c * dim + i] // flat[c] for i in range(dim)]
        history = np.concatenate([history, after[None]])
    found = blocks.select("ids", "rows", "own").mapInArrow(
        _unpack(history[-1], arrow_id), f"vec_id {id_type}, cluster int, distance long")
    # One row for each of the k centroids.
    each = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()
    sums = {r["cluster"]: int(r["n"]) for r in each}
    total = sum(sums.values())
    totals = spark.createDataFrame(
        [(c, fits(n), fits(total), history[-1][c].tolist()) for c, n in sums.items()],
        "cluster int, cluster_inertia long, inertia long, centroid array<long>",
    )
    return found.join(F.broadcast(totals), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def fits(n: int) -> int | None:
    return n if -(1 << 63) <= n < 1 << 63 else None
