"""Merging state updates: last write wins, appended lists, running totals, sessions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shiftwright.session import cut


def merge_latest(updates: DataFrame, keys: list, order: list, values: list) -> DataFrame:
    """Per key the values of its last update. Partial aggregates shrink hot keys first."""
    latest = F.max_by(F.struct(*values), F.struct(*order))
    return updates.groupBy(*keys).agg(latest.alias("_v")).select(*keys, "_v.*")


# Columns in use between the steps of a prefix scan.
_PART, _RUN, _AT, _KEY = "_scan_part", "_scan_run", "_scan_at", "_scan_key"


def running_totals(df: DataFrame, keys: list, order: list, totals: dict) -> DataFrame:
    """Running sums per key in order, this row included: a prefix scan that spreads a hot key over tasks.

    Rows are dealt out in ranges of (keys, order), so that a key with many rows fills many partitions, whatever its
    rows have in common, as long as ``order`` tells them apart. Each partition is summed on its own, in one pass over
    its sorted rows, and written to the shared folder, so that all that follows reads one run of the tasks. A key that
    goes on from the partition before begins with what the earlier ones hold of it: one row for each partition comes to
    the driver for that, and one offset for each goes out. Null keys are keys; sums are whole numbers.
    """
    spark, names = df.sparkSession, list(totals)
    key = [F.col(f"`{k}`") for k in keys]
    dealt = (
        df.withColumns({f"_in_{n}": c.cast("bigint") for n, c in totals.items()})
        .repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)
        .withColumns({_PART: F.spark_partition_id(), _KEY: F.xxhash64(*key, *[k.isNull() for k in key])})
    )
    schema = StructType([*df.schema.fields]).add(_PART, "integer").add(_RUN, "long").add(_AT, "long")
    for n in names:
        schema = schema.add(f"_sum_{n}", "long")
    passed = schema.names[: len(df.columns) + 1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, run, at, carry = None, 0, 0, [0] * len(names)
        for batch in batches:
            if not batch.num_rows:
                continue
            hashes = batch[_KEY].to_numpy(zero_copy_only=False)
            begins = np.append(last is not None and hashes[0] != last, hashes[1:] != hashes[:-1])
            runs = run + np.cumsum(begins)
            starts = np.maximum.accumulate(np.where(begins, np.arange(len(hashes)), -1))
            sums = []
            for i, n in enumerate(names):
                value = batch[f"_in_{n}"].fill_null(0).to_numpy(zero_copy_only=False)
                total = np.cumsum(value)
                # Without what stood before the key's first row here; a key that goes on adds what it had.
                sums.append(total - np.where(starts >= 0, total[starts] - value[starts], -carry[i]))
                carry[i] = int(sums[-1][-1])
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in passed), pa.array(runs), pa.array(at + np.arange(len(hashes))), *map(pa.array, sums)],
                schema.names,
            )
            last, run, at = hashes[-1], int(runs[-1]), at + len(hashes)

    local = cut(dealt.mapInArrow(scan, schema), "scan")
    place = F.struct(_RUN, _AT)
    ends = local.groupBy(_PART).agg(
        F.min_by(F.struct(*key), place).alias("first"), F.max_by(F.struct(*key), place).alias("last"),
        F.max_by(F.array(*[f"_sum_{n}" for n in names]), place).alias("sums"), F.max(_RUN).alias("runs"),
    ).collect()
    offsets, before, held = [], None, [0] * len(names)
    for row in sorted(ends, key=lambda r: r[_PART]):
        offset = held if row["first"] == before else [0] * len(names)
        offsets.append((row[_PART], *offset))
        before, held = row["last"], [s + (o if not row["runs"] else 0) for s, o in zip(row["sums"], offset, strict=True)]
    carried = spark.createDataFrame(offsets, ", ".join([f"{_PART} int", *(f"`_carry_{n}` long" for n in names)]))
    return local.join(F.broadcast(carried), _PART).select(
        *df.columns,
        *[(F.col(f"_sum_{n}") + F.when(F.col(_RUN) == 0, F.col(f"_carry_{n}")).otherwise(0)).alias(n) for n in names],
    )


# Columns of the pieces of sessions. A piece is what one batch of one partition holds of a session.
_FROM, _UNTIL = "_scan_from", "_scan_until"


def sessions(df: DataFrame, keys: list, at: str, gap: str, counts: dict) -> DataFrame:
    """Sessions per key: runs of rows no further apart than ``gap``, with sums per session.

    A prefix scan that spreads a hot key over tasks: rows of one key and instant are summed first, then dealt out in
    ranges of (keys, instant). Each partition turns its sorted rows into intervals and writes them to the shared folder.
    Where an interval goes on in the next partitions, one row for each partition tells so: those rows come to the driver,
    the places they belong to go out, and the pieces are summed. Rows without an instant are left out, null keys are keys.
    A row exactly ``gap`` after the one before belongs to its session.
    """
    names = list(counts)
    key = [F.col(f"`{k}`") for k in keys]
    # Column names of callers are kept apart from those of the scan.
    instants = (
        df.filter(F.col(at).isNotNull())
        .groupBy(*key, F.col(at).cast("timestamp").alias(_FROM))
        .agg(*[F.sum(c.cast("bigint")).alias(f"_in_{n}") for n, c in counts.items()])
        .withColumns({
            _UNTIL: F.unix_micros(F.col(_FROM) + F.expr(f"INTERVAL {gap}")), _FROM: F.unix_micros(_FROM),
        })
    )
    dealt = instants.repartitionByRange(*key, _FROM).sortWithinPartitions(*key, _FROM).withColumns(
        {_PART: F.spark_partition_id(), _KEY: F.xxhash64(*key, *[k.isNull() for k in key])})
    schema = StructType([f for f in instants.schema.fields if f.name in keys])
    for name, kind in ((_PART, "integer"), (_RUN, "long"), (_FROM, "long"), (_UNTIL, "long"), *((f"_sum_{n}", "long") for n in names)):
        schema = schema.add(name, kind)
    kept = [*schema.names[: len(keys)], _PART]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_until, run = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            hashes = batch[_KEY].to_numpy(zero_copy_only=False)
            start, until = batch[_FROM].to_numpy(), batch[_UNTIL].to_numpy()
            apart = np.append(
                last_key is not None and (hashes[0] != last_key or start[0] > last_until),
                (hashes[1:] != hashes[:-1]) | (start[1:] > until[:-1]),
            )
            first = np.flatnonzero(np.append(True, apart[1:]))
            final = np.append(first[1:], len(hashes)) - 1
            sums = [
                np.add.reduceat(batch[f"_in_{n}"].fill_null(0).to_numpy(zero_copy_only=False), first) for n in names
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c].take(pa.array(first)) for c in kept), pa.array(run + np.cumsum(apart)[first]),
                 pa.array(start[first]), pa.array(until[final]), *map(pa.array, sums)],
                schema.names,
            )
            last_key, last_until, run = hashes[-1], until[-1], run + int(apart.sum())

    pieces = cut(dealt.mapInArrow(scan, schema), "sessions")
    ends = pieces.groupBy(_PART).agg(
        F.min_by(F.struct(*key, _FROM), F.struct(_RUN, _FROM)).alias("first"),
        F.max_by(F.struct(*key, _UNTIL), F.struct(_RUN, _FROM)).alias("last"), F.max(_RUN).alias("runs"),
    ).collect()
    owners, before, owner = [], None, None
    for row in sorted(ends, key=lambda r: r[_PART]):
        first, last = row["first"], row["last"]
        goes_on = before is not None and first[:-1] == before[:-1] and first[-1] <= before[-1]
        begins_in = owner if goes_on else (row[_PART], 0)
        owners.append((row[_PART], *begins_in))
        before, owner = last, (row[_PART], row["runs"]) if row["runs"] else begins_in
    owned = df.sparkSession.createDataFrame(owners, f"{_PART} int, _owner_part int, _owner_run long")
    first_run = F.col(_RUN) == 0
    placed = pieces.join(F.broadcast(owned), _PART)
    # Keys are constant within a session; they stay grouping columns, so that null keys keep their types.
    return placed.groupBy(
        *key, F.when(first_run, F.col("_owner_part")).otherwise(F.col(_PART)).alias("_owner_part"),
        F.when(first_run, F.col("_owner_run")).otherwise(F.col(_RUN)).alias("_owner_run"),
    ).agg(
        F.timestamp_micros(F.min(_FROM)).alias("session_start"), F.timestamp_micros(F.max(_UNTIL)).alias("session_end"),
        *[F.sum(f"_sum_{n}").alias(n) for n in names],
    ).drop("_owner_part", "_owner_run")


def append_list(updates: DataFrame, keys: list, order: list) -> DataFrame:
    """Appended items with their place in the key's list, from 1, as rows.

    Rows keep a list of any length; an array per key would have to fit one task.
    """
    return running_totals(updates, keys, order, {"place": F.lit(1)})


def changed_since(files: DataFrame, last_run: DataFrame) -> DataFrame:
    """Files that are new or whose content differs from the last run.

    ``last_run`` holds (project, path, content_hash). Only keys and hashes
    travel through the join's other side.
    """
    hashed = files.withColumn("content_hash", F.sha2("content", 256))
    seen = last_run.select("project", "path", "content_hash")
    return hashed.join(seen, ["project", "path", "content_hash"], "left_anti")
