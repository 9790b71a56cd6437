"""Streams of attempts: state per file, retry budget, failures per time window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from shiftwright import fixed_values as fixed
from shiftwright.operators.state import sessions


def attempt_state(
    attempts: DataFrame, keys: list, order: list, state: str, max_retries: int = fixed.MAX_RETRIES
) -> DataFrame:
    """Per file: steps, failures, the latest state and what is left of the retry budget.

    A streaming aggregation: partial sums per task keep a busy file cheap, and
    the state store holds one small row per file. Use output mode update.
    """
    failures = F.count_if(~F.col("passed"))
    return attempts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("steps"),
        failures.alias("failures"),
        F.max_by(F.col(state), F.struct(*order)).alias("latest"),
        F.greatest(F.lit(max_retries) - failures, F.lit(0)).cast("bigint").alias("retries_left"),
    )


def _chosen(late: str | None) -> str:
    if late is None:
        raise ValueError("say how late the rows of a stream may be")
    return late


def failure_windows(
    attempts: DataFrame, at: str, length: str = "1 hour", slide: str | None = None, late: str | None = None
) -> DataFrame:
    """Steps and failures per tumbling (or, with ``slide``, sliding) window of event time.

    A stream needs ``late``: rows further behind the newest one may be dropped, so the caller chooses.
    """
    timed = attempts.withColumn("_at", F.col(at).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("_at", _chosen(late))
    window = F.window("_at", length, slide) if slide else F.window("_at", length)
    return timed.groupBy(window.alias("_w")).agg(
        F.count(F.lit(1)).alias("steps"), F.count_if(~F.col("passed")).alias("failures")
    ).select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "steps", "failures")


def failure_sessions(attempts: DataFrame, keys: list, at: str, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Sessions of steps per key: runs of steps no further apart than ``gap``. A stream needs ``late``, as above.

    A table is cut into sessions by a scan that spreads a hot key over tasks; a stream keeps the open sessions as state.
    """
    failed = ~F.col("passed")
    if not attempts.isStreaming:
        return sessions(attempts, keys, at, gap, {"steps": F.lit(1), "failures": F.when(failed, 1).otherwise(0)})
    timed = attempts.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", _chosen(late))
    return timed.groupBy(*keys, F.session_window("_at", gap).alias("_w")).agg(
        F.count(F.lit(1)).alias("steps"), F.count_if(failed).alias("failures")
    ).select(*keys, F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), "steps", "failures")


DECISION = "struct<at:timestamp,id:bigint,attempt:bigint,retry_count:bigint,action:string>"
_STATE = "closed boolean, at array<bigint>, id array<bigint>, passed array<boolean>, secret array<boolean>"


def _earliest(attempts: DataFrame, keys: list, at: str, id_col: str, most: int) -> DataFrame:
    """The ``most`` earliest attempts of each key within each Arrow batch: what can still decide a file.

    A key with many attempts reaches its state as a few rows of each batch. ``_seen`` is the newest instant that was
    looked at together with the row: it carries the watermark.
    """
    passed = F.coalesce("passed", F.lit(False))
    instant = F.col(at).cast("timestamp")
    key = [F.col(f"`{k}`") for k in keys]
    rows = attempts.filter(instant.isNotNull() & F.col(id_col).isNotNull()).select(
        *key, F.unix_micros(instant).alias("_at"), F.col(id_col).cast("bigint").alias("_id"), passed.alias("_passed"),
        (~passed & (F.coalesce("category", F.lit("")) == "secrets_detected")).alias("_secret"), instant.alias("_seen"),
        F.xxhash64(*key, *[k.isNull() for k in key]).alias("_key"),
    )
    schema = StructType(rows.schema.fields[:-1])

    def cut_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            hashes, when, ids = (batch[c].to_numpy() for c in ("_key", "_at", "_id"))
            order = np.lexsort((ids, when, hashes))
            begins = np.append(True, hashes[order][1:] != hashes[order][:-1])
            start = np.flatnonzero(begins)
            group = np.cumsum(begins) - 1
            newest = order[np.append(start[1:], len(order)) - 1]
            chosen = np.arange(len(order)) - start[group] < most
            taken, seen = pa.array(order[chosen]), pa.array(newest[group[chosen]])
            yield pa.RecordBatch.from_arrays(
                [batch[c].take(seen if c == "_seen" else taken) for c in schema.names], schema.names)

    return rows.select(*schema.names, "_key").mapInArrow(cut_down, schema)


def retry_decisions(
    attempts: DataFrame, keys: list, at: str, id_col: str, late: str, max_retries: int = fixed.MAX_RETRIES
) -> DataFrame:
    """What follows the attempts of a stream, per file: approve, retry or escalate, as score.retry_routing decides.

    ``attempts`` is a stream with ``passed`` and ``category``; ``id_col`` (whole numbers) orders attempts of one instant.
    The state of a file is its earliest attempts up to the one that decides, never more than the retry budget and one, so
    that it stays small however many attempts come, and the outcome does not depend on how they fall into micro-batches.
    A row per updated file holds all its ``decisions`` in order and replaces its earlier row: an attempt that comes late
    moves those behind it. Attempts that are not listed are closed. A timer fires when no attempt before the decisive
    one can come any more, ``late`` behind the newest: the file is ``settled`` and only a mark of it is kept.
    Attempts later than that may be left out, those without instant or id always are. Use output mode update.
    """
    most = max_retries + 1
    rows = _earliest(attempts, keys, at, id_col, most).withWatermark("_seen", late)
    named = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    ddl = ", ".join([*(f"`{k}` {named[k]}" for k in keys), "settled boolean", f"decisions array<{DECISION}>"])

    def decided(held: list) -> list:
        """(at, id, passed, secret, action) up to the attempt that decides."""
        out = []
        for i, (when, ident, passed, secret) in enumerate(held[:most], 1):
            action = "approve" if passed else "retry" if i <= max_retries and not secret else "escalate"
            out.append((when, ident, passed, secret, action))
            if action != "retry":
                break
        return out

    def row(key: tuple, found: list, settled: bool) -> pd.DataFrame:
        listed = [
            {"at": pd.Timestamp(when, unit="us", tz="UTC"), "id": ident, "attempt": i, "retry_count": i - 1, "action": action}
            for i, (when, ident, _, _, action) in enumerate(found, 1)
        ]
        values = dict(zip(keys, key, strict=True)) | {"settled": settled, "decisions": listed}
        return pd.DataFrame({name: pd.Series([value], dtype=object) for name, value in values.items()})

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closed, *lists = state.get if state.exists else (False, [], [], [], [])
        held = list(zip(*lists, strict=True))
        if not state.hasTimedOut:
            for frame in frames:
                new = frame[["_at", "_id", "_passed", "_secret"]].itertuples(index=False, name=None)
                held = sorted([*held, *((int(a), int(i), bool(p), bool(s)) for a, i, p, s in new)], key=lambda h: h[:2])[:most]
        if closed:
            return
        found = decided(held)
        final = found[-1][-1] != "retry"
        due = found[-1][0] // 1000
        settled = final and (state.hasTimedOut or due <= state.getCurrentWatermarkMs())
        kept = [] if settled else [f[:4] for f in found]
        state.update((settled, *(list(c) for c in zip(*kept, strict=True))) if kept else (settled, [], [], [], []))
        if final and not settled:
            state.setTimeoutTimestamp(due)
        yield row(key, found, settled)

    return rows.groupBy(*keys).applyInPandasWithState(step, ddl, _STATE, "update", GroupStateTimeout.EventTimeTimeout)
