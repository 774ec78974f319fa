"""Streaming twins of the event operators, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def throttled(events: DataFrame, key: str, phase: str, seconds: str, event_id: str, interval: float) -> DataFrame:
    """Events that pass the throttle of their key: a change of phase, or an interval since the last that passed.

    State is two values a key. A micro-batch is put in order before it is read.
    """

    def step(keys, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, at = state.get if state.exists else (None, float("-inf"))
        parts = list(batches)
        rows = parts[0] if len(parts) == 1 else pd.concat(parts)
        # arrays, since a frame's sort and rows cost more than a key's events
        at_s, ids = rows[seconds].to_numpy(), rows[event_id].to_numpy()
        order = np.lexsort((ids, at_s))
        phases = rows[phase].to_numpy(dtype=object)[order].tolist()
        passed = []
        for k, (p, s) in enumerate(zip(phases, at_s[order].tolist(), strict=True)):
            if last != p or s - at >= interval:
                last, at = p, s
                passed.append(k)
        state.update((last, at))
        if passed:
            yield rows.iloc[order[passed]][[key, phase, seconds, event_id]]

    kind = dict(events.dtypes)
    schema = f"{key} {kind[key]}, {phase} string, {seconds} double, {event_id} bigint"
    rows = events.select(key, phase, F.col(seconds).cast("double").alias(seconds), F.col(event_id).cast("bigint").alias(event_id))
    return rows.groupBy(key).applyInPandasWithState(step, schema, "phase string, at double", "append", GroupStateTimeout.NoTimeout)


def replay_ring(events: DataFrame, channel: str, seq: str, data: str, size: int = 256) -> DataFrame:
    """The last events of each channel as they stand after each micro-batch: a bounded ring by sequence."""

    def step(keys, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (old_seq, old_data) = state.get if state.exists else ([], [])
        rows = pd.concat([pd.DataFrame({seq: old_seq, data: old_data}), *batches]).drop_duplicates(seq).sort_values(seq).tail(size)
        state.update((rows[seq].astype(int).tolist(), rows[data].tolist()))
        yield pd.DataFrame({channel: [keys[0]], "first": [int(rows[seq].min())], "last": [int(rows[seq].max())], "held": [len(rows)]})

    kind = dict(events.dtypes)
    return events.select(channel, seq, data).groupBy(channel).applyInPandasWithState(
        step, f"{channel} {kind[channel]}, first bigint, last bigint, held bigint", "seqs array<bigint>, data array<string>", "update", GroupStateTimeout.NoTimeout
    )


def resume(ring: DataFrame, seq: str, last: int) -> tuple[DataFrame, DataFrame]:
    """(events after the last one seen, whether any between were lost)."""
    lost = ring.agg((F.coalesce(F.min(seq), F.lit(last + 1)) > last + 1).alias("incomplete"))
    return ring.where(F.col(seq) > last).orderBy(seq), lost


def sessions(events: DataFrame, by: str, time: str, gap: str, late: str) -> DataFrame:
    """Sessions that a gap ends, with a watermark for late events."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windowed_counts(events: DataFrame, by: str, time: str, width: str, late: str) -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), "n")


def once_per_change(polls: DataFrame, path: str, size: str, time: str, late: str) -> DataFrame:
    """Each (path, size, time) once: files that are reported again only after a change."""
    return polls.withWatermark(time, late).dropDuplicatesWithinWatermark([path, size, time])


def refresh_sink(path: str, keys: list[str], recompute: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """foreachBatch handler that keeps a summary table up to date for the keys of each micro-batch.

    Versions are folders by batch id: a batch that is run again writes the same
    folder anew, and readers take the newest that is complete.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        from ..operators.groups import refresh

        spark = batch.sparkSession
        dirty = batch.select(*keys).distinct()
        fresh = recompute(dirty)
        try:
            stored = spark.read.parquet(f"{path}/v{batch_id - 1}")
            fresh = refresh(stored, dirty, keys, recompute)
        except Exception as e:  # the first version has nothing before it
            if batch_id > 0 or "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.write.mode("overwrite").parquet(f"{path}/v{batch_id}")

    return handle


def latest_overlay(rows: DataFrame, updates: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Stored rows with the newest values of a stream of updates, stream-static."""
    from ..operators.relational import first_per_key

    newest = first_per_key(updates, [key], [F.col(order).desc()]).select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = rows.join(newest, key, "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])
