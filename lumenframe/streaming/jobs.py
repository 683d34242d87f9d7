"""The recurring jobs as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def deduplicated(stream: DataFrame, key: list[str], at: str, late: str = "2 days") -> DataFrame:
    """First arrival of each natural key; keys are forgotten once the watermark passes them."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def passes(stream: DataFrame, entity: str, at: str, value: str, gap: str = "10 minutes", late: str = "2 days") -> DataFrame:
    """Session per entity: start, end, sum and count; emitted when the watermark closes it."""
    w = F.session_window(at, gap)
    return stream.withWatermark(at, late).groupBy(entity, w.alias("w")).agg(F.sum(value).alias("total"), F.count("*").alias("n")).select(entity, F.col("w.start").alias("starts_at"), F.col("w.end").alias("closes_at"), "total", "n")


def windowed_counts(stream: DataFrame, at: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    w = F.window(at, width)
    return stream.withWatermark(at, late).groupBy(w.alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")


def _cooldown_state(rest_us: int) -> Callable:
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        times = sorted(t for b in batches for t in (b["at"].astype("datetime64[us]").astype("int64")).tolist())
        fired = []
        for t in times:
            if last is None or t - last >= rest_us:
                fired.append(t)
                last = t
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max(last // 1000 + rest_us // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [key[0]] * len(fired), "fired_at": pd.to_datetime(fired, unit="us")})

    return step


def cooldown(stream: DataFrame, key: str, at: str, hours: float, late: str = "1 hour") -> DataFrame:
    """Rows that fire under a rest per key, with the last firing as state that expires after the rest."""
    rows = stream.select(F.col(key).cast("long").alias("key"), F.col(at).cast("timestamp").alias("at")).withWatermark("at", late)
    return rows.groupBy("key").applyInPandasWithState(_cooldown_state(int(hours * 3.6e9)), "key long, fired_at timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def upsert_into(path: str, key: list[str]) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer that appends the rows whose key the table at path doesn't hold yet; a replayed batch adds nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        one = batch.dropDuplicates(key)
        try:
            known = spark.read.parquet(path).select(*key)
        except Exception as missing:  # the first batch meets no table
            if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
                raise
            known = None
        (one if known is None else one.join(known, key, "left_anti")).write.mode("append").parquet(path)

    return write
