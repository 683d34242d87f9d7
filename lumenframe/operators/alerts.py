"""Notices under caps and cooldowns, and jobs that go from state to state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def trailing_count(df: DataFrame, key: str, at: str, hours: float) -> DataFrame:
    """df with recent: rows of the same key in the hours up to and including each row."""
    us = F.unix_micros(F.col(at).cast("timestamp"))
    return df.withColumn("recent", F.count("*").over(Window.partitionBy(key).orderBy(us).rangeBetween(-int(hours * 3.6e9), 0)))


def plan_pushes(pending: DataFrame, sent: DataFrame, device: str, as_of: Column, cap: int = 3, hours: float = 6.0) -> DataFrame:
    """One row per device with pending notices: how many, nearest one, and push or hold by the pushes of the last hours."""
    recent = sent.where((F.col("sent_at") > as_of - F.make_dt_interval(F.lit(0), F.lit(int(hours)))) & (F.col("sent_at") <= as_of)).groupBy(device).agg(F.countDistinct("push_id").alias("recent"))
    grouped = pending.groupBy(device).agg(F.min_by("ref", F.struct("km", "ref")).alias("nearest"), F.min("km").alias("km"), (F.countDistinct("ref") - 1).alias("more"))
    return grouped.join(recent, device, "left").select(
        device, "nearest", "km", "more", F.coalesce("recent", F.lit(0)).alias("recent"), F.when(F.coalesce("recent", F.lit(0)) < cap, "push").otherwise("hold").alias("decision")
    )


def cooldown(df: DataFrame, key: str, at: str, hours: float) -> DataFrame:
    """The rows that fire when each key rests for the hours after firing: a greedy choice in order, one pass per key.

    Whether a row fires depends on the one before it that did, so each key's times are walked in order;
    they travel as one array of numbers.
    """
    us = F.unix_micros(F.col(at).cast("timestamp"))
    rest = int(hours * 3.6e9)
    times = df.where(F.col(at).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(us)).alias("t"))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<long>").alias("out"))
    fired = F.aggregate("t", start, lambda a, t: F.when(a["last"].isNull() | (t - a["last"] >= rest), F.struct(t.alias("last"), F.concat(a["out"], F.array(t)).alias("out"))).otherwise(a), lambda a: a["out"])
    return times.select(key, F.explode(fired).alias("_us")).select(key, F.timestamp_micros("_us").alias("fired_at"))


def fixed_window_limit(df: DataFrame, key: str, at: str, minutes: int, limit: int) -> DataFrame:
    """Requests per key and clock window, and how many of them a limit lets through."""
    w = F.window(F.col(at).cast("timestamp"), f"{minutes} minutes")
    return df.groupBy(key, w.alias("w")).agg(F.count("*").alias("requests")).select(key, F.col("w.start").alias("window_start"), "requests", F.least("requests", F.lit(limit)).alias("allowed"))


def next_fetch_state(status: Column, attempts: Column, task_status: Column, max_attempts: int = 3) -> Column:
    """awaiting -> submitted -> downloaded; a failed task is tried again up to max_attempts, then failed."""
    return (
        F.when(status.isin("downloaded", "failed"), status)
        .when(status == "awaiting", "submitted")
        .when(task_status == "done", "downloaded")
        .when(task_status == "error", F.when(attempts + 1 >= max_attempts, "failed").otherwise("awaiting"))
        .otherwise(status)
    )


def health(runs: DataFrame, as_of: Column, interval_hours: dict[str, float]) -> DataFrame:
    """Per job: last success, last life sign (a skip is one), stale after two intervals, and input without output."""
    spark = runs.sparkSession
    jobs = spark.createDataFrame(list(interval_hours.items()), "job string, hours double")
    seen = runs.groupBy("job").agg(
        F.max(F.when(F.col("status") == "ok", F.col("finished_at"))).alias("last_ok"),
        F.max(F.when(F.col("status").isin("ok", "skipped"), F.col("finished_at"))).alias("alive_at"),
        F.max_by("status", F.struct("finished_at", "status")).alias("last_status"),
        F.max_by(F.struct("n_in", "n_out"), F.struct("finished_at", "status")).alias("io"),
    )
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("alive_at").cast("timestamp"))) / 3.6e9
    return jobs.join(seen, "job", "left").select(
        "job", "last_ok", "last_status", F.coalesce(age > 2 * F.col("hours"), F.lit(True)).alias("stale"),
        F.coalesce((F.col("io.n_in") > 0) & (F.col("io.n_out") == 0), F.lit(False)).alias("anomaly"),
    )


def fold_stories(items: DataFrame, gap_hours: float = 48, unknown_gap_hours: float = 24, span_hours: float = 192, least: int = 2) -> DataFrame:
    """Headlines (id, province, at, kind, places) grouped into stories, in time order per province.

    An item joins the first open story that is recent enough, not too long, whose places aren't all different and
    whose kind agrees; the order decides, so a province is walked in one task (its headlines are few).
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        open_: list[dict] = []
        for row in pdf.sort_values(["at", "id"]).itertuples():
            places, kind = set(row.places if row.places is not None else ()), row.kind if isinstance(row.kind, str) else None
            for g in open_:
                gap = gap_hours if kind and g["kind"] else unknown_gap_hours
                apart = g["places"] and places and not g["places"] & places
                if (row.at - g["last"]) <= pd.Timedelta(hours=gap) and (row.at - g["first"]) <= pd.Timedelta(hours=span_hours) and not apart and (not kind or not g["kind"] or kind == g["kind"]):
                    g["ids"].append(row.id)
                    g["last"], g["kind"] = row.at, g["kind"] or kind
                    g["places"] |= places
                    break
            else:
                open_.append({"first": row.at, "last": row.at, "kind": kind, "places": places, "ids": [row.id]})
        kept = [g for g in open_ if len(g["ids"]) >= least]
        return pd.DataFrame({"province": [pdf["province"].iloc[0]] * len(kept), "story": [g["ids"][0] for g in kept], "items": [g["ids"] for g in kept]})

    return items.where(F.col("province").isNotNull()).groupBy("province").applyInPandas(walk, "province string, story long, items array<long>")


def batches_of(rows: Iterator, size: int) -> Iterator[list]:
    """Chunks for sinks that take a bounded number of rows at once."""
    held: list = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
