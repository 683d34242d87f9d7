"""Folding observations into passes, and what passes tell: trend, drift, persistence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geo, rules

GAP_MINUTES = 10


def pass_flag(entity: str, at: str, gap_minutes: float) -> Column:
    """1 where an observation starts a pass: the first of its entity, or more than the gap after the one before."""
    before = F.lag(at).over(Window.partitionBy(entity).orderBy(at))
    return F.when(before.isNull() | (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(before.cast("timestamp")) > int(gap_minutes * 60_000_000)), 1).otherwise(0)


def with_pass_index(df: DataFrame, entity: str, at: str, gap_minutes: float = GAP_MINUTES) -> DataFrame:
    """df with pass_idx, 1 for an entity's first pass; observations of one time share theirs.

    Lag and running sum use one partitioning and one sort.
    """
    running = Window.partitionBy(entity).orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_starts", pass_flag(entity, at, gap_minutes)).withColumn("pass_idx", F.sum("_starts").over(running)).drop("_starts")


def pass_count(times: Column | str, gap_minutes: float = GAP_MINUTES) -> Column:
    """Passes in an array of times, without leaving the row."""
    t = F.array_sort(F.transform(times, lambda x: F.unix_micros(x.cast("timestamp"))))
    gap = int(gap_minutes * 60_000_000)
    return F.when(F.size(t) == 0, 0).otherwise(1 + F.size(F.filter(F.zip_with(F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))), lambda b, a: b - a), lambda d: d > gap)))


def power_trend(df: DataFrame, entity: str, at: str, power: str, area: str, gap_minutes: float = GAP_MINUTES) -> DataFrame:
    """Per entity: passes, late/early ratio of summed pass power, pixel geometry ratio, trend (null where the evidence is thin).

    With an odd number of passes the middle one is in neither half. Rows without power or area don't count.
    """
    used = df.where(F.col(entity).isNotNull() & F.col(power).isNotNull() & F.col(area).isNotNull())
    folded = with_pass_index(used, entity, at, gap_minutes).groupBy(entity, "pass_idx").agg(F.sum(power).alias("power"), F.avg(area).alias("area"))
    by = Window.partitionBy(entity)
    ordered = folded.withColumn("rn", F.row_number().over(by.orderBy("pass_idx"))).withColumn("n", F.count("*").over(by))
    halves = ordered.groupBy(entity).agg(
        F.max("n").alias("passes"),
        F.avg(F.when(F.col("rn") <= F.expr("n div 2"), F.col("power"))).alias("early"),
        F.avg(F.when(F.col("rn") > F.expr("(n + 1) div 2"), F.col("power"))).alias("late"),
        (F.max("area") / F.nullif(F.min("area"), F.lit(0.0))).alias("geometry_ratio"),
    )
    ratio = F.when((F.col("passes") >= rules.TREND_MIN_PASSES) & (F.col("early") > 0), F.col("late") / F.col("early"))
    return halves.select(
        entity, "passes", F.round(ratio, 3).alias("ratio"), F.round("geometry_ratio", 3).alias("geometry_ratio"),
        rules.trend(ratio, F.col("passes"), F.col("geometry_ratio"), F.lit(False)).alias("trend"),
    )


def drift(df: DataFrame, entity: str, at: str, lat: str, lng: str, gap_minutes: float = GAP_MINUTES) -> DataFrame:
    """Bearing and speed between the centroids of the halves before and after an entity's mid-time.

    Needs two passes and four observations; "moderate" from four and ten on.
    """
    us = F.unix_micros(F.col(at).cast("timestamp"))
    mid = df.groupBy(entity).agg(((F.min(us) + F.max(us)) / 2).alias("mid"))
    passes = with_pass_index(df.select(entity, at), entity, at, gap_minutes).groupBy(entity).agg(F.max("pass_idx").alias("passes"))
    first, late = us <= F.col("mid"), us > F.col("mid")
    halves = df.join(mid, entity).groupBy(entity).agg(
        F.count("*").alias("n"),
        *(F.avg(F.when(half, F.col(c))).alias(f"{c}{k}") for k, half in ((1, first), (2, late)) for c in (lat, lng)),
        F.avg(F.when(first, us)).alias("t1"), F.avg(F.when(late, us)).alias("t2"),
    )
    km = geo.haversine_km(f"{lat}1", f"{lng}1", f"{lat}2", f"{lng}2")
    usable = halves.join(passes, entity).where((F.col("passes") >= 2) & (F.col("n") >= 4) & (F.col("t2") > F.col("t1")))
    return usable.select(
        entity, "n", "passes",
        F.round(geo.planar_azimuth(f"{lng}1", f"{lat}1", f"{lng}2", f"{lat}2"), 2).alias("bearing"),
        F.round(km * 1000 / ((F.col("t2") - F.col("t1")) / 3.6e9), 2).alias("speed_mh"),
        F.when((F.col("passes") >= 4) & (F.col("n") >= 10), "moderate").otherwise("low").alias("confidence"),
    )


def persistence(df: DataFrame, entity: str, at: str, power: str) -> DataFrame:
    """Mergeable accumulators per entity: seen days, sum, sum of squares, count, and the mean and deviation they give."""
    x = F.col(power)
    sums = df.groupBy(entity).agg(
        F.array_sort(F.collect_set(F.to_date(at))).alias("seen_days"), F.sum(x).alias("power_sum"), F.sum(x * x).alias("power_sum_sq"),
        F.count(x).alias("samples"), F.max(x).alias("peak"),
    )
    return with_moments(sums)


def with_moments(sums: DataFrame) -> DataFrame:
    """mean and population deviation from the sums; the variance is held at zero against cancellation."""
    n = F.nullif(F.col("samples"), F.lit(0))
    mean = F.col("power_sum") / n
    return sums.withColumn("mean", mean).withColumn("deviation", F.sqrt(F.greatest(F.lit(0.0), F.col("power_sum_sq") / n - mean * mean)))


def merge_persistence(old: DataFrame, new: DataFrame, entity: str) -> DataFrame:
    """Two accumulator frames added up; days are united, so a replay of the same day adds none."""
    both = old.unionByName(new, allowMissingColumns=True)
    merged = both.groupBy(entity).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("seen_days")))).alias("seen_days"),
        *(F.sum(c).alias(c) for c in ("power_sum", "power_sum_sq", "samples")), F.max("peak").alias("peak"),
    )
    return with_moments(merged)


def contiguous_runs(df: DataFrame, key: str, at: str, flag: str, step_seconds: int) -> DataFrame:
    """First and last time of each unbroken run of samples where flag holds (a missing sample ends a run)."""
    on = df.where(F.coalesce(F.col(flag), F.lit(False)))
    return with_pass_index(on, key, at, step_seconds * 1.5 / 60).groupBy(key, "pass_idx").agg(F.min(at).alias("starts_at"), F.max(at).alias("ends_at"), F.count("*").alias("samples"))
