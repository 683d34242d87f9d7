"""Summaries: gap-filled calendars, shares, top lists, histograms, counts that tell unknown from zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import times


def monthly(df: DataFrame, at: str, first_month: str, last_month: str, measures: dict[str, Column]) -> DataFrame:
    """Measures per month, every month of the range present; a month without rows has zeros."""
    spark = df.sparkSession
    months = spark.range(1).select(F.explode(times.months_between_inclusive(F.lit(first_month).cast("date"), F.lit(last_month).cast("date"))).alias("month"))
    inside = df.where((F.col(at) >= F.lit(first_month).cast("timestamp")) & (F.col(at) < F.add_months(F.lit(last_month).cast("date"), 1).cast("timestamp")))
    sums = inside.groupBy(F.trunc(at, "month").alias("month")).agg(*(c.alias(k) for k, c in measures.items()))
    return months.join(sums, "month", "left").select("month", *(F.coalesce(k, F.lit(0)).alias(k) for k in measures))


def shares(df: DataFrame, key: str, digits: int = 2) -> DataFrame:
    """Rows per value and their percent of all rows, unknown values included in the whole."""
    counted = df.groupBy(key).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("_total"))
    return counted.crossJoin(F.broadcast(total)).select(key, "n", F.round(100.0 * F.col("n") / F.col("_total"), digits).alias("percent"))


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows of an order that ends in a unique key."""
    return df.orderBy(*order).limit(n)


def page(df: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(size)


def histogram(df: DataFrame, value: str, low: float, high: float, buckets: int) -> DataFrame:
    return df.groupBy(F.expr(f"width_bucket({value}, {low}D, {high}D, {buckets})").cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def count_or_unknown(counts: DataFrame, keys: DataFrame, key: str, n: str, fresh: Column) -> DataFrame:
    """Count per key: null for all while the pipeline isn't fresh, zero for a known key without rows."""
    return keys.join(counts, key, "left").select(key, F.when(fresh, F.coalesce(n, F.lit(0))).alias(n))


def first_cells(queue: DataFrame, order: list[Column], cell: str, n: int) -> DataFrame:
    """The first n distinct cells in the order of a queue. Only each cell's best row takes part in the final sort."""
    best = queue.withColumn("_k", F.struct(*order)).groupBy(cell).agg(F.min("_k").alias("_k"))
    return best.orderBy("_k").limit(n).select(cell)


def running_share(df: DataFrame, at: str, amount: str, budget: float) -> DataFrame:
    """Running total per day and its share of a daily budget."""
    day = Window.partitionBy(F.to_date(at)).orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(amount).over(day)).withColumn("share", F.col("used") / budget)


def mode_lowest(value: str) -> Column:
    """Most frequent value, the lowest on ties."""
    return F.expr(f"mode() within group (order by {value})")


def run_log(job: str, status: str, stats: dict[str, Column], source: DataFrame, at: Column, error: str | None = None) -> DataFrame:
    """One row for a finished run: job, status, stats as JSON, error cut to 500 characters."""
    counts = source.agg(*(c.alias(k) for k, c in stats.items()))
    return counts.select(F.lit(job).alias("job"), F.lit(status).alias("status"), F.to_json(F.struct(*stats)).alias("stats"), F.lit(error).cast("string").substr(1, 500).alias("error"), at.alias("finished_at"))
