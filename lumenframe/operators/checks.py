"""Small rules over jobs, filters and boxes.

Defined cases: null times, statuses and coordinates meet no rule; an empty table gives no
rows; ties take the lower id; helper columns stay inside, so input columns may have any names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Hours for which a finished job counts as fresh; exactly as many are fresh, times to come are not.
FRESH_HOURS = 6


def optional_filter(column: str, value: object = None, unlike: Sequence = (), among: Sequence | None = None) -> Column:
    """Equal to value, none of unlike, one of among: each only where it is given."""
    met = F.lit(True)
    if value is not None:
        met = met & (F.col(column) == F.lit(value))
    if unlike:
        met = met & ~F.col(column).isin(*unlike)
    return met if among is None else met & F.col(column).isin(*among)


def all_fresh(runs: DataFrame, by: str, job: str, finished: str, ok: Column, jobs: Sequence[str], as_of: Column, hours: int = FRESH_HOURS) -> DataFrame:
    """by, fresh: whether each of the jobs has an ok run at most `hours` old at as_of; a job without one isn't fresh."""
    age = as_of.cast("timestamp").cast("double") - F.col(finished).cast("timestamp").cast("double")
    fresh = ok & age.between(0, hours * 3600)
    each = [F.coalesce(F.bool_or(F.when(F.col(job) == name, fresh)), F.lit(False)) for name in jobs]
    met = each[0]
    for one in each[1:]:
        met = met & one
    return runs.groupBy(by).agg(met.alias("fresh"))


def first_of_month(day: str) -> Column:
    return F.col(day).cast("date") == F.trunc(day, "MM")


def worst_per_key(df: DataFrame, key: str, weight: str, row_id: str) -> DataFrame:
    """key, row_id, weight of each key's heaviest row; rows of unknown weight come last."""
    best = F.max(F.struct(F.col(weight).isNotNull(), F.col(weight).alias("w"), (-F.col(row_id)).alias("i"))).alias("b")
    return df.groupBy(key).agg(best).select(key, (-F.col("b.i")).alias(row_id), F.col("b.w").alias(weight))


def box_totals(points: DataFrame, boxes: DataFrame, box_id: str, day: str, hectares_each: float, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """box_id, n, hectares, first_day, last_day of each box (w, e, s, n_) that holds a point; a point may be in several."""
    from .spatial import small

    inside = F.col(lng).between(F.col("w"), F.col("e")) & F.col(lat).between(F.col("s"), F.col("n_"))
    met = points.select(lat, lng, day).join(small(boxes.select(box_id, "w", "e", "s", "n_")), inside)
    n = F.count("*")
    return met.groupBy(box_id).agg(n.alias("n"), F.round(n * F.lit(hectares_each), 2).alias("hectares"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))
