"""Aggregates kept up to date by what a load touches, and states that merge in any order.

Point sets: the state of an entity is the set of its distinct points, as rows, so that no entity is
one array; merging is a union of sets, so replays and order change nothing, and the centroid is the
mean of the points at NANO decimals, summed exactly.

Monthly rows: a load replaces whole (entity, month) rows; what hangs on all months of an entity
is worked out again for the entities it touches only, found by a semi-join, and kept for the others.

Defined cases: rows with a null entity take no part, points without a coordinate aren't points; an
entity without points or months left is in no result; repeated rows of a load count once; empty
loads change nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Decimals to which coordinates are told apart.
NANO = 9


def point_set(df: DataFrame, entity: str, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """entity, lat, lng: the distinct points of each entity."""
    exact = lambda c: F.col(c).cast(f"decimal(13,{NANO})").alias(c)
    return df.where(F.col(entity).isNotNull() & F.col(lat).isNotNull() & F.col(lng).isNotNull()).select(entity, exact(lat), exact(lng)).distinct()


def merge_point_sets(*states: DataFrame) -> DataFrame:
    """The union of states of the same columns."""
    first, *rest = states
    for state in rest:
        first = first.unionByName(state)
    return first.distinct()


def centroids(state: DataFrame, entity: str, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """entity, points, lat, lng: the mean of each entity's distinct points."""
    n = F.count("*")
    mean = lambda c: (F.sum(F.col(c).cast(f"decimal(31,{NANO})")).cast("double") / n).alias(c)
    return state.groupBy(entity).agg(n.alias("points"), mean(lat), mean(lng))


def replace_rows(stored: DataFrame, load: DataFrame, keys: list[str]) -> DataFrame:
    """stored, with the rows of each key that the load holds replaced by the load's; columns are the stored ones'."""
    fresh = load.where(" and ".join(f"{k} is not null" for k in keys)).select(*stored.columns).distinct()
    touched = fresh.select(*keys).distinct()
    return stored.join(touched, keys, "left_anti").select(*stored.columns).unionByName(fresh)


def month_rollup(rows: DataFrame, entity: str, month: str, amount: str) -> DataFrame:
    """entity, months (with an amount above zero), total, first_month, last_month (of those)."""
    counted = F.coalesce(F.col(amount) > 0, F.lit(False))
    return rows.where(F.col(entity).isNotNull()).groupBy(entity).agg(
        F.count_if(counted).alias("months"), F.coalesce(F.sum(amount), F.lit(0)).alias("total"), F.min(F.when(counted, F.col(month))).alias("first_month"), F.max(F.when(counted, F.col(month))).alias("last_month")
    )


def refreshed_rollup(rollup: DataFrame, rows: DataFrame, load: DataFrame, entity: str, month: str, amount: str) -> DataFrame:
    """The rollup after a load: rows are all rows with the load in place; only those of touched entities are read again."""
    touched = load.where(F.col(entity).isNotNull()).select(entity).distinct()
    again = month_rollup(rows.join(touched, entity, "left_semi"), entity, month, amount)
    return rollup.join(touched, entity, "left_anti").select(*again.columns).unionByName(again)
