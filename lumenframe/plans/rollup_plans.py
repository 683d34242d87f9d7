"""Point sets merged from three loads, and customers' months after two loads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rollups
from ..sources.tables import table
from .stand_ins import DET, detections


def merged_centroids(spark, sf):
    """Detections in three overlapping loads, one of them twice."""
    d = detections(spark, sf)
    load = lambda cond: rollups.point_set(d.where(cond), "incident_id")
    a, b, c = load("event_id % 3 = 0"), load("event_id % 3 = 1 or event_id % 5 = 0"), load("event_id % 3 = 2")
    merged = rollups.merge_point_sets(c, rollups.merge_point_sets(a, b), a)
    found = rollups.centroids(merged, "incident_id")
    micro = lambda c: F.floor(F.col(c) * 1_000_000).cast("long").alias(f"{c}_micro")
    return found.select("incident_id", "points", micro("lat"), micro("lng"))


CENTROID_SQL = f"""with {DET}, p as (select distinct incident_id, lat::decimal(13,9) lat, lng::decimal(13,9) lng from det)
 select incident_id, count(*) points, floor(sum(lat)::double/count(*)*1000000)::bigint lat_micro, floor(sum(lng)::double/count(*)*1000000)::bigint lng_micro from p group by 1"""


def _months(spark, sf, share):
    """Cents of each customer's orders by month, of a part of the orders."""
    o = table(spark, sf, "orders").where(share)
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return o.groupBy(F.col("o_custkey").alias("customer"), F.trunc("o_orderdate", "MM").alias("month")).agg(F.sum(cents).alias("cents"))


def touched_months(spark, sf):
    """A first load of two thirds of the orders, then whole months of every fifth customer from all orders."""
    first = _months(spark, sf, "o_orderkey % 3 <> 0")
    second = _months(spark, sf, "o_custkey % 5 = 0")
    before = rollups.month_rollup(first, "customer", "month", "cents")
    rows = rollups.replace_rows(first, second, ["customer", "month"])
    found = rollups.refreshed_rollup(before, rows, second, "customer", "month", "cents")
    text = lambda c: F.date_format(c, "yyyy-MM").alias(c)
    return found.select("customer", "months", "total", text("first_month"), text("last_month"))


MONTHS_SQL = """with o as (select o_custkey customer, strftime(o_orderdate,'%Y-%m') as mon, round(o_totalprice*100)::bigint cents from orders where o_custkey%5=0 or o_orderkey%3<>0),
 m as (select customer, mon, sum(cents) cents from o group by 1, 2)
 select customer, count(*) filter (where cents>0) as months, sum(cents)::bigint as total, min(mon) filter (where cents>0) as first_month, max(mon) filter (where cents>0) as last_month from m group by 1"""

QUERIES = {"a14_merged_centroids": merged_centroids, "a20_touched_months": touched_months}
ORACLE = {"a14_merged_centroids": CENTROID_SQL, "a20_touched_months": MONTHS_SQL}
