"""Queries of the small rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks
from ..sources.tables import table
from .stand_ins import AS_OF, CENTRES, PLACES, centres, places

#: Area of a burn pixel, rounded as the monthly totals have it.
HECTARES = 21.4659


def freshness(spark, sf):
    """Users as pipelines with the jobs view and click; a run is ok above ten."""
    return checks.all_fresh(table(spark, sf, "events"), "user_id", "event_type", "ts", F.col("value") > 10, ["view", "click"], F.lit(AS_OF), 48)


def filtered_parts(spark, sf):
    p = table(spark, sf, "part")
    met = checks.optional_filter("p_size", None) & checks.optional_filter("p_size", None, [1, 2, 3]) & checks.optional_filter("p_size", among=range(1, 30))
    return p.where(met).select("p_partkey", "p_size")


def month_starts(spark, sf):
    return table(spark, sf, "orders").groupBy(checks.first_of_month("o_orderdate").alias("first")).agg(F.count("*").alias("n"))


def worst_events(spark, sf):
    return checks.worst_per_key(table(spark, sf, "events"), "user_id", "value", "event_id")


def status_counts(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_orderstatus", "o_orderpriority")


def box_days(spark, sf):
    b = centres(spark, sf).select("region_id", (F.col("lng") - 0.5).alias("w"), (F.col("lng") + 0.5).alias("e"), (F.col("lat") - 0.5).alias("s"), (F.col("lat") + 0.5).alias("n_"))
    p = places(spark, sf).select("lat", "lng", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("place_id") % 90).cast("int")).alias("day"))
    return checks.box_totals(p, b, "region_id", "day", HECTARES)


QUERIES = {
    "p27_freshness": freshness, "p14_optional_filter": filtered_parts, "d11_month_starts": month_starts, "o8_worst_first": worst_events,
    "a17_status_counts": status_counts, "a29_box_days": box_days,
}
ORACLE = {
    "p27_freshness": f"""with r as (select user_id, event_type, value > 10 and ts between timestamp '{AS_OF}' - interval 48 hour and timestamp '{AS_OF}' as ok from events)
 select user_id, coalesce(bool_or(ok) filter (where event_type='view'), false) and coalesce(bool_or(ok) filter (where event_type='click'), false) as fresh from r group by 1""",
    "p14_optional_filter": "select p_partkey, p_size from part where p_size not in (1,2,3) and p_size between 1 and 29",
    "d11_month_starts": "select day(o_orderdate)=1 as \"first\", count(*) n from orders group by 1",
    "o8_worst_first": "select user_id, event_id, value from (select *, row_number() over (partition by user_id order by value desc nulls last, event_id) n from events) where n=1",
    "a17_status_counts": "select o_orderstatus, o_orderpriority, count(*) n from orders group by 1,2 order by n desc, 1, 2",
    "a29_box_days": f"""with {PLACES}, {CENTRES}, p as (select lat, lng, date '2024-01-01' + (place_id%90)::int as d from places)
 select c.region_id, count(*) n, round(count(*)*{HECTARES}e0,2) hectares, min(p.d) first_day, max(p.d) last_day from p join centres c on p.lng between c.lng-0.5e0 and c.lng+0.5e0 and p.lat between c.lat-0.5e0 and c.lat+0.5e0 group by 1""",
}
