"""How the domain's tables are read off the test tables, once for Spark and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import table

#: The newest time of the month of events; jobs never read the clock.
AS_OF = "2024-01-31 00:00:00"


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as detections: entity, time, power, tier, pixel area and a place derived from the id."""
    e = table(spark, sf_dir, "events")
    tier = F.when(F.col("event_type") == "error", "high").when(F.col("event_type").isin("purchase", "signup"), "nominal").otherwise("low")
    return e.select(
        "event_id", F.col("user_id").alias("incident_id"), F.col("ts").cast("timestamp").alias("acquired_at"), F.col("value").alias("frp"), tier.alias("tier"), "event_type",
        (0.16 * (1 + (F.col("event_id") % 3) / 4.0)).alias("pixel_area"), (26 + (F.col("event_id") * 37 % 1800) / 100.0).alias("lng"), (36 + (F.col("event_id") * 53 % 600) / 100.0).alias("lat"),
    )


DET = """det as (select event_id, user_id as incident_id, ts as acquired_at, value as frp,
 case when event_type='error' then 'high' when event_type in ('purchase','signup') then 'nominal' else 'low' end as tier, event_type,
 0.16e0*(1+(event_id%3)/4.0e0) as pixel_area, 26+(event_id*37%1800)/100.0e0 as lng, 36+(event_id*53%600)/100.0e0 as lat from events)"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers as saved places."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("place_id"), F.col("c_nationkey").alias("region_id"), (26 + (F.col("c_custkey") * 37 % 1800) / 100.0).alias("lng"), (36 + (F.col("c_custkey") * 53 % 600) / 100.0).alias("lat"), F.element_at(F.array(F.lit(5.0), F.lit(10.0), F.lit(25.0)), (F.col("c_custkey") % 3 + 1).cast("int")).alias("radius_km"))


PLACES = """places as (select c_custkey as place_id, c_nationkey as region_id, 26+(c_custkey*37%1800)/100.0e0 as lng, 36+(c_custkey*53%600)/100.0e0 as lat,
 case c_custkey%3 when 0 then 5.0e0 when 1 then 10.0e0 else 25.0e0 end as radius_km from customer)"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """suppliers as entities with a place."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("site_id"), F.col("s_nationkey").alias("region_id"), (26 + (F.col("s_suppkey") * 131 % 1800) / 100.0).alias("lng"), (36 + (F.col("s_suppkey") * 79 % 600) / 100.0).alias("lat"), F.col("s_acctbal").alias("peak"))


SITES = """sites as (select s_suppkey as site_id, s_nationkey as region_id, 26+(s_suppkey*131%1800)/100.0e0 as lng, 36+(s_suppkey*79%600)/100.0e0 as lat, s_acctbal as peak from supplier)"""


def centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nations as region centres."""
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias("region_id"), F.col("n_name").alias("name"), (27 + (F.col("n_nationkey") * 71 % 1600) / 100.0).alias("lng"), (36.5 + (F.col("n_nationkey") * 97 % 500) / 100.0).alias("lat"))


CENTRES = """centres as (select n_nationkey::bigint as region_id, n_name as name, 27+(n_nationkey*71%1600)/100.0e0 as lng, 36.5e0+(n_nationkey*97%500)/100.0e0 as lat from nation)"""


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An L-shaped polygon around each centre, as rings."""
    x, y = F.col("lng"), F.col("lat")
    corner = lambda dx, dy: F.array(x + dx, y + dy)
    ring = F.array(corner(-0.8, -0.6), corner(0.9, -0.6), corner(0.9, 0.1), corner(0.1, 0.1), corner(0.1, 0.7), corner(-0.8, 0.7), corner(-0.8, -0.6))
    return centres(spark, sf_dir).select("region_id", F.array(ring).alias("rings"))


EDGES = """corners as (select region_id, lng, lat, unnest([-0.8e0,0.9e0,0.9e0,0.1e0,0.1e0,-0.8e0]) dx1, unnest([-0.6e0,-0.6e0,0.1e0,0.1e0,0.7e0,0.7e0]) dy1,
 unnest([0.9e0,0.9e0,0.1e0,0.1e0,-0.8e0,-0.8e0]) dx2, unnest([-0.6e0,0.1e0,0.1e0,0.7e0,0.7e0,-0.6e0]) dy2 from centres),
 edges as (select region_id, lng+dx1 x1, lat+dy1 y1, lng+dx2 x2, lat+dy2 y2 from corners)"""


def secs(c: str) -> F.Column:
    """Whole seconds of a time, the form in which both engines give times back."""
    return F.floor(F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000).cast("long")
