"""Events as detections scattered around the sites of their users, folded into incidents week by week."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import incidents
from ..operators.durable import keep
from ..operators.spatial import density_clusters
from ..sources.tables import table
from .stand_ins import secs

#: Runs a week apart, each over its week; an incident matches for as long.
HOURS = 168
RUNS = [datetime(2024, 1, 1) + timedelta(hours=HOURS * k) for k in range(1, 6)]


def scattered(spark, sf) -> DataFrame:
    """Detections up to 4 km north and 2 km east of a site, on steps of 0.001 and 0.013 degrees."""
    e = table(spark, sf, "events")
    tier = F.when(F.col("event_type") == "error", "high").when(F.col("event_type").isin("purchase", "signup"), "nominal").otherwise("low")
    north, east = (F.col("event_id") * 7919 % 40) / 1000.0, (F.floor(F.col("event_id") / 40) % 3) * 13 / 1000.0
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), (36 + (F.col("user_id") * 53 % 600) / 100.0 + north).alias("lat"),
        (26 + (F.col("user_id") * 37 % 1800) / 100.0 + east).alias("lng"), F.col("value").alias("power"), tier.alias("tier"),
    )


def folded(spark, sf):
    """Every incident after the weekly runs: those still open and those that expired on the way. The weeks don't overlap, so their clusters are found at once."""
    rows, state, done = scattered(spark, sf), incidents.empty(spark), []
    week = F.ceil((F.unix_micros("at") - F.unix_micros(F.lit(RUNS[0]).cast("timestamp"))) / (HOURS * 3_600_000_000))
    clusters = keep(density_clusters(rows.withColumn("week", week), "id", incidents.CLUSTER_M, apart="week"))
    for as_of in RUNS:
        after, expired = incidents.extend(state, rows, F.lit(as_of).cast("timestamp"), HOURS, HOURS, clusters=clusters)
        state = incidents.State(*map(keep, after))
        done.append(incidents.told(expired))
    found = reduce(DataFrame.unionByName, done, incidents.told(state))
    micro = lambda c: F.floor(F.col(c) * 1_000_000).cast("long").alias(f"{c}_micro")
    return found.select("entity", secs("first_at").alias("first_at"), secs("last_at").alias("last_at"), "detections", "passes", "days", "points", micro("lat"), micro("lng"), F.round("mean_power", 6).alias("mean_power"), "peak", "tier")


QUERIES = {"c3_incidents": folded}
ORACLE: dict[str, str] = {}
