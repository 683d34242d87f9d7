"""Incidents as a stored state that runs of observations extend.

A run takes the observations of the last `window` that no run has linked yet, clusters them, and goes through
the clusters in the order of their least observation id: a cluster joins the nearest incident that is open (seen
within `match` of the run, not officially closed) and at most MATCH_KM from one of its points, else it starts
one, named by that id. What a cluster starts or lengthens is there for later clusters of the run.

As `window` is no longer than `match`, every cluster of a run leaves an open incident behind. So the nearest
one among stored points and earlier clusters' points is known without the order being walked: each cluster
points to its nearest target, pointers only lead to stored incidents or lower ids, and doubling them finds
the incident of all clusters at once, in as many rounds as the longest chain has binary digits.

Only open incidents are state. One that no later run can extend leaves it with the run that finds so, and is
told once. Distances are compared at whole millimetres, ties go to the lower id.

Defined cases: rows without id, time or place take no part; rows of one id count once, the earliest; a linked
id that comes again changes nothing; null power counts in no sum; an empty run expires incidents only;
other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import geo
from .durable import keep
from .passes import GAP_MINUTES, pass_flag
from .spatial import KM_PER_DEGREE, density_clusters, point_cell, within_distance

CLUSTER_M, MATCH_KM, WINDOW_HOURS, MATCH_HOURS = 1200.0, 2.0, 24, 72
#: Side of the squares whose first points stand for all of theirs in a first comparison, and a bound on their diagonal.
SQUARE_KM, DIAGONAL_KM = 0.25, 0.358
#: Tiers from weakest; others rank below all.
TIERS = ("low", "nominal", "high")

SCHEMAS = {
    "entities": "entity long, first_at timestamp, last_at timestamp, detections long, power_sum double, power_sum_sq double, samples long, peak double, tier int",
    "points": "entity long, lat double, lng double",
    "times": "entity long, at timestamp",
    "ledger": "id long, at timestamp, entity long",
}


class State(NamedTuple):
    """entities: folded sums; points, times: distinct ones of each; ledger: ids linked within the window."""

    entities: DataFrame
    points: DataFrame
    times: DataFrame
    ledger: DataFrame


def empty(spark: SparkSession) -> State:
    return State(*(spark.createDataFrame([], schema) for schema in SCHEMAS.values()))


def _mm(km: Column) -> Column:
    return F.round(km * 1e6).cast("long")


def _squares(sets: DataFrame) -> DataFrame:
    """sets with the square of each point."""
    return point_cell(sets, "lat", "lng", SQUARE_KM / KM_PER_DEGREE)


def nearest_sets(left: DataFrame, right: DataFrame, radius_km: float = MATCH_KM) -> DataFrame:
    """set, target, mm: for each point set (set, lat, lng) the nearest other one of right (target, lat, lng, below) within reach.

    below: the target is for sets of a higher id only. Squares are compared by one point each first; of those only pairs that can hold the
    nearest points of the nearest target, by the diagonals of both, are compared point by point, so crowded places don't meet as their product.
    """
    rep = lambda df, key: df.groupBy(*key, "cell_row", "cell_col").agg(F.min(F.struct("lat", "lng")).alias("p")).select(*key, "cell_row", "cell_col", "p.lat", "p.lng")
    a, b = _squares(left), _squares(right)
    l, r = F.col("l"), F.col("r")
    other = (l["set"] != r["target"]) & (~r["below"] | (r["target"] < l["set"]))
    near = within_distance(rep(a, ["set"]), rep(b, ["target", "below"]), radius_km + 2 * DIAGONAL_KM).where(other).select(
        l["set"].alias("set"), r["target"].alias("target"), l["cell_row"].alias("ar"), l["cell_col"].alias("ac"), r["cell_row"].alias("br"), r["cell_col"].alias("bc"), "km"
    )
    bound = near.groupBy("set").agg(F.min("km").alias("most"))
    doubtful = near.join(bound, "set").where(F.col("km") - 2 * DIAGONAL_KM <= F.least("most", F.lit(float(radius_km)))).drop("km", "most")
    ours = a.select("set", F.col("cell_row").alias("ar"), F.col("cell_col").alias("ac"), F.col("lat").alias("lat1"), F.col("lng").alias("lng1"))
    theirs = b.select("target", F.col("cell_row").alias("br"), F.col("cell_col").alias("bc"), "lat", "lng")
    met = doubtful.join(ours, ["set", "ar", "ac"]).join(theirs, ["target", "br", "bc"]).select("set", "target", _mm(geo.haversine_km("lat1", "lng1", "lat", "lng")).alias("mm"))
    best = met.where(F.col("mm") <= int(radius_km * 1e6)).groupBy("set").agg(F.min(F.struct("mm", "target")).alias("b"))
    return best.select("set", "b.target", "b.mm")


def roots(pointers: DataFrame) -> DataFrame:
    """id, root of pointers (id, up) that lead to lower ids or out of the table: doubled until none moves."""
    while True:
        further = pointers.select(F.col("id").alias("up"), F.col("up").alias("next"))
        moved = keep(pointers.join(further, "up", "left").select("id", F.coalesce("next", "up").alias("up"), (F.col("next").isNotNull() & (F.col("next") != F.col("up"))).alias("moved")))
        if moved.where("moved").isEmpty():
            return moved.select("id", F.col("up").alias("root"))
        pointers = moved.select("id", "up")


def open_entities(entities: DataFrame, as_of: Column, match_hours: int = MATCH_HOURS) -> DataFrame:
    return entities.where(F.col("last_at") > as_of - F.make_dt_interval(hours=F.lit(match_hours)))


def extend(
    state: State, detections: DataFrame, as_of: Column, window_hours: int = WINDOW_HOURS, match_hours: int = MATCH_HOURS, closed: DataFrame | None = None, clusters: DataFrame | None = None
) -> tuple[State, State]:
    """The state after a run over detections (id, at, lat, lng, power, tier), and what expired before it.

    closed: entity ids that are officially closed; nothing joins them. clusters: (id, cluster) where the run's clusters are known already. The tables given back are plans over state and kept tables:
    the caller writes them (version by version in a stream).
    """
    if window_hours > match_hours:
        raise ValueError("a run's window can't be longer than the time in which incidents match")
    spark = detections.sparkSession
    since = as_of - F.make_dt_interval(hours=F.lit(window_hours))
    live = open_entities(state.entities, as_of, match_hours)
    ids = live.select("entity")
    expired = State(state.entities.join(ids, "entity", "left_anti"), state.points.join(ids, "entity", "left_anti"), state.times.join(ids, "entity", "left_anti"), empty(spark).ledger)

    rank = F.coalesce(F.array_position(F.lit(list(TIERS)), F.col("tier")), F.lit(0)).cast("int")
    rows = detections.where("id is not null and lat is not null and lng is not null").where((F.col("at") > since) & (F.col("at") <= as_of))
    rows = rows.select(F.col("id").cast("long").alias("id"), F.struct(F.col("at").cast("timestamp").alias("at"), F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"), F.col("power").cast("double").alias("power"), rank.alias("tier")).alias("r"))
    fresh = keep(rows.groupBy("id").agg(F.min("r").alias("r")).select("id", "r.*").join(state.ledger.select("id"), "id", "left_anti"))

    member = keep(fresh.join(density_clusters(fresh, "id", CLUSTER_M) if clusters is None else clusters.select("id", "cluster"), "id"))
    sets = member.select("cluster", "lat", "lng").distinct()
    able = ids if closed is None else ids.join(closed.select("entity"), "entity", "left_anti")
    targets = state.points.join(able, "entity").select(F.col("entity").alias("target"), "lat", "lng", F.lit(False).alias("below"))
    targets = targets.unionByName(sets.select(F.col("cluster").alias("target"), "lat", "lng", F.lit(True).alias("below")))
    nearest = nearest_sets(sets.withColumnRenamed("cluster", "set"), targets)
    named = member.select(F.col("cluster").alias("id")).distinct()
    pointers = keep(named.join(nearest.select(F.col("set").alias("id"), "target"), "id", "left").select("id", F.coalesce("target", "id").alias("up")))
    linked = member.join(roots(pointers).select(F.col("id").alias("cluster"), F.col("root").alias("entity")), "cluster")

    sums = linked.groupBy("entity").agg(
        F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("detections"), F.coalesce(F.sum("power"), F.lit(0.0)).alias("power_sum"),
        F.coalesce(F.sum(F.col("power") * F.col("power")), F.lit(0.0)).alias("power_sum_sq"), F.count("power").alias("samples"), F.max("power").alias("peak"), F.max("tier").alias("tier"),
    )
    entities = live.unionByName(sums).groupBy("entity").agg(
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), *(F.sum(c).alias(c) for c in ("detections", "power_sum", "power_sum_sq", "samples")), *(F.max(c).alias(c) for c in ("peak", "tier"))
    )
    points = state.points.join(ids, "entity", "left_semi").unionByName(linked.select("entity", "lat", "lng")).distinct()
    times = state.times.join(ids, "entity", "left_semi").unionByName(linked.select("entity", "at")).distinct()
    ledger = state.ledger.where(F.col("at") > since).unionByName(linked.select("id", "at", "entity"))
    return State(entities, points, times, ledger), expired


def told(state: State) -> DataFrame:
    """entity, first_at, last_at, detections, passes, days, points, lat, lng (mean of its points), mean_power, deviation, peak, tier of each incident."""
    seen = state.times.withColumn("_starts", pass_flag("entity", "at", GAP_MINUTES)).groupBy("entity").agg(F.sum("_starts").alias("passes"), F.countDistinct(F.to_date("at")).alias("days"))
    exact = lambda c: F.sum(F.col(c).cast("decimal(31,9)")).cast("double") / F.count("*")
    places = state.points.groupBy("entity").agg(F.count("*").alias("points"), exact("lat").alias("lat"), exact("lng").alias("lng"))
    n = F.nullif("samples", F.lit(0))
    mean = F.col("power_sum") / n
    name = F.element_at(F.lit(["unknown", *TIERS]), F.col("tier") + 1)
    return state.entities.join(seen, "entity").join(places, "entity").select(
        "entity", "first_at", "last_at", "detections", "passes", "days", "points", "lat", "lng", mean.alias("mean_power"),
        F.sqrt(F.greatest(F.lit(0.0), F.col("power_sum_sq") / n - mean * mean)).alias("deviation"), "peak", name.alias("tier"),
    )
