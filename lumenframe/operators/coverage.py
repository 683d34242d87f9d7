"""Whether a later pass looked at a place without seeing it: inside the hull of what the pass saw, or near it, by tiers.

Passes are hulls with a time; a place takes the strongest tier of any pass that started after it was
last seen. So for each spot and tier it is enough to know the latest pass that fits: places at one spot ask
once, of passes with one ring the latest is asked, and a tier asks only for the spots that hold a
place that the stronger ones haven't told. Spots and hulls meet by cells as wide as the tier's radius at
least, a hull standing in the cells that its box reaches. A hull that fits a cell as a whole tells all its spots and
spares them the earlier ones, a hull that fits none of it is left out, and only the others are measured spot by spot. A
hull is a ring in its row and has few corners.

Distances are planar, scaled at the place's latitude; a place on a hull's edge is near it at 0 km,
as a hull holds its inside only. A hull of two points or one holds nothing but has a distance.

Defined cases: a place without coordinates or time, and any place where there are no later
passes, is `none`; a later pass beyond the last tier leaves it `unknown`; rows that repeat stay
rows of their own; null rings and times make no pass; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geo
from .durable import keep
from .passes import with_pass_index
from .spatial import KM_PER_DEGREE, band_width, box_cells, convex_hulls, point_cell

TIERS_KM = (50, 100, 250, 500)
#: Least width of a cell: hulls are large, and narrower cells would repeat each of them many times.
CELL_KM = 50
#: Degrees by which a cell is taken to be wider, against rounding.
EDGE = 1e-9


def pass_hulls(detections: DataFrame, at: str, lat: str = "lat", lng: str = "lng", gap_minutes: float = 10, bucket_hours: int = 24) -> DataFrame:
    """pass_id, started_at, detections, ring of each pass: detections of all entities no more than the gap apart.

    A pass ends only at a gap, so distinct times are folded by day first and days are joined where none lies between.
    """
    times = detections.where(F.col(at).isNotNull()).select(F.col(at).cast("timestamp").alias("at")).distinct()
    us, day_us = F.unix_micros("at"), bucket_hours * 3_600_000_000
    daily = times.withColumn("day", F.floor(us / day_us).cast("long"))
    ends = daily.groupBy("day").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    # one row for each day
    before = ends.select("day", F.lag("last").over(Window.orderBy("day")).alias("before"))
    marked = with_pass_index(daily, "day", "at", gap_minutes).join(before, "day")
    first = marked.groupBy("day", "pass_idx").agg(F.min("at").alias("started_at"), F.first("before").alias("before"))
    goes_on = (F.col("pass_idx") == 1) & F.coalesce(F.unix_micros("started_at") - F.unix_micros("before") <= int(gap_minutes * 60_000_000), F.lit(False))
    # a pass that goes on from the day before belongs to the last one that started: looked up over the passes' own starts
    starts = first.select("day", "pass_idx", F.when(~goes_on, F.col("started_at")).alias("own"))
    carried = starts.groupBy("day").agg(F.max("own").alias("latest"))
    carried = carried.select("day", F.last("latest", ignorenulls=True).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    named = starts.join(carried, "day").select("day", "pass_idx", F.coalesce("own", "carried").alias("started_at"))
    of_time = marked.select("day", "pass_idx", "at").join(named, ["day", "pass_idx"]).select("at", F.unix_micros("started_at").alias("pass_id"))
    seen = detections.select(F.col(at).cast("timestamp").alias("at"), F.col(lat).alias("lat"), F.col(lng).alias("lng")).join(of_time, "at")
    counts = seen.groupBy("pass_id").agg(F.count("*").alias("detections"))
    return convex_hulls(seen, "pass_id").join(counts, "pass_id").select("pass_id", F.timestamp_micros("pass_id").alias("started_at"), "detections", "ring")


def _edges(ring: str) -> Column:
    n = F.size(ring) - 1
    return F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), lambda a, b: F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")))


def _left(lat: geo.C, lng: geo.C, e: Column) -> Column:
    """Positive where a point lies to the left of an edge."""
    lat, lng = (F.col(c) if isinstance(c, str) else c for c in (lat, lng))
    return (e["x2"] - e["x1"]) * (lat - e["y1"]) - (e["y2"] - e["y1"]) * (lng - e["x1"])


def inside_ring(lat: geo.C, lng: geo.C, ring: str) -> Column:
    """Whether a point lies inside a counter-clockwise convex ring, its edges left out."""
    return (F.size(ring) > 3) & F.forall(_edges(ring), lambda e: _left(lat, lng, e) > 0)


def ring_km(lat: geo.C, lng: geo.C, ring: str) -> Column:
    """Distance of a point to a ring's edges."""
    return F.array_min(F.transform(_edges(ring), lambda e: geo.segment_distance_km(lat, lng, e["x1"], e["y1"], e["x2"], e["y2"])))


def coverage_tiers(places: DataFrame, hulls: DataFrame, place_id: str, last_seen: str, lat: str = "lat", lng: str = "lng", tiers_km: tuple[int, ...] = TIERS_KM) -> DataFrame:
    """place_id, tier: inside_hull, near_<km>, unknown or none.

    hulls: pass_id, started_at, ring (closed, counter-clockwise, [lng, lat]).
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    x, y = F.transform("ring", lambda p: p[0]), F.transform("ring", lambda p: p[1])
    # of passes with the same ring the latest one tells all
    rings = hulls.where("ring is not null and started_at is not null and size(ring) > 1").groupBy("ring").agg(F.max(us("started_at")).alias("_from"))
    shapes = keep(rings.select("_from", "ring", F.array_min(x).alias("w"), F.array_max(x).alias("e"), F.array_min(y).alias("s"), F.array_max(y).alias("n")))
    latest = shapes.agg(F.max("_from")).first()[0]
    rows = places.select(place_id, us(last_seen).alias("_seen"), F.col(lat).cast("double").alias("_lat"), F.col(lng).cast("double").alias("_lng"))
    able = F.col("_seen").isNotNull() & F.col("_lat").isNotNull() & F.col("_lng").isNotNull() & F.coalesce(F.col("_seen") < F.lit(latest), F.lit(False))
    # _known: the latest pass that fits so far
    spots = rows.where(able).groupBy("_lat", "_lng").agg(F.min("_seen").alias("_first"), F.max("_seen").alias("_last")).withColumn("_known", F.lit(None).cast("long"))
    names = []
    for name, radius in [("inside_hull", None), *((f"near_{km}", km) for km in tiers_km)]:
        spots = keep(_with_latest(spots, shapes, radius, name))
        names.append(name)
    tier = F.coalesce(*(F.when(F.col("_seen") < F.col(n), n) for n in names), F.lit("unknown"))
    told = rows.join(spots.select("_lat", "_lng", *names), ["_lat", "_lng"], "left")
    return told.select(place_id, F.when(able, tier).otherwise("none").alias("tier"))


def _with_latest(spots: DataFrame, shapes: DataFrame, radius: float | None, name: str) -> DataFrame:
    """spots with column `name`, the latest pass that fits, where that tells more than _known; _known is raised by it."""
    cell_km = max(radius or 0, CELL_KM)
    step = cell_km / KM_PER_DEGREE
    at = ["cell_row", "cell_col"]
    waiting = point_cell(spots.where("_known is null or _last >= _known"), "_lat", "_lng", step)
    waiting = waiting.withColumn("_after", F.greatest(F.col("_first"), F.col("_known")))
    # the least that any place of a cell asks for; cells without waiting places need no shapes
    asked = waiting.groupBy(*at).agg(F.min("_after").alias("_least"))
    width = band_width(F.col("cell_row"), step)
    sides = {"_s": F.col("cell_row") * step - EDGE, "_n": (F.col("cell_row") + 1) * step + EDGE, "_w": F.col("cell_col") * width - EDGE, "_e": (F.col("cell_col") + 1) * width + EDGE}
    asked = keep(asked.withColumns(sides))
    met = box_cells(shapes, step).join(asked, at).where("_from > _least")
    sure, never = _of_cell(radius)
    met = keep(met.select(*at, "_from", "ring", "w", "e", "s", "n", F.when(sure, "sure").when(never, "never").otherwise("partly").alias("_fit")).where("_fit <> 'never'"))
    whole = met.where("_fit = 'sure'").groupBy(*at).agg(F.max("_from").alias("_whole"))
    # in a cell that one pass fits as a whole only later ones are left to ask
    partly = met.where("_fit = 'partly'").join(whole, at, "left").where("_whole is null or _from > _whole").drop("_fit", "_whole")
    dx = F.greatest(F.col("w") - F.col("_lng"), F.col("_lng") - F.col("e"), F.lit(0.0)) * F.cos(F.radians("_lat"))
    dy = F.greatest(F.col("s") - F.col("_lat"), F.col("_lat") - F.col("n"), F.lit(0.0))
    near = F.sqrt(dx * dx + dy * dy) * KM_PER_DEGREE <= (radius or 0) * 1.000001
    fits = inside_ring("_lat", "_lng", "ring") if radius is None else ring_km("_lat", "_lng", "ring") <= radius
    single = waiting.join(partly, at).where((F.col("_from") > F.col("_after")) & near & fits).groupBy("_lat", "_lng").agg(F.max("_from").alias("_single"))
    placed = point_cell(spots, "_lat", "_lng", step).join(whole, at, "left").join(single, ["_lat", "_lng"], "left")
    found = F.greatest("_whole", "_single")
    return placed.withColumn(name, found).withColumn("_known", F.greatest("_known", name)).drop(*at, "_whole", "_single")


def _of_cell(radius: float | None) -> tuple[Column, Column]:
    """Whether a ring fits every point of its cell, and whether it fits none, as far as the cell's corners or middle tell."""
    s, n, w, e = (F.col(c) for c in ("_s", "_n", "_w", "_e"))
    if radius is None:
        corners = [(s, w), (s, e), (n, w), (n, e)]
        sure = reduce(and_, (inside_ring(a, b, "ring") for a, b in corners))
        never = (F.size("ring") <= 3) | F.exists(_edges("ring"), lambda edge: reduce(and_, (_left(a, b, edge) <= 0 for a, b in corners)))
    else:
        # distances are scaled at the place's own latitude, so the middle's are stretched by what that differs inside the cell
        cos = lambda c: F.cos(F.radians(c))
        most = F.when((s < 0) & (n > 0), 1.0).otherwise(F.greatest(cos(s), cos(n)))
        least = F.least(cos(s), cos(n))
        half = F.sqrt(((n - s) / 2) * ((n - s) / 2) + ((e - w) / 2 * most) * ((e - w) / 2 * most)) * KM_PER_DEGREE
        km = ring_km((s + n) / 2, (w + e) / 2, "ring")
        sure = km * most / cos((s + n) / 2) + half <= radius * (1 - 1e-9)
        never = km * least / cos((s + n) / 2) - half > radius * (1 + 1e-9)
    # next to a pole a cell has no width
    return F.coalesce(sure, F.lit(False)), F.coalesce(never, F.lit(False))
