"""Distance joins, nearest neighbours, point in polygon, hulls and density clusters.

A distance join puts both sides on a grid whose cells are as wide as the radius and
equi-joins on the cell, the probing side repeated over the nine neighbours; the
exact distance decides after. Rows at one place are measured once. Work follows the places per cell,
never the product of the tables.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geo
from .durable import cut, keep
from .graph import connected_components

KM_PER_DEGREE = geo.EARTH_KM * 3.141592653589793 / 180
#: Rows that a broadcast dimension may have; beyond it joins are left to the planner.
BROADCAST_ROWS = 20_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint only if it is counted to hold few rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _cells(lat: Column, lng: Column, radius_km: float, spread: bool) -> Column:
    """Cell of a point, or the nine around it. Longitude cells widen with the latitude band they lie in."""
    step = radius_km / KM_PER_DEGREE
    row = F.floor(lat / step)

    def cell(r: Column, dx: Column) -> Column:
        top = F.least(F.lit(89.0), F.greatest(F.abs(r * step), F.abs((r + 1) * step)))
        width = step / F.cos(F.radians(top)) * 1.000001
        return F.struct(r.cast("long").alias("r"), (F.floor(lng / width) + dx).cast("long").alias("c"))

    if not spread:
        return F.array(cell(row, F.lit(0)))
    near = F.sequence(F.lit(-1), F.lit(1))
    return F.flatten(F.transform(near, lambda dr: F.transform(near, lambda dx: cell(row + dr, dx))))


def _spots(df: DataFrame, at: tuple[str, str], apart: tuple[str, ...] = ()) -> DataFrame:
    """The distinct places of rows that have one: apart's columns, la, ln."""
    return df.select(*apart, F.col(at[0]).cast("double").alias("la"), F.col(at[1]).cast("double").alias("ln")).where("la is not null and ln is not null").distinct()


def _met(b: DataFrame, radius_km: float) -> DataFrame:
    """b's spots as la2, ln2 with their cell, and that of a turn to the west and to the east, for places beyond the 180th meridian."""
    turned = b.withColumnsRenamed({"la": "la2", "ln": "ln2"}).withColumn("turn", F.explode(F.array(F.lit(0), F.lit(-360), F.lit(360))))
    return turned.select("*", F.explode(_cells(F.col("la2"), F.col("ln2") + F.col("turn"), radius_km, False)).alias("cell")).drop("turn")


def _spot_pairs(a: DataFrame, b: DataFrame, radius_km: float) -> DataFrame:
    """la, ln, la2, ln2, km of the spots of a (further columns stay) and b at most radius_km apart."""
    probing = a.select("*", F.explode(_cells(F.col("la"), F.col("ln"), radius_km, True)).alias("cell"))
    return probing.join(_met(b, radius_km), "cell").drop("cell").withColumn("km", geo.haversine_km("la", "ln", "la2", "ln2")).where(F.col("km") <= float(radius_km))


#: Rows of one spot that go to one task with all their partners, and partners that travel in one row.
SPOT_ROWS = 8192


def within_distance(left: DataFrame, right: DataFrame, radius_km: float, left_at: tuple[str, str] = ("lat", "lng"), right_at: tuple[str, str] = ("lat", "lng"), row_radius_km: str | None = None) -> DataFrame:
    """Pairs (columns l, r as structs, km) at most radius_km apart; row_radius_km names a smaller radius of the left row.

    Places are measured once each, not once a row. The pairs of rows are then put together in as many tasks as
    a shuffle has, however few bytes come in, with the rows of a crowded place dealt over several.
    """
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = left.select(F.struct("*").alias("l"), F.col(left_at[0]).cast("double").alias("la"), F.col(left_at[1]).cast("double").alias("ln")).where("la is not null and ln is not null")
    b = right.select(F.struct("*").alias("r"), F.col(right_at[0]).cast("double").alias("la2"), F.col(right_at[1]).cast("double").alias("ln2")).where("la2 is not null and ln2 is not null")
    crowds = a.groupBy("la", "ln").agg(F.ceil(F.count("*") / SPOT_ROWS).cast("int").alias("parts"))
    pairs = _spot_pairs(crowds, b.select(F.col("la2").alias("la"), F.col("ln2").alias("ln")).distinct(), radius_km)
    again = b.groupBy("la2", "ln2").agg(F.ceil(F.count("*") / SPOT_ROWS).cast("int").alias("shares"))
    dealt = b.join(again, ["la2", "ln2"]).withColumn("share", F.floor(F.rand(1) * F.col("shares")))
    lists = dealt.groupBy("la2", "ln2", "share").agg(F.collect_list("r").alias("rs")).drop("share")
    told = pairs.join(lists, ["la2", "ln2"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("la", "ln", "part", "km", "rs")
    rows = a.join(crowds, ["la", "ln"]).withColumn("part", F.floor(F.rand(2) * F.col("parts")).cast("int")).drop("parts").repartition(tasks, "la", "ln", "part")
    limit = F.least(F.lit(float(radius_km)), F.col("l")[row_radius_km]) if row_radius_km else F.lit(float(radius_km))
    return rows.join(told, ["la", "ln", "part"]).where(F.col("km") <= limit).select("l", F.explode("rs").alias("r"), "km")


def counts_within(left: DataFrame, right: DataFrame, radius_km: float, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """left with n, the right rows at most radius_km away (0 without coordinates): distinct places are measured, with their rows' number."""
    there = right.groupBy(F.col(lat).cast("double").alias("la2"), F.col(lng).cast("double").alias("ln2")).agg(F.count("*").alias("n"))
    pairs = _spot_pairs(_spots(left, (lat, lng)), _spots(right, (lat, lng)), radius_km)
    of_spot = pairs.join(there, ["la2", "ln2"]).groupBy("la", "ln").agg(F.sum("n").alias("n"))
    placed = left.withColumns({"la": F.col(lat).cast("double"), "ln": F.col(lng).cast("double")})
    return placed.join(of_spot, ["la", "ln"], "left").select(*(F.col(f"`{c}`") for c in left.columns), F.coalesce("n", F.lit(0)).alias("n"))


def nearest_of_few(points: DataFrame, centres: DataFrame, centre_id: str, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """points with nearest_id and nearest_km among a dimension of few centres (counted before it is broadcast); ties take the lower id."""
    if centres.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        raise ValueError("too many centres for a broadcast; use nearest_within")
    few = F.array_agg(F.struct(F.col(centre_id).alias("id"), F.col(lat).alias("la"), F.col(lng).alias("ln")))
    listed = centres.agg(few.alias("_centres"))
    best = F.array_min(F.transform("_centres", lambda c: F.struct(geo.haversine_km(lat, lng, c["la"], c["ln"]).alias("km"), c["id"].alias("id"))))
    return points.crossJoin(F.broadcast(listed)).withColumn("_best", best).drop("_centres").withColumn("nearest_id", F.col("_best.id")).withColumn("nearest_km", F.col("_best.km")).drop("_best")


def _nearest_spots(a: DataFrame, b: DataFrame, apart: tuple[str, ...], radius_km: float) -> DataFrame:
    """apart's columns, la, ln and the nearest (km, k) of b's spots (least key k) for each of a's, if within radius_km.

    The radius grows from one that holds about one of b's spots, and only spots that found nothing go on: who finds one within
    the radius has met all that are nearer. So a spot meets few others however many there are.
    """
    a, b = keep(a), keep(b)
    box = b.groupBy(*apart).agg(F.count("*").alias("n"), F.min("la").alias("s"), F.max("la").alias("x"), F.min("ln").alias("w"), F.max("ln").alias("e"))
    area = F.greatest(F.col("x") - F.col("s"), F.lit(0.01)) * F.greatest((F.col("e") - F.col("w")) * F.cos(F.radians((F.col("x") + F.col("s")) / 2)), F.lit(0.01))
    dense = box.agg(F.percentile(F.sqrt(area / F.col("n")), 0.5)).first()[0]
    radius = min(radius_km, max(0.05, (dense or 1.0) * KM_PER_DEGREE))
    told, rest = None, a
    key = [*apart, "la", "ln"]
    while True:
        probing = rest.select("*", F.explode(_cells(F.col("la"), F.col("ln"), radius, True)).alias("cell"))
        near = probing.join(_met(b, radius), [*apart, "cell"]).withColumn("km", geo.haversine_km("la", "ln", "la2", "ln2")).where(F.col("km") <= radius)
        found = keep(near.groupBy(*key).agg(F.min(F.struct("km", "k")).alias("b")))
        told = found if told is None else told.union(found)
        if radius >= radius_km:
            return told
        rest = keep(rest.join(found, key, "left_anti"))
        if rest.isEmpty():
            return told
        radius = min(radius * 4, radius_km)
        if radius > FAR_KM:
            # cells this wide are no help: the few that are left meet all of theirs
            by = F.broadcast(rest) if rest.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rest
            met = b.select(*apart, "k", F.col("la").alias("la2"), F.col("ln").alias("ln2"))
            near = (met.join(by, [*apart]) if apart else met.crossJoin(by)).withColumn("km", geo.haversine_km("la", "ln", "la2", "ln2")).where(F.col("km") <= radius_km)
            return told.union(near.groupBy(*key).agg(F.min(F.struct("km", "k")).alias("b")))


#: Radius beyond which cells are not used; half the earth's circumference, with no place farther.
FAR_KM, HALF_ROUND_KM = 2000.0, 20100.0


def nearest_within(left: DataFrame, right: DataFrame, left_key: str, right_key: str, radius_km: float, apart: tuple[str, ...] = (), lat: str = "lat", lng: str = "lng") -> DataFrame:
    """left_key, right_key, km of the nearest right row within the radius; ties take the lower key.

    apart names columns that both rows must share. Rows at one place are asked and met once.
    """
    there = right.select(*apart, F.col(right_key).alias("k"), F.col(lat).cast("double").alias("la"), F.col(lng).cast("double").alias("ln")).where("k is not null and la is not null and ln is not null")
    best = _nearest_spots(_spots(left, (lat, lng), apart), there.groupBy(*apart, "la", "ln").agg(F.min("k").alias("k")), apart, radius_km)
    placed = left.select(*{left_key: 0, **dict.fromkeys(apart)}, F.col(lat).cast("double").alias("la"), F.col(lng).cast("double").alias("ln"))
    of_key = placed.join(best, [*apart, "la", "ln"]).groupBy(left_key).agg(F.min("b").alias("b"))
    return of_key.select(left_key, F.col("b.k").alias(right_key), F.col("b.km").alias("km"))


def polygon_edges(polygons: DataFrame, polygon_id: str, rings: str) -> DataFrame:
    """Edges (polygon_id, x1, y1, x2, y2) of an array of closed rings, each an array of [lng, lat]."""
    ring = polygons.select(polygon_id, F.explode(rings).alias("ring"))
    pairs = F.zip_with(F.slice("ring", F.lit(1), F.size("ring") - 1), F.slice("ring", F.lit(2), F.size("ring") - 1), lambda a, b: F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")))
    return ring.select(polygon_id, F.explode(pairs).alias("e")).select(polygon_id, "e.*")


def boxes(edges: DataFrame, polygon_id: str) -> DataFrame:
    """polygon_id, w, e, s, n of each polygon."""
    return edges.groupBy(polygon_id).agg(F.min(F.least("x1", "x2")).alias("w"), F.max(F.greatest("x1", "x2")).alias("e"), F.min(F.least("y1", "y2")).alias("s"), F.max(F.greatest("y1", "y2")).alias("n"))


def band_width(row: Column, step: float) -> Column:
    """Longitude width of the cells in a row of latitude; null next to a pole, where one cell is the whole row."""
    top = F.greatest(F.abs(row * step), F.abs((row + 1) * step))
    return F.when(top < 89, step / F.cos(F.radians(top)) * 1.000001)


def _column(x: Column, row: Column, step: float) -> Column:
    return F.coalesce(F.floor(x / band_width(row, step)), F.lit(0)).cast("long")


def point_cell(points: DataFrame, lat: str, lng: str, step: float) -> DataFrame:
    """points with cell_row and cell_col on a grid of `step` degrees."""
    placed = points.withColumn("cell_row", F.floor(F.col(lat) / step).cast("long"))
    return placed.withColumn("cell_col", _column(F.col(lng), F.col("cell_row"), step))


def box_cells(shapes: DataFrame, step: float) -> DataFrame:
    """shapes (w, e, s, n) once for each cell that is at most a cell's width away from their box."""
    rows = shapes.withColumn("cell_row", F.explode(F.sequence(F.floor(F.col("s") / step).cast("long") - 1, F.floor(F.col("n") / step).cast("long") + 1)))
    reach = F.coalesce(band_width(F.col("cell_row"), step), F.lit(0.0))
    return rows.withColumn("cell_col", F.explode(F.sequence(_column(F.col("w") - reach, F.col("cell_row"), step), _column(F.col("e") + reach, F.col("cell_row"), step))))


def near_boxes(points: DataFrame, shapes: DataFrame, lat: str, lng: str, radius_km: float) -> DataFrame:
    """points with each box at most radius_km away, in the plane scaled at the point's latitude: joined by cell, a box standing in every cell it reaches."""
    step = radius_km / KM_PER_DEGREE
    placed, spread = point_cell(points, lat, lng, step), box_cells(shapes, step)
    dx = F.greatest(F.col("w") - F.col(lng), F.col(lng) - F.col("e"), F.lit(0.0)) * F.cos(F.radians(lat))
    dy = F.greatest(F.col("s") - F.col(lat), F.col(lat) - F.col("n"), F.lit(0.0))
    return placed.join(spread, ["cell_row", "cell_col"]).where(F.sqrt(dx * dx + dy * dy) * KM_PER_DEGREE <= radius_km * 1.000001).drop("cell_row", "cell_col", "w", "e", "s", "n")


def _measured(near: DataFrame, edges: DataFrame, point_id: str, polygon_id: str, lat: str, lng: str) -> DataFrame:
    """(point_id, polygon_id, crossings, km) of candidate pairs: the edges stand as rows, so both are plain aggregates."""
    met = near.join(small(edges), polygon_id)
    across = F.count_if(geo.crosses(lat, lng, "x1", "y1", "x2", "y2"))
    return met.groupBy(point_id, polygon_id).agg(across.alias("crossings"), F.min(geo.segment_distance_km(lat, lng, "x1", "y1", "x2", "y2")).alias("km"))


#: Cell side for points and the boxes they lie in, and the radii that are tried in turn for those outside: the last reaches everything.
BOX_KM, RADII_KM = 100.0, (50.0, 200.0, 800.0, 3200.0, 12800.0, 51200.0)


def points_in_polygons(points: DataFrame, edges: DataFrame, point_id: str, polygon_id: str, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """(point_id, polygon_id, depth_km) of each polygon that holds a point: cell and box first, then even-odd parity over edges."""
    at = points.select(point_id, lat, lng)
    near = near_boxes(at, boxes(edges, polygon_id), lat, lng, BOX_KM).select(point_id, lat, lng, polygon_id)
    return _measured(near, edges, point_id, polygon_id, lat, lng).where("crossings % 2 = 1").select(point_id, polygon_id, F.col("km").alias("depth_km"))


def assign_polygon(points: DataFrame, edges: DataFrame, point_id: str, polygon_id: str, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """point_id, polygon_id, inside: the polygon that holds the point deepest (ties: lower id), else the nearest one.

    Points outside look for polygons within a radius that grows until one is found; a point without coordinates, or any point where there are no polygons, has none.
    """
    held = points_in_polygons(points, edges, point_id, polygon_id, lat, lng)
    inside = F.lit(True).alias("inside")
    told = cut(held.groupBy(point_id).agg(F.min(F.struct(-F.col("depth_km"), F.col(polygon_id).alias("p"))).alias("b")).select(point_id, F.col("b.p").alias(polygon_id), inside))
    shapes = cut(boxes(edges, polygon_id))
    rest = cut(points.select(point_id, lat, lng).join(told, point_id, "left_anti"))
    for radius in RADII_KM:
        if rest.isEmpty():
            break
        near = near_boxes(rest, shapes, lat, lng, radius).select(point_id, lat, lng, polygon_id)
        best = _measured(near, edges, point_id, polygon_id, lat, lng).groupBy(point_id).agg(F.min(F.struct("km", F.col(polygon_id).alias("p"))).alias("b"))
        found = cut(best.where(F.col("b.km") <= radius).select(point_id, F.col("b.p").alias(polygon_id), F.lit(False).alias("inside")))
        told = told.union(found)
        rest = cut(rest.join(found, point_id, "left_anti"))
    return points.select(point_id).join(told, point_id, "left").select(point_id, polygon_id, F.coalesce("inside", F.lit(False)).alias("inside"))


def representative_points(edges: DataFrame, polygon_id: str) -> DataFrame:
    """polygon_id, lat, lng of a point inside each polygon (edges of all its rings), holes and hollows left out.

    A level line runs half-way between the two heights of corners next to the middle, so it meets no corner; its crossings, sorted, bound what
    lies inside in turn, and the middle of the widest stretch is taken, the western one of equals. A polygon without height has no point. Edges stand as rows; repeated ones count once.
    """
    lines = edges.where(F.col(polygon_id).isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull() & F.col("x2").isNotNull() & F.col("y2").isNotNull()).select(polygon_id, "x1", "y1", "x2", "y2").distinct()
    middle = lines.groupBy(polygon_id).agg(((F.min(F.least("y1", "y2")) + F.max(F.greatest("y1", "y2"))) / 2).alias("_mid"))
    heights = lines.select(polygon_id, F.explode(F.array("y1", "y2")).alias("_y")).join(small(middle), polygon_id)
    level = heights.groupBy(polygon_id).agg(((F.max(F.when(F.col("_y") <= F.col("_mid"), F.col("_y"))) + F.min(F.when(F.col("_y") > F.col("_mid"), F.col("_y")))) / 2).alias("_level"))
    met = lines.join(small(level.where(F.col("_level").isNotNull())), polygon_id).where((F.col("y1") > F.col("_level")) != (F.col("y2") > F.col("_level")))
    x = F.col("x1") + (F.col("_level") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    order = Window.partitionBy(polygon_id).orderBy("_x")
    stretches = met.select(polygon_id, "_level", x.alias("_x")).withColumn("_n", F.row_number().over(order)).withColumn("_to", F.lead("_x").over(order)).where("_n % 2 = 1 and _to is not null")
    widest = stretches.groupBy(polygon_id, "_level").agg(F.max(F.struct((F.col("_to") - F.col("_x")).alias("w"), (-F.col("_x")).alias("x"))).alias("b"))
    return widest.select(polygon_id, F.col("_level").alias("lat"), (F.col("b.w") / 2 - F.col("b.x")).alias("lng"))


def border_gate(inside_home: Column, home_km: Column, in_neighbour: Column, sea_km: float = 5.0, land_km: float = 1.5) -> Column:
    """Inside, or within sea_km of the border unless on a neighbour's land farther than land_km in."""
    return inside_home | ((home_km <= sea_km) & ~(F.coalesce(in_neighbour, F.lit(False)) & (home_km > land_km)))


def density_clusters(points: DataFrame, point_id: str, eps_m: float = 1200.0, lat: str = "lat", lng: str = "lng", apart: str | None = None) -> DataFrame:
    """(point_id, cluster) of clusters in which each point has a neighbour within eps: components of the eps graph.

    apart names a column of whole numbers; points that differ in it are never linked, so many sets are clustered at once.

    Distances are planar in the equal-area projection. Points of one small square (side eps / sqrt 2) are
    linked to its first one - they are all within eps - so a crowded place gives a line of links, not its
    square; only squares that touch are compared point by point.
    """
    x, y = geo.laea_xy(lat, lng)
    side = eps_m / 2**0.5
    placed = cut(points.where(F.col(lat).isNotNull() & F.col(lng).isNotNull()).select(F.col(point_id).cast("long").alias("id"), (F.col(apart) if apart else F.lit(0)).cast("long").alias("g"), x.alias("x"), y.alias("y")).withColumn("i", F.floor(F.col("x") / side)).withColumn("j", F.floor(F.col("y") / side)))
    heads = placed.groupBy("g", "i", "j").agg(F.min("id").alias("head"))
    own = placed.join(heads, ["g", "i", "j"]).select(F.col("id").alias("a"), F.col("head").alias("b"))
    # one representative link per pair of squares within reach: the closest pair of their points
    distinct = placed.groupBy("g", "i", "j", "x", "y").agg(F.min("id").alias("id"))
    reach = [(di, dj) for di in range(-2, 3) for dj in range(-2, 3) if (di, dj) > (0, 0) and not (abs(di) == 2 and abs(dj) == 2)]
    moves = F.explode(F.array(*(F.struct(F.lit(di).alias("di"), F.lit(dj).alias("dj")) for di, dj in reach)))
    left = distinct.select(moves.alias("m"), *(F.col(c) for c in ("g", "i", "j", "x", "y", "id"))).select("g", (F.col("i") + F.col("m.di")).alias("i"), (F.col("j") + F.col("m.dj")).alias("j"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("id").alias("a"), F.col("i").alias("i1"), F.col("j").alias("j1"))
    near = (F.col("x1") - F.col("x")) ** 2 + (F.col("y1") - F.col("y")) ** 2 <= eps_m * eps_m
    across = left.join(distinct, ["g", "i", "j"]).where(near).groupBy("g", "i", "j", "i1", "j1").agg(F.min(F.struct("a", F.col("id").alias("b"))).alias("s")).select("s.a", "s.b")
    labels = connected_components(own.union(across), "a", "b")
    return placed.join(labels, "id", "left").select(F.col("id").alias(point_id), F.coalesce("component", "id").alias("cluster"))


def convex_hulls(points: DataFrame, key: str, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """key, ring (closed, counter-clockwise from the leftmost point, [lng, lat]) of each group's hull.

    Each task first keeps only the corners of its share of a group, so what meets in one place is small.
    """

    def hull(xy: list[tuple[float, float]]) -> list[tuple[float, float]]:
        xy = sorted(set(xy))
        if len(xy) < 3:
            return xy

        def half(seq):
            out: list[tuple[float, float]] = []
            for p in seq:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(p)
            return out[:-1]

        return half(xy) + half(reversed(xy))

    def corners(batches):
        for pdf in batches:
            # what has three points at most is all corners
            few = pdf.groupby("key")["key"].transform("size") < 4
            yield pdf[few]
            pdf = pdf[~few]
            parts = [(k, *p) for k, g in pdf.groupby("key", sort=False) for p in hull(list(zip(g["lng"], g["lat"])))]
            yield pd.DataFrame(parts, columns=["key", "lng", "lat"])

    def close(batches):
        for pdf in batches:
            rings = [hull([(p["lng"], p["lat"]) for p in xy]) for xy in pdf["xy"]]
            yield pd.DataFrame({"key": pdf["key"], "ring": [[list(p) for p in [*ring, ring[0]]] for ring in rings]})

    rows = points.where(F.col(lat).isNotNull() & F.col(lng).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(lng).cast("double").alias("lng"), F.col(lat).cast("double").alias("lat"))
    few = rows.mapInPandas(corners, "key long, lng double, lat double")
    met = few.groupBy("key").agg(F.collect_list(F.struct("lng", "lat")).alias("xy"))
    return met.mapInPandas(close, "key long, ring array<array<double>>").withColumnRenamed("key", key)


def swath_coverage(track: DataFrame, points: DataFrame, half_swath_km: float, platform: str = "platform", max_step_seconds: int = 120, reach_km: float = 1600.0) -> DataFrame:
    """For each point and platform the least cross-track share of the half swath over the track's segments.

    track: platform, at, lat, lng samples in order. covered means a share of at most 1, near_nadir at most 0.6.
    """
    follow = Window.partitionBy(platform).orderBy("at")
    segments = track.select(platform, "at", "lat", "lng", F.lead("lat").over(follow).alias("lat2"), F.lead("lng").over(follow).alias("lng2"), F.lead("at").over(follow).alias("at2")).where(
        (F.unix_micros(F.col("at2").cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))) <= max_step_seconds * 1_000_000
    )
    pairs = within_distance(points, segments, reach_km)
    seg = F.col("r")
    length = geo.haversine_km(seg["lat"], seg["lng"], seg["lat2"], seg["lng2"])
    along = geo.along_track_km(seg["lat"], seg["lng"], seg["lat2"], seg["lng2"], F.col("l.lat"), F.col("l.lng"))
    across = geo.cross_track_km(seg["lat"], seg["lng"], seg["lat2"], seg["lng2"], F.col("l.lat"), F.col("l.lng"))
    share = pairs.where((along >= 0) & (along <= length)).select(F.col("l.point_id").alias("point_id"), seg[platform].alias(platform), (across / half_swath_km).alias("share"), seg["at"].alias("at"))
    best = share.groupBy("point_id", platform).agg(F.min(F.struct("share", "at")).alias("b"))
    return best.select("point_id", platform, F.col("b.at").alias("at"), F.col("b.share").alias("share"), (F.col("b.share") <= 1).alias("covered"), (F.col("b.share") <= 0.6).alias("near_nadir"))
