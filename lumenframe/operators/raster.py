"""Shares of land-cover classes in boxes around points, from rasters stored as rows of tiles.

A tile (tile_row, tile_col, values) holds SIDE * SIDE codes, row by row from its north-west corner; tiles lie on one grid.
Equal boxes are cut once, however many points they are of. A box is cut out of every tile it touches: tiles that
no box touches are dropped by a semi-join, the others are split into blocks about as wide as a box, joined on the block,
and each piece is counted where it meets its box, so what travels on is one count per class.

Defined cases: points without id or place, and ones beyond MAX_LAT, have no box and null shares; pixels outside all
tiles don't count; a box without any pixel has null shares; codes without a name count as pixels of no class; null
codes too; repeated points give repeated rows; tiles must be unique; points
keep their columns, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

#: Half the side of the box.
RADIUS_M, METRES_PER_DEGREE, MAX_LAT = 750.0, 111_320.0, 89.0
BLOCK = 64

# Codes of the land-cover classes.
CLASSES = {10: "tree", 20: "shrub", 30: "grass", 40: "crop", 50: "built", 60: "bare", 70: "snow", 80: "water", 90: "wetland", 95: "mangrove", 100: "moss"}


class Grid(NamedTuple):
    """North-west corner and pixel size in degrees, and the pixels along a tile's side."""

    lat: float
    lng: float
    res_lat: float
    res_lng: float
    side: int


def boxes(points: DataFrame, grid: Grid, radius_m: float = RADIUS_M, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """point (all columns of points) and box: the pixels (y0, y1, x0, x1; ends exclusive) of the box around each."""
    la, ln = F.col(lat).cast("double"), F.col(lng).cast("double")
    d_lat = F.lit(radius_m / METRES_PER_DEGREE)
    d_lng = radius_m / (METRES_PER_DEGREE * F.cos(F.radians(la)))
    whole = lambda c, name: c.cast("long").alias(name)
    box = F.struct(
        whole(F.floor((grid.lat - (la + d_lat)) / grid.res_lat), "y0"), whole(F.ceil((grid.lat - (la - d_lat)) / grid.res_lat), "y1"),
        whole(F.floor((ln - d_lng - grid.lng) / grid.res_lng), "x0"), whole(F.ceil((ln + d_lng - grid.lng) / grid.res_lng), "x1"),
    )
    return points.select(F.struct("*").alias("point"), F.when(ln.isNotNull() & (F.abs(la) <= MAX_LAT), box).alias("box"))


def _touched(df: DataFrame, side: int, row: str, col: str) -> DataFrame:
    """df (y0, y1, x0, x1) once for each square of side pixels that its box touches."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / side).cast("long"), F.floor((F.col(b) - 1) / side).cast("long")))
    return df.withColumn(row, span("y0", "y1")).withColumn(col, span("x0", "x1"))


def _part(values: Column, side: int, top: Column, bottom: Column, left: Column, right: Column) -> Column:
    """Rows top to bottom and columns left to right (ends exclusive) of a square of values."""
    lines = F.sequence(top, bottom - 1)
    return F.flatten(F.transform(lines, lambda r: F.slice(values, (r * side + left + 1).cast("int"), (right - left).cast("int"))))


def blocks(tiles: DataFrame, side: int, block: int) -> DataFrame:
    """block_row, block_col, values of tiles cut into squares of block pixels, which must divide side."""
    n = side // block
    at = lambda name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    split = tiles.select("tile_row", "tile_col", "values", at("i")).select("*", at("j"))
    cut = _part(F.col("values"), side, F.col("i") * block, (F.col("i") + 1) * block, F.col("j") * block, (F.col("j") + 1) * block)
    return split.select((F.col("tile_row") * n + F.col("i")).alias("block_row"), (F.col("tile_col") * n + F.col("j")).alias("block_col"), cut.alias("values"))


def class_shares(points: DataFrame, tiles: DataFrame, grid: Grid, radius_m: float = RADIUS_M, classes: dict[int, str] = CLASSES, block: int = BLOCK, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """points with pixels (in its box) and shares: whole percent by class, halves rounded up, classes without a pixel left out."""
    if grid.side % block:
        block = grid.side
    placed = boxes(points, grid, radius_m, lat, lng)
    distinct = placed.where("box is not null").select("box.*").distinct()
    wanted = _touched(distinct, grid.side, "tile_row", "tile_col").select("tile_row", "tile_col").distinct()
    stored = blocks(tiles.select("tile_row", "tile_col", "values").join(wanted, ["tile_row", "tile_col"], "left_semi"), grid.side, block)
    top, left = F.col("block_row") * block, F.col("block_col") * block
    zero, end = F.lit(0).cast("long"), F.lit(block).cast("long")
    piece = _part(
        F.col("values"), block, F.greatest(F.col("y0") - top, zero), F.least(F.col("y1") - top, end), F.greatest(F.col("x0") - left, zero), F.least(F.col("x1") - left, end)
    )
    met = _touched(distinct, block, "block_row", "block_col").join(stored, ["block_row", "block_col"]).select("y0", "y1", "x0", "x1", piece.alias("piece"))
    codes = list(classes)
    count = lambda code: F.size(F.filter("piece", lambda v: v.eqNullSafe(F.lit(code)))).alias(f"c{code}")
    counts = met.select("y0", "y1", "x0", "x1", F.size("piece").alias("n"), *map(count, codes))
    sums = counts.groupBy("y0", "y1", "x0", "x1").agg(F.sum("n").alias("n"), *(F.sum(f"c{c}").alias(f"c{c}") for c in codes))
    share = lambda c: F.struct(F.lit(classes[c]).alias("k"), F.floor(F.col(f"c{c}") * 100.0 / F.col("n") + 0.5).cast("int").alias("v"), F.col(f"c{c}").alias("c"))
    present = F.transform(F.filter(F.array(*map(share, codes)), lambda s: s["c"] > 0), lambda s: F.struct(s["k"], s["v"]))
    told = sums.select(F.struct("y0", "y1", "x0", "x1").alias("box"), F.col("n").alias("pixels"), F.map_from_entries(present).alias("shares"))
    return placed.join(told, "box", "left").select("point.*", "pixels", "shares")
