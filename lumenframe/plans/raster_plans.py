"""Orders as the pixels of a land-cover raster, 300 wide and as long as they last, and customers as points on it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import raster
from ..sources.tables import table

WIDTH, GRID = 300, raster.Grid(40.0, 30.0, 0.0015, 0.0015, 50)
#: Codes that take turns; 0 is none.
CODES = [10, 40, 30, 50, 40, 20, 40, 90, 30, 100, 60, 0]


def tiles(spark, sf):
    """Tiles of 50 by 50 pixels, each put together from the orders on it; pixels without an order are 0."""
    side = GRID.side
    k = F.col("o_orderkey")
    row, col = F.floor(k / WIDTH), k % WIDTH
    turn = (F.floor(row / 7) * 5 + F.floor(col / 5) + F.when(F.col("o_custkey") % 3 == 0, 1).otherwise(0)) % len(CODES)
    px = table(spark, sf, "orders").select(row.alias("row"), col.alias("col"), F.element_at(F.lit(CODES), (turn + 1).cast("int")).alias("code"))
    placed = px.select(F.floor(F.col("row") / side).alias("tile_row"), F.floor(F.col("col") / side).alias("tile_col"), (F.col("row") % side * side + F.col("col") % side).cast("int").alias("k"), "code")
    blank = placed.select("tile_row", "tile_col").distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(side * side - 1))).alias("k"), F.lit(0).alias("code"))
    cells = placed.unionByName(blank).groupBy("tile_row", "tile_col", "k").agg(F.max("code").alias("code"))
    met = cells.groupBy("tile_row", "tile_col").agg(F.array_sort(F.collect_list(F.struct("k", "code"))).alias("cells"))
    return met.select("tile_row", "tile_col", F.col("cells.code").alias("values"))


def covers(spark, sf):
    """Each customer's ground: pixels of its box, shares of four classes, and the cover they make."""
    k = F.col("c_custkey")
    points = table(spark, sf, "customer").select("c_custkey", (GRID.lat - (k / 30.0 + 0.05) * GRID.res_lat).alias("lat"), (GRID.lng + (k * 37 % 3000 / 10.0 + 0.05) * GRID.res_lng).alias("lng"))
    found = raster.class_shares(points, tiles(spark, sf), GRID)
    part = lambda name: F.coalesce(F.try_element_at("shares", F.lit(name)), F.lit(0)).alias(name)
    return found.select("c_custkey", "pixels", *map(part, ("tree", "crop", "built", "grass")), F.when(F.col("shares").isNotNull(), rules.land_cover("shares")).alias("cover"))


def _covers_sql() -> str:
    """The assembled raster, one row per pixel, and every box over it."""
    named = [f"floor(count(*) filter (where code={c})*100.0e0/count(*)+0.5)::int as {n}" for c, n in ((10, "tree"), (40, "crop"), (50, "built"), (30, "grass"), (20, "shrub"), (90, "wetland"), (100, "moss"))]
    return f"""with o as (select o_orderkey//300 as y, o_orderkey%300 as x, ([{','.join(map(str, CODES))}])[((o_orderkey//300//7)*5+(o_orderkey%300)//5+(case when o_custkey%3=0 then 1 else 0 end))%12+1] as code from orders),
 t as (select distinct y//50 as ty, x//50 as tx from o), px as (select ty*50+i//50 as y, tx*50+i%50 as x from t, range(2500) r(i)), img as (select px.y, px.x, coalesce(code, 0) code from px left join o using (y, x)),
 p as (select c_custkey, 40.0e0-(c_custkey/30.0e0+0.05e0)*0.0015e0 as la, 30.0e0+((c_custkey*37%3000)/10.0e0+0.05e0)*0.0015e0 as ln from customer),
 b as (select c_custkey, floor((40.0e0-(la+750.0e0/111320.0e0))/0.0015e0)::bigint y0, ceil((40.0e0-(la-750.0e0/111320.0e0))/0.0015e0)::bigint y1,
  floor((ln-750.0e0/(111320.0e0*cos(radians(la)))-30.0e0)/0.0015e0)::bigint x0, ceil((ln+750.0e0/(111320.0e0*cos(radians(la)))-30.0e0)/0.0015e0)::bigint x1 from p),
 s as (select c_custkey, count(*) pixels, {', '.join(named)} from (select c_custkey, x0, x1, unnest(range(y0, y1)) y from b) w join img on img.y=w.y and img.x>=w.x0 and img.x<w.x1 group by 1)
 select c_custkey, pixels, coalesce(tree,0) tree, coalesce(crop,0) crop, coalesce(built,0) built, coalesce(grass,0) grass,
 case when pixels is null then null when built>=30 then 'built' when crop>=35 and tree+shrub<35 then 'agriculture' when tree+shrub+grass+wetland+moss>=60 then 'natural' else 'other' end cover from customer left join s using (c_custkey)"""


QUERIES = {"s14_land_cover_windows": covers}
ORACLE = {"s14_land_cover_windows": _covers_sql()}
