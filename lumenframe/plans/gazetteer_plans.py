"""Suppliers as districts of their nations, two of a name each, as shapes that spell them in seven ways, and as outlines with a hole."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gazetteer, spatial
from ..sources.tables import table
from .stand_ins import SITES, sites

#: Letters that stand for the digits of a number in a name, and what folding makes of them.
DIGITS, LETTERS, FOLDED = "0123456789", "çğıöşüabde", "cgiosuabde"
ALIASES = gazetteer.ALIASES | {"imbros": "yerğ"}


def _code(n, into=LETTERS):
    return F.translate(n.cast("long").cast("string"), DIGITS, into)


def districts(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("district_id"), F.concat(F.lit("Yer "), _code(F.floor(F.col("s_suppkey") / 2))).alias("name"), F.col("s_nationkey").alias("k"))
    centres = table(spark, sf, "nation").select((F.col("n_nationkey") + 1_000_000_000).alias("district_id"), F.lit("Merkez").alias("name"), F.col("n_nationkey").alias("k"))
    return s.unionByName(centres).select("district_id", "name", F.concat(F.lit("İl "), _code(F.col("k"))).alias("province"))


def shapes(spark, sf):
    k = F.col("s_suppkey")
    place, plain = _code(F.floor(k / 2)), _code(F.floor(k / 2), FOLDED)
    province = F.concat(F.lit("İl "), _code(F.col("s_nationkey")))
    ways = [
        F.concat(F.lit("YER-"), place), F.concat(F.lit("Yer "), plain), F.concat(F.lit("yer "), place, F.lit(" Merkez")), F.concat(F.lit("Yer "), plain, F.lit(" (merkez İlçe)")),
        F.when(k % 2 == 0, F.lit("Imbros")).otherwise(F.concat(F.lit("Başka "), place)), F.concat(province, F.lit(" District")), F.concat(F.lit("IL "), _code(F.col("s_nationkey"), FOLDED)),
    ]
    return table(spark, sf, "supplier").select(k.alias("shape_id"), F.element_at(F.array(*ways), (k % 7 + 1).cast("int")).alias("name"), province.alias("province"))


def matched(spark, sf):
    return gazetteer.matched_shapes(shapes(spark, sf), districts(spark, sf), ALIASES)


_N = "nullif(regexp_replace(translate(lower(replace({},'İ','i')),'âîû','aiu'),'[^a-zçğıöşü]','','g'),'')"
_F = "translate({},'çğıöşü','cgiosu')"
_C = "translate(({})::varchar,'0123456789','çğıöşüabde')"
_P = "translate(({})::varchar,'0123456789','cgiosuabde')"
MATCHED_SQL = f"""with g0 as (select s_suppkey id, 'Yer '||{_C.format('s_suppkey//2')} nm, s_nationkey k from supplier union all select n_nationkey+1000000000, 'Merkez', n_nationkey from nation),
 g as (select id, {_N.format('nm')} n, {_N.format("'İl '||" + _C.format('k'))} p from g0),
 h as (select s_suppkey shape_id, {_N.format("'İl '||" + _C.format('s_nationkey'))} p,
  case s_suppkey%7 when 0 then 'YER-'||{_C.format('s_suppkey//2')} when 1 then 'Yer '||{_P.format('s_suppkey//2')} when 2 then 'yer '||{_C.format('s_suppkey//2')}||' Merkez' when 3 then 'Yer '||{_P.format('s_suppkey//2')}||' (merkez İlçe)'
  when 4 then case when s_suppkey%2=0 then 'Imbros' else 'Başka '||{_C.format('s_suppkey//2')} end when 5 then 'İl '||{_C.format('s_nationkey')}||' District' else 'IL '||{_P.format('s_nationkey')} end nm,
  case s_suppkey%7 when 2 then 'yer '||{_C.format('s_suppkey//2')} when 3 then 'Yer '||{_P.format('s_suppkey//2')} when 5 then 'İl '||{_C.format('s_nationkey')} end base from supplier),
 s as (select shape_id, p, {_N.format('nm')} raw, {_N.format('base')} base from h),
 w as (select shape_id, p, 1 o, 'exact' stage, raw w, false f from s union all select shape_id, p, 2, 'folded', {_F.format('raw')}, true from s union all select shape_id, p, 3, 'alias', 'yerğ', false from s where raw='imbros'
  union all select shape_id, p, 4, 'centre', 'merkez', false from s where {_F.format('base')}={_F.format('p')} union all select shape_id, p, 5, 'centre', base, false from s where {_F.format('base')}<>{_F.format('p')}
  union all select shape_id, p, 6, 'centre', {_F.format('base')}, true from s where {_F.format('base')}<>{_F.format('p')} union all select shape_id, p, 7, 'bare_province', 'merkez', false from s where {_F.format('raw')}={_F.format('p')}),
 hit as (select w.shape_id, o, stage, min(id) id from w join g on g.p=w.p and case when f then {_F.format('g.n')} else g.n end=w.w group by 1, 2, 3 having count(*)=1),
 b as (select * from hit qualify row_number() over (partition by shape_id order by o)=1), c as (select *, count(*) over (partition by id) n from b)
 select s.shape_id, case when n=1 then id end district_id, stage, coalesce(n>1, false) as conflict from s left join c using (shape_id)"""

#: Corners of an outline around a supplier, a C that is open to the east, and of a hole in its back.
OUTER = [(-0.8, -0.6), (0.9, -0.6), (0.9, -0.3), (-0.1, -0.3), (-0.1, 0.4), (0.9, 0.4), (0.9, 0.7), (-0.8, 0.7), (-0.8, -0.6)]
HOLE = [(-0.7, -0.2), (-0.3, -0.2), (-0.3, 0.3), (-0.7, 0.3), (-0.7, -0.2)]


def outlines(spark, sf):
    """Edges of the outlines, each stretched by its supplier's number."""
    k = 1 + F.col("site_id") % 7 / 10.0
    ring = lambda corners: F.array(*(F.array(F.col("lng") + k * x, F.col("lat") + k * y) for x, y in corners))
    return spatial.polygon_edges(sites(spark, sf).select("site_id", F.array(ring(OUTER), ring(HOLE)).alias("rings")), "site_id", "rings")


def inner_points(spark, sf):
    edges = outlines(spark, sf)
    points = spatial.representative_points(edges, "site_id")
    across = points.join(edges, "site_id").groupBy("site_id", "lat", "lng").agg((F.count_if(spatial.geo.crosses("lat", "lng", "x1", "y1", "x2", "y2")) % 2 == 1).alias("inside"))
    return across.select("site_id", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "inside")


_SIDES = ", ".join(f"({a[0]}e0,{a[1]}e0,{b[0]}e0,{b[1]}e0)" for ring in (OUTER, HOLE) for a, b in zip(ring, ring[1:]))
INNER_SQL = f"""with {SITES}, c(a1,b1,a2,b2) as (values {_SIDES}), e as (select site_id, lng+k*a1 x1, lat+k*b1 y1, lng+k*a2 x2, lat+k*b2 y2 from (select *, 1+site_id%7/10.0e0 k from sites), c),
 m as (select site_id, (min(least(y1,y2))+max(greatest(y1,y2)))/2 mid from e group by 1), h as (select site_id, y1 y from e union select site_id, y2 from e),
 l as (select site_id, (max(y) filter (where y<=mid) + min(y) filter (where y>mid))/2 lvl from h join m using (site_id) group by 1),
 x as (select site_id, lvl, x1+(lvl-y1)*(x2-x1)/(y2-y1) x from e join l using (site_id) where (y1>lvl)<>(y2>lvl)),
 s as (select *, row_number() over (partition by site_id order by x) n, lead(x) over (partition by site_id order by x) nxt from x),
 b as (select site_id, lvl, x, nxt from s where n%2=1 qualify row_number() over (partition by site_id order by nxt-x desc, x)=1)
 select site_id, round(lvl,6) lat, round((x+nxt)/2,6) lng, true as inside from b"""

QUERIES = {"j23_matched_shapes": matched, "g14_inner_points": inner_points}
ORACLE = {"j23_matched_shapes": MATCHED_SQL, "g14_inner_points": INNER_SQL}
