"""Coverage tiers, read off events as detections in even succession and customers as places."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage
from ..sources.tables import table
from .stand_ins import PLACES, places

BASE = "2024-01-01 00:00:00"
#: Seconds from one detection to the next (seven make a pass), and from one place's last sighting to the next one's.
STEP, SEEN_STEP = 200, 2000


def _base():
    return F.unix_timestamp(F.lit(BASE).cast("timestamp"))


def detections(spark, sf):
    i = F.col("event_id")
    at = F.timestamp_seconds(_base() + i * STEP + F.floor(i / 7) * 900)
    return table(spark, sf, "events").select(at.alias("at"), (26 + (i * i * 37 % 1800) / 100.0).alias("lng"), (36 + (i * 53 % 600) / 100.0).alias("lat"))


def seen_places(spark, sf):
    """Customers, every fourth of them moved east, out of what passes see."""
    k = F.col("place_id")
    p = places(spark, sf).select("place_id", "lat", (F.col("lng") + F.when(k % 4 == 0, 10 + k % 40 / 4.0).otherwise(0.0)).alias("lng"))
    return p.withColumn("last_seen", F.timestamp_seconds(_base() + k * SEEN_STEP))


def hulls(spark, sf):
    h = coverage.pass_hulls(detections(spark, sf), "at")
    return h.select("pass_id", "detections", F.round(F.element_at(F.element_at("ring", 1), 1), 6).alias("west"), F.round(F.array_max(F.transform("ring", lambda p: p[1])), 6).alias("north"))


def tiers(spark, sf):
    return coverage.coverage_tiers(seen_places(spark, sf), coverage.pass_hulls(detections(spark, sf), "at"), "place_id", "last_seen")


_PASSES = f"""d as (select timestamp '{BASE}' + to_seconds(event_id*{STEP} + event_id//7*900) as tm, 26+(event_id*event_id*37%1800)/100.0e0 x, 36+(event_id*53%600)/100.0e0 y from events),
 t as (select tm, case when lag(tm) over (order by tm) is null or tm - lag(tm) over (order by tm) > interval 10 minute then 1 else 0 end starts from (select distinct tm from d)),
 p as (select tm, sum(starts) over (order by tm) pass from t), m as (select pass, x, y, min(d.tm) over (partition by pass) started, count(*) over (partition by pass) n from d join p using (tm)),
 u as (select distinct pass, started, n, x, y from m), c as (select pass, count(*) points from u group by 1),
 g as (select a.pass, a.started, a.n, a.x x1, a.y y1, b.x x2, b.y y2 from u a join u b on a.pass=b.pass and (a.x<>b.x or a.y<>b.y)),
 e as (select g.* from g where not exists (select 1 from u o where o.pass=g.pass and (g.x2-g.x1)*(o.y-g.y1)-(g.y2-g.y1)*(o.x-g.x1) < -1e-12)
  union all select pass, started, n, x, y, x, y from u where pass in (select pass from c where points=1))"""
_OUTER = "o as (select pass, bool_or(exists (select 1 from u v where v.pass=e.pass and (x2-x1)*(v.y-y1)-(y2-y1)*(v.x-x1) > 1e-12)) wide from e group by 1)"
_K = "(6371.0e0*3.141592653589793e0/180)"
_DX, _DY = "((x2-x1)*cos(radians(lat)))", "(y2-y1)"
_AX, _AY = "((x1-lng)*cos(radians(lat)))", "(y1-lat)"
_T = f"greatest(0.0e0,least(1.0e0,coalesce(-({_AX}*{_DX}+{_AY}*{_DY})/nullif({_DX}*{_DX}+{_DY}*{_DY},0),0.0e0)))"
_DIST = f"(sqrt(power({_AX}+{_T}*{_DX},2)+power({_AY}+{_T}*{_DY},2))*{_K})"
TIERS_SQL = f"""with {_PASSES}, {_OUTER}, {PLACES},
 q as (select place_id, lat, lng + case when place_id%4=0 then 10+place_id%40/4.0e0 else 0.0e0 end lng, timestamp '{BASE}' + to_seconds(place_id*{SEEN_STEP}) seen from places),
 r as (select place_id, e.pass, bool_and((x2-x1)*(lat-y1)-(y2-y1)*(lng-x1) > 0) and any_value(o.wide) inside, min({_DIST}) km from q join e on e.started > q.seen join o on o.pass=e.pass group by 1, 2),
 b as (select place_id, bool_or(inside) inside, min(km) km from r group by 1)
 select place_id, case when b.place_id is null then 'none' when inside then 'inside_hull' {' '.join(f"when km<={k} then 'near_{k}'" for k in coverage.TIERS_KM)} else 'unknown' end tier from q left join b using (place_id)"""

QUERIES = {"c10_coverage_tiers": tiers, "a15_pass_hulls": hulls}
ORACLE = {
    "c10_coverage_tiers": TIERS_SQL,
    "a15_pass_hulls": f"""with {_PASSES}, f as (select distinct pass, started, n, x1, y1 from e)
 select epoch_us(any_value(started)) pass_id, any_value(n) detections, round(min(x1), 6) west, round(max(y1), 6) north from f group by pass""",
}
