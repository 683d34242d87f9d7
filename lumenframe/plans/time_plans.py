"""Passes, trends, persistence, windows, latest rows, caps and job health."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import alerts, passes, reporting, state
from ..sources.tables import table
from .stand_ins import AS_OF, DET, detections, secs


def _trend(minutes):
    return lambda spark, sf: passes.power_trend(detections(spark, sf), "incident_id", "acquired_at", "frp", "pixel_area", minutes)


def _trend_sql(minutes):
    return f"""with {DET}, marked as (select *, case when lag(acquired_at) over w is null or acquired_at - lag(acquired_at) over w > interval '{minutes} minutes' then 1 else 0 end s
 from det where incident_id is not null and frp is not null window w as (partition by incident_id order by acquired_at)),
 grouped as (select *, sum(s) over (partition by incident_id order by acquired_at range between unbounded preceding and current row) p from marked),
 folded as (select incident_id, p, sum(frp) power, avg(pixel_area) area from grouped group by 1,2),
 o as (select *, row_number() over (partition by incident_id order by p) rn, count(*) over (partition by incident_id) n from folded),
 h as (select incident_id, max(n) passes, avg(power) filter (where rn <= n//2) early, avg(power) filter (where rn > (n+1)//2) late, max(area)/nullif(min(area),0) g from o group by 1),
 r as (select *, case when passes>=3 and early>0 then late/early end ratio from h)
 select incident_id, passes, round(ratio,3) ratio, round(g,3) geometry_ratio,
 case when passes>=3 and g<=1.5 and ratio is not null then case when ratio<0.6 then 'weakening' when ratio>1.667 then 'intensifying' else 'stable' end end as trend from r"""


def pass_counts(spark, sf):
    times = detections(spark, sf).groupBy("incident_id").agg(F.collect_set("acquired_at").alias("t"))
    return times.select("incident_id", passes.pass_count(F.col("t"), 360).cast("long").alias("passes"))


def drift(spark, sf):
    return passes.drift(detections(spark, sf), "incident_id", "acquired_at", "lat", "lng", 360).withColumn("passes", F.col("passes").cast("long"))


def persistence(spark, sf):
    p = passes.persistence(detections(spark, sf), "incident_id", "acquired_at", "frp")
    return p.select("incident_id", F.size("seen_days").cast("long").alias("days"), "samples", *(F.round(c, d).alias(c) for c, d in (("power_sum", 3), ("mean", 3), ("deviation", 3), ("peak", 3))))


def persistence_merged(spark, sf):
    d = detections(spark, sf)
    half = lambda odd: passes.persistence(d.where(F.col("event_id") % 2 == odd), "incident_id", "acquired_at", "frp").drop("mean", "deviation")
    p = passes.merge_persistence(half(0), half(1), "incident_id")
    return p.select("incident_id", F.size("seen_days").cast("long").alias("days"), "samples", *(F.round(c, d).alias(c) for c, d in (("power_sum", 3), ("mean", 3), ("deviation", 3), ("peak", 3))))


PERSISTENCE_SQL = f"""with {DET}, s as (select incident_id, count(distinct acquired_at::date) as days, count(frp) samples, sum(frp) power_sum, sum(frp*frp) q, max(frp) peak from det group by 1)
 select incident_id, days, samples, round(power_sum,3) power_sum, round(power_sum/samples,3) mean, round(sqrt(greatest(0e0,q/samples-(power_sum/samples)*(power_sum/samples))),3) deviation, round(peak,3) peak from s"""


def rollup(spark, sf):
    """One pass over the observations gives every figure of an entity."""
    d = detections(spark, sf)
    out = d.groupBy("incident_id").agg(
        F.min("acquired_at").alias("a"), F.max("acquired_at").alias("b"), F.count("*").alias("n"), F.count("frp").alias("n_power"), F.round(F.max("frp"), 4).alias("peak"), F.round(F.avg("frp"), 4).alias("mean"),
        F.round(F.avg("lat"), 7).alias("lat"), F.round(F.avg("lng"), 7).alias("lng"), F.min_by("tier", rules.tier_rank("tier")).alias("tier"), reporting.mode_lowest("event_type").alias("kind"),
        F.array_join(F.array_sort(F.collect_set(F.date_format("acquired_at", "yyyy-MM-dd"))), ",").alias("days"), F.array_join(F.array_sort(F.collect_set("event_type")), "+").alias("kinds"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("acquired_at", "event_id"))), lambda s: s["event_id"].cast("string")), ",").alias("members"), F.sum(F.when(F.col("tier") == "high", 1).otherwise(0)).alias("n_high"),
        F.expr("count(*) filter (where tier = 'low')").alias("n_low"), F.countDistinct("event_type").alias("n_kinds"),
    )
    return out.withColumn("a", secs("a")).withColumn("b", secs("b"))


ROLLUP_SQL = f"""with {DET}, k as (select incident_id, event_type, row_number() over (partition by incident_id order by count(*) desc, event_type) r from det group by 1,2)
 select d.incident_id, floor(epoch(min(acquired_at)))::bigint a, floor(epoch(max(acquired_at)))::bigint b, count(*) n, count(frp) n_power, round(max(frp),4) peak, round(avg(frp),4) mean, round(avg(lat),7) lat, round(avg(lng),7) lng,
 case min(case tier when 'high' then 1 when 'nominal' then 2 else 3 end) when 1 then 'high' when 2 then 'nominal' else 'low' end tier, any_value(k.event_type) kind,
 (select string_agg(x, ',' order by x) from (select distinct strftime(acquired_at,'%Y-%m-%d') x from det e where e.incident_id=d.incident_id)) as days,
 (select string_agg(x, '+' order by x) from (select distinct event_type x from det e where e.incident_id=d.incident_id)) kinds,
 string_agg(event_id::varchar, ',' order by acquired_at, event_id) members, sum(case when tier='high' then 1 else 0 end)::bigint n_high, count(*) filter (where tier='low') n_low, count(distinct d.event_type) n_kinds
 from det d join k on k.incident_id=d.incident_id and k.r=1 group by d.incident_id"""


def heat_source(spark, sf):
    p = passes.persistence(detections(spark, sf).withColumn("frp", F.col("frp") / 20), "incident_id", "acquired_at", "frp").withColumn("days", F.size("seen_days")).withColumn("small", F.least("peak", F.lit(19.0)))
    return p.select(
        "incident_id", rules.persistent_source("days", "mean", "small").alias("fixed"), rules.interim_source("days", "small", "samples").alias("interim"),
        rules.significant("samples", "peak", F.lit("nominal")).alias("significant"), rules.strong("samples", "peak", F.lit("low")).alias("strong"), F.concat_ws("/", F.col("days"), rules.persistent_source("days", "mean", "peak")).alias("raw"),
    )


HEAT_SQL = f"""with {DET}, s as (select incident_id, count(distinct acquired_at::date) as days, count(frp) samples, sum(frp/20)/count(frp) mean, max(frp/20) peak from det group by 1)
 select incident_id, days>=7 and mean<5 and least(peak,19e0)<20 fixed, days>=2 and least(peak,19e0)<10 and samples>=6 interim, samples>=2 and peak>=8 significant, peak>=15 strong,
 days||'/'||(days>=7 and mean<5 and peak<20) raw from s"""


def latest_previous(spark, sf):
    o = table(spark, sf, "orders")
    got = state.latest_with_previous(o, "o_custkey", "o_orderdate", "o_totalprice", "o_orderkey")
    return got.select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("latest"), F.round("previous_o_totalprice", 2).alias("previous"))


LATEST_SQL = """with r as (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) n, max(o_orderdate) over (partition by o_custkey) top from orders),
 p as (select o_custkey, o_totalprice, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) n from r where o_orderdate < top)
 select r.o_custkey, r.o_orderkey, round(r.o_totalprice,2) latest, round(p.o_totalprice,2) previous from r left join p on p.o_custkey=r.o_custkey and p.n=1 where r.n=1"""


def trailing(spark, sf):
    got = alerts.trailing_count(detections(spark, sf), "incident_id", "acquired_at", 6)
    return got.select("event_id", "recent", (F.col("recent") > 3).alias("capped"))


TRAILING_SQL = f"""with {DET} select event_id, count(*) over w recent, count(*) over w > 3 capped from det window w as (partition by incident_id order by acquired_at range between interval 6 hours preceding and current row)"""


def status_times(spark, sf):
    d = detections(spark, sf)
    return d.groupBy("event_type").agg(F.max(F.when(F.col("tier") == "high", F.col("acquired_at"))).alias("h"), F.max_by("event_id", F.struct("acquired_at", "event_id")).alias("last_event"), F.max("acquired_at").alias("t")).select("event_type", secs("h").alias("last_high"), secs("t").alias("last_any"), "last_event")


STATUS_SQL = f"""with {DET} select event_type, floor(epoch(max(acquired_at) filter (where tier='high')))::bigint last_high, floor(epoch(max(acquired_at)))::bigint last_any, arg_max(event_id, (acquired_at, event_id)) last_event from det group by 1"""


def job_health(spark, sf):
    d = detections(spark, sf)
    runs = d.select(F.col("event_type").alias("job"), F.when(F.col("tier") == "low", "skipped").otherwise("ok").alias("status"), F.col("acquired_at").alias("finished_at"), (F.col("event_id") % 5).alias("n_in"), (F.col("event_id") % 2).alias("n_out"))
    got = alerts.health(runs, F.lit(AS_OF).cast("timestamp"), {"click": 1.0, "error": 1.0, "purchase": 0.001, "absent": 3.0})
    return got.withColumn("last_ok", secs("last_ok"))


HEALTH_SQL = f"""with {DET}, runs as (select event_type job, case when tier='low' then 'skipped' else 'ok' end status, acquired_at f, event_id%5 i, event_id%2 o from det),
 jobs(job, h) as (values ('click',1e0),('error',1e0),('purchase',0.001e0),('absent',3e0)),
 s as (select job, max(f) filter (where status='ok') ok, max(f) alive, arg_max(status,(f,status)) last_status, arg_max(i,(f,status)) i, arg_max(o,(f,status)) o from runs group by 1)
 select j.job, floor(epoch(ok))::bigint last_ok, last_status, coalesce(epoch(timestamp '{AS_OF}'-alive)/3600.0 > 2*h, true) stale, coalesce(i>0 and o=0,false) anomaly from jobs j left join s using (job)"""


def runs_of_silence(spark, sf):
    hours = detections(spark, sf).groupBy("event_type", F.date_trunc("hour", "acquired_at").alias("h")).agg(F.count("*").alias("n")).withColumn("busy", F.col("n") >= 2)
    return passes.contiguous_runs(hours, "event_type", "h", "busy", 3600).select("event_type", secs("starts_at").alias("starts_at"), secs("ends_at").alias("ends_at"), "samples")


RUNS_SQL = f"""with {DET}, h as (select event_type, date_trunc('hour', acquired_at) h, count(*) n from det group by 1,2), b as (select *, case when h - lag(h) over (partition by event_type order by h) <= interval 90 minutes then 0 else 1 end s from h where n>=2),
 g as (select *, sum(s) over (partition by event_type order by h) p from b) select event_type, epoch(min(h))::bigint starts_at, epoch(max(h))::bigint ends_at, count(*) samples from g group by event_type, p"""


def cooldowns(spark, sf):
    return alerts.cooldown(detections(spark, sf), "incident_id", "acquired_at", 6).select("incident_id", F.unix_micros("fired_at").alias("fired_us"))


COOLDOWN_SQL = f"""with recursive {DET}, t as (select incident_id, epoch_us(acquired_at) u from det group by 1,2), f as (select incident_id, min(u) u from t group by 1
 union all select f.incident_id, (select min(t.u) from t where t.incident_id=f.incident_id and t.u >= f.u + 21600000000) from f where f.u is not null)
 select incident_id, u fired_us from f where u is not null"""


def window_limit(spark, sf):
    return alerts.fixed_window_limit(detections(spark, sf), "event_type", "acquired_at", 60, 5).withColumn("window_start", secs("window_start"))


WINDOW_SQL = f"""with {DET} select event_type, epoch(date_trunc('hour', acquired_at))::bigint window_start, count(*) requests, least(count(*),5) allowed from det group by 1,2"""


def sessions(spark, sf):
    d = detections(spark, sf)
    w = F.session_window("acquired_at", "6 hours")
    return d.groupBy("incident_id", w.alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("frp"), 4).alias("power")).select("incident_id", secs("w.start").alias("starts_at"), "n", "power")


SESSION_SQL = f"""with {DET}, m as (select *, case when acquired_at - lag(acquired_at) over (partition by incident_id order by acquired_at) <= interval 6 hours then 0 else 1 end s from det),
 g as (select *, sum(s) over (partition by incident_id order by acquired_at range between unbounded preceding and current row) p from m)
 select incident_id, floor(epoch(min(acquired_at)))::bigint starts_at, count(*) n, round(sum(frp),4) power from g group by incident_id, p"""

QUERIES = {
    "c6_power_trend": _trend(10), "c6_power_trend_6h": _trend(360), "w1_pass_count": pass_counts, "c5_drift": drift, "a10_persistence": persistence, "a10_persistence_merged": persistence_merged,
    "a1_entity_rollup": rollup, "p17_heat_source": heat_source, "w8_latest_previous": latest_previous, "w9_trailing_cap": trailing, "w10_latest_status": status_times, "c24_job_health": job_health,
    "c12_contiguous_runs": runs_of_silence, "c29_cooldown": cooldowns, "c30_fixed_window": window_limit, "w2_sessions": sessions,
}
ORACLE = {
    "c6_power_trend": _trend_sql(10), "c6_power_trend_6h": _trend_sql(360),
    "w1_pass_count": f"with {DET}, t as (select distinct incident_id, acquired_at from det), m as (select incident_id, case when acquired_at - lag(acquired_at) over (partition by incident_id order by acquired_at) <= interval 6 hours then 0 else 1 end s from t) select incident_id, sum(s)::bigint passes from m group by 1",
    "c5_drift": f"""with {DET}, m as (select incident_id, (epoch_us(min(acquired_at))+epoch_us(max(acquired_at)))/2 mid from det group by 1),
 p as (select incident_id, sum(s)::bigint passes from (select incident_id, case when acquired_at - lag(acquired_at) over (partition by incident_id order by acquired_at) <= interval 6 hours then 0 else 1 end s from det) group by 1),
 h as (select d.incident_id, count(*) n, avg(lat) filter (where epoch_us(acquired_at)<=mid) la1, avg(lng) filter (where epoch_us(acquired_at)<=mid) ln1, avg(lat) filter (where epoch_us(acquired_at)>mid) la2, avg(lng) filter (where epoch_us(acquired_at)>mid) ln2,
 avg(epoch_us(acquired_at)) filter (where epoch_us(acquired_at)<=mid) t1, avg(epoch_us(acquired_at)) filter (where epoch_us(acquired_at)>mid) t2 from det d join m using (incident_id) group by 1)
 select incident_id, n, passes, round(case when degrees(atan2(ln2-ln1,la2-la1))<0 then degrees(atan2(ln2-ln1,la2-la1))+360 else degrees(atan2(ln2-ln1,la2-la1)) end,2) bearing,
 round(2*6371.0e0*asin(sqrt(least(1e0,power(sin(radians(la2-la1)/2),2)+cos(radians(la1))*cos(radians(la2))*power(sin(radians(ln2-ln1)/2),2))))*1000/((t2-t1)/3.6e9),2) speed_mh,
 case when passes>=4 and n>=10 then 'moderate' else 'low' end confidence from h join p using (incident_id) where passes>=2 and n>=4 and t2>t1""",
    "a10_persistence": PERSISTENCE_SQL, "a10_persistence_merged": PERSISTENCE_SQL, "a1_entity_rollup": ROLLUP_SQL, "p17_heat_source": HEAT_SQL, "w8_latest_previous": LATEST_SQL, "w9_trailing_cap": TRAILING_SQL,
    "w10_latest_status": STATUS_SQL, "c24_job_health": HEALTH_SQL, "c12_contiguous_runs": RUNS_SQL, "c29_cooldown": COOLDOWN_SQL, "c30_fixed_window": WINDOW_SQL, "w2_sessions": SESSION_SQL,
}
