"""Queries of reported sightings, read off events and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import haversine_sql
from ..operators import sightings
from .stand_ins import AS_OF, SITES, secs, sites
from ..sources.tables import table

#: As many suppliers are districts that events can name.
DISTRICTS = 1000


def incidents(spark, sf):
    """Every fourth error event as an incident near the supplier of its user, known three to six hours after it starts."""
    e = table(spark, sf, "events").where("event_type = 'error' and event_id % 4 = 0")
    k, at = F.col("user_id") % DISTRICTS + 1, F.col("ts").cast("timestamp")
    hours = lambda n: F.make_dt_interval(F.lit(0), n.cast("int"))
    return e.select(
        F.col("event_id").alias("incident_id"), at.alias("first_at"), (at + hours(F.col("event_id") % 5 * 6)).alias("last_at"), (at + hours(3 + F.col("event_id") % 4)).alias("known_at"),
        (F.col("event_id") % 11 == 0).alias("fixed"), (F.col("event_id") % 7 == 0).alias("closed"),
        (26 + (k * 131 % 1800) / 100.0 + (F.col("event_id") % 17 - 8) / 50.0).alias("lng"), (36 + (k * 79 % 600) / 100.0 + (F.col("event_id") % 13 - 6) / 50.0).alias("lat"),
    )


def reports(spark, sf):
    """View and click events as reports from the supplier of their user."""
    e = table(spark, sf, "events").where("event_type in ('view', 'click')")
    return e.select(F.col("event_id").alias("report_id"), (F.col("user_id") % DISTRICTS + 1).alias("district_id"), F.col("ts").cast("timestamp").alias("published_at"))


def _judged(spark, sf):
    return sightings.judge(reports(spark, sf), incidents(spark, sf), sites(spark, sf).withColumnRenamed("site_id", "district_id"))


def outcomes(spark, sf):
    return _judged(spark, sf).select("report_id", "district_id", "outcome", "sighting_id")


def lifecycle(spark, sf):
    found = sightings.sightings(_judged(spark, sf), F.lit(AS_OF))
    return found.select("sighting_id", "district_id", secs("first_reported_at").alias("first_reported"), secs("last_reported_at").alias("last_reported"), "reports", "status", secs("resolved_at").alias("resolved"), "incident_id", "km")


_H = "interval {} hour"
JUDGED = f"""{SITES}, inc as (select event_id incident_id, ts first_at, ts + to_hours((event_id%5*6)::int) last_at, ts + to_hours((3+event_id%4)::int) known_at, event_id%11=0 fixed, event_id%7=0 closed,
  26+((user_id%{DISTRICTS}+1)*131%1800)/100.0e0+(event_id%17-8)/50.0e0 lng, 36+((user_id%{DISTRICTS}+1)*79%600)/100.0e0+(event_id%13-6)/50.0e0 lat from events where event_type='error' and event_id%4=0),
 near as (select site_id district_id, incident_id, round({haversine_sql('s.lat', 's.lng', 'i.lat', 'i.lng')},4) km, first_at, last_at, known_at, fixed, closed from sites s, inc i
  where i.lat between s.lat-0.2 and s.lat+0.2 and {haversine_sql('s.lat', 's.lng', 'i.lat', 'i.lng')} <= {sightings.RADIUS_KM}),
 told as (select event_id report_id, user_id%{DISTRICTS}+1 district_id, ts t from events where event_type in ('view','click') and user_id%{DISTRICTS}+1 in (select site_id from sites)),
 nearby as (select distinct report_id from told join near using (district_id) where not closed and t >= known_at and t <= last_at + interval {sightings.ACTIVE_HOURS} hour),
 conf as (select report_id, min({{'at': greatest(t, known_at), 'km': km, 'incident_id': incident_id}}) best from told join near using (district_id) where not fixed
  and first_at between t - interval {sightings.GRACE_HOURS} hour and t + interval {sightings.WINDOW_HOURS} hour and known_at <= t + interval {sightings.WINDOW_HOURS} hour group by 1),
 e as (select report_id, district_id, t, best, t + interval {sightings.WINDOW_HOURS} hour expires, coalesce(best['at'], t + interval {sightings.WINDOW_HOURS} hour) close_at from told left join conf using (report_id) where report_id not in (select report_id from nearby)),
 nxt as (select a.report_id, min({{'t': b.t, 'id': b.report_id}})['id'] next_id from e a join e b on a.district_id=b.district_id and (b.t > a.t or (b.t = a.t and b.report_id > a.report_id)) and b.t >= a.close_at group by 1),
 heads as (select min({{'t': t, 'id': report_id}})['id'] id from e group by district_id)"""
_CHAIN = f"with recursive {JUDGED}, chain(id) as (select id from heads union select next_id from chain join nxt on nxt.report_id=chain.id)"
_OWNED = "owned as (select e.report_id, e.district_id, e.t, max({'t': o.t, 'id': o.report_id})['id'] sighting_id from e join (select * from e where report_id in (select id from chain)) o on o.district_id=e.district_id and (o.t < e.t or (o.t = e.t and o.report_id <= e.report_id)) group by all)"
OUTCOMES_SQL = f"""{_CHAIN}, {_OWNED}
 select report_id, district_id, case when report_id=sighting_id then 'created' else 'corroborated' end outcome, sighting_id from owned
 union all select report_id, district_id, 'incident_nearby', null from told where report_id in (select report_id from nearby)"""
LIFECYCLE_SQL = f"""{_CHAIN}, {_OWNED}, f as (select sighting_id, o.district_id, min(o.t) a, max(o.t) z, count(*) reports, any_value(e.best) best, any_value(e.expires) expires from owned o join e on e.report_id=o.sighting_id group by 1, 2)
 select sighting_id, district_id, floor(epoch(a))::bigint first_reported, floor(epoch(z))::bigint last_reported, reports,
 case when best['at'] <= timestamp '{AS_OF}' then 'satellite_confirmed' when expires <= timestamp '{AS_OF}' then 'unconfirmed_expired' else 'news_reported' end status,
 floor(epoch(case when best['at'] <= timestamp '{AS_OF}' then best['at'] when expires <= timestamp '{AS_OF}' then expires end))::bigint resolved,
 case when best['at'] <= timestamp '{AS_OF}' then best['incident_id'] end incident_id, case when best['at'] <= timestamp '{AS_OF}' then best['km'] end km from f"""


def nearest_confirmation(spark, sf):
    """Each report with the incident within reach and time that is known first, the nearest of those."""
    near = sightings.near_incidents(sites(spark, sf).withColumnRenamed("site_id", "district_id"), incidents(spark, sf)).where(~F.col("fixed"))
    told = reports(spark, sf).select("report_id", "district_id", F.unix_micros("published_at").alias("t"))
    hours = lambda n: n * sightings.HOUR
    best = F.struct("km", "incident_id")
    found = sightings.best_within(told, near.select("district_id", "incident_id", "km", "first"), "district_id", "report_id", F.col("t") - hours(sightings.GRACE_HOURS), F.col("t") + hours(sightings.WINDOW_HOURS), "first", best)
    return found.select("report_id", F.col("best.incident_id").alias("incident_id"), F.col("best.km").alias("km"))


NEAREST_SQL = f"""with {JUDGED}, p as (select report_id, incident_id, km from told join near using (district_id) where not fixed and first_at between t - interval {sightings.GRACE_HOURS} hour and t + interval {sightings.WINDOW_HOURS} hour)
 select report_id, incident_id, km from p qualify row_number() over (partition by report_id order by km, incident_id)=1"""

QUERIES = {"c26_outcomes": outcomes, "c26_sightings": lifecycle, "j8_best_in_reach": nearest_confirmation}
ORACLE = {"c26_outcomes": OUTCOMES_SQL, "c26_sightings": LIFECYCLE_SQL, "j8_best_in_reach": NEAREST_SQL}
