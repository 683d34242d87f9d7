"""Reported sightings: one report opens a sighting of its district, later ones corroborate it, an observed incident confirms it, time expires it.

A report is judged when it comes: an incident near its district that is known by then, was seen
lately and isn't officially closed makes it `incident_nearby`; a sighting of the district that is
still open makes it `corroborated`; else it is `created` and opens one. A sighting closes when the
first qualifying incident becomes known (a new one, no fixed source; the nearest of those known
at the same time), or `window` after its first report. Times decide, then ids; nothing reads a clock.

Which report opens a sighting depends on the one before that did. Every report gets a pointer to
the report that would open the next sighting if it opened one; reports without any other in the
window before them surely open one, and the rest are reached from those by doubling the pointers,
in as many rounds as the longest unbroken chain has binary digits. Pointers and openers are looked
up in buckets of one window by district, so no district is ever one task or one group.

Defined cases: rows with a null id, district, time or place take no part, nor does a report of an
unknown district; repeated rows count once; reports at one time go by id; empty tables give no
rows; input columns keep to themselves, as only the named ones are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .durable import keep
from .spatial import within_distance

RADIUS_KM, WINDOW_HOURS, GRACE_HOURS, ACTIVE_HOURS = 15.0, 48, 6, 24
HOUR = 3_600_000_000


def _us(c: str | Column) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def near_incidents(places: DataFrame, incidents: DataFrame, radius_km: float = RADIUS_KM) -> DataFrame:
    """district_id, incident_id, km, first, last, known (microseconds), fixed, closed of each incident within reach of a district.

    places: district_id, lat, lng; incidents: incident_id, lat, lng, first_at, last_at, known_at, fixed, closed.
    """
    there = places.where("district_id is not null and lat is not null and lng is not null").select("district_id", "lat", "lng").distinct()
    seen = incidents.where("incident_id is not null and lat is not null and lng is not null and first_at is not null and last_at is not null and known_at is not null").select(
        "incident_id", "lat", "lng", _us("first_at").alias("first"), _us("last_at").alias("last"), _us("known_at").alias("known"), F.coalesce("fixed", F.lit(False)).alias("fixed"), F.coalesce("closed", F.lit(False)).alias("closed")
    ).distinct()
    pairs = within_distance(there, seen, radius_km)
    return pairs.select(F.col("l.district_id").alias("district_id"), F.col("r.incident_id").alias("incident_id"), F.round("km", 4).alias("km"), *(F.col(f"r.{c}").alias(c) for c in ("first", "last", "known", "fixed", "closed")))


def _day(us: Column) -> Column:
    return F.floor(us / (24 * HOUR)).cast("long")


def best_within(left: DataFrame, right: DataFrame, key: str, row_id: str, low: Column, high: Column, at: str, best: Column) -> DataFrame:
    """row_id, best: the least `best` over the right rows of the same key whose `at` lies in [low, high] of the left row.

    Key and day are the join key, a left row stands on every day it reaches; all in microseconds.
    """
    spread = left.select("*", low.alias("_low"), high.alias("_high")).withColumn("_day", F.explode(F.sequence(_day(F.col("_low")), _day(F.col("_high")))))
    met = spread.join(right.withColumn("_day", _day(F.col(at))), [key, "_day"]).where(F.col(at).between(F.col("_low"), F.col("_high")))
    return met.groupBy(row_id).agg(F.min(best).alias("best"))


def _known_nearby(reports: DataFrame, near: DataFrame, active_hours: int) -> DataFrame:
    """Ids of the reports that an incident already explains, each incident standing on the days on which it does."""
    opens, closes = F.col("known"), F.col("last") + active_hours * HOUR
    days = near.where(~F.col("closed") & (opens <= closes)).select("district_id", opens.alias("opens"), closes.alias("closes"), F.explode(F.sequence(_day(opens), _day(closes))).alias("day"))
    # of the stretches of one day only the longest from each start counts
    days = days.groupBy("district_id", "day", "opens").agg(F.max("closes").alias("closes"))
    asked = reports.withColumn("day", _day(F.col("t")))
    return asked.join(days, (asked["district_id"] == days["district_id"]) & (asked["day"] == days["day"]) & F.col("t").between(F.col("opens"), F.col("closes")), "left_semi").select("report_id")


def _openers(rows: DataFrame, window_us: int) -> DataFrame:
    """report_id of the reports that open a sighting; rows: district_id, report_id, t, close."""
    bucket = lambda t: F.floor(F.col(t) / window_us).cast("long")
    place = F.struct(F.col("t"), F.col("report_id"))
    reports = rows.select("district_id", bucket("t").alias("b"), "t", F.col("report_id").alias("i"), F.lit(0).alias("kind"), "report_id")
    # a mark stands before all reports of its time, or behind its own report where the sighting closes at once
    marks = rows.select("district_id", bucket("close").alias("b"), F.col("close").alias("t"), F.when(F.col("close") > F.col("t"), F.lit(-(2**63))).otherwise(F.col("report_id")).alias("i"), F.lit(1).alias("kind"), "report_id")
    ends = rows.groupBy("district_id", bucket("t").alias("b")).agg(F.min(place).alias("head"), F.max("t").alias("tail"))
    every = marks.select("district_id", "b").distinct().join(ends, ["district_id", "b"], "full")
    by = Window.partitionBy("district_id").orderBy("b")
    later = Window.partitionBy("district_id").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    # a row for each district and window: few, however many reports there are
    buckets = every.withColumn("next_head", F.last("head", ignorenulls=True).over(later)).withColumn("before", F.when(F.lag("b").over(by) == F.col("b") - 1, F.lag("tail").over(by)))
    follow = Window.partitionBy("district_id", "b").orderBy(F.desc("t"), F.desc("i"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = reports.unionByName(marks).withColumn("next", F.last(F.when(F.col("kind") == 0, F.struct("t", "report_id")), ignorenulls=True).over(follow))
    pointers = found.where("kind = 1").join(buckets.select("district_id", "b", "next_head"), ["district_id", "b"]).select("report_id", F.coalesce(F.col("next.report_id"), F.col("next_head.report_id")).alias("to")).where("to is not null")
    inside = Window.partitionBy("district_id", "b").orderBy("t", "i")
    placed = reports.withColumn("own", F.lag("t").over(inside)).join(buckets.select("district_id", "b", "before"), ["district_id", "b"])
    previous = F.coalesce("own", "before")
    open_ = keep(placed.where(previous.isNull() | (F.col("t") - previous >= window_us)).select("report_id"))
    jump, n = keep(pointers), open_.count()
    while True:
        more = keep(open_.union(open_.join(jump, "report_id").select(F.col("to").alias("report_id"))).distinct())
        if (now := more.count()) == n:
            return more
        open_, n = more, now
        jump = keep(jump.join(jump.select(F.col("report_id").alias("to"), F.col("to").alias("beyond")), "to").select("report_id", F.col("beyond").alias("to")))


def judge(reports: DataFrame, incidents: DataFrame, places: DataFrame, radius_km: float = RADIUS_KM, window_hours: int = WINDOW_HOURS, grace_hours: int = GRACE_HOURS, active_hours: int = ACTIVE_HOURS) -> DataFrame:
    """report_id, district_id, reported_at, outcome, sighting_id (the report that opened it), and for openers confirmed_at, incident_id, km, expires_at.

    reports: report_id, district_id, published_at of the reports that passed the gates on their text.
    """
    window = window_hours * HOUR
    near = keep(near_incidents(places, incidents, radius_km))
    told = reports.where("report_id is not null and published_at is not null").select("report_id", "district_id", _us("published_at").alias("t")).distinct()
    told = told.join(places.select("district_id").distinct(), "district_id", "left_semi")
    told = told.select(F.col("report_id").cast("long").alias("report_id"), "district_id", "t")
    nearby = _known_nearby(told, near, active_hours).withColumn("nearby", F.lit(True))
    # an incident counts from `grace` before the report until the sighting's end, if it is known by then
    able = near.where(~F.col("fixed")).select("district_id", "incident_id", "km", "first", "known")
    first = F.struct(F.greatest("t", "known").alias("at"), "km", "incident_id")
    confirmed = best_within(told, able, "district_id", "report_id", F.col("t") - grace_hours * HOUR, F.col("t") + window, "first", F.when(F.col("known") <= F.col("t") + window, first))
    every = keep(told.join(nearby, "report_id", "left").join(confirmed, "report_id", "left").select("*", (F.col("t") + window).alias("expires")).withColumn("close", F.coalesce("best.at", "expires")))
    rows = every.where("nearby is null")
    opened = _openers(rows, window).withColumn("opens", F.lit(True))
    flagged = rows.join(opened, "report_id", "left").withColumn("b", F.floor(F.col("t") / window).cast("long"))
    opener = F.when(F.col("opens"), F.struct("t", "report_id"))
    tails = flagged.groupBy("district_id", "b").agg(F.max(opener).alias("before")).withColumn("b", F.col("b") + 1)
    upto = Window.partitionBy("district_id", "b").orderBy("t", "report_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a sighting is open for one window at most, so its opener stands in the report's bucket or the one before
    owned = flagged.withColumn("own", F.last(opener, ignorenulls=True).over(upto)).join(tails, ["district_id", "b"], "left")
    time = lambda c: F.timestamp_micros(c)
    opens = F.coalesce("opens", F.lit(False))
    own = owned.select(
        "report_id", "district_id", time(F.col("t")).alias("reported_at"), F.when(opens, "created").otherwise("corroborated").alias("outcome"), F.coalesce(F.col("own.report_id"), F.col("before.report_id")).alias("sighting_id"),
        F.when(opens, time(F.col("best.at"))).alias("confirmed_at"), F.when(opens, F.col("best.incident_id")).alias("incident_id"), F.when(opens, F.col("best.km")).alias("km"), F.when(opens, time(F.col("expires"))).alias("expires_at"),
    )
    known = every.where("nearby").select("report_id", "district_id", time(F.col("t")).alias("reported_at"), F.lit("incident_nearby").alias("outcome"))
    return own.unionByName(known, allowMissingColumns=True)


def sightings(judged: DataFrame, as_of: Column) -> DataFrame:
    """sighting_id, district_id, first and last reported_at, reports, status at as_of, resolved_at, incident_id, km.

    The reports of a sighting stay rows of `judged`; their number is what a sighting holds.
    """
    now = as_of.cast("timestamp")
    joined = judged.where(F.col("sighting_id").isNotNull() & (F.col("reported_at") <= now))
    folded = joined.groupBy("sighting_id", "district_id").agg(
        F.min("reported_at").alias("first_reported_at"), F.max("reported_at").alias("last_reported_at"), F.count("*").alias("reports"),
        *(F.max(c).alias(c) for c in ("confirmed_at", "incident_id", "km", "expires_at")),
    )
    confirmed, expired = F.coalesce(F.col("confirmed_at") <= now, F.lit(False)), F.col("expires_at") <= now
    return folded.select(
        "sighting_id", "district_id", "first_reported_at", "last_reported_at", "reports",
        F.when(confirmed, "satellite_confirmed").when(expired, "unconfirmed_expired").otherwise("news_reported").alias("status"),
        F.when(confirmed, F.col("confirmed_at")).when(expired, F.col("expires_at")).alias("resolved_at"), F.when(confirmed, F.col("incident_id")).alias("incident_id"), F.when(confirmed, F.col("km")).alias("km"),
    )
