"""Stories and incidents: which open incidents a story can mean, and which incident it confirms.

Both joins meet on (province, day), an incident standing on every day it can be met. A pair
shares one such key only, so nothing is counted twice, and AQE can split a province-day.
Rows with a null province, time or place join nothing; an incident whose days are reversed
stands on none. Input columns keep their names, only the named ones are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geo

DAY = 86_400


def _day(at: Column, offset_hours: int = 0) -> Column:
    return F.floor((F.unix_micros(at.cast("timestamp")) / 1_000_000 + offset_hours * 3600) / DAY).cast("long")


def _days(first: Column, last: Column) -> Column:
    return F.explode(F.when(first <= last, F.sequence(first, last)))


def open_incidents(stories: DataFrame, incidents: DataFrame, story_id: str, lookback_days: int, lookahead_hours: int) -> DataFrame:
    """story_id, candidates, incident_id (null unless one): incidents of the story's city last seen at most lookback_days before it and first seen at most lookahead_hours after it.

    stories: story_id, city, published_at; incidents: incident_id, city, first_at, last_at, those without an official state only.
    A story without a candidate isn't returned; repeated incident rows count once.
    """
    first, last = F.col("first_at") - F.make_interval(hours=F.lit(lookahead_hours)), F.col("last_at") + F.make_interval(days=F.lit(lookback_days))
    spread = incidents.select("incident_id", "city", first.alias("opens"), last.alias("closes")).distinct()
    spread = spread.select("*", _days(_day(F.col("opens")), _day(F.col("closes"))).alias("day"))
    asked = stories.select(story_id, "city", "published_at", _day(F.col("published_at")).alias("day"))
    met = asked.join(spread, ["city", "day"]).where(F.col("published_at").between(F.col("opens"), F.col("closes")))
    counted = met.groupBy(story_id).agg(F.count("*").alias("candidates"), F.min("incident_id").alias("only"))
    return counted.select(story_id, "candidates", F.when(F.col("candidates") == 1, F.col("only")).alias("incident_id"))


def confirmed_incidents(incidents: DataFrame, stories: DataFrame, radius_km: float, day_window: int, offset_hours: int = 3) -> DataFrame:
    """incident_id, story_id, km: each story goes to its closest incident, none where two are equally close; an incident then takes its closest story, the lower id on a tie.

    incidents: incident_id, city, first_at, last_at, lat, lng; stories: story_id, city, published_at, lat, lng of the one place it names.
    Days are local ones; both minima are combined before the shuffle.
    """
    i = incidents.select("incident_id", "city", F.struct("lat", "lng").alias("at"), _days(_day(F.col("first_at"), offset_hours) - day_window, _day(F.col("last_at"), offset_hours) + day_window).alias("day"))
    s = stories.select("story_id", "city", F.struct("lat", "lng").alias("told"), _day(F.col("published_at"), offset_hours).alias("day"))
    km = geo.haversine_km(F.col("told.lat"), F.col("told.lng"), F.col("at.lat"), F.col("at.lng"))
    pairs = i.join(s, ["city", "day"]).select("incident_id", "story_id", km.alias("km")).where(F.col("km") <= radius_km)
    closest = pairs.groupBy("story_id").agg(F.min(F.struct("km", "incident_id")).alias("low"), F.max(F.struct(-F.col("km"), F.col("incident_id"))).alias("high"))
    clear = closest.where(F.col("low.incident_id") == F.col("high.incident_id")).select("story_id", "low.*")
    return clear.groupBy("incident_id").agg(F.min(F.struct("km", "story_id")).alias("best")).select("incident_id", "best.story_id", "best.km")
