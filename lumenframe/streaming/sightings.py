"""Reported sightings as a stream: keyed state of a district, event-time timers, and a log of what happened.

Reports and the incidents near their districts come as one stream of events. A district's
events wait in state until the watermark passes them, under their time, kind and id, so that
a repeated one changes nothing; one that comes behind the watermark is dropped, be it late
or replayed. Then they are worked off in order: an open sighting is confirmed, corroborated
or left to expire, for which a timer of its own stands. State holds the waiting events, the
open sighting and the incidents that can still explain or confirm something.

Times are microseconds; timers and watermarks are milliseconds, so a timer stands at the
end of its event's millisecond. The rules are those of operators.sightings, whose tables the log
folds into. Null ids, districts and times take no part; a stream without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.sightings import ACTIVE_HOURS, GRACE_HOURS, HOUR, WINDOW_HOURS

EVENT = "district_id long, at timestamp, kind int, id long, first long, last long, km double, fixed boolean, closed boolean"
LOG = "district_id long, at long, what string, report_id long, sighting_id long, incident_id long, km double, expires long"
INCIDENT, REPORT = 0, 1


def events(reports: DataFrame, near: DataFrame) -> DataFrame:
    """EVENT rows of reports (report_id, district_id, published_at) and near_incidents(); either may be a stream."""
    told = reports.where("report_id is not null and district_id is not null and published_at is not null").select(
        F.col("district_id").cast("long").alias("district_id"), F.col("published_at").cast("timestamp").alias("at"), F.lit(REPORT).alias("kind"), F.col("report_id").cast("long").alias("id"),
        *(F.lit(None).cast(t).alias(c) for c, t in (("first", "long"), ("last", "long"), ("km", "double"), ("fixed", "boolean"), ("closed", "boolean"))),
    )
    seen = near.select(F.col("district_id").cast("long").alias("district_id"), F.timestamp_micros("known").alias("at"), F.lit(INCIDENT).alias("kind"), F.col("incident_id").cast("long").alias("id"), "first", "last", "km", "fixed", "closed")
    return told.unionByName(seen)


class SightingProcessor(StatefulProcessor):
    def __init__(self, window_hours: int = WINDOW_HOURS, grace_hours: int = GRACE_HOURS, active_hours: int = ACTIVE_HOURS):
        self.window, self.grace, self.active = window_hours * HOUR, grace_hours * HOUR, active_hours * HOUR

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, kind int, id long", "first long, last long, km double, fixed boolean, closed boolean")
        self.incidents = handle.getMapState("incidents", "id long", "known long, first long, last long, km double, fixed boolean, closed boolean")
        self.open = handle.getValueState("open", "sighting_id long, first long, expires long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        for r in rows:
            if r["us"] // 1000 >= passed:
                self.waiting.updateValue((r["us"], r["kind"], r["id"]), (r["first"], r["last"], r["km"], r["fixed"], r["closed"]))
                self.handle.registerTimer(r["us"] // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        # incidents before reports, the nearest of one time first
        due = sorted((k[0], k[1], v[2] if k[1] == INCIDENT else 0.0, k[2], v) for k, v in self.waiting.iterator() if k[0] < passed)
        for at, kind, _, ident, _ in due:
            self.waiting.removeKey((at, kind, ident))
        known = {k[0]: tuple(v) for k, v in self.incidents.iterator()}
        before = dict(known)
        sighting = tuple(self.open.get()) if self.open.exists() else None
        out: list[Row] = []

        def tell(at: int, what: str, report: int | None, incident: int | None = None, km: float | None = None) -> None:
            out.append(Row(district_id=key[0], at=at, what=what, report_id=report, sighting_id=sighting[0] if sighting else None, incident_id=incident, km=km, expires=sighting[2] if sighting else None))

        def confirms(incident: tuple, first: int, expires: int) -> bool:
            return not incident[4] and incident[0] <= expires and first - self.grace <= incident[1] <= expires

        for at, kind, km, ident, v in due:
            if sighting and (at > sighting[2] or (kind == REPORT and at == sighting[2])):
                tell(sighting[2], "expired", None)
                sighting = None
            if kind == INCIDENT:
                known[ident] = incident = (at, v[0], v[1], v[2], v[3], v[4])
                if sighting and confirms(incident, sighting[1], sighting[2]):
                    tell(at, "confirmed", None, ident, km)
                    sighting = None
            elif any(not i[5] and at <= i[2] + self.active for i in known.values()):
                out.append(Row(district_id=key[0], at=at, what="incident_nearby", report_id=ident, sighting_id=None, incident_id=None, km=None, expires=None))
            elif sighting:
                tell(at, "corroborated", ident)
            else:
                sighting = (ident, at, at + self.window)
                tell(at, "created", ident)
                if able := min(((i[3], n) for n, i in known.items() if confirms(i, sighting[1], sighting[2])), default=None):
                    tell(at, "confirmed", None, able[1], able[0])
                    sighting = None
                else:
                    self.handle.registerTimer(sighting[2] // 1000 + 1)
            known = {n: i for n, i in known.items() if at <= max(i[2] + self.active, i[1] + self.grace)}
        if sighting and sighting[2] < passed:
            tell(sighting[2], "expired", None)
            sighting = None
        known = {n: i for n, i in known.items() if passed <= max(i[2] + self.active, i[1] + self.grace)}
        for n in before.keys() - known.keys():
            self.incidents.removeKey((n,))
        for n, i in known.items():
            if before.get(n) != i:
                self.incidents.updateValue((n,), i)
        if sighting:
            self.open.update(sighting)
        else:
            self.open.clear()
        yield from out

    def close(self) -> None:
        pass


def log(stream: DataFrame, late: str = "6 hours", processor: SightingProcessor | None = None) -> DataFrame:
    """LOG rows of a stream of EVENT rows. The session's state store must be RocksDB, which keyed state with timers asks for."""
    rows = stream.withWatermark("at", late).withColumn("us", F.unix_micros("at"))
    return rows.groupBy("district_id").transformWithState(processor or SightingProcessor(), LOG, "append", "EventTime")


def outcomes(told: DataFrame) -> DataFrame:
    """report_id, district_id, outcome, sighting_id of a log: the first table of operators.sightings; lines that repeat count once."""
    return told.where("report_id is not null").select("report_id", "district_id", F.col("what").alias("outcome"), "sighting_id").distinct()


def folded(told: DataFrame) -> DataFrame:
    """sighting_id, district_id, first and last reported_at, reports, status, resolved_at, incident_id, km of a log; repeated lines count once."""
    time = lambda c: F.timestamp_micros(c)
    of = lambda what, c: F.max(F.when(F.col("what") == what, F.col(c)))
    each = told.where("sighting_id is not null").distinct().groupBy("sighting_id", "district_id").agg(
        of("created", "at").alias("first"), F.max(F.when(F.col("report_id").isNotNull(), F.col("at"))).alias("last"), F.count("report_id").alias("reports"),
        of("confirmed", "at").alias("confirmed"), of("expired", "at").alias("expired"), of("confirmed", "incident_id").alias("incident_id"), of("confirmed", "km").alias("km"),
    )
    status = F.when(F.col("confirmed").isNotNull(), "satellite_confirmed").when(F.col("expired").isNotNull(), "unconfirmed_expired").otherwise("news_reported")
    return each.select("sighting_id", "district_id", time("first").alias("first_reported_at"), time("last").alias("last_reported_at"), "reports", status.alias("status"), time(F.coalesce("confirmed", "expired")).alias("resolved_at"), "incident_id", "km")
