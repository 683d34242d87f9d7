"""The sighting lifecycle against a plain walk in order, on awkward rows, and as a stream with replays."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lumenframe.operators import sightings
from lumenframe.streaming import sightings as streamed

HOUR = sightings.HOUR
T0 = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)
REPORTS = "report_id long, district_id long, published_at timestamp, t string, close int"
INCIDENTS = "incident_id long, lat double, lng double, first_at timestamp, last_at timestamp, known_at timestamp, fixed boolean, closed boolean, district_id string"
PLACES = "district_id long, lat double, lng double, known string"


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def us(t):
    return int((t - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) / dt.timedelta(microseconds=1))


def plain(reports, near):
    """{report: (outcome, sighting)}, {sighting: (reports, confirmed at, incident)}; near: (district, incident, km, first, last, known, fixed, closed)."""
    told, found, open_ = {}, {}, {}
    for r, d, t in sorted({(r, d, us(t)) for r, d, t in reports}, key=lambda x: (x[2], x[0])):
        mine = [n for n in near if n[0] == d]
        if any(not n[7] and n[5] <= t <= n[4] + 24 * HOUR for n in mine):
            told[r] = ("incident_nearby", None)
            continue
        if d in open_ and t < open_[d][1]:
            told[r] = ("corroborated", open_[d][0])
            found[open_[d][0]][0] += 1
            continue
        best = min(((max(t, n[5]), n[2], n[1]) for n in mine if not n[6] and t - 6 * HOUR <= n[3] <= t + 48 * HOUR and n[5] <= t + 48 * HOUR), default=None)
        told[r] = ("created", r)
        found[r] = [1, best and best[0], best and best[2]]
        open_[d] = (r, best[0] if best else t + 48 * HOUR)
    return told, found


def made(seed=4, n=400):
    rng = random.Random(seed)
    places = [(d, 38.0 + d / 2, 30.0, "x") for d in range(4)]
    reports = [(i, rng.choice([0, 0, 0, 1, 2]), at(rng.randrange(0, 24 * 40 * 4) / 4), "x", 1) for i in range(n)]
    reports += [(1000 + k, 3, at(12 * k), "x", 1) for k in range(60)]  # an unbroken chain
    reports += [(2000 + k, 3, at(48 * k), "x", 1) for k in range(5)]  # at the very time of others
    incidents = []
    for k in range(60):
        d, start = rng.randrange(4), rng.randrange(0, 24 * 40)
        incidents.append((k, 38.0 + d / 2 + rng.choice([0, 0.05, 0.1, 0.2]), 30.0, at(start), at(start + rng.choice([0, 3, 20])), at(start + rng.choice([0, 3, 5])), rng.random() < 0.2, rng.random() < 0.4, "y"))
    return places, reports, incidents


def frames(spark, places, reports, incidents):
    return spark.createDataFrame(reports, REPORTS), spark.createDataFrame(incidents, INCIDENTS), spark.createDataFrame(places, PLACES)


def near_rows(incidents, places):
    return [tuple(r) for r in sightings.near_incidents(places, incidents).collect()]


def test_batch_is_the_plain_walk(spark):
    places, reports, incidents = made()
    r, i, p = frames(spark, places, [*reports, reports[0], (None, 1, at(1), "", 1), (9001, None, at(1), "", 1), (9002, 1, None, "", 1), (9003, 77, at(1), "", 1)], [*incidents, incidents[0], (None, 38.0, 30.0, at(0), at(1), at(1), False, False, ""), (900, None, 30.0, at(0), at(1), at(1), False, False, "")])
    told, found = plain([x[:3] for x in reports], near_rows(i, p))
    judged = sightings.judge(r, i, p)
    rows = judged.collect()
    assert {x["report_id"]: (x["outcome"], x["sighting_id"]) for x in rows} == told and len(rows) == len(told)
    assert {o for o, _ in told.values()} == {"created", "corroborated", "incident_nearby"}
    got = sightings.sightings(judged, F.lit("2024-12-31")).collect()
    assert {x["sighting_id"]: [x["reports"], x["incident_id"]] for x in got} == {s: [n, i_] for s, (n, _, i_) in found.items()}
    assert {x["status"] for x in got} == {"satellite_confirmed", "unconfirmed_expired"}
    early = {x["sighting_id"]: x["status"] for x in sightings.sightings(judged, F.lit("2024-05-03")).collect()}
    assert "news_reported" in early.values()
    for empty in (sightings.judge(r.limit(0), i, p), sightings.judge(r, i, p.limit(0))):
        assert empty.count() == 0
    alone = sightings.judge(r, i.limit(0), p)
    assert {x["outcome"] for x in alone.collect()} == {"created", "corroborated"}


def test_stream_ends_in_the_batch_tables(spark, tmp_path):
    places, reports, incidents = made(seed=8, n=150)
    r, i, p = frames(spark, places, reports, incidents)
    all_events = streamed.events(r, sightings.near_incidents(p, i)).cache()
    # days in turn, each out of order inside, a day again, and a row that closes the last windows
    day = F.floor((F.unix_micros("at") - us(T0)) / (24 * HOUR))
    days = sorted(x[0] for x in all_events.select(day).distinct().collect())
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    end = spark.createDataFrame([(99, at(24 * 400), 1, 1)], "district_id long, at timestamp, kind int, id long")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:

        def run():
            stream = spark.readStream.schema(streamed.EVENT).parquet(source)
            query = streamed.log(stream, "1 day").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
            query.awaitTermination(300)
            assert query.exception() is None

        third = len(days) // 3
        for part in (days[:third], days[: third + 2], days[third + 2 :]):  # the second holds the first again
            all_events.where(day.isin(part)).coalesce(1).orderBy(F.desc("at")).write.mode("append").parquet(source)
            run()
        end.selectExpr("*", "cast(null as long) first", "cast(null as long) last", "cast(null as double) km", "false fixed", "false closed").write.mode("append").parquet(source)
        run()
        end.selectExpr("district_id", "at + interval 9 days as at", "kind", "id + 1 as id", "cast(null as long) first", "cast(null as long) last", "cast(null as double) km", "false fixed", "false closed").write.mode("append").parquet(source)
        run()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    told = spark.read.schema(streamed.LOG).parquet(out).where("district_id <> 99")
    judged = sightings.judge(r, i, p)
    key = lambda df, *c: sorted((tuple(x) for x in df.select(*c).collect()), key=repr)
    cols = ("report_id", "district_id", "outcome", "sighting_id")
    assert key(streamed.outcomes(told), *cols) == key(judged, *cols)
    batch = sightings.sightings(judged, F.lit("2025-01-01"))
    assert key(streamed.folded(told), *batch.columns) == key(batch, *batch.columns)
    assert told.count() == told.distinct().count()
