"""Coverage tiers on known shapes and odd rows."""

import datetime as dt
import time

from lumenframe.operators import coverage

T0 = dt.datetime(2024, 1, 1)
SQUARE = [[30.0, 40.0], [32.0, 40.0], [32.0, 42.0], [30.0, 42.0], [30.0, 40.0]]


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def test_tiers_of_known_places(spark):
    hulls = spark.createDataFrame([(1, at(10), SQUARE), (2, at(20), [[50.0, 40.0], [50.0, 40.0]]), (3, None, SQUARE), (4, at(10), None)], "pass_id long, started_at timestamp, ring array<array<double>>")
    rows = [
        (1, 41.0, 31.0, at(0), "inside_hull"), (2, 41.0, 31.0, at(10), "unknown"),  # the pass isn't later than the second
        (3, 41.0, 30.0, at(0), "near_50"), (4, 42.5, 31.0, at(0), "near_100"), (5, 44.0, 31.0, at(0), "near_250"), (6, 46.0, 31.0, at(0), "near_500"), (7, 55.0, 10.0, at(0), "unknown"),
        (8, 40.0, 50.0, at(15), "near_50"), (9, 40.0, 50.0, at(30), "none"), (10, None, 31.0, at(0), "none"), (11, 41.0, 31.0, None, "none"), (1, 41.0, 31.0, at(0), "inside_hull"),
    ]
    places = spark.createDataFrame([(*r[:4], "x", 1) for r in rows], "id long, lat double, lng double, seen timestamp, ring string, w int")
    got = sorted(tuple(r) for r in coverage.coverage_tiers(places, hulls, "id", "seen").collect())
    assert got == sorted((r[0], r[4]) for r in rows)
    assert {r["tier"] for r in coverage.coverage_tiers(places, hulls.limit(0), "id", "seen").collect()} == {"none"}
    assert coverage.coverage_tiers(places.limit(0), hulls, "id", "seen").count() == 0


def test_passes_go_on_over_midnight(spark):
    minutes = [0, 5, 15, 24 * 60 - 4, 24 * 60 + 5, 24 * 60 + 15, 24 * 60 + 26, *range(3 * 24 * 60, 5 * 24 * 60, 10), 6 * 24 * 60]
    rows = [(T0 + dt.timedelta(minutes=m), 40.0 + k % 7 / 10, 30.0 + k % 5 / 10) for k, m in enumerate(minutes)]
    seen = spark.createDataFrame([*rows, rows[0], (None, 1.0, 1.0)], "at timestamp, lat double, lng double")
    got = sorted((r["started_at"], r["detections"]) for r in coverage.pass_hulls(seen, "at").collect())
    starts, want = None, {}
    for t, *_ in sorted(rows):
        start = t if starts is None or t - starts > dt.timedelta(minutes=10) else start  # noqa: F821
        starts = t
        want[start] = want.get(start, 0) + 1
    want[rows[0][0]] += 1
    assert got == sorted(want.items())


def test_work_follows_spots_and_rings_not_their_rows(spark):
    # 20,000 later passes with one ring and 20,000 places at a spot of its box that none of the tiers reaches: 4e8 pairs a tier
    n = 20_000
    triangle = "array(array(30.0D, 40.0D), array(60.0D, 40.0D), array(30.0D, 60.0D), array(30.0D, 40.0D))"
    hulls = spark.range(n).selectExpr("id pass_id", "timestamp_seconds(1704067200 + id) started_at", f"{triangle} ring")
    places = spark.range(n).selectExpr("id", "60.0D lat", "60.0D lng", "timestamp_seconds(1704000000 + id) seen")
    began = time.perf_counter()
    got = {r["tier"]: r["count"] for r in coverage.coverage_tiers(places, hulls, "id", "seen").groupBy("tier").count().collect()}
    assert got == {"unknown": n} and time.perf_counter() - began < 100
