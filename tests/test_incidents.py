"""The incident fold against a plain sequential reading, as weekly runs and as a stream with a repeated batch."""

from datetime import datetime, timedelta
from math import asin, cos, radians, sin, sqrt

import pytest
from pyspark.sql import functions as F

from lumenframe.functions import geo
from lumenframe.operators import incidents
from lumenframe.plans import incident_plans
from lumenframe.streaming import incidents as stream

SF = "/root/testdata/sf0.001"
COLUMNS = "id long, at timestamp, lat double, lng double, power double, tier string"
NOON = datetime(2024, 5, 1, 12)


def mm(a, b):
    la, lb = radians(a[0]), radians(b[0])
    h = sin((lb - la) / 2) ** 2 + cos(la) * cos(lb) * sin(radians(b[1] - a[1]) / 2) ** 2
    return round(2 * geo.EARTH_KM * asin(sqrt(h)) * 1e6)


def sequential(rows, runs, window, match):
    """Run by run, cluster by cluster: rows are (id, at, lat, lng, x, y) with planar metres; gives {id: incident} and {incident: last time}."""
    linked, found = {}, {}
    for as_of in runs:
        fresh = sorted(r for r in rows if as_of - window < r[1] <= as_of and r[0] not in linked)
        left, clusters = list(fresh), []
        while left:
            group, todo = [], [left.pop(0)]
            while todo:
                r = todo.pop()
                group.append(r)
                near = [o for o in left if (r[4] - o[4]) ** 2 + (r[5] - o[5]) ** 2 <= 1200.0**2]
                left = [o for o in left if o not in near]
                todo += near
            clusters.append(sorted(group))
        for group in sorted(clusters):
            able = []
            for name, (last, points) in found.items():
                if last > as_of - match:
                    least = min(mm(r[2:4], p) for r in group for p in points)
                    if least <= 2_000_000:
                        able.append((least, name))
            name = min(able)[1] if able else group[0][0]
            last, points = found.get(name, (as_of - timedelta(days=999), set()))
            found[name] = (max([last, *(r[1] for r in group)]), points | {r[2:4] for r in group})
            linked |= {r[0]: name for r in group}
    return linked, found


def planar(df):
    x, y = geo.laea_xy("lat", "lng")
    return [tuple(r) for r in df.select("id", "at", "lat", "lng", x.alias("x"), y.alias("y")).collect()]


def test_weekly_runs_equal_the_sequential_reading(spark):
    rows = planar(incident_plans.scattered(spark, SF))
    week = timedelta(hours=incident_plans.HOURS)
    linked, found = sequential(rows, incident_plans.RUNS, week, week)
    at = {r[0]: r[1] for r in rows}
    want = {}
    for i, name in linked.items():
        n, first, last = want.get(name, (0, at[i], at[i]))
        want[name] = (n + 1, min(first, at[i]), max(last, at[i]))
    epoch = datetime(1970, 1, 1)
    secs = lambda t: (t - epoch) // timedelta(seconds=1)
    got = {r["entity"]: r for r in incident_plans.folded(spark, SF).collect()}
    assert {k: (r["detections"], r["first_at"], r["last_at"], r["points"]) for k, r in got.items()} == {k: (n, secs(a), secs(b), len(found[k][1])) for k, (n, a, b) in want.items()}
    assert any(n > 5 for n, *_ in want.values()) and len(want) > 15


def detections(spark, rows):
    return spark.createDataFrame([(i, NOON + timedelta(hours=h), lat, lng, power, tier) for i, h, lat, lng, power, tier in rows], COLUMNS)


def run(spark, state, rows, hour, **more):
    return incidents.extend(state, detections(spark, rows), F.lit(NOON + timedelta(hours=hour)).cast("timestamp"), **more)


def entities(state):
    return {r["entity"]: r["detections"] for r in state.entities.collect()}


def test_known_folds(spark):
    # 1 and 2 are 1.1 km apart: one cluster; 3 is 1.8 km farther on: joins what they start; 9 lies alone
    first, _ = run(spark, incidents.empty(spark), [(1, -3, 39.0, 30.0, 5.0, "low"), (2, -2, 39.01, 30.0, None, "high"), (3, -1, 39.0262, 30.0, 3.0, "odd"), (9, -1, 41.0, 30.0, 1.0, None), (9, 0, 41.5, 30.0, 1.0, None),
                                                    (None, 0, 39.0, 30.0, 1.0, "low"), (5, 0, None, 30.0, 1.0, "low"), (6, 1, 39.0, 30.0, 1.0, "low"), (7, -24, 39.0, 30.0, 1.0, "low")], 0)
    assert entities(first) == {1: 3, 9: 1}
    row = {r["entity"]: r for r in incidents.told(first).collect()}
    assert (row[1]["passes"], row[1]["days"], row[1]["points"], row[1]["mean_power"], row[1]["peak"], row[1]["tier"]) == (3, 1, 3, 4.0, 5.0, "high")
    assert row[9]["tier"] == "unknown" and row[9]["lat"] == 41.0
    # a replay changes nothing; a cluster with a lower id joins a stored incident all the same
    again, _ = run(spark, first, [(1, -3, 39.0, 30.0, 5.0, "low"), (0, 1, 39.0262, 30.02, 2.0, "low")], 2)
    assert entities(again) == {1: 4, 9: 1}
    # closed incidents gain nothing, and what nobody saw for 72 hours leaves the state
    closed = spark.createDataFrame([(1,)], "entity long")
    later, gone = run(spark, again, [(20, 40, 39.0, 30.0, 1.0, "low")], 40, closed=closed)
    assert entities(later) == {1: 4, 9: 1, 20: 1} and entities(gone) == {}
    last, gone = run(spark, later, [(30, 71.5, 39.0, 30.0, 1.0, "low")], 71.5)
    assert entities(last) == {1: 5, 20: 1} and entities(gone) == {9: 1}


def test_empty_runs_and_long_windows(spark):
    state, gone = run(spark, incidents.empty(spark), [], 0)
    assert entities(state) == {} and entities(gone) == {} and incidents.told(state).collect() == []
    with pytest.raises(ValueError):
        run(spark, state, [], 0, window_hours=80)


def test_stream_ends_in_the_same_state_and_takes_repeats(spark, tmp_path):
    import time

    batches = [[(k * 10 + j, 6 * k + j / 10, 39.0 + 0.012 * k, 30.0 + 0.4 * (j % 2), 1.0 * j, "low") for j in range(5)] for k in range(3)]
    state = incidents.empty(spark)
    for k, rows in enumerate(batches):
        detections(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        state, _ = run(spark, state, rows, 6 * k + 0.4)
        time.sleep(1.1)  # the file source takes files by their time
    source = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.start(source, str(tmp_path / "state"), str(tmp_path / "log")).awaitTermination()
    rows = lambda s: sorted(map(tuple, incidents.told(s).collect()))
    assert rows(stream.stored(spark, str(tmp_path / "state"), 3)) == rows(state)
    stream.fold_batch(detections(spark, batches[2]), 2, str(tmp_path / "state"))
    assert rows(stream.stored(spark, str(tmp_path / "state"), 3)) == rows(state)
