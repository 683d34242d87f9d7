"""Merging in any order, and a refreshed rollup against a full one."""

import itertools
import random

from pyspark.sql import functions as F

from lumenframe.operators import rollups


def test_point_sets_merge_in_any_order(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(4), rng.randrange(30, 33) + 0.1, rng.randrange(40, 43) + 0.7, rng.randrange(3), "x") for _ in range(200)] + [(None, 1.0, 1.0, 0, ""), (1, None, 1.0, 0, ""), (9, None, None, 0, "")]
    df = spark.createDataFrame(rows, "e long, lat double, lng double, load int, points string")
    loads = [rollups.point_set(df.where(F.col("load") == k), "e") for k in range(3)]
    want = {}
    for e, la, ln, *_ in rows:
        if e is not None and la is not None:
            want.setdefault(e, set()).add((la, ln))
    results = set()
    for a, b, c in itertools.permutations(loads):
        got = rollups.centroids(rollups.merge_point_sets(rollups.merge_point_sets(a, b), c, a), "e").collect()
        results.add(tuple(sorted(map(tuple, got))))
        assert {r["e"]: r["points"] for r in got} == {e: len(p) for e, p in want.items()}
    assert len(results) == 1
    for e, n, la, ln in next(iter(results)):
        assert abs(la - sum(p[0] for p in want[e]) / n) < 1e-9 and abs(ln - sum(p[1] for p in want[e]) / n) < 1e-9
    assert rollups.centroids(rollups.merge_point_sets(loads[0].limit(0)), "e").count() == 0


def test_refreshed_is_the_full_rollup(spark):
    first = spark.createDataFrame([(1, "2024-01", 5), (1, "2024-02", 0), (2, "2024-01", 7), (3, "2024-03", None), (None, "2024-01", 1)], "e long, m string, v long")
    load = spark.createDataFrame([(1, "2024-02", 4), (1, "2024-02", 4), (4, "2024-05", 2), (3, "2024-03", 0), (None, "2024-01", 9)], "e long, m string, v long").withColumn("total", F.lit(1))
    rows = rollups.replace_rows(first, load, ["e", "m"])
    full = rollups.month_rollup(rows, "e", "m", "v")
    fresh = rollups.refreshed_rollup(rollups.month_rollup(first, "e", "m", "v"), rows, load, "e", "m", "v")
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert key(fresh) == key(full) == [(1, 2, 9, "2024-01", "2024-02"), (2, 1, 7, "2024-01", "2024-01"), (3, 0, 0, None, None), (4, 1, 2, "2024-05", "2024-05")]
    assert "LeftSemi" in fresh._jdf.queryExecution().optimizedPlan().toString()
    none = load.limit(0)
    assert key(rollups.refreshed_rollup(full, rollups.replace_rows(rows, none, ["e", "m"]), none, "e", "m", "v")) == key(full)
