"""Edges of the small rules: exact ages, missing jobs, nulls, ties, empty tables and clashing names."""

from pyspark.sql import functions as F

from lumenframe.operators import checks


def test_freshness_edges(spark):
    rows = [
        ("a", "x", "2026-01-01 06:00:00", "ok"), ("a", "y", "2026-01-01 12:00:00", "ok"),  # exactly six hours and none
        ("b", "x", "2026-01-01 05:59:59", "ok"), ("b", "y", "2026-01-01 11:00:00", "ok"),  # too old
        ("c", "x", "2026-01-01 12:00:01", "ok"), ("c", "y", "2026-01-01 11:00:00", "ok"),  # to come
        ("d", "x", "2026-01-01 11:00:00", "ok"),  # a job is missing
        ("e", "x", "2026-01-01 11:00:00", "failed"), ("e", "y", "2026-01-01 11:00:00", "ok"),
        ("f", "x", None, None), ("f", "y", "2026-01-01 11:00:00", "ok"),
    ]
    runs = spark.createDataFrame([(*r, 1) for r in rows], "pipe string, job string, at string, status string, fresh int")
    ask = lambda df: checks.all_fresh(df, "pipe", "job", "at", F.col("status") == "ok", ["x", "y"], F.lit("2026-01-01 12:00:00"))
    assert {r["pipe"]: r["fresh"] for r in ask(runs).collect()} == {"a": True, "b": False, "c": False, "d": False, "e": False, "f": False}
    assert ask(runs.limit(0)).count() == 0


def test_filters_and_worst(spark):
    df = spark.createDataFrame([("k", 1, 5.0), ("k", 2, 5.0), ("k", 3, None), ("l", 4, None), ("l", 5, None), (None, 6, 1.0)], "key string, id int, w double")
    assert {tuple(r) for r in checks.worst_per_key(df, "key", "w", "id").collect()} == {("k", 1, 5.0), ("l", 4, None), (None, 6, 1.0)}
    count = lambda **kw: df.where(checks.optional_filter("id", **kw)).count()
    assert (count(), count(value=3), count(unlike=[1, 2]), count(among=[1, 9]), count(among=[])) == (6, 1, 4, 1, 0)


def test_boxes_and_month_starts(spark):
    points = spark.createDataFrame([(1.0, 1.0, "2024-01-01"), (1.0, 1.0, "2024-01-03"), (None, 1.0, "2024-01-02"), (9.0, 9.0, "2024-02-01")], "lat double, lng double, day string")
    boxes = spark.createDataFrame([(1, 0.0, 1.0, 0.0, 1.0), (2, 0.5, 2.0, 1.0, 2.0), (3, 50.0, 51.0, 50.0, 51.0)], "box int, w double, e double, s double, n_ double")
    found = checks.box_totals(points, boxes, "box", "day", 21.4659).collect()
    assert {tuple(r) for r in found} == {(1, 2, 42.93, "2024-01-01", "2024-01-03"), (2, 2, 42.93, "2024-01-01", "2024-01-03")}
    assert [r[0] for r in points.select(checks.first_of_month("day")).collect()] == [True, False, False, True]
