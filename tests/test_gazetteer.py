"""Staged name matching on known names."""

from pyspark.sql import functions as F

from lumenframe.operators import gazetteer

DISTRICTS = [(1, "Gökçeada", "Çanakkale"), (2, "Merkez", "Elazığ"), (3, "Ulukışla", "Niğde"), (4, "Merkez", "Ardahan"), (5, "Merkez", "Niğde"), (6, "Kemer", "Burdur"), (7, "Kemer", "Burdur"), (8, "Sivrice", "Elazığ"), (9, "Hâlkali", "Niğde"), (6, "Kemer", "Burdur"), (None, "Sivrice", "Elazığ"), (10, None, "Elazığ"), (11, "Merkez", "Kilis"), (12, "Ağın", "Elazığ"), (13, "Agin", "Elazığ")]
SHAPES = [
    (1, "Imbros", "Çanakkale", 1, "alias"), (2, "Elazığ merkez", "Elazığ", 2, "centre"), (3, "Ulukisla", "Niğde", 3, "folded"), (4, "Ardahan", "Ardahan", 4, "bare_province"), (5, "NIĞDE (Merkez İlçe)", "Niğde", 5, "centre"),
    (6, "Kemer", "Burdur", None, None), (7, "Sivrice District", "Elazığ", 8, "centre"), (8, "HALKALİ", "Niğde", 9, "exact"), (9, "Merkez", "Elsewhere", None, None), (10, None, "Elazığ", None, None), (11, "123", "Elazığ", None, None),
    (12, "Kilis merkezi", "Kilis", None, "centre"), (13, "Kilis", "Kilis", None, "bare_province"), (14, "Ağın", "Elazığ", 12, "exact"), (15, "Âgin", "Elazığ", 13, "exact"), (16, " merkez", "Burdur", None, None), (17, "Sivrice", None, None, None),
]


def test_known_names(spark):
    shapes = spark.createDataFrame([(*r[:3], "x", 1) for r in [*SHAPES, SHAPES[0], (None, "Sivrice", "Elazığ", None, None)]], "shape_id long, name string, province string, stage string, district_id int")
    districts = spark.createDataFrame(DISTRICTS, "district_id long, name string, province string").withColumn("raw", F.lit(1))
    got = {r["shape_id"]: (r["district_id"], r["stage"], r["conflict"]) for r in gazetteer.matched_shapes(shapes, districts).collect()}
    assert got == {i: (d, s, i in (12, 13)) for i, _, _, d, s in SHAPES}
    assert {r["district_id"] for r in gazetteer.matched_shapes(shapes, districts.limit(0)).collect()} == {None}
    assert gazetteer.matched_shapes(shapes.limit(0), districts).count() == 0


def test_inner_points_lie_inside(spark):
    import math
    import random

    from lumenframe.operators import spatial

    rng = random.Random(6)
    edges = []
    for p in range(60):
        n = rng.randrange(3, 12)
        reach = [rng.uniform(0.3, 2) for _ in range(n)]
        for shrink in (1.0, 0.4) if p % 2 else (1.0,):  # every other one has a hole of its own shape
            corners = [(30 + shrink * r * math.cos(2 * math.pi * k / n), 40 + shrink * r * math.sin(2 * math.pi * k / n)) for k, r in enumerate(reach)]
            edges += [(p, *a, *b, "x") for a, b in zip(corners, [*corners[1:], corners[0]])]
    flat = [(100, 1.0, 1.0, 2.0, 1.0, "x"), (100, 2.0, 1.0, 1.0, 1.0, "x"), (None, 1.0, 1.0, 2.0, 2.0, "x"), (101, None, 1.0, 2.0, 2.0, "x")]
    df = spark.createDataFrame([*edges, *edges[:5], *flat], "id long, x1 double, y1 double, x2 double, y2 double, lat string")
    got = {r["id"]: (r["lng"], r["lat"]) for r in spatial.representative_points(df, "id").collect()}
    assert set(got) == set(range(60))
    for p, (x, y) in got.items():
        crossed = sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for i, x1, y1, x2, y2, _ in edges if i == p)
        assert crossed % 2 == 1
    assert spatial.representative_points(df.limit(0), "id").count() == 0
