"""Distance joins where many rows stand at few places, against plain pairs; work must not follow the rows' product."""

import math
import random
import time

from lumenframe.operators import spatial


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


def tables(spark):
    draw = random.Random(3)
    spot = lambda: (draw.randrange(400, 420) / 10, draw.randrange(300, 320) / 10)
    left = [(i, i % 3, *spot()) for i in range(150)] + [(900, 1, None, 30.0), (901, 2, -60.0, -179.9), (902, None, 41.0, 31.0), (5, 1, 41.0, 31.0)]
    right = [(i, i % 4, *spot()) for i in range(90)] + [(700, 2, 41.0, None), (701, 2, -60.0, 179.9)]
    schema = "id long, g int, lat double, lng double"
    return left, right, spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)


def test_against_plain_pairs(spark):
    left, right, a, b = tables(spark)
    there = [r for r in right if None not in r]
    able = [r for r in left if r[2] is not None]
    pairs = [(p[0], s[0], round(km(p[2:], s[2:]), 6)) for p in able for s in there]
    got = sorted((r.i, r.k, r.d) for r in spatial.within_distance(a, b, 40.0).selectExpr("l.id i", "r.id k", "round(km, 6) d").collect())
    assert got == sorted(x for x in pairs if x[2] <= 40)
    counts = sorted((r.id, r.n) for r in spatial.counts_within(a, b, 40.0).collect())
    assert counts == sorted((p[0], sum(km(p[2:], s[2:]) <= 40 for s in there) if p[2] is not None else 0) for p in left)
    for reach, apart in ((15.0, ()), (spatial.HALF_ROUND_KM, ("g",))):
        fits = lambda p, s: km(p[2:], s[2:]) <= reach and (not apart or p[1] == s[1])
        best = {}
        for p in able:
            best[p[0]] = min([best.get(p[0], 9e9), *(km(p[2:], s[2:]) for s in there if fits(p, s))])
        best = {k: round(d, 6) for k, d in best.items() if d < 9e9}
        near = spatial.nearest_within(a, b.withColumnRenamed("id", "k"), "id", "k", reach, apart=apart).collect()
        assert {r.id: round(r.km, 6) for r in near} == best and len(near) == len(best)
        # which one it is: at that distance, and the least of those at its place
        for r in near:
            at = {s[2:] for s in there if s[0] == r.k}
            met = [(p, s) for p in able for s in there if p[0] == r.id and s[2:] in at and fits(p, s)]
            assert r.k == min(s[0] for _, s in met) and round(min(km(p[2:], s[2:]) for p, s in met), 6) == best[r.id]


def test_crowded_places(spark):
    # 200,000 rows meet 50,000 at each of four places: 1e10 pairs, of which none needs to be made for counts and the nearest
    here = lambda n: spark.range(n).selectExpr("id", "int(id % 5) g", "40.0D + int(id % 2) / 4D lat", "30.0D + int(id % 4 / 2) / 4D lng")
    a, b = here(200_000), here(50_000).withColumnRenamed("id", "k")
    began = time.perf_counter()
    assert [tuple(r) for r in spatial.counts_within(a, b, 60.0).groupBy("n").count().collect()] == [(50_000, 200_000)]
    near = spatial.nearest_within(a, b, "id", "k", 60.0, apart=("g",))
    assert near.where("km = 0 and k < 20 and k % 5 = id % 5 and k % 4 = id % 4").count() == 200_000
    assert time.perf_counter() - began < 120
