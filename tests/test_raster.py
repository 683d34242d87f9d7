"""Boxes cut out of tiles against the assembled raster."""

from math import ceil, cos, floor, radians

from lumenframe.operators import raster

GRID = raster.Grid(41.0, 29.0, 0.001, 0.001, 8)
POINTS = "id long, lat double, lng double, box string"


def assembled(codes, lat, lng, radius):
    d_lat, d_lng = radius / 111_320, radius / (111_320 * cos(radians(lat)))
    ys = range(floor((41.0 - (lat + d_lat)) / 0.001), ceil((41.0 - (lat - d_lat)) / 0.001))
    xs = range(floor((lng - d_lng - 29.0) / 0.001), ceil((lng + d_lng - 29.0) / 0.001))
    seen = [codes[y, x] for y in ys for x in xs if (y, x) in codes]
    shares = {n: floor(seen.count(c) * 100 / len(seen) + 0.5) for c, n in raster.CLASSES.items() if c in seen}
    return (len(seen), shares) if seen else (None, None)


def image(spark, rows=4, cols=3, without=((1, 1),)):
    """Tiles of a patterned raster, one of them missing, and its pixels."""
    code = lambda y, x: None if (y + x) % 23 == 0 else [10, 40, 50, 30, 7, 100][(y // 3 * 2 + x // 2 + (x * y) % 5 // 4) % 6]
    names = [(r, c) for r in range(rows) for c in range(cols) if (r, c) not in without]
    codes = {(r * 8 + i, c * 8 + j): code(r * 8 + i, c * 8 + j) for r, c in names for i in range(8) for j in range(8)}
    tiles = [(r, c, [codes[r * 8 + i, c * 8 + j] for i in range(8) for j in range(8)]) for r, c in names]
    return spark.createDataFrame(tiles, "tile_row long, tile_col long, values array<int>"), codes


def test_boxes_equal_the_assembled_raster(spark):
    tiles, codes = image(spark)
    at = [(k, 41.0 - 0.0007 * k, 29.0 + 0.00053 * (k * 11 % 50), "x") for k in range(50)]
    at += [(90, 41.0 - 0.0121, 29.0 + 0.0121, "in the hole"), (91, 45.0, 29.0, "far away"), (92, None, 29.0, None), (None, 40.99, 29.005, None), (93, 89.9, 29.0, None), (0, *at[0][1:])]
    points = spark.createDataFrame(at, POINTS)
    for radius in (150.0, 750.0):
        for block in (2, 8, 64):
            got = raster.class_shares(points, tiles, GRID, radius, block=block).collect()
            want = [(*p, *(assembled(codes, *p[1:3], radius) if p[1] is not None and p[1] < 89 else (None, None))) for p in at]
            plain = lambda rows: sorted(repr((*r[:5], r[5] and sorted(r[5].items()))) for r in rows)
            assert plain(got) == plain(want)


def test_empty_sides(spark):
    tiles, _ = image(spark)
    assert raster.class_shares(spark.createDataFrame([], POINTS), tiles, GRID).collect() == []
    one = raster.class_shares(spark.createDataFrame([(1, 40.99, 29.01, None)], POINTS), tiles.where("false"), GRID).collect()
    assert [tuple(r) for r in one] == [(1, 40.99, 29.01, None, None, None)]
