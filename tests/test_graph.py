import random

from lumenframe.operators.graph import connected_components


def components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_match_union_find(spark):
    draw = random.Random(5)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 560)]
    edges = [(draw.randrange(80), draw.randrange(80)) for _ in range(50)] + chain + star + [(7, 7), (None, 3), (3, None), (1, 2), (2, 1)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r["id"]: r["component"] for r in found} == components(edges)
    assert len(found) == len({r["id"] for r in found})


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_few_edges_take_few_tasks(spark):
    """Each shuffle writes files for each task before it, so a session with many partitions must not make them for a few edges."""
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(90, 91)], "a long, b long")
        found = connected_components(edges, "a", "b")
        assert {r["id"]: r["component"] for r in found.collect()} == {i: 0 for i in range(31)} | {90: 90, 91: 90}
        assert found.rdd.getNumPartitions() <= 2
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
