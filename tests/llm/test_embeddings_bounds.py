"""Quantised products against double precision at many lengths, near the threshold and at extreme magnitudes."""

import numpy as np
from test_operators import least

from lumenframe.llm import embeddings


def test_tiles_equal_double_precision_near_the_threshold():
    draw = np.random.default_rng(2)
    for d in (3, 64, 1041, 1536, 4096):
        a = draw.normal(size=(60, d))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        side = draw.normal(size=(60, d))
        side -= (side * a).sum(axis=1, keepdims=True) * a
        side /= np.linalg.norm(side, axis=1, keepdims=True)
        want = 0.95 + draw.uniform(-1e-6, 1e-6, 60)
        b = (want[:, None] * a + np.sqrt(1 - want**2)[:, None] * side) * draw.uniform(1e-3, 1e3, (60, 1))
        i, j = embeddings.tile_links(embeddings.quantise(a), embeddings.quantise(b), 0.95)
        exact = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
        sure = np.abs(exact - 0.95) > 1e-13
        found = np.zeros((60, 60), bool)
        found[i, j] = True
        assert (found == (exact >= 0.95))[sure].all() and 10 < found.diagonal().sum() < 50


def test_code_products_are_exact():
    draw = np.random.default_rng(3)
    q = draw.integers(-127, 128, (20, 5000))
    assert (embeddings.code_products(q.astype(np.float32), q.astype(np.float32)) == q @ q.T).all()


def test_extreme_magnitudes_and_long_vectors(spark, monkeypatch):
    draw = np.random.default_rng(4)
    base = draw.normal(size=(30, 1536))
    x = np.concatenate([base, base[:10] * 1e200, base[:5] * 1e-200, base[10:20] + 0.2 * draw.normal(size=(10, 1536)), np.full((1, 1536), 1e-320), np.full((1, 1536), 1.7e308)])
    monkeypatch.setattr(embeddings, "BAND_BYTES", 8 * 1536 * 20)
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    i, j = np.nonzero(unit @ unit.T >= 0.95)
    pairs = [(int(p), int(q)) for p, q in zip(i, j) if p != q]
    want, ids = least(pairs, range(len(x))), range(len(x))
    frame = spark.createDataFrame([(n, v.tolist(), "w") for n, v in enumerate(x)], "vec_id long, embedding array<double>, component string")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(frame).collect()}
    assert found == {n: (sum(p == n for p, _ in pairs), want[n]) for n in ids}
