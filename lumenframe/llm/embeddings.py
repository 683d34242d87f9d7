"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Unit vectors are quantised to int8 with a scale of their own; the norm of what the
rounding left out bounds the error of every quantised product, so a pair is
accepted when its product less the bound reaches the threshold, refused when
product plus bound stays below it, and only the pairs in between are recomputed in
double precision. All vectors meet in blocks: `bands` row bands against as many
column bands (upper triangle), a band never holding more than about `band_rows`
vectors; inside a block the products run tile by tile. A block returns a link
count per vector and a local spanning forest, never its pairs. Equal vectors are
one class with a multiplicity.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components, or of a length other than the pair's, link with nothing; components of any finite size
and vectors of any length are met by scaling with the largest component first and by
bounds and bands that grow and shrink with the length; repeated rows
of one vec_id are separate members of their class; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.durable import cut
from ..operators.graph import connected_components
from .batches import join_groups
from .simhash import merge_labels

THRESHOLD = 0.95
BAND_ROWS = 16384
#: Bytes of the double-precision vectors of a band; longer vectors make bands of fewer rows.
BAND_BYTES = 16 << 20
TILE = 1024
#: Components whose products of codes float32 still sums without rounding: 127 * 127 * 1024 < 2 ** 24.
EXACT = 1024
#: Slack for the double-precision roundings of the bound itself, and what each component adds to it.
SLACK, SLACK_EACH = 1e-9, 2.0**-50


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows, int8 codes (as float32), scales, and bounds on each row's lost part."""
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1) / 127
    code = np.rint(unit / scale[:, None]).astype(np.int8)
    lost = np.linalg.norm(unit - code * scale[:, None], axis=1) + SLACK + SLACK_EACH * x.shape[1]
    return unit, code.astype(np.float32), scale, lost


def code_products(qa: np.ndarray, qb: np.ndarray) -> np.ndarray:
    """Products of code rows without rounding: float32 within EXACT components, their sums in double precision."""
    if qa.shape[1] <= EXACT:
        return qa @ qb.T
    return sum((qa[:, at : at + EXACT] @ qb[:, at : at + EXACT].T).astype(np.float64) for at in range(0, qa.shape[1], EXACT))


def tile_links(a: tuple, b: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the pairs of two quantised tiles whose cosine reaches the threshold."""
    (ua, qa, sa, ea), (ub, qb, sb, eb) = a, b
    product = code_products(qa, qb) * (sa[:, None] * sb[None, :]).astype(np.float32)
    # |x| <= 1 + lost part of x on either side; two float32 roundings of a product below 1.1 err by less than 1e-6, those of the bound too
    error = (ea[:, None] * (1 + eb[None, :]) + (1 + ea[:, None]) * eb[None, :] + 2e-6).astype(np.float32)
    i, j = np.nonzero(product + error >= threshold)
    doubtful = product[i, j] - error[i, j] < threshold
    keep = np.ones(len(i), bool)
    where = np.flatnonzero(doubtful)
    for at in range(0, len(where), 65536):
        w = where[at : at + 65536]
        keep[w] = np.einsum("ij,ij->i", ua[i[w]], ub[j[w]]) >= threshold
    return i[keep], j[keep]


def _block(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of one block: rows of side 0 against rows of side 1, or side 0 among themselves where that's all there is."""
    same = pdf["diagonal"].iloc[0]
    ids = pdf["cid"].to_numpy()
    x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
    weight = pdf["n"].to_numpy()
    side = pdf["side"].to_numpy()
    left = np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    if not len(left) or not len(right):
        return pd.DataFrame({"cid": [], "links": [], "root": []})
    parts = quantise(x)
    count, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for s in range(0, len(left), TILE):
        for t in range(s if same else 0, len(right), TILE):
            p, q = left[s : s + TILE], right[t : t + TILE]
            i, j = tile_links(tuple(z[p] for z in parts), tuple(z[q] for z in parts), threshold)
            i, j = p[i], q[j]
            if same and s == t:
                i, j = i[i < j], j[i < j]
            np.add.at(count, i, weight[j])
            np.add.at(count, j, weight[i])
            merge_labels(label, i, j)
    told = count > 0
    return pd.DataFrame({"cid": ids[told], "links": count[told], "root": ids[label[told]]})


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, band_rows: int = BAND_ROWS) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (least vec_id reachable), kept (vec_id = component_id)."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    usable = F.coalesce((F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0), F.lit(False))
    classes = cut(
        rows.where(usable).groupBy("v").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
        .withColumn("cid", F.monotonically_increasing_id()).withColumn("size", F.size("v"))
    )
    n, length = classes.agg(F.count("*"), F.max("size")).first()
    band_rows = max(1, min(band_rows, BAND_BYTES // (8 * (length or 1))))
    bands = max(1, math.ceil(n / band_rows))
    bands = max(bands, min(6, 2 * bands + 2))
    blocks = F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda o: F.struct(F.least("band", o).alias("i"), F.greatest("band", o).alias("j"), F.when(F.col("band") <= o, 0).otherwise(1).alias("side"), (F.col("band") == o).alias("diagonal")),
    )
    dealt = (
        classes.withColumn("band", F.pmod(F.xxhash64("cid"), F.lit(bands)).cast("int"))
        .withColumn("b", F.explode(blocks)).select("size", "b.*", "cid", "n", "v")
    )
    found = cut(dealt.groupBy("size", "i", "j").applyInPandas(lambda pdf: _block(pdf, threshold), "cid long, links long, root long"))
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    labels = connected_components(found, "cid", "root").withColumnRenamed("id", "cid")
    named = cut(
        classes.join(counts, "cid", "left").join(labels, "cid", "left")
        .select("v", "n", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component"))
    )
    roots = cut(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("c")))
    known = cut(join_groups(named, roots, ["component"], n).select("v", F.col("n").alias("c"), "n_links", "component_id"))
    out = join_groups(rows.where(usable), known, ["v"], rows.count()).select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
