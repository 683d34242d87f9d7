"""Hard negatives of anchor vectors by an orthogonal rotation with bounded remainders.

Components become integers, so that scores are exact integer products. Leading
principal directions, fitted on a bounded sample, give each row a few coordinates that
hold most of its length, and what is left of the length bounds the rest: a product
lies within the product of the two remainders, plus slack for all roundings and for
directions that are orthogonal only nearly, of the sum over the coordinates. Tiles of
anchors and rows add up coordinates in steps; a pair leaves as soon as its bounds miss
what is wanted, and only pairs that are left over get their integer product.

Two passes over blocks of anchors and rows. The first finds each anchor's positives,
its best rows of the same label: rows meet by label buckets and bands, so a common
label is many blocks. The second takes anchors with the scores of their positives and
finds, for each, the best rows of other labels inside the positive's window. A block
keeps the best so far of each anchor and lets only better rows through: its rows come
in the order of their ids, so that one that ties comes too late. It gives back a few
rows an anchor; the best over all blocks are ranked behind it.

Anchors are a part of all rows, so the work is all anchors with all rows by
definition; a block ships up to BAND_ROWS rows and ANCHOR_ROWS anchors once, less where
vectors are long, so memory is bounded by the block.

Defined cases: rows with a null id or label, a null or empty vector, any null or
non-finite component take no part, nor do those whose scores might not fit into a long
(squared length 2 ** 62 or more, or a component beyond an int); vectors of different
lengths never meet; the other rows of an anchor are those of other ids; rows that
repeat are separate rows, but an anchor that repeats is mined once; an anchor without
positives, or a positive without negatives in its window, gives no rows; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.durable import keep

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: The window of a negative's score, in parts of 100 of the positive's.
LOW, HIGH = 50, 95
#: Rows and anchors of a block, and bytes of a block's codes; longer vectors make smaller blocks.
BAND_ROWS, ANCHOR_ROWS, BAND_BYTES = 65536, 4096, 32 << 20
LABEL_BUCKETS = 16
#: Anchors and rows whose bounds are computed together; pairs whose integer products are.
TILE_ANCHORS, TILE_ROWS, PAIRS = 256, 2048, 65536
#: Numbers of the sample that the directions are fitted on, and most directions.
FIT_NUMBERS, FIT_ROWS, DIRECTIONS = 1 << 21, 20_000, 128
#: Parts of the directions that are added up before a look at the bounds.
STEPS = (0.25, 0.5, 1.0)


class Rotation:
    """Leading directions (columns) of vectors of one length, and the slack that their rounding takes."""

    def __init__(self, sample: np.ndarray):
        d = sample.shape[1]
        k = min(DIRECTIONS, max(1, d // 2))
        values, vectors = np.linalg.eigh(sample.T @ sample)
        self.directions = np.ascontiguousarray(vectors[:, np.argsort(-values)[:k]])
        defect = np.linalg.norm(self.directions.T @ self.directions - np.eye(k))
        #: For products relative to both lengths: the defect, and roundings of sums of d products, generously.
        self.slack = defect + 64 * (d + 8) * 2.0**-52
        self.steps = sorted({max(1, round(k * s)) for s in STEPS})

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Coordinates, lengths, and for each step a bound on the length of what it leaves out."""
        x = codes.astype(np.float64)
        lengths = np.sqrt(np.einsum("ij,ij->i", x, x))
        told = x @ self.directions
        held = np.cumsum(told * told, axis=1)[:, [s - 1 for s in self.steps]]
        rest = np.sqrt(np.maximum(0.0, lengths[:, None] ** 2 * (1 + 4 * self.slack) - held))
        return told, lengths, rest


def fitted_rotation(rows: DataFrame) -> tuple[int, Rotation] | None:
    """(vector length, directions) of the commonest length, from a sample by a hash of the id; vectors of other lengths are compared without bounds."""
    sizes = rows.groupBy("size").count().orderBy(F.desc("count"), "size").limit(1).collect()
    if not sizes:
        return None
    size, n = sizes[0]["size"], sizes[0]["count"]
    share = min(1.0, min(FIT_ROWS, max(2, FIT_NUMBERS // size)) / n)
    taken = rows.where((F.col("size") == size) & (F.pmod(F.xxhash64(F.lit("directions"), "vec_id"), F.lit(1_000_000)) < math.ceil(1_000_000 * share))).select("codes")
    sample = np.array([r["codes"] for r in taken.limit(2 * FIT_ROWS).collect()], np.float64).reshape(-1, size)
    return size, Rotation(sample / max(1.0, np.abs(sample).max(initial=1.0)))


def best(key: np.ndarray, score: np.ndarray, ident: np.ndarray, most: int) -> np.ndarray:
    """Positions of the `most` first of each key, by score downwards, then id."""
    order = np.lexsort((ident, -score, key))
    sorted_key = key[order]
    starts = np.flatnonzero(np.r_[True, sorted_key[1:] != sorted_key[:-1]]) if len(order) else np.zeros(0, int)
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[place < most]


def percent(score: np.ndarray, parts: int, up: bool) -> np.ndarray:
    """parts hundredths of integer scores, rounded up or down, without a product that overflows."""
    whole, rest = score // 100, score % 100
    return parts * whole + (-((-parts * rest) // 100) if up else parts * rest // 100)


def block_best(anchors: dict, rows: dict, rotation: Rotation | None, most: int, windows: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, window, row, score) of the best rows of each anchor, or of each window of an anchor, in a block.

    Without windows rows of the anchor's label and of another id are wanted; with windows
    (anchors x windows x low, high) rows of other labels whose score lies inside one.
    """
    order = np.argsort(rows["vec_id"], kind="stable")
    ids, labels, codes = rows["vec_id"][order], rows["label"][order], rows["codes"][order]
    told, length, rest = rotation.of(codes) if rotation else (None,) * 3
    out = []
    for at in range(0, len(anchors["vec_id"]), TILE_ANCHORS):
        a = slice(at, at + TILE_ANCHORS)
        a_ids, a_labels, a_codes = anchors["vec_id"][a], anchors["label"][a], anchors["codes"][a]
        n = len(a_ids)
        low = windows[a, :, 0].copy() if windows is not None else np.full((n, 1), np.iinfo(np.int64).min)
        high = windows[a, :, 1] if windows is not None else np.full((n, 1), np.iinfo(np.int64).max)
        slots = low.shape[1]
        found = [np.zeros(0, np.int64)] * 3  # slot of an anchor, row, score
        a_told, a_length, a_rest = rotation.of(a_codes) if rotation else (None,) * 3
        for start in range(0, len(ids), TILE_ROWS):
            b = slice(start, start + TILE_ROWS)
            same = a_labels[:, None] == labels[None, b]
            wanted = same & (a_ids[:, None] != ids[None, b]) if windows is None else ~same
            if rotation:
                least, largest = low.min(axis=1).astype(float)[:, None], high.max(axis=1).astype(float)[:, None]
                slack = rotation.slack * a_length[:, None] * length[None, b]
                product, done = 0.0, 0
                for k, step in enumerate(rotation.steps):
                    product = product + a_told[:, done:step] @ told[b, done:step].T
                    error = a_rest[:, k, None] * rest[None, b, k] + slack
                    wanted &= (product + error >= least) & (product - error <= largest)
                    done = step
                    if wanted.sum() * 16 < wanted.size:
                        break
            i, j = np.nonzero(wanted)
            if not len(i):
                continue
            score = np.concatenate([np.einsum("ij,ij->i", a_codes[i[s : s + PAIRS]], codes[start + j[s : s + PAIRS]]) for s in range(0, len(i), PAIRS)])
            for w in range(slots):
                inside = (score >= low[i, w]) & (score <= high[i, w])
                found = [np.concatenate([x, y[inside]]) for x, y in zip(found, (i * slots + w, start + j, score))]
            kept = best(found[0], found[2], ids[found[1]], most)
            found = [x[kept] for x in found]
            # once a slot is full, its last score must be passed: later rows have larger ids
            count = np.bincount(found[0], minlength=n * slots)
            last = np.full(n * slots, np.iinfo(np.int64).max)
            np.minimum.at(last, found[0], found[2])
            full = (count >= most).reshape(n, slots)
            low = np.where(full, np.maximum(low, last.reshape(n, slots) + 1), low)
        out.append((at + found[0] // slots, found[0] % slots, order[found[1]], found[2]))
    return tuple(np.concatenate(x) if out else np.zeros(0, np.int64) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4


def _side(table: pa.Table, side: int, size: int) -> tuple[dict, pa.Table]:
    part = table.filter(pa.compute.equal(table["side"], side)).combine_chunks()
    codes = part["codes"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)
    return {"vec_id": part["vec_id"].to_numpy(), "label": part["label"].to_numpy(), "codes": codes}, part


RESULT = "anchor_id long, twin long, slot int, vec_id long, score long"


def _blocks(dealt: DataFrame, keys: list[str], rotation: tuple[int, Rotation] | None, most: int, window: tuple[int, int] | None) -> DataFrame:
    """RESULT of all blocks: rows of side 0 (anchors; scores of their positives in `scores`) against rows of side 1."""

    def run(table: pa.Table) -> pa.Table:
        import pyarrow.compute  # noqa: F401

        size = table["size"][0].as_py()
        anchors, told = _side(table, 0, size)
        rows, _ = _side(table, 1, size)
        windows = None
        if window:
            counts = np.array([len(s) for s in told["scores"].to_pylist()], int)
            scores = told["scores"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            # an anchor with fewer positives has windows that nothing fits in
            windows = np.empty((len(counts), max(counts, default=1), 2), np.int64)
            windows[..., 0], windows[..., 1] = np.iinfo(np.int64).max, np.iinfo(np.int64).min
            i = np.repeat(np.arange(len(counts)), counts)
            w = np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts)
            windows[i, w, 0], windows[i, w, 1] = percent(scores, window[0], True), percent(scores, window[1], False)
        a, slot, r, score = block_best(anchors, rows, rotation[1] if rotation and rotation[0] == size else None, most, windows)
        return pa.table({"anchor_id": anchors["vec_id"][a], "twin": told["twin"].to_numpy()[a], "slot": slot.astype(np.int32), "vec_id": rows["vec_id"][r], "score": score})

    return dealt.groupBy("size", *keys).applyInArrow(run, RESULT)


def _dealt(anchors: DataFrame, rows: DataFrame, anchor_bands: int, row_bands: int) -> DataFrame:
    """Each anchor in all row bands and each row in all anchor bands: (i, j, side, ...)."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    band = lambda n: F.pmod(F.xxhash64(F.lit("band"), "vec_id"), F.lit(n)).cast("int")
    left = anchors.select("*", band(anchor_bands).alias("i"), every(row_bands).alias("j"), F.lit(0).alias("side"))
    right = rows.select("*", every(anchor_bands).alias("i"), band(row_bands).alias("j"), F.lit(1).alias("side"), F.lit(0).cast("long").alias("twin"), F.array().cast("array<long>").alias("scores"))
    return left.unionByName(right)


def _first(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The best of each key over all blocks, numbered from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(vectors: DataFrame, anchor: F.Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the rows (vec_id, embedding, label) where anchor holds.

    A negative n of a positive p satisfies low * p <= 100 * n <= high * p by their scores.
    """
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * scale).cast("double"))
    told = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0**31)) & (F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) < 2.0**62 * (1 - 1e-9))
    finite = F.forall(F.col("embedding").cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0**62))
    usable = F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite
    rows = (
        vectors.where(F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
        .where(told).select("vec_id", "label", F.col("v").cast("array<int>").alias("codes"), F.size("v").alias("size"), "anchor")
    )
    n, asked, size = rows.agg(F.count("*"), F.count(F.when(F.col("anchor"), 1)), F.max("size")).first()
    fits = BAND_BYTES // (4 * (size or 1))
    # as many bands as the cores can take while blocks are large enough to be worth a task
    cores = rows.sparkSession.sparkContext.defaultParallelism
    row_bands = max(1, math.ceil(n / max(1, min(BAND_ROWS, fits))), min(2 * cores, math.ceil(n / 2048)))
    anchor_bands = max(1, math.ceil(asked / max(1, min(ANCHOR_ROWS, fits))))
    rotation = fitted_rotation(rows)

    twin = F.xxhash64("label", "codes").alias("twin")
    none = F.array().cast("array<long>").alias("scores")
    anchors = rows.where("anchor").select("vec_id", "label", "codes", "size", twin, none).distinct()
    rows = rows.select("vec_id", "label", "codes", "size")
    bucket = F.pmod(F.xxhash64(F.lit("label"), "label"), F.lit(LABEL_BUCKETS)).alias("bucket")
    near = _blocks(_dealt(anchors, rows, anchor_bands, row_bands).withColumn("bucket", bucket), ["bucket", "i", "j"], rotation, positives, None)
    chosen = keep(
        _first(near, ["anchor_id", "twin"], positives).groupBy("anchor_id", "twin")
        .agg(F.sort_array(F.collect_list(F.struct("rank", F.col("vec_id").alias("id"), "score"))).alias("positives"))
    )
    with_scores = anchors.drop("scores").join(chosen.select(F.col("anchor_id").alias("vec_id"), "twin", F.col("positives.score").alias("scores")), ["vec_id", "twin"])
    far = _first(_blocks(_dealt(with_scores, rows, anchor_bands, row_bands), ["i", "j"], rotation, negatives, (low, high)), ["anchor_id", "twin", "slot"], negatives)
    positive = F.element_at("positives", F.col("slot") + 1)
    return far.join(chosen, ["anchor_id", "twin"]).select(
        "anchor_id", positive["id"].alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), positive["score"].alias("positive_score"), F.col("score").alias("negative_score")
    )


ORACLE = f"""with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor({SCALE} * x::double)) q from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 s as (select a.vec_id as anchor_id, r.vec_id, r.label = a.label as same, list_dot_product(a.q, r.q)::bigint as score from r as a join r on a.vec_id % 50 = 0),
 p as (select anchor_id, vec_id as positive_id, score from s where same and vec_id <> anchor_id qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= {POSITIVES}),
 n as (select p.anchor_id, p.positive_id, p.score as positive_score, s.vec_id as negative_id, s.score as negative_score,
  row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id)::int as rank
  from p join s on s.anchor_id = p.anchor_id and not s.same and {LOW} * p.score <= 100 * s.score and 100 * s.score <= {HIGH} * p.score)
 select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= {NEGATIVES}"""
