"""Near copies: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

SimHash fingerprints linked through BK-trees (`simhash.py`, 4 bits at most) tell first which texts go together; each
text of such a group is held against the group's first one by the exact sets, which joins a large group of copies by
one pair a text. SimHash can't be cut at this similarity: such texts differ by up to 13 of 64 bits and
more, and blocks of the word that 13 flips leave alone have four bits, so that each
shard would hold a 256th of the corpus. What it leaves apart is therefore sent to BANDS
shards, each told by BAND_ROWS minima of permuted shingle hashes. Two texts at 0.8
miss each other in all shards with probability (1 - 0.8**3)**30 = 5e-10.

Every link is confirmed by the exact similarity of both sets. A shard whose members are in one component is done. The others
first compare all members with one of them (STARS times, another one each time), unless both are in one
component. Of the texts in shards whose members are in different components after that, every pair across components that can
still reach the similarity is compared: two such texts share one of their rarest shingles (a prefix of each, in one order
for all), far enough ahead in both. A shingle that one component alone holds is in no set shared across components, so
a text with too many of them is left out, and what is compared are the others. So each pair that shares a shard is
compared, known to be connected or shown to be below the similarity; texts on one passage meet by their own words, not by it.

Defined cases: null text counts as empty; texts without words have the same one-element
set; fewer words than a shingle give one shingle of them all; equal texts are one vertex.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.durable import cut, gathered, keep
from ..operators.graph import connected_components
from .batches import map_batches, texts_of
from .simhash import fingerprint, near_links, shingle_hashes

WIDTH = 5
LIKENESS = 0.8
BANDS = 30
BAND_ROWS = 3
STARS = 2
_ODD = np.random.default_rng(64).integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One shard key per band."""
    least = np.full(len(_ODD), ~np.uint64(0))
    for at in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[at : at + 4096, None] * _ODD).min(axis=0), out=least)
    rows = least.reshape(BANDS, BAND_ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(BAND_ROWS):
        key = (key ^ rows[:, k]) * _MIX
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.xxhash64(text).alias("t"), text.alias("text"))


def _sketched(docs: DataFrame) -> DataFrame:
    """t (text's hash), n (shingles), fp (SimHash fingerprint), keys (shards) of each distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(texts_of(batch.column(1)))
            sets = [shingle_set(t) for t in texts]
            fps = pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))
            keys = pa.array([bands(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), fps, keys], names=["t", "n", "fp", "keys"])

    return map_batches(_texts(docs), run, "t long, n long, fp long, keys array<long>").groupBy("t").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))


def _sets(texts: DataFrame) -> DataFrame:
    """t, n (shingles), shingles of texts (t, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t).view(np.int64) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["t", "n", "shingles"])

    return map_batches(texts, run, "t long, n long, shingles array<long>")


def _alike(a: str, b: str) -> F.Column:
    """Whether sets of these sizes can reach the likeness."""
    return F.least(a, b) >= LIKENESS * F.greatest(a, b)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the likeness. sets: t, n (size of the set), shingles (those that can be in both, at least)."""
    one = sets.select(F.col("t").alias("a"), F.col("n").alias("p"), F.col("shingles").alias("x"))
    two = sets.select(F.col("t").alias("b"), F.col("n").alias("q"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(one, "a").join(two, "b").where(both >= LIKENESS * (F.col("p") + F.col("q") - both)).select("a", "b")


def _components(links: DataFrame) -> DataFrame:
    return connected_components(links, "a", "b").select(F.col("id").alias("t"), F.col("component").alias("g"))


def _open(named: DataFrame) -> DataFrame:
    """The rows of shards whose members are in different groups."""
    several = named.groupBy("s").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("s")
    return gathered(named.join(several, "s"))


def _simhash_pairs(sketched: DataFrame) -> DataFrame:
    """(a, b): each text of a group of linked fingerprints and the group's first text."""
    links = near_links(sketched.select("fp").distinct())
    group = connected_components(links, "a", "b").select(F.col("id").alias("fp"), "component")
    named = sketched.select("t", "n", "fp").join(group, "fp", "left").withColumn("component", F.coalesce("component", "fp")).drop("fp")
    first = named.groupBy("component").agg(F.min(F.struct("t", "n")).alias("c"), F.count("*").alias("texts")).where("texts > 1")
    met = named.join(first, "component").where((F.col("t") != F.col("c.t")) & _alike("n", "c.n"))
    return met.select(F.least("t", "c.t").alias("a"), F.greatest("t", "c.t").alias("b"))


def _across(texts: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of texts (t, g) of different groups that can reach the likeness, and the sets to confirm them by.

    In one order of all shingles, rarest first, two sets of n and m at the likeness share at least L / (1 + L) * (n + m)
    shingles; so the first they share has that many left, itself included, in both, and stands among the first n - L * n.
    """
    rows = texts.join(sets, "t").select("t", "g", F.explode("shingles").alias("x"))
    shared = rows.groupBy("x").agg(F.count("*").alias("c"), F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("x", "c")
    ordered = rows.join(shared, "x").groupBy("t").agg(F.sort_array(F.collect_list(F.struct("c", "x")))["x"].alias("shingles"))
    # those of one group alone come before all others; a text may have so many places for the first shared one
    room = F.floor(F.col("n") * (1 - LIKENESS) + 1e-6) + 1 - (F.col("n") - F.size("shingles"))
    own = keep(texts.join(sets.select("t", "n"), "t").join(ordered, "t").withColumn("room", room.cast("int")).where("room > 0"))
    first = own.select("t", "g", "n", F.size("shingles").alias("shared"), F.posexplode(F.slice("shingles", 1, F.col("room"))).alias("k", "x"))
    first = first.select("x", "t", "g", "n", (F.col("shared") - F.col("k")).alias("left"))
    one, two = (first.select("x", *(F.col(c).alias(c + side) for c in ("t", "g", "n", "left"))) for side in "12")
    enough = F.least("left1", "left2") * (1 + LIKENESS) >= LIKENESS * (F.col("n1") + F.col("n2")) - 1e-6
    pairs = one.join(two, "x").where((F.col("t1") < F.col("t2")) & (F.col("g1") != F.col("g2")) & enough)
    return pairs.select(F.col("t1").alias("a"), F.col("t2").alias("b")).distinct(), own.select("t", "n", "shingles")


def text_groups(docs: DataFrame) -> DataFrame:
    """t (xxhash64 of the text), g (the group's least t) of every distinct text."""
    sketched = keep(_sketched(docs))
    pairs = gathered(_simhash_pairs(sketched))
    rows = sketched.select(F.explode("keys").alias("s"), "t", "n")
    shards = rows.groupBy("s").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("t")).alias("x"), F.min("t").alias("m")).where("c > 1")
    # of shards with the same members one is enough
    shards = shards.groupBy("c", "x", "m").agg(F.min("s").alias("s")).select("s")
    left = gathered(rows.join(shards, "s"))
    wanted = left.select("t").union(pairs.select("a")).union(pairs.select("b")).distinct()
    sets = keep(_sets(_texts(docs).join(wanted, "t").dropDuplicates(["t"])))
    links = gathered(_confirmed(pairs, sets))
    groups = _components(links)
    for star in range(STARS + 1):
        left = _open(left.select("s", "t", "n").join(groups, "t", "left").withColumn("g", F.coalesce("g", "t")))
        if left.isEmpty():
            break
        if star < STARS:
            centre = left.groupBy("s").agg(F.min(F.struct(F.xxhash64(F.lit(star), "t"), "t", "n", "g")).alias("c"))
            met = left.join(centre, "s").where((F.col("g") != F.col("c.g")) & _alike("n", "c.n"))
            pairs = met.select(F.least("t", "c.t").alias("a"), F.greatest("t", "c.t").alias("b"))
            left = left.join(centre, "s").where("t <> c.t").drop("c")
            found = _confirmed(pairs.distinct(), sets)
        else:
            found = _confirmed(*_across(left.select("t", "g").distinct(), sets))
        links = gathered(found.union(links))
        groups = _components(links)
    return sketched.select("t").join(groups, "t", "left").select("t", F.coalesce("g", "t").alias("g"))
