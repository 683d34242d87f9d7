"""SimHash near-duplicates linked through BK-trees.

A fingerprint bit is set where over half of the text's 4-word shingle hashes have
it. Two fingerprints within `radius` bits agree in one of radius + 1 blocks of the word.
Every distinct fingerprint is sent to one shard per block, told by as many of the block's
bits as make shards of about `shard_words` (few words: no bits, one shard). Each
shard's BK-tree (children keyed by integer Hamming distance to the parent) is searched
along the edges within the radius only, and a shard returns at most one link per
member, a local spanning forest, so a group of any size never becomes its square of
pairs. Shards beyond `split_words` are cut again by the same rule on the bits that
haven't told them yet, as long as blocks of them are left.

The trees are not broadcast: that would take the fingerprints of all documents through
the driver. They stay where the shuffle put their shard.

Defined cases: null text counts as empty; texts without words have fingerprint zero
and link like any other; fewer words than a shingle give one shingle of them all;
equal fingerprints link; repeated rows are one vertex and come back once per row;
an empty table gives no rows; null doc_ids are kept, never chosen as a component's
id unless all of it is null; other input columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.durable import cut, gathered
from ..operators.graph import connected_components
from .batches import join_groups, map_batches, texts_of

SHINGLE_WORDS = 4
RADIUS = 4
#: Words of a shard, about, and words from which on it is cut again.
SHARD_WORDS = 512
SPLIT_WORDS = 8192
LEAF = 16
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """Hashes of the text's shingles in order; that of no bytes for a text without words."""
    from xxhash import xxh64_intdigest as digest

    words = _WORD.findall(text.encode().translate(_LOWER))
    if not words:
        return np.array([digest(b"", 42)], np.uint64)
    n = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size)
    start, stop = (end - size)[:n].tolist(), (end[min(width, len(words)) - 1 :][:n] - 1).tolist()
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(start, stop)), np.uint64, n)


def fingerprint(text: str, width: int = SHINGLE_WORDS) -> int:
    if not _WORD.search(text.encode()):
        return 0
    hashes = shingle_hashes(text, width)
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in texts_of(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, fp long")


class BKTree:
    """A BK-tree over an array of distinct words; leaves hold up to LEAF words."""

    def __init__(self, words: np.ndarray):
        self.words, self.compared = words, 0
        self.root = self._build(np.arange(len(words)))

    def _build(self, members: np.ndarray):
        if len(members) <= LEAF:
            return members, None
        parent, rest = members[0], members[1:]
        distance = np.bitwise_count(self.words[rest] ^ self.words[parent])
        if distance.min() == distance.max():
            return members, None
        return parent, {int(d): self._build(rest[distance == d]) for d in np.unique(distance)}

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query's position, member) at most radius apart, node by node; a query follows only the edges that can hold one."""
        stack = [(self.root, np.arange(len(queries)))]
        while stack:
            (node, children), asked = stack.pop()
            if children is None:
                for at in range(0, len(asked), max(1, (1 << 20) // max(1, len(node)))):
                    part = asked[at : at + max(1, (1 << 20) // max(1, len(node)))]
                    self.compared += len(part) * len(node)
                    q, m = np.nonzero(np.bitwise_count(queries[part][:, None] ^ self.words[node][None, :]) <= radius)
                    yield part[q], node[m]
                continue
            self.compared += len(asked)
            distance = np.bitwise_count(queries[asked] ^ self.words[node]).astype(np.int16)
            near = distance <= radius
            yield asked[near], np.full(int(near.sum()), node)
            for edge, child in children.items():
                follow = np.abs(distance - edge) <= radius
                if follow.any():
                    stack.append((child, asked[follow]))


def merge_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Lowers label in place until linked positions agree on the least of their component."""
    while True:
        a, b = label[i], label[j]
        if (a == b).all():
            return
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(label, high, low)
        while (label != label[label]).any():
            label[:] = label[label]


def shard_links(words: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct words: (word, its component's first word)."""
    n = len(words)
    label = np.arange(n)
    if n <= LEAF:
        i, j = np.nonzero(np.bitwise_count(words[:, None] ^ words[None, :]) <= radius)
        merge_labels(label, i, j)
    else:
        tree = BKTree(words)
        for at in range(0, n, 1024):
            for q, m in tree.within(words[at : at + 1024], radius):
                merge_labels(label, q + at, m)
    moved = label != np.arange(n)
    return words[moved], words[label[moved]]


def _blocks(bits: list[int], count: int) -> list[list[int]]:
    return [part.tolist() for part in np.array_split(np.array(bits), count)]


def _key(fp: str, blocks: list[list[int]]) -> F.Column:
    """The bits of some blocks as one long."""
    mask = sum(1 << b for block in blocks for b in block)
    return F.col(fp).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _links(rows: DataFrame, radius: int) -> DataFrame:
    """rows: shard columns and fp. Links (a, b) of each shard's local forest; a task streams over its sorted shards."""
    keys = [c for c in rows.columns if c != "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        held_key = None

        def out(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            if found:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            fp = cols[-1].astype(np.int64).view(np.uint64)
            if not len(fp):
                continue
            new = np.zeros(len(fp), bool)
            for c in cols[:-1]:
                new[1:] |= c[1:] != c[:-1]
            starts = [0, *np.flatnonzero(new).tolist(), len(fp)]
            found = []
            for s, e in zip(starts, starts[1:]):
                key = tuple(c[s] for c in cols[:-1])
                if key != held_key:
                    if sum(map(len, held)) > 1:
                        found.append(shard_links(np.concatenate(held), radius))
                    held, held_key = [], key
                held.append(fp[s:e])
            yield from out(found)
        if sum(map(len, held)) > 1:
            yield from out([shard_links(np.concatenate(held), radius)])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def _shards(rows: DataFrame, keys: list[str], blocks: list[tuple[F.Column | None, list[list[int]]]], bits: int, n: int) -> DataFrame:
    """rows with their shards' number s{n} and key k{n}; blocks: by a condition on the shards so far, the bits to tell them by."""
    made = None
    for when, parts in blocks:
        told = F.array(*(F.struct(F.lit(m).alias("s"), _key("fp", [part[:bits]]).alias("k")) for m, part in enumerate(parts[: len(parts) if bits else 1])))
        made = told if when is None else F.when(when, told) if made is None else made.when(when, told)
    return rows.select(*keys, F.explode(made).alias("x"), "fp").select(*keys, F.col("x.s").alias(f"s{n}"), F.col("x.k").alias(f"k{n}"), "fp")


def near_links(fps: DataFrame, radius: int = RADIUS, shard_words: int = SHARD_WORDS, split_words: int = SPLIT_WORDS) -> DataFrame:
    """Links (a, b) that span each component of distinct fingerprints (column fp) at most radius bits apart.

    One of radius + 1 blocks holds no differing bit, so each linked pair meets in a shard.
    """
    links, keys, rows = None, [], fps.select("fp")
    paths: dict[tuple[int, ...], list[int]] = {(): list(range(64))}
    bits = max(0, (fps.count() // shard_words).bit_length())
    for depth in range(4):
        blocks = {path: _blocks(left, radius + 1) for path, left in paths.items()}
        width = min(bits, *(len(part) for parts in blocks.values() for part in parts))
        whens = [(_all(path) if path else None, parts) for path, parts in blocks.items()]
        rows = _shards(rows, keys, whens, width, depth)
        keys = [*keys, f"s{depth}", f"k{depth}"]
        sizes = gathered(rows.groupBy(*keys).agg(F.count("*").alias("c")).where("c > 1"))
        last = depth == 3 or not width
        rows = cut(join_groups(rows, sizes.withColumn("hot", F.lit(False) if last else F.col("c") > split_words), keys, rows.count()))
        found = _links(rows.where("not hot").drop("hot"), radius)
        links = found if links is None else links.union(found)
        rows = rows.where("hot").drop("hot")
        if last or rows.isEmpty():
            return links
        paths = {(*path, m): [b for b in left if b not in blocks[path][m][:width]] for path, left in paths.items() for m in range(radius + 1)}
        bits = max(bits, 8)


def _all(path: tuple[int, ...]) -> F.Column:
    met = F.lit(True)
    for n, m in enumerate(path):
        met = met & (F.col(f"s{n}") == m)
    return met


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id reachable through links) for each row."""
    rows = cut(fingerprints(docs, width))
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = connected_components(near_links(distinct.select("fp"), radius), "a", "b")
    named = distinct.join(labels.select(F.col("id").alias("fp"), "component"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = cut(named)
    roots = cut(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("c")))
    told = join_groups(named, roots, ["component"], named.count()).select("fp", "component_id")
    per_word = told.join(rows.groupBy("fp").agg(F.count("*").alias("c")), "fp")
    return join_groups(rows, cut(per_word), ["fp"], rows.count()).select("doc_id", "fp", "component_id")


def text_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """t (xxhash64 of the text), g (its near-duplicate group) of every distinct text."""
    text = F.col("text").cast("string")
    return near_duplicates(docs.select(F.xxhash64(text).alias("doc_id"), text.alias("text")), radius).select(F.col("doc_id").alias("t"), F.col("component_id").alias("g")).distinct()


def one_per_group(docs: DataFrame, radius: int = RADIUS, groups: DataFrame | None = None) -> DataFrame:
    """docs with one row of each group of texts (t, g as of text_groups): that of the least doc_id, then the least text hash; null doc_ids come last.

    The chosen rows are joined to the texts; the texts themselves are sent once at most.
    """
    groups = text_groups(docs, radius) if groups is None else groups
    t, d = F.xxhash64(F.col("text").cast("string")), F.col("doc_id").cast("long")
    least = docs.select(t.alias("t"), F.struct(d.isNull().alias("none"), d.alias("d")).alias("id")).groupBy("t").agg(F.min("id").alias("id"), F.count("*").alias("rows"))
    best = least.join(groups, "t").groupBy("g").agg(F.min(F.struct("id", "t", "rows")).alias("m"))
    chosen = gathered(best.select(F.col("m.id.d").alias("simhash_d"), F.col("m.t").alias("simhash_t"), (F.col("m.rows") > 1).alias("simhash_again")))
    keyed = docs.withColumns({"simhash_kd": d, "simhash_kt": t})
    kept = keyed.join(chosen, (F.col("simhash_kt") == F.col("simhash_t")) & F.col("simhash_kd").eqNullSafe(F.col("simhash_d")))
    names = [F.col(f"`{c}`") for c in docs.columns]
    once = kept.where("not simhash_again").select(*names)
    return once.unionByName(kept.where("simhash_again").dropDuplicates(["simhash_t"]).select(*names))
