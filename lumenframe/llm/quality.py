"""Quality by compression: zstandard dictionaries of good and of bad labelled text.

Every text is compressed piece by piece with either dictionary; the difference of
the compressed sizes, over the plain size, tells which text it resembles. With the
compressed rate itself and the length it becomes a probability by a logistic
calibration. Dictionaries and calibration are fitted on a sample of about
`fit_rows` labelled rows, chosen by a hash of the id (one half each by a hash of the text,
so calibration sees texts the dictionaries haven't). Calibration and scoring read every
whole text; a dictionary is trained on pieces from anywhere in its texts, the TRAIN_PIECES
least by hash where there are more.

Defined cases: null text counts as empty and gets the score of length zero; rows
without a label or text don't train; without both labels every score is the share
of good ones (0.5 if none); repeated rows score alike; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import map_batches, texts_of
from .toxicity import labelled_sample, logistic_fit

FIT_ROWS = 6_000
DICTIONARY_BYTES = 1 << 16
#: Bytes compressed at once: short enough that the dictionary, not the text itself, explains a piece.
PIECE = 1024
#: Pieces that one dictionary is trained on at most, drawn by hash from all of its texts (6 MB).
TRAIN_PIECES = 6144
LEVEL = 1


def cut_pieces(data: bytes) -> list[bytes]:
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)]


def train_dictionary(pieces: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from pieces of texts; the last of them as they are where they are too few for training."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-size:]


def drawn_pieces(texts: DataFrame, pieces: int = TRAIN_PIECES) -> list[bytes]:
    """Pieces of the whole texts (column text): all of them, or the given number least by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([p for t in texts_of(batch.column(0)) for p in cut_pieces(t.encode())], pa.binary())], names=["piece"])

    found = map_batches(texts.select("text"), run, "piece binary").select(F.xxhash64("piece").alias("h"), "piece")
    return [bytes(r["piece"]) for r in found.orderBy("h", "piece").limit(pieces).collect()]


class Compressors:
    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        kind = lambda d: zstandard.DICT_TYPE_AUTO if d[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        dictionaries = [zstandard.ZstdCompressionDict(d, dict_type=kind(d)) for d in (good, bad)]
        for d in dictionaries:
            d.precompute_compress(level=LEVEL)
        self.both = [zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False) for d in dictionaries]

    def features(self, text: str) -> np.ndarray:
        """Normalised size difference (bad less good), either rate's mean, shortness."""
        data = text.encode()
        if not data:
            return np.array([0.0, 0.0, 3.0])
        pieces = cut_pieces(data)
        good, bad = (sum(len(c.compress(p)) for p in pieces) for c in self.both)
        return np.array([10 * (bad - good) / len(data), (good + bad) / len(data) - 1, 3 / (1 + len(data) / 50)])


class Model:
    def __init__(self, good: bytes, bad: bytes, weights: np.ndarray):
        self.good, self.bad, self.weights = good, bad, weights


def fit(docs: DataFrame, labels: DataFrame, train: F.Column, fit_rows: int = FIT_ROWS) -> Model:
    """Learns from the rows of labels (doc_id, quality) where train holds. Each label gives at most half of fit_rows texts."""
    each = [labelled_sample(docs, labels.where(F.col("quality") == y), "quality", train, fit_rows // 2) for y in (0, 1)]
    sample = each[0].union(each[1]).withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "text"), F.lit(2))).persist()
    try:
        rows = {(r["y"], r["half"]): r["count"] for r in sample.groupBy("y", "half").count().collect()}
        n_bad, n_good = (rows.get((y, 0), 0) + rows.get((y, 1), 0) for y in (0, 1))
        share = (n_good + 1) / (n_bad + n_good + 2)
        if not n_bad or not n_good:
            return Model(b"", b"", np.array([0, 0, 0, np.log(share / (1 - share))]))
        # a label too rare for two halves gives all of its texts to both
        bad, good = (train_dictionary(drawn_pieces(sample.where((F.col("y") == y) & (F.col("half") == 0)) if (y, 0) in rows else sample.where(F.col("y") == y))) for y in (0, 1))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            coder = Compressors(good, bad)
            for batch in batches:
                x = [coder.features(t).tolist() for t in texts_of(batch.column(0))]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

        seen = sample.where(" or ".join(f"y = {y} and half = 1" if (y, 1) in rows else f"y = {y}" for y in (0, 1)))
        found = sorted((r["x"], r["y"]) for r in map_batches(seen.select("text", "y"), run, "x array<double>, y int").collect())
    finally:
        sample.unpersist()
    return Model(good, bad, logistic_fit(np.array([x for x, _ in found]), np.array([y for _, y in found], float), np.zeros(4), 0.01))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for every row."""
    good, bad, weights = model.good, model.bad, model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Compressors(good, bad) if good and bad else None
        for batch in batches:
            x = np.array([coder.features(t) if coder else np.zeros(3) for t in texts_of(batch.column(1))]).reshape(-1, 3)
            p = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=["doc_id", "score"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, score double")
