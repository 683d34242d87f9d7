"""A training-corpus pipeline: each stage applies one text operator to what the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenframe.llm import line_runs, near_copies, packing, secrets, simhash, toxicity
from lumenframe.llm.queries import tokenizer_file
from lumenframe.operators.durable import shared_dir
from lumenframe.sources.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar, fitted on the labelled training rows, doesn't reject."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out("doc_id", 4, 2))
    return toxicity.clean(docs, model)


def drop_repeated_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, less the line runs that an earlier place of the corpus holds already."""
    return line_runs.remove_repeats(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity 0.8 or more): the one with the least doc_id."""
    return simhash.one_per_group(docs, groups=near_copies.text_groups(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with secrets replaced by their kind."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed training sequences."""
    pieces = packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_runs),
    ("simhash near-dedup", drop_near_copies),
    ("secret scan", redact_secrets),
    ("packing", pack),
]

#: Learned weights, fingerprint components and tokenizer merges have no SQL form; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each result written as Parquet in the shared folder and read again."""
    import uuid

    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
