"""Queries and oracle SQL of the operators for training-text pipelines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import table
from . import embeddings, fill_middle, hard_negatives, line_runs, packing, pseudonyms, quality, secrets, sentencepieces, simhash, sketches, token_counts, toxicity


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, ~toxicity.held_out("doc_id", 4, 2))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "patterns"
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.findings(docs, secrets.scan(docs))
    base = F.filter("spans", lambda s: s["kind"].isin(secrets.BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, secrets.BASE), F.sha2(secrets.span_text(base), 256).alias("base_sha256"), secrets.span_text(F.col("spans")).alias("spans"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spark.lumenframe.pseudonym.key", pseudonyms.DEMO_KEY)
    found = pseudonyms.pseudonymise(table(spark, sf_dir, "documents"), key)
    kinds = F.transform(pseudonyms.FOUND, lambda t: t["kind"])
    count = lambda kind: F.size(F.filter(kinds, lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", "text", *map(count, pseudonyms.KINDS), F.transform(pseudonyms.FOUND, lambda t: t["pseudonym"]).alias("pseudonyms"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, ~toxicity.held_out("doc_id", 3, 1))
    return quality.score(docs, model).select("doc_id", toxicity.held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepieces.encode_decode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sketches.compare_edits(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op10_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_runs.with_cuts(docs).select("row.doc_id", "row.text", F.coalesce(F.size("cut_lines"), F.lit(0)).alias("lines_removed"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restored(), 256).alias("restored_sha256"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label")), anchor=F.col("vec_id") % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_simhash": op2_simhash,
        "op3_embeddings": op3_embeddings,
        "op4_secrets": op4_secrets,
        "op5_pii": op5_pii,
        "op6_packing": op6_packing,
        "op7_quality": op7_quality,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_fingerprints": op9_fingerprints,
        "op10_line_runs": op10_line_runs,
        "op11_fill_middle": op11_fill_middle,
        "op12_token_counts": op12_token_counts,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    """The others learn, tokenise, sketch or walk graphs; tests hold them against brute force."""
    return {"op4_secrets": secrets.oracle_sql(), "op11_fill_middle": fill_middle.oracle_sql(), "op13_hard_negatives": hard_negatives.ORACLE}
