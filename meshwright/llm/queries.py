"""The registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.llm import bpe, embedding_dedup, katz, license_scan, mixing, quality_classifier, quality_rules, sharding, simhash, sql, suffix_dedup


#: Installed on every executor with the tokenizer libraries.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdict of every document; null and empty texts fail the base rule."""
    return quality_rules.repetition_report(_table(spark, sf_dir, "documents"))


def op5_simhash_popcount_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document; null and wordless texts have fingerprint 0. A group whose ids are all null has none."""
    groups = simhash.near_duplicate_groups(_table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_license_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families of every document; an empty string where there are none."""
    docs = _table(spark, sf_dir, "documents")
    found = license_scan.scan(docs, license_scan.fit(docs))
    return found.select("doc_id", F.array_join("families", ",").alias("licences"), "n_paragraphs", "n_unknown", "probability")


def op7_epsilon_grid_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and group of every vector; one that is null, zero or not finite, or has no label, is alone."""
    return embedding_dedup.vector_links(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op8_suffix_deep_shallow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated strings of 400 bytes take from every document; null texts are empty."""
    return suffix_dedup.removal_report(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op1_subword_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of every document, learnt from labels whose row isn't held out; a null id is never held out nor learnt from."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    settings = quality_classifier.Settings()
    sample = quality_classifier.labelled_sample(docs, labels.where(rest != 0), settings, "doc_id", "text", "quality")
    model = quality_classifier.train([r[0] for r in sample], [r[1] for r in sample], settings)
    scored = quality_classifier.score_documents(docs, model)
    return scored.select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document; null texts have size 0."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


def op4_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard, slot, and shard after growth by one of every document; null ids are a key like any other."""
    rows = sharding.shard_documents(_table(spark, sf_dir, "documents"), sharding.layout(24), sharding.layout(25))
    return rows.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document; a null id is learnt from."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    scored = katz.score_texts(docs.select("doc_id", "text", (~held_out).alias("train")), "train")
    return scored.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and hashes of every document; null texts are empty."""
    return bpe.encode(_table(spark, sf_dir, "documents"), TOKENIZER)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_subword_embeddings, op2_sainte_lague_mix, op3_repetition_coverage, op5_simhash_popcount_grid, op4_hash_tree, op6_license_paragraphs, op7_epsilon_grid_order, op8_suffix_deep_shallow, op9_katz_backoff, op10_bpe_chunk_reuse)}
QUERIES["pipeline"] = corpus_pipeline.run
SQL: dict[str, str] = {"op3_repetition_coverage": sql.repetition_coverage(quality_rules.Rules()), "op7_epsilon_grid_order": sql.VECTOR_LINKS}
