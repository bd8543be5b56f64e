"""The queries of the operators in this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, centroid_clustering, decontaminate, jaccard_join, language_id, license_scan, line_dedup, matroska, quality_rules, spelling_variants, token_files, toxicity, url_filter
from tessera.llm.tables import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every document."""
    return license_scan.digest(license_scan.scan(table(spark, sf_dir, "documents"), ["doc_id"]), ["doc_id"])


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the ranks and decoded again."""
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, ["doc_id"])


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's url."""
    return url_filter.judge(table(spark, sf_dir, "pages"), ["page_id"])


def op4_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as an audio track and read back."""
    return matroska.stored_features(table(spark, sf_dir, "documents"), ["doc_id"])


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain benchmark items, re-parameterised ones included."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines of every document are repeats of earlier ones."""
    found = line_dedup.repeats(table(spark, sf_dir, "documents"))
    dropped = F.array_join(F.transform("_dropped", lambda i: i.cast("string")), ",")
    return found.select(F.col("_key").alias("doc_id"), "n_lines", "n_equal", "n_near", dropped.alias("dropped_lines"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document; labels of one fold in four are never learned."""
    docs, held_out = table(spark, sf_dir, "documents"), toxicity.fold("doc_id", 4) == 2
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; one fold in five is never learned from."""
    docs, held_out = table(spark, sf_dir, "documents"), toxicity.fold("doc_id", 5) == 0
    model = language_id.train(docs, ~held_out)
    return language_id.predict(docs, model, ["doc_id"]).withColumn("held_out", F.coalesce(held_out, F.lit(False)))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document among those that share 80 % of their shingles."""
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids, written to files and read back."""
    return token_files.round_trip(table(spark, sf_dir, "documents"), WORDS, 2)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents and the more frequent word that it is a variant of."""
    return spelling_variants.variants(table(spark, sf_dir, "documents"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and robust outliers among the documents of a language and source."""
    return quality_rules.judged(table(spark, sf_dir, "documents"), ["doc_id"])


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster after three rounds, exactly."""
    return centroid_clustering.digest(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_url_filter": op3_url_filter,
    "op4_matroska": op4_matroska,
    "op5_decontaminate": op5_decontaminate,
    "op6_line_dedup": op6_line_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_language_id": op8_language_id,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_token_files": op10_token_files,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_quality_rules": op12_quality_rules,
    "op13_centroid_clustering": op13_centroid_clustering,
}

ORACLE_SQL: dict[str, str] = {
    "op3_url_filter": url_filter.SQL,
    "op5_decontaminate": decontaminate.SQL,
    "op9_jaccard_join": jaccard_join.SQL,
    "op11_spelling_variants": spelling_variants.SQL,
    "op13_centroid_clustering": centroid_clustering.SQL,
}
