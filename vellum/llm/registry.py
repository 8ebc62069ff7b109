"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import Scratch, table
from vellum.llm.oracles import BY_QUERY


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ivf_pq_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.ann import nearest_of_every_50th

    return nearest_of_every_50th(table(spark, sf_dir, "embeddings"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.quality_rules import quality_rules

    found = quality_rules(table(spark, sf_dir, "documents"))
    return found.withColumn("host_failure", F.round("host_failure", 9)).withColumn("host_low", F.round("host_low", 9))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache is a new one for each call, so that all distinct texts are encoded and a call repeats the work of any other."""
    from vellum.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), f"{Scratch(spark, 'token-counts').root}/cache")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.mixing import mix_report

    return mix_report(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"))


def op6_substring_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.substring_index import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"))


def op7_superminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.superminhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op8_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.compression_quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.prefix_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op13_golden_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vellum.llm.golden_record import golden_records

    return golden_records(table(spark, sf_dir, "clients"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(BY_QUERY)
