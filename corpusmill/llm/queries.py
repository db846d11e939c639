"""The registered queries of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusmill.llm.common import documents, stored
from corpusmill.llm.decontamination import contamination
from corpusmill.llm.line_dedup import repeated_lines
from corpusmill.llm.merkle import build_manifest, folded, leaf_digest, proof_digest, prove
from corpusmill.llm.mixing import mixture
from corpusmill.llm.near_duplicates import near_duplicates
from corpusmill.llm.paragraph_dedup import repeated_paragraphs
from corpusmill.llm.prefix_trie import numbered_turns, prefix_trie, rebuilt
from corpusmill.llm.quality import quality
from corpusmill.llm.sharding import assign_shards
from corpusmill.llm.simhash import similar_fingerprints
from corpusmill.llm.suffix_dedup import without_repeats
from corpusmill.llm.toxicity import fit, score
from corpusmill.llm.url_filter import filter_urls


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir)).drop("kept")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_paragraphs(documents(spark, sf_dir))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fit(docs, labels)).drop("__text")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(documents(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(documents(spark, sf_dir))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(documents(spark, sf_dir))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.unhex(leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), more, F.col("text"))))
    proofs = prove(build_manifest(docs, carry={"tampered": tampered}))
    now = F.coalesce(F.lower(F.hex("tampered")), F.col("leaf"))
    return proofs.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("siblings")).alias("proof_sha256"), folded(now, F.col("siblings"), F.col("left")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = rebuilt(numbered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return prefix_trie(stored(turns), convs).drop("name", "parent")


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_fingerprints(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_suffix_array_dedup, op2_substring_dedup, op3_minhash_near_dedup, op4_toxicity, op5_url_filters, op6_line_dedup, op7_quality_rules, op8_benchmark_decontamination, op9_mixing, op10_sharding, op11_merkle_manifest, op12_prefix_trie, op13_simhash_near_dedup)
}
