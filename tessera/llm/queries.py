"""The thin queries of the operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, discriminant, license_scan, log_bilinear, nnls_packing, norm_buckets, odd_sketch, prefix_shards, projection_forest, rule_ledger, tandem_runs, url_trees, weak_pii
from tessera.llm._native import let
from tessera.llm._tables import table
from tessera.llm.oracle import ORACLE_SQL as ORACLE_SQL


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_pii.found(table(spark, sf_dir, "documents"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_forest.nearest(table(spark, sf_dir, "embeddings"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trees.judged(table(spark, sf_dir, "pages"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nnls_packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_bilinear.scored(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discriminant.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ledger.apply_policy(rule_ledger.ledger(table(spark, sf_dir, "documents")))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(table(spark, sf_dir, "documents")).drop("blocks")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end"))
    return norm_buckets.mined(vectors)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_shards.sharded(table(spark, sf_dir, "documents")).withColumn("grown_shard", F.lit(None).cast("int"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, of which a tenth, chosen by the checksum of doc_id, is made periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: F.Column) -> F.Column:
        n = F.size(words)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return F.when(n > 0, let(F.struct(a.alias("a"), p.alias("p")), lambda x: F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < x["a"], i).otherwise(x["a"] + F.pmod(i - x["a"], x["p"])).cast("int"))), " "))).otherwise("")

    text = F.col("text").cast("string")
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return docs.select("doc_id", F.when(F.pmod(h, F.lit(10)) == 0, let(words, repeated)).otherwise(text).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tandem_runs.found(with_planted_runs(table(spark, sf_dir, "documents")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("m"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = found.withColumn("longest", longest).withColumn("length", -F.col("longest.m"))
    return found.select(
        "doc_id", "n_words", F.size("runs").cast("bigint").alias("n_runs"), "longest.start", "length", "longest.period", F.expr("1000 * length div longest.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_pii": op1_pii,
    "op2_nearest": op2_nearest,
    "op3_url_filter": op3_url_filter,
    "op4_near_dedup": op4_near_dedup,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_quality": op7_quality,
    "op8_rules": op8_rules,
    "op9_packing": op9_packing,
    "op10_license_scan": op10_license_scan,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_sharding": op12_sharding,
    "op13_periodic_runs": op13_periodic_runs,
}
