"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import decontam, filter_audit, minhash, negatives, oracles, packing, quality, secret_scan, sharding, sketches, substring_dedup, suffix_dedup, token_files, toxicity

TOKENIZER, SEQUENCE = "word_bpe_49k.json", 2048
#: Bytes of text a shard, small enough that buckets of the test tables split unevenly; shards for training are set larger.
SHARD_BYTES = 160 << 10


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(_docs(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(_docs(spark, sf_dir))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality.fails("base").alias("base_failed"), (~quality.fails("v1")).alias("kept"), "failures")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(_docs(spark, sf_dir), public_tokenizers.path(TOKENIZER), end_id=1)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    rows = toxicity.scored(docs, model)
    return rows.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "spans")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_docs(spark, sf_dir), SHARD_BYTES)


def _removed() -> tuple:
    n = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return n.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256")


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, digest = _removed()
    return suffix_dedup.dedup(_docs(spark, sf_dir)).select("doc_id", "n_bytes", n, F.size("removed").cast("long").alias("n_spans"), digest)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontam.contamination(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return rows.select("doc_id", "n_words", decontam.n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    rows = secret_scan.scan(docs, secret_scan.thresholds(docs), battery="tests")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    return rows.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secret_scan.digest(base), 256).alias("base_sha256"), secret_scan.digest(F.col("secrets")).alias("spans"), count("random"), F.col("tests.tested").alias("n_tested"), F.col("tests.named").alias("n_base_random"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, places = packing.packed_documents(_docs(spark, sf_dir), public_tokenizers.path(TOKENIZER), end_id=0, capacity=SEQUENCE)
    return places.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(_docs(spark, sf_dir)).select("doc_id", "n_words", *_removed())


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mined(rows, F.col("vec_id") % 50 == 0)


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.neighbours_compared(_docs(spark, sf_dir))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return filter_audit.audit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic"))


QUERIES = {f.__name__: f for f in (op1_minhash_dedup, op2_quality_rules, op3_token_files, op4_toxicity, op5_sharding, op6_suffix_array_dedup, op7_decontamination, op8_secret_scan, op9_packing, op10_substring_dedup, op11_hard_negatives, op12_fingerprints, op13_filter_audit)}

ORACLE: dict[str, str] = {
    "op2_quality_rules": oracles.quality(),
    "op5_sharding": oracles.sharding(SHARD_BYTES),
    "op7_decontamination": oracles.decontamination(),
    "op10_substring_dedup": oracles.substring_dedup(),
    "op11_hard_negatives": oracles.hard_negatives(),
    "op13_filter_audit": oracles.filter_audit(),
}
