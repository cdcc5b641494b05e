"""From raw documents to packed training sequences.

STAGES in order: toxic documents go; one document of each near-duplicate class
stays; documents with benchmark passages go; secrets are masked; what is left is
packed. Each stage gets what the one before wrote, as Parquet, and calls one
operator of sightline.llm on all of it.

Defined cases: null and empty texts pass every filter (they are not toxic, have
no near copies, no benchmark passages and no secrets) and pack as a lone end id;
very long texts are rows like any other;
rows that repeat a doc_id are documents of their own, of which equal or near
texts are copies; an empty
table gives empty results; extra columns are carried along to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import decontam, minhash, packing, secret_scan, toxicity
from sightline.llm._common import staged

TOKENIZER = "word_bpe_49k.json"


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    scored = toxicity.scored(docs.withColumnRenamed("score", "_score").withColumnRenamed("spans", "_spans"), model, spans=False)
    return scored.where(F.col("score") < toxicity.THRESHOLD).drop("score").withColumnRenamed("_score", "score").withColumnRenamed("_spans", "spans").select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    repeated = docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL")
    if repeated.isEmpty():
        kept = minhash.classes(docs).where("kept").select(F.col("doc_id").alias("_kept"))
        return docs.join(kept, F.col("doc_id").cast("long") == F.col("_kept"), "left_semi")
    # ids do not tell rows apart: rows are numbered, and the numbers written, before they are compared
    rows = staged(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    kept = minhash.classes(rows.select(F.col("_row").alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias("_row"))
    return rows.join(kept, "_row", "left_semi").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=True)
    return found.where(F.size("_hits") == 0).select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = secret_scan.scan(docs.withColumnRenamed("secrets", "_secrets"), secret_scan.thresholds(docs))
    rows = rows.withColumn("text", secret_scan.redacted(F.col("text"), F.col("secrets"))).drop("secrets").withColumnRenamed("_secrets", "secrets")
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _, places = packing.packed_documents(docs, public_tokenizers.path(TOKENIZER), end_id=0)
    return places.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: The toxicity field, ProbMinHash and the tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
