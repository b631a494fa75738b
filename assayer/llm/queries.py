"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, decontaminate, divergence, gif, jaccard, langid, licenses, line_dedup, packing, ppm, substring, toxicity
from .common import crc_remainder, documents


def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.filter(crc_remainder("doc_id", 3) != 1))
    return toxicity.score(docs, model).withColumn("held_out", F.coalesce(crc_remainder("doc_id", 3) == 1, F.lit(False)))


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.train(docs.filter(crc_remainder("doc_id", 5) != 0))
    return langid.identify(docs, model).withColumn("held_out", F.coalesce(crc_remainder("doc_id", 5) == 0, F.lit(False)))


def language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ppm.score(documents(spark, sf_dir), crc_remainder("doc_id", 10) != 0)
    return scored.withColumn("held_out", F.coalesce(crc_remainder("doc_id", 10) == 0, F.lit(False))).drop("training")


QUERIES = {
    "op1_bpe": lambda spark, sf_dir: bpe.round_trip(documents(spark, sf_dir)),
    "op2_ppm": language_model,
    "op3_licenses": lambda spark, sf_dir: licenses.scan(documents(spark, sf_dir)).drop("detections"),
    "op4_jaccard": lambda spark, sf_dir: jaccard.join(documents(spark, sf_dir)),
    "op5_substring": lambda spark, sf_dir: substring.report(documents(spark, sf_dir)),
    "op6_gif": lambda spark, sf_dir: gif.report(documents(spark, sf_dir)),
    "op7_toxicity": toxic,
    "op8_line_dedup": lambda spark, sf_dir: line_dedup.line_report(documents(spark, sf_dir)),
    "op9_decontaminate": lambda spark, sf_dir: decontaminate.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")),
    "op10_langid": language,
    "op11_divergence": lambda spark, sf_dir: divergence.audit(documents(spark, sf_dir)),
    "op12_centroids": lambda spark, sf_dir: centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("exact_share"),
    "op13_packing": lambda spark, sf_dir: packing.pack(documents(spark, sf_dir), value=F.crc32("ids").alias("ids_crc32")),
}
ORACLES = {
    "op8_line_dedup": line_dedup.ORACLE,
    "op9_decontaminate": decontaminate.ORACLE,
    "op11_divergence": divergence.ORACLE,
    "op12_centroids": centroids.ORACLE,
}
