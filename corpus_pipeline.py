"""The training-data pipeline: five stages from raw documents to token ids.

1. language: lang becomes the language that the string kernels tell; documents without one (no letter in the text, or no
   text) go. Where no model can be fitted, lang stays as it is.
2. lines: later occurrences of three-line windows are cut out; documents with nothing left go.
3. near_copies: of each group of documents linked by shingle similarity, the one with the smallest id stays.
4. benchmark: documents that hold a benchmark item, or nearly, go.
5. tokens: the ids of each text that is left.

Each stage takes and, but for the last, returns the columns of documents; its result is written as Parquet in the shared
folder and read again. Other columns pass through unchanged, lang and n_chars follow the text. Rows with a null doc_id stay in
stage 3, as they belong to no group; rows alike in id and text share each decision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import bpe, decontaminate, jaccard, langid, line_dedup
from assayer.llm.common import crc_remainder, scratch, stored
from assayer.llm.native import small


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs.filter(crc_remainder("doc_id", 5) != 0))
    if not model.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    # Columns go by number, so that none clashes with those that are added.
    place = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    told = langid.identify(docs.toDF(*place.values()), model, text_col=place["text"], keep=True).filter("lang_pred <> 'und'")
    return told.select(*[F.col("lang_pred" if c == "lang" else p).alias(c) for c, p in place.items()])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(docs).filter("text <> ''")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = stored(jaccard.join(docs).filter("component_id <> doc_id").select("doc_id").distinct(), "gone")
    return docs.join(small(gone), "doc_id", "left_anti").select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("tokens", tokens)]
#: Kernels, components and byte-pair merges have no SQL form; tests/llm/test_pipeline.py has the brute-force one.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (last, end) = STAGES
    with scratch(spark):
        for name, stage in first:
            with scratch(spark):
                docs = stored(stage(spark, docs, sf_dir), name, keep=True)
        return stored(end(spark, docs, sf_dir), last, keep=True)
