"""Labelled cases and stored runs from JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROLES = ("user", "assistant", "system")
CASE = (
    "case_id string, query string, expected_answerable boolean, expected_answer string, expected_chunk_ids array<string>, expected_source_docs array<string>, "
    "expected_standalone_query string, history array<struct<role:string,content:string>>, tags array<string>, notes string"
)
_TURN = pa.struct([("role", pa.string()), ("content", pa.string())])
_KINDS = [pa.string(), pa.string(), pa.bool_(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.list_(_TURN), pa.list_(pa.string()), pa.string()]
_NAMES = [x.split()[0] for x in ("case_id", "query", "expected_answerable", "expected_answer", "expected_chunk_ids", "expected_source_docs", "expected_standalone_query", "history", "tags", "notes")]


def _case(raw: str) -> tuple:
    """One labelled case, checked strictly."""
    try:
        row = json.loads(raw)
    except json.JSONDecodeError:
        raise ValueError("invalid JSON") from None
    if not isinstance(row, dict):
        raise ValueError("not a JSON object")

    def needed(name: str) -> str:
        value = str(row.get(name, "")).strip()
        if not value:
            raise ValueError(f"{name} is missing")
        return value

    def text(name: str) -> str | None:
        value = row.get(name)
        if value is not None and not isinstance(value, str):
            raise ValueError(f"{name} is neither text nor null")
        return value if value is None else value.strip()

    def texts(name: str) -> list[str]:
        value = row.get(name)
        if value is not None and not (isinstance(value, list) and all(isinstance(x, str) and x.strip() for x in value)):
            raise ValueError(f"{name} is no list of texts")
        return [x.strip() for x in value or []]

    def turns() -> list[dict]:
        value = row.get("history")
        if value is not None and not (isinstance(value, list) and all(isinstance(x, dict) and x.get("role") in ROLES and isinstance(x.get("content"), str) for x in value)):
            raise ValueError("a turn of history needs a role and content")
        return [{"role": x["role"], "content": x["content"]} for x in value or []]

    head = needed("case_id"), needed("query")
    answerable = row.get("expected_answerable")
    if not isinstance(answerable, bool):
        raise ValueError("expected_answerable is neither true nor false")
    case = (*head, answerable, text("expected_answer"), texts("expected_chunk_ids"), texts("expected_source_docs"), text("expected_standalone_query"), turns(), texts("tags"), str(row.get("notes", "")).strip())
    if answerable and not any(case[3:6]):
        raise ValueError("an answerable case needs an answer or evidence")
    return case


def parse_cases(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lines (line_no, value) to the cases, and what is refused (line_no, error). Empty lines and those from '#' on are
    left out; of cases with one id the first line's stays, and the others are refused."""
    names = ["line_no", *_NAMES, "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for n, raw in zip(b.column("line_no").to_pylist(), b.column("value").to_pylist(), strict=True):
                try:
                    rows.append((n, *_case(raw), None))
                except ValueError as e:
                    rows.append((n, *[None] * len(_NAMES), str(e)))
            cols = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), *_KINDS, pa.string()], strict=True)], names)

    rows = lines.select(F.col("line_no").cast("long").alias("line_no"), F.trim("value").alias("value")).filter("value <> '' and not startswith(value, '#')")
    read = rows.mapInArrow(run, f"line_no long, {CASE}, error string")
    first = read.filter("error is null").groupBy("case_id").agg(F.min("line_no").alias("first_line")).withColumnRenamed("case_id", "first_id")
    told = read.join(first, read.case_id == first.first_id, "left").withColumn("error", F.coalesce("error", F.when(F.col("line_no") > F.col("first_line"), F.concat(F.lit("duplicate case_id "), F.col("case_id")))))
    return told.filter("error is null").select(_NAMES), told.filter("error is not null").select("line_no", "error")


def load_cases(spark: SparkSession, text: str) -> DataFrame:
    """The cases of a JSONL text; any refused line, and an empty file, fails the whole."""
    lines = spark.createDataFrame(list(enumerate(text.splitlines(), 1)) or [(1, "")], "line_no long, value string")
    cases, refused = parse_cases(lines)
    bad = refused.orderBy("line_no").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"line {r.line_no}: {r.error}" for r in bad))
    if cases.isEmpty():
        raise ValueError("there is no labelled case")
    return cases


RUN = (
    "run_id string, created_at string, variant string, metrics map<string,double>, confusion map<string,bigint>, failure_counts map<string,bigint>, "
    "cases array<struct<case_id:string,query:string,expected_answerable:boolean,predicted_answerable:boolean,correct:boolean,answer_exact_match:double,answer_token_f1:double,retrieval_recall:double,"
    "reciprocal_rank:double,citation_precision:double,citation_recall:double,citation_f1:double,rewrite_token_f1:double,confidence_score:double,latency_seconds:double,failures:array<string>,tags:array<string>>>, metadata string"
)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Stored runs; a file that isn't one fails the read. metadata is its JSON text (null: none), whose fields follow the
    run; it is written and read again as such."""
    return spark.read.schema(RUN).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
