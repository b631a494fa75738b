"""Aggregates over case evaluations and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import f1, py_round, ratio

MEANS = {
    "answer_exact_match": "answer_exact_match", "answer_token_f1": "answer_token_f1", "retrieval_recall_at_k": "retrieval_recall", "mrr": "reciprocal_rank", "citation_precision": "citation_precision",
    "citation_recall": "citation_recall", "citation_f1": "citation_f1", "rewrite_token_f1": "rewrite_token_f1", "mean_latency_seconds": "latency_seconds",
}
#: A case evaluation's columns, as stored runs have them.
CASE_COLUMNS = [
    "case_id", "query", "expected_answerable", "predicted_answerable", "correct", "answer_exact_match", "answer_token_f1", "retrieval_recall", "reciprocal_rank", "citation_precision", "citation_recall",
    "citation_f1", "rewrite_token_f1", "confidence_score", "latency_seconds", "failures", "tags",
]
#: Tags of the safety summary and the names of their figures.
SAFETY = {"red-team": "red_team", "safe-refusal": "safe_refusal", "conversational": "conversational"}


def mean4(c: Column) -> Column:
    """Mean of the values there are, which have at most four digits: summed as whole numbers, so order doesn't matter."""
    return py_round(F.sum(F.round(c * 10_000).cast("long")) / (10_000.0 * F.count(c)), 4)


def share4(c: Column) -> Column:
    return mean4(c.cast("double"))


def confusion(cases: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, tn, fp, fn of answering."""
    e, p = F.col("expected_answerable"), F.col("predicted_answerable")
    return cases.groupBy(*(by or [])).agg(F.count_if(e & p).alias("tp"), F.count_if(~e & ~p).alias("tn"), F.count_if(~e & p).alias("fp"), F.count_if(e & ~p).alias("fn"))


def refusal_scores(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and F1 of refusing, each rounded before the next."""
    four = lambda a, b: py_round(ratio(a, b), 4)
    out = counts.withColumns({"refusal_precision": four(F.col("tn"), F.col("tn") + F.col("fn")), "refusal_recall": four(F.col("tn"), F.col("tn") + F.col("fp"))})
    return out.withColumn("refusal_f1", py_round(f1(F.col("refusal_precision"), F.col("refusal_recall")), 4))


def _bin(c: Column, bins: int) -> Column:
    """Number of the equal-width bin; 1 is in the last; null outside 0 to 1."""
    return F.when(c.between(0.0, 1.0), F.least(F.lit(bins - 1), F.floor(c * bins)).cast("int"))


def calibration_error(scored: DataFrame, confidence: str = "confidence_score", outcome: str = "correct", bins: int = 10) -> DataFrame:
    """ece and brier_score over rows with a confidence; null without any."""
    rows = scored.filter(F.col(confidence).isNotNull()).select(F.col(confidence).alias("c"), F.col(outcome).cast("double").alias("o"))
    each = rows.groupBy(_bin(F.col("c"), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg("c").alias("mc"), F.avg("o").alias("mo"), F.sum((F.col("c") - F.col("o")) ** 2).alias("sq"))
    gap = F.sum(F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("mo") - F.col("mc"))).otherwise(0.0))
    return each.agg(py_round(gap / F.sum("n"), 4).alias("ece"), py_round(F.sum("sq") / F.sum("n"), 4).alias("brier_score"))


def calibration_bins(cases: DataFrame, bins: int = 10) -> DataFrame:
    """Bins with cases: bin_lower, bin_upper, count, mean_confidence, accuracy."""
    rows = cases.filter("confidence_score is not null").withColumn("bin", _bin(F.col("confidence_score"), bins)).filter("bin is not null")
    out = rows.groupBy("bin").agg(F.count("*").alias("count"), py_round(F.avg("confidence_score"), 4).alias("mean_confidence"), share4(F.col("correct")).alias("accuracy"))
    return out.select(py_round(F.col("bin") / bins, 2).alias("bin_lower"), py_round((F.col("bin") + 1) / bins, 2).alias("bin_upper"), "count", "mean_confidence", "accuracy")


def run_metrics(cases: DataFrame, bins: int = 10) -> DataFrame:
    """One row: the metrics of a run and its confusion counts. No row without cases."""
    means = cases.agg(F.count("*").alias("cases"), share4(F.col("correct")).alias("overall_accuracy"), share4(F.col("expected_answerable") == F.col("predicted_answerable")).alias("answerability_accuracy"), *[mean4(F.col(c)).alias(n) for n, c in MEANS.items()])
    errors = calibration_error(cases.filter("predicted_answerable"), bins=bins)
    return means.crossJoin(refusal_scores(confusion(cases))).crossJoin(errors).filter("cases > 0")


def metrics_long(metrics: DataFrame) -> DataFrame:
    """metric, value of a row of metrics."""
    names = [c for c in metrics.columns if c not in ("tp", "tn", "fp", "fn", "variant", "run_id")]
    return metrics.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])))


def failure_counts(cases: DataFrame) -> DataFrame:
    """failure and count, the most frequent first."""
    return cases.select(F.explode("failures").alias("failure")).groupBy("failure").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "failure")


def slices(cases: DataFrame) -> DataFrame:
    """Metrics by tag; a case counts once for each of its tags."""
    rows = cases.withColumn("slice", F.explode(F.array_distinct("tags")))
    return rows.groupBy("slice").agg(
        F.count("*").alias("cases"), share4(F.col("correct")).alias("accuracy"), mean4(F.col("retrieval_recall")).alias("retrieval_recall"), mean4(F.col("citation_f1")).alias("citation_f1"),
        mean4(F.col("rewrite_token_f1")).alias("rewrite_f1"), mean4(F.col("latency_seconds")).alias("mean_latency_seconds"),
    )


def safety_summary(cases: DataFrame, tags: dict[str, str] = SAFETY) -> DataFrame:
    """Cases and pass rate of each safety tag; the rate is null without cases."""
    out = []
    for tag, name in tags.items():
        has = F.array_contains("tags", tag)
        out += [F.count_if(has).alias(f"{name}_cases"), share4(F.when(has, F.col("correct"))).alias(f"{name}_pass_rate")]
    return cases.agg(*out)


def efficiency(traces: DataFrame) -> DataFrame:
    """Latency (mean, median, 95th percentile; interpolated), tokens and costs; null where there are none."""
    s = F.col("total_ms") / 1000
    return traces.agg(
        py_round(F.avg(s), 4).alias("mean_latency_seconds"), py_round(F.percentile(s, F.lit(0.5)), 4).alias("p50_latency_seconds"), py_round(F.percentile(s, F.lit(0.95)), 4).alias("p95_latency_seconds"),
        *[py_round(F.avg(f"{n}_tokens"), 2).alias(f"mean_{n}_tokens") for n in ("prompt", "completion", "total")], F.sum("total_tokens").cast("long").alias("total_tokens"),
        py_round(F.avg("estimated_cost_usd"), 8).alias("mean_estimated_cost_usd"), py_round(F.sum("estimated_cost_usd"), 8).alias("total_estimated_cost_usd"),
    )


def run_metadata(cases: DataFrame, traces: DataFrame) -> DataFrame:
    """One row: efficiency, red_blue, slices and telemetry (of each case its times, tokens and cost)."""
    one = efficiency(traces).select(F.struct("*").alias("efficiency")).crossJoin(safety_summary(cases).select(F.struct("*").alias("red_blue")))
    one = one.crossJoin(slices(cases).agg(F.array_sort(F.collect_list(F.struct("*"))).alias("slices")))
    told = [c for c in ("retrieval_ms", "generation_ms", "total_ms", "prompt_tokens", "completion_tokens", "total_tokens", "estimated_cost_usd", "provider", "model") if c in traces.columns]
    return one.crossJoin(traces.agg(F.array_sort(F.collect_list(F.struct("case_id", *told))).alias("telemetry")))


def benchmark_run(cases: DataFrame, variant: str = "", traces: DataFrame | None = None) -> DataFrame:
    """One row: run_id, created_at, variant, metrics, confusion, failure_counts, cases and, with traces, metadata. A run is one
    document, as sources.labels stores and reads it, so its cases (labelled by hand, so not many) are gathered in the row."""
    m = run_metrics(cases)
    names = [c for c in m.columns if c not in ("tp", "tn", "fp", "fn")]
    entries = lambda of: F.map_from_arrays(F.array(*[F.lit(n) for n in of]), F.array(*of))
    f = failure_counts(cases).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("failure", "count")))).alias("failure_counts"))
    own = cases.agg(F.array_sort(F.collect_list(F.struct(*CASE_COLUMNS))).alias("cases"))
    out = m.select(*[F.col(n).cast("double").alias(n) for n in names], "tp", "tn", "fp", "fn").crossJoin(f).select(
        F.replace(F.uuid(), F.lit("-"), F.lit("")).alias("run_id"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("created_at"), F.lit(variant.strip() or "default").alias("variant"),
        entries(names).alias("metrics"), entries(["tp", "tn", "fp", "fn"]).alias("confusion"), "failure_counts",
    )
    out = out.crossJoin(own)
    return out if traces is None else out.crossJoin(run_metadata(cases, traces).select(F.struct("*").alias("metadata")))


def run_history(runs: DataFrame) -> DataFrame:
    """Runs, the newest first, with the figures of the overview."""
    return runs.select("run_id", "created_at", "variant", *[F.col("metrics")[c].alias(c) for c in ("cases", "overall_accuracy", "answerability_accuracy", "refusal_f1", "retrieval_recall_at_k", "citation_f1", "brier_score", "ece", "mean_latency_seconds")]).orderBy(F.desc("created_at"), "run_id")


def add_runs(known: DataFrame, more: DataFrame) -> DataFrame:
    """Known runs and those of more whose run_id isn't known yet."""
    return known.unionByName(more.join(known.select("run_id"), "run_id", "left_anti").select(known.columns))


def evidence_view(traces: DataFrame) -> DataFrame:
    """Shown chunks of each trace, with the number they are cited by, their scores and how they were found."""
    cols = ["chunk_id", "source_doc", "page_number", "similarity", "dense_score", "lexical_score", "rerank_score", "retrieval_method", "text"]
    return traces.select("query_id", F.posexplode("retrieved").alias("n", "r")).select("query_id", (F.col("n") + 1).alias("position"), *[F.col(f"r.{c}").alias(c) for c in cols])


def trace_view(traces: DataFrame) -> DataFrame:
    """A line for each trace."""
    return traces.select(
        "query_id", "query", "standalone_query", "rewrite_failed", "retrieval_mode", "is_refusal", "refusal_reason", "confidence", "confidence_score", "top_similarity", F.size("retrieved").alias("sources"),
        "citation_validation_error", "citation_repair_used", "invalid_citations", "provider", "model", "retrieval_ms", "generation_ms", "total_ms", "total_tokens", "estimated_cost_usd",
    )


def case_audit(cases: DataFrame) -> DataFrame:
    """Cases that failed, with their labels, the worst first."""
    return cases.filter(~F.col("correct") | (F.size("failures") > 0)).select("case_id", "query", "expected_answerable", "predicted_answerable", "correct", F.array_join("failures", ", ").alias("failures"), "confidence_score").orderBy("correct", F.desc(F.size(F.split("failures", ","))), "case_id")


def report_markdown(traces: DataFrame) -> DataFrame:
    """query_id and a readable report of each answer with its sources."""
    sources = F.array_join(F.transform("retrieved", lambda r, i: F.concat(F.lit("\n- [S"), (i + 1).cast("string"), F.lit("] "), r["source_doc"], F.lit(", page "), r["page_number"].cast("string"), F.lit(", score "), F.call_function("format_number", r["similarity"], F.lit("0.000")))), "")
    return traces.select("query_id", F.concat(F.lit("# "), F.col("query"), F.lit("\n\n"), F.col("answer"), F.lit("\n\nConfidence: "), F.col("confidence"), F.lit("\n\n## Sources\n"), sources).alias("report_md"))
