"""Experiments: grids over candidates retrieved once, run comparison, regression gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import f1, py_round, ratio
from . import chunking, embedding, retrieval
from . import grid as grids
from .evaluation import hits, identities, wanted
from .grouped import small
from .reports import mean4
from .storage import scratch, stored

# Default grids, which way metrics are better, and tolerances.
THRESHOLDS = [i / 20 for i in range(2, 17)]
TOP_KS, ABLATION_THRESHOLDS = [3, 4, 6, 8], [0.3, 0.4, 0.5]
CHUNK_SIZES, OVERLAPS = [800, 1200, 1800, 2400], [100, 220]
HIGHER = [
    "overall_accuracy", "answerability_accuracy", "refusal_precision", "refusal_recall", "refusal_f1", "answer_exact_match", "answer_token_f1",
    "retrieval_recall_at_k", "mrr", "citation_precision", "citation_recall", "citation_f1", "rewrite_token_f1",
]
LOWER = ["mean_latency_seconds", "brier_score", "ece"]
TOLERANCES = {
    "overall_accuracy": 0.02, "answerability_accuracy": 0.02, "retrieval_recall_at_k": 0.02, "citation_f1": 0.02, "refusal_f1": 0.03,
    "rewrite_token_f1": 0.03, "ece": 0.03, "brier_score": 0.03, "mean_latency_seconds": 1.0,
}
OTHER_TOLERANCE = 0.02


def probe_queries(gold: DataFrame) -> DataFrame:
    """query_id (the case) and query: the labelled standalone query where there is one."""
    return gold.select(F.col("case_id").alias("query_id"), F.coalesce(F.nullif("expected_standalone_query", F.lit("")), F.col("query")).alias("query"))


def probes(gold: DataFrame, retrieved: DataFrame, chunks: DataFrame) -> DataFrame:
    """A row for each case: its labels and its candidates in order (chunk_id, source_doc, similarity). With collection on both
    sides a row for each case and collection in which anything is found."""
    by = ["collection"] if "collection" in retrieved.columns and "collection" in chunks.columns else []
    found = retrieved.join(chunks.select(*by, "chunk_id", "source_doc"), [*by, "chunk_id"]).groupBy(F.col("query_id").alias("case_id"), "retrieval_method", *by)
    items = found.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "source_doc", "similarity"))), lambda x: x.dropFields("rank")).alias("candidates"))
    cases = gold.select("case_id", "expected_answerable", "expected_chunk_ids", "expected_source_docs")
    modes = items.select("retrieval_method", *by).distinct()
    full = cases.crossJoin(F.broadcast(modes)).join(items, ["case_id", "retrieval_method", *by], "left")
    return full.withColumn("candidates", F.coalesce("candidates", F.array().cast(full.schema["candidates"].dataType))).withColumnRenamed("retrieval_method", "mode")


def score_probes(cases: DataFrame, grid: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Retrieval and gate figures for every cell of a grid (seq, top_k, threshold) from the same candidates."""
    by = by or ["mode"]
    c = cases.crossJoin(F.broadcast(grid))
    shown = F.filter(F.slice("candidates", F.lit(1), F.col("top_k")), lambda x: x["similarity"] >= F.col("threshold"))
    c = c.withColumn("shown", shown).withColumn("hit", hits(wanted(F.col("expected_chunk_ids"), F.col("expected_source_docs")), identities(F.col("expected_chunk_ids"), F.col("shown"))))
    yes = F.coalesce(F.get(F.col("candidates.similarity"), F.lit(0)), F.lit(-1.0)) >= F.col("threshold")
    e = F.col("expected_answerable")
    a = c.groupBy(*by, "seq", "top_k", "threshold").agg(
        F.count("*").alias("cases"), F.coalesce(mean4(F.col("hit.recall")), F.lit(0.0)).alias("retrieval_recall_at_k"), F.coalesce(mean4(F.col("hit.reciprocal_rank")), F.lit(0.0)).alias("mrr"),
        F.count_if(e & yes).alias("tp"), F.count_if(~e & ~yes).alias("tn"), F.count_if(~e & yes).alias("fp"), F.count_if(e & ~yes).alias("fn"),
    )
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    p, r, s = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)
    return a.withColumns({
        "threshold": py_round(F.col("threshold"), 3), "answerability_accuracy": py_round(ratio(tp + tn, F.col("cases")), 4), "answerable_precision": py_round(p, 4), "answerable_recall": py_round(r, 4),
        "answerable_f1": py_round(f1(p, r), 4), "balanced_accuracy": py_round((r + s) / 2, 4),
    })


def grid(spark, top_ks: list[int], thresholds: list[float]) -> DataFrame:
    return spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate((k, t) for k in top_ks for t in thresholds)], "seq int, top_k int, threshold double")


def threshold_sweep(cases: DataFrame, top_k: int = 4, configured: float = 0.4, thresholds: list[float] | None = None) -> DataFrame:
    """The grid's rows with `recommended` on one: best balanced accuracy, then recall, then nearest to the configured."""
    rows = score_probes(cases, grid(cases.sparkSession, [top_k], thresholds or THRESHOLDS))
    best = Window.orderBy(F.desc("balanced_accuracy"), F.desc("retrieval_recall_at_k"), F.abs(F.col("threshold") - configured), "seq")
    return rows.withColumn("recommended", F.row_number().over(best) == 1)


def retrieval_ablation(cases: DataFrame, top_ks: list[int] | None = None, thresholds: list[float] | None = None) -> DataFrame:
    """All modes, depths and thresholds, the best first."""
    rows = score_probes(cases, grid(cases.sparkSession, top_ks or TOP_KS, thresholds or ABLATION_THRESHOLDS))
    mode = F.coalesce(*[F.when(F.col("mode") == m, F.lit(i)) for i, m in enumerate(retrieval.MODES)], F.lit(9))
    return rows.orderBy(F.desc("balanced_accuracy"), F.desc("retrieval_recall_at_k"), F.desc("mrr"), mode, "seq")


def chunking_ablation(gold: DataFrame, pages: DataFrame, embedder, sizes: list[int] | None = None, overlaps: list[int] | None = None, mode: str = "hybrid", top_k: int = 4, threshold: float = 0.4) -> DataFrame:
    """Retrieval figures for each chunk size and overlap (under the size), the best first.

    Each cell of the grid is a collection: one plan cuts, indexes, searches and scores all of them, each by its own statistics.
    Chunks are made where they are read, not stored: they are the grid times as large as the pages. All cells share a page's
    units; of the chunks found only the pages are cut again. With embedding.embed itself they share a page's tokens as well
    (grid.hybrid()). Cells without chunks have no row."""
    cells = [(f"{s}/{o}", s, o) for s in sizes or CHUNK_SIZES for o in overlaps or OVERLAPS if o < s]
    variants = gold.sparkSession.createDataFrame([(seq, *c) for seq, c in enumerate(cells)], "seq int, collection string, chunk_size int, overlap int")

    def some(found: DataFrame) -> DataFrame:
        """Chunks of the pages of some chunks, whose ids begin with 12 characters of the page's hash."""
        keys = small(found.select(F.substring("chunk_id", 1, 12).alias("_key")).distinct())
        own = pages.withColumn("_key", F.substring("document_hash", 1, 12)).join(keys, "_key", "left_semi")
        return chunking.chunk_grid(own.drop("_key"), cells)

    with scratch(gold.sparkSession):
        asked, cell = probe_queries(gold), gold.sparkSession.createDataFrame([(0, top_k, threshold)], "seq int, top_k int, threshold double")
        if embedder is embedding.embed and mode == "hybrid" and grids.fits(asked, cells):
            found, n = grids.hybrid(asked, pages, cells, top_k)
            sources = found.select("collection", "chunk_id", "source_doc").distinct()
            found = found.drop("source_doc")
            counts = gold.sparkSession.createDataFrame(list(n.items()), "collection string, indexed_chunks long")
        else:
            asked = variants.select("collection").crossJoin(stored(embedder(asked, "query"), "probes"))
            found = stored(retrieval.retrieve(asked, embedder(chunking.chunk_grid(pages, cells)), top_k, mode, **({"texts": some} if mode == "hybrid" else {})), "found")
            sources, counts = some(found), stored(chunking.grid_counts(pages, cells), "counts")
        rows = score_probes(probes(gold, found, sources), cell, ["mode", "collection"]).drop("seq")
        rows = stored(rows.join(F.broadcast(variants), "collection").join(F.broadcast(counts), "collection").drop("collection"), "grid", keep=True)
    return rows.orderBy(F.desc("balanced_accuracy"), F.desc("retrieval_recall_at_k"), F.desc("mrr"), "seq")


def compare_runs(base: DataFrame, candidate: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """base, candidate: metric, value. metric, baseline, candidate, delta, regression for metrics that both have."""
    both = base.filter("value is not null").withColumnRenamed("value", "b").join(candidate.filter("value is not null").withColumnRenamed("value", "c"), "metric").filter(F.col("metric").isin(HIGHER + LOWER))
    delta = F.col("c") - F.col("b")
    worse = F.when(F.col("metric").isin(HIGHER), delta < -tolerance).otherwise(delta > tolerance)
    return both.select("metric", py_round(F.col("b"), 4).alias("baseline"), py_round(F.col("c"), 4).alias("candidate"), py_round(delta, 4).alias("delta"), worse.alias("regression"))


def regression_gate(base: DataFrame, candidate: DataFrame, tolerances: dict[str, float] | None = None) -> DataFrame:
    """The comparison at no tolerance, with each metric's own tolerance, gate_failed, and passed for the whole."""
    own = TOLERANCES | (tolerances or {})
    limit = F.coalesce(*[F.when(F.col("metric") == k, F.lit(float(v))) for k, v in own.items()], F.lit(OTHER_TOLERANCE))
    rows = compare_runs(base, candidate, 0.0).withColumn("tolerance", limit)
    failed = F.when(F.col("metric").isin(HIGHER), F.col("delta") < -F.col("tolerance")).otherwise(F.col("delta") > F.col("tolerance"))
    rows = rows.withColumn("gate_failed", failed)
    return rows.crossJoin(F.broadcast(rows.agg((~F.coalesce(F.bool_or("gate_failed"), F.lit(False))).alias("passed"))))


def by_model(gold: DataFrame, models: list[str]) -> DataFrame:
    """Each case once for each model, with the run's variant."""
    named = gold.sparkSession.createDataFrame([(m, f"model::{m}") for m in models], "model string, variant string")
    return gold.crossJoin(F.broadcast(named))


def first_cases(gold: DataFrame, n: int, seq: str = "case_id") -> DataFrame:
    """The first n cases (0: all)."""
    return gold.orderBy(seq).limit(n) if n else gold
