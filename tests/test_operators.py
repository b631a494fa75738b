import math

import pytest
from pyspark.sql import functions as F

from assayer.operators import answering, chunking, evaluation, lab, reports, retrieval

DOCS = [("d1", "The red kite needs a permit. Permit review takes two days."), ("d2", "Blue kite sales are open to all."), ("d3", "Café opening hours")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "chunk_id string, text string")


def asked(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")


def test_bm25(spark, docs):
    got = {(r.query_id, r.chunk_id): r.score for r in retrieval.bm25(asked(spark, "kite permit", "kite permit permit", "what is the"), docs).collect()}
    assert got == {(0, "d1"): 1.0, (0, "d2"): 0.320176, (1, "d1"): 1.0, (1, "d2"): 0.181894}


def test_lexical_fill(spark, docs):
    q = asked(spark, "kite permit", "what is the", "")
    got = {}
    for r in retrieval.lexical_topk(q, docs, 3).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.lexical_score))
    assert got == {0: [("d1", 1.0), ("d2", 0.3202), ("d3", 0.0)], 1: [("d1", 0.0), ("d2", 0.0), ("d3", 0.0)], 2: [("d1", 0.0), ("d2", 0.0), ("d3", 0.0)]}
    assert retrieval.lexical_topk(q, docs, 0).count() == 3


def test_collections_apart(spark, docs):
    both = docs.withColumn("collection", F.lit("a")).unionByName(docs.filter("chunk_id <> 'd1'").withColumn("collection", F.lit("b")))
    q = asked(spark, "kite permit").withColumn("collection", F.lit("b"))
    got = retrieval.lexical_topk(q, both, 5).orderBy("rank").collect()
    assert [(r.chunk_id, r.lexical_score) for r in got] == [("d2", 1.0), ("d3", 0.0)]


def test_dense(spark, monkeypatch):
    c = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.43588989]), ("c", [-1.0, 0.0]), ("z", [0.0, 0.0]), ("n", None), ("a2", [2.0, 0.0])], "chunk_id string, vec array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id int, vec array<double>")
    for block in (4096, 1):
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
        got = [(r.query_id, r.chunk_id, r.dense_score) for r in retrieval.dense_topk(q, c, 3).orderBy("query_id", "rank").collect()]
        assert got == [(1, "a", 1.0), (1, "a2", 1.0), (1, "b", 0.9), (2, "b", 0.4359), (2, "a", 0.0), (2, "a2", 0.0)]


def test_rerank(spark):
    rows = [("d1", 0.71, 1.0, 1, 1), ("d2", 0.64, 0.3, 2, 2), ("d3", -0.05, 0.0, 3, 3)]
    df = spark.createDataFrame([(*r, dict(DOCS)[r[0]]) for r in rows], "id string, d double, x double, dr int, xr int, text string")
    got = df.select("id", retrieval.rerank(F.lit("kite permit"), F.col("text"), F.col("d"), F.col("x"), retrieval.rrf(F.col("dr"), F.col("xr"))).alias("s")).collect()
    assert {r.id: r.s for r in got} == {"d1": 0.8108, "d2": 0.497555, "d3": 0.03873}


def test_modes(spark, docs):
    v = {"d1": [1.0, 0.0], "d2": [0.6, 0.8], "d3": [0.0, 1.0]}
    c = spark.createDataFrame([(k, t, v[k]) for k, t in DOCS], "chunk_id string, text string, vec array<double>")
    q = spark.createDataFrame([(1, "kite permit", [1.0, 0.0])], "query_id int, query string, vec array<double>")
    for mode in retrieval.MODES:
        r = retrieval.retrieve(q, c, 2, mode).orderBy("rank").collect()
        assert [x.chunk_id for x in r] == ["d1", "d2"] and r[0].retrieval_method == mode
    assert r[0].dense_score == 1.0 and r[0].lexical_score == 1.0 and r[0].similarity == r[0].rerank_score
    with pytest.raises(ValueError, match="mode"):
        retrieval.retrieve(q, c, 2, "other")


def plain_chunks(text, size, overlap):
    """The packing rule in its plainest form, over units that are given."""
    out, held = [], ""
    for u in text:
        if held and len(held + " " + u) > size:
            out.append(held)
            t = held[len(held) - overlap :] if overlap else ""
            t = t[t.find(" ") + 1 :] if " " in t else t
            room = max(0, size - len(u) - 1)
            if len(t) > room:
                t = t[len(t) - room :] if room else ""
                t = t[t.find(" ") + 1 :] if " " in t else t
            held = (t + " " + u).strip()
        else:
            held = (held + " " + u).strip()
    return [*out, held] if held else out


def test_chunks(spark):
    text = " ".join(f"Sentence number {i} has {'many ' * (i % 9)}words." for i in range(60)) + "\n\n" + "x" * 950 + " " + "word " * 200
    page = spark.createDataFrame([("abcdef0123456789", "a.txt", 2, text), ("ff", "b.txt", 1, ""), ("gg", "c.txt", 1, None)], "document_hash string, source_doc string, page_number int, text string")
    for size, overlap in ((400, 60), (200, 0), (800, 220)):
        got = chunking.chunk_pages(page, size, overlap).collect()
        units = [u for p in text.split("\n\n") for u in __import__("re").split(r"(?<=[.!?])\s+", p.strip())]
        pieces = list(chunking.bounded(units, size))
        assert [r.text for r in got] == plain_chunks(pieces, size, overlap)
        assert all(0 < len(r.text) <= size for r in got) and max(map(len, pieces)) <= size
        assert [r.chunk_id for r in got] == [f"abcdef012345_p2_c{i + 1}" for i in range(len(got))]
        assert all(text[r.char_start : r.char_start + 20] == r.text[:20] for r in got if r.char_start)
    assert list(chunking.bounded(["ab cd ef"], 5)) == ["ab cd"[:5].strip(), "ef"] or list(chunking.bounded(["ab cd ef"], 5))[0] == "ab"


def test_admission(spark):
    df = spark.createDataFrame([("s", 1, 6), ("s", 2, 5), ("s", 3, 4), ("t", 1, 11)], "session_id string, seq int, chunks int")
    assert {(r.session_id, r.seq): r.admitted for r in chunking.admit(df, 10).collect()} == {("s", 1): True, ("s", 2): False, ("s", 3): True, ("t", 1): False}


def test_gate_and_context(spark):
    rows = [(1, "a", 0.9, 1), (1, "b", 0.4, 2), (1, "c", 0.3, 3), (2, "a", 0.3, 1), (2, "b", 0.2, 2)]
    df = spark.createDataFrame(rows, "query_id int, chunk_id string, similarity double, rank int")
    got = {(r.query_id, r.chunk_id): (r.passed, r.shown) for r in answering.gate(df, 0.4, 1).collect()}
    assert got == {(1, "a"): (True, True), (1, "b"): (True, False), (1, "c"): (True, False), (2, "a"): (False, True), (2, "b"): (False, False)}
    shown = df.withColumns({"source_doc": F.lit("d"), "page_number": F.lit(1), "text": F.lit("x" * 100)})
    head = len('<EVIDENCE id="S1" document="d" page="1" score="0.900">\n') + len("\n</EVIDENCE>")
    assert answering.pack_context(shown, 2 * (head + 100) + 2).count() == 4
    assert answering.pack_context(shown, 2 * (head + 100) + 1).count() == 2
    cut = answering.pack_context(shown.filter("rank = 1"), head + 10).collect()
    assert {len(r.text) for r in cut} == {10}
    assert answering.pack_context(shown, head).count() == 0


def test_confidence(spark):
    df = spark.createDataFrame([(0.7, 1.0), (0.5, 0.8), (0.4, 1.0), (0.9, 0.5)], "t double, c double")
    got = df.select(answering.confidence_label(F.col("t"), 0.4, F.col("c")).alias("a"), answering.confidence_score(F.col("t"), 0.4, F.col("c")).alias("b")).collect()
    assert [r.a for r in got] == ["High", "Medium", "Low", "Low"]
    assert [r.b for r in got] == [0.625, 0.325, 0.0, 0.75]


class Scripted:
    name, model = "scripted", "m"

    def __init__(self, first, second=None):
        self.first, self.second = first, second

    def complete(self, prompts):
        return [self.second if "DRAFT:" in user else self.first for _, user in prompts]


GOOD = '{"can_answer": true, "items": [{"claim": "A kite needs a permit", "source_ids": ["S1"]}]}'


@pytest.mark.parametrize(("first", "second", "reason", "error", "repaired"), [
    (GOOD, None, None, None, False), ("A kite needs a permit [S1].", None, None, None, False), ("A kite needs a permit.", GOOD, None, None, True), ("A kite needs a permit.", "no", "citation_validation", "missing_source_ids", False),
    ("A kite needs a permit [S9].", "no", "citation_validation", "unknown_source_ids:9", False), ("A kite needs this [S1]. It also needs that one.", None, "citation_validation", "incomplete_claim_citations", False),
    ('{"can_answer": false, "reason": "no"}', None, "model_insufficient_evidence", None, False), (None, None, "provider_error", None, False),
])
def test_answers(spark, docs, first, second, reason, error, repaired):
    chunks = docs.withColumns({"source_doc": F.concat("chunk_id", F.lit(".txt")), "page_number": F.lit(1)})
    q = asked(spark, "kite permit", " ", "zzz")
    found = retrieval.retrieve(q, docs, 3, "lexical")
    r = {x.query_id: x for x in answering.answer(q, found, chunks, Scripted(first, second), 0.2).collect()}
    assert (r[0].refusal_reason, r[0].citation_validation_error, r[0].citation_repair_used) == (reason, error, repaired)
    assert (r[1].refusal_reason, r[2].refusal_reason) == ("empty_query", "similarity_threshold")
    assert r[0].is_refusal == (reason is not None) and [x.chunk_id for x in r[0].retrieved] == ["d1", "d2"]
    if reason is None:
        assert r[0].confidence == "High" and r[0].confidence_score == 1.0 and "[S1]" in r[0].answer


def test_evaluation(spark, docs):
    gold = spark.createDataFrame([
        ("a", "q", True, "A kite needs a permit", [], ["D1.txt"], "kite permit", ["t"]), ("b", "q", False, None, [], [], None, ["t", "red-team"]), ("c", "q", True, None, ["x", "d2"], [], None, []), ("d", "q", True, "never", [], [], None, []),
    ], "case_id string, query string, expected_answerable boolean, expected_answer string, expected_chunk_ids array<string>, expected_source_docs array<string>, expected_standalone_query string, tags array<string>")
    shown = [("d2", "d2.txt"), ("d1", "d1.txt")]
    traces = spark.createDataFrame([
        ("a", "- A kite needs a permit [S2]", None, "kite permit", shown, False, "High", 0.9, 1000.0), ("b", "x", None, "q", shown, False, "High", None, 9000.0), ("c", "y [S1]", None, "q", shown, False, "Low", None, 0.0), ("d", "no", None, "q", [], True, "Low (safe refusal)", None, 0.0),
    ], "case_id string, answer string, generated_answer string, standalone_query string, retrieved array<struct<chunk_id:string,source_doc:string>>, is_refusal boolean, confidence string, confidence_score double, total_ms double").withColumn("query", F.lit("q"))
    e = evaluation.evaluate(gold, traces, latency_slo_seconds=8.0)
    r = {x.case_id: x for x in e.collect()}
    a, b, c, d = r["a"], r["b"], r["c"], r["d"]
    assert (a.correct, a.answer_exact_match, a.answer_token_f1, a.retrieval_recall, a.reciprocal_rank, a.citation_f1, a.rewrite_token_f1, a.failures) == (True, 1.0, 1.0, 1.0, 0.5, 1.0, 1.0, [])
    assert (b.correct, b.retrieval_recall, b.confidence_score, b.failures) == (False, None, 0.85, ["WRONG_ANSWERABILITY", "OVERCONFIDENT_ERROR", "LATENCY_REGRESSION"])
    assert (c.correct, c.retrieval_recall, c.citation_recall, c.citation_precision, c.failures) == (True, 0.5, 0.5, 1.0, ["CITATION_OFF_GOLD", "UNDERCONFIDENT_CORRECT"])
    assert (d.correct, d.answer_token_f1, d.failures) == (False, 0.0, ["WRONG_REFUSAL"])
    m = reports.run_metrics(e).first()
    assert (m.cases, m.overall_accuracy, m.answerability_accuracy, m.tp, m.tn, m.fp, m.fn, m.refusal_f1) == (4, 0.5, 0.5, 2, 0, 1, 1, 0.0)
    s = {x.slice: x for x in reports.slices(e).collect()}
    assert s["t"].cases == 2 and s["t"].accuracy == 0.5 and s["red-team"].retrieval_recall is None
    safe = reports.safety_summary(e).first()
    assert (safe.red_team_cases, safe.red_team_pass_rate, safe.conversational_pass_rate) == (1, 0.0, None)
    run = reports.benchmark_run(e, " ", traces.withColumns({c: F.lit(None).cast("double") for c in ("prompt_tokens", "completion_tokens", "total_tokens", "estimated_cost_usd")}))
    assert run.first().variant == "default" and reports.run_history(run).count() == 1
    assert reports.run_metrics(e.limit(0)).count() == 0


def test_calibration(spark):
    df = spark.createDataFrame([(0.9, True), (0.8, True), (0.2, False), (0.1, False), (None, True)], "confidence_score double, correct boolean")
    r = reports.calibration_error(df, bins=2).first()
    assert (r.ece, r.brier_score) == (0.15, 0.025)
    b = reports.calibration_bins(df.unionByName(spark.createDataFrame([(1.0, True), (0.5, False)], df.schema)), 2).orderBy("bin_lower").collect()
    assert [(x.bin_lower, x.bin_upper, x["count"]) for x in b] == [(0.0, 0.5, 2), (0.5, 1.0, 4)]
    none = reports.calibration_error(df.limit(0)).first()
    assert (none.ece, none.brier_score) == (None, None)


def test_refusal_rounding(spark):
    r = reports.refusal_scores(spark.createDataFrame([(0, 1, 5, 0)], "tp long, tn long, fp long, fn long")).first()
    assert r.refusal_f1 == 0.2858


def test_sweep(spark):
    rows = [("a", True, [], ["d"], "dense", [("1", "d", 0.85)]), ("b", False, [], [], "dense", [("2", "e", 0.20)])]
    c = spark.createDataFrame(rows, "case_id string, expected_answerable boolean, expected_chunk_ids array<string>, expected_source_docs array<string>, mode string, candidates array<struct<chunk_id:string,source_doc:string,similarity:double>>")
    got = lab.threshold_sweep(c, thresholds=[0.1, 0.4, 0.9]).collect()
    best = [r for r in got if r.recommended]
    assert len(best) == 1 and best[0].threshold == 0.4 and best[0].balanced_accuracy == 1.0
    assert lab.retrieval_ablation(c).count() == 12


def test_runs(spark):
    base = spark.createDataFrame([("overall_accuracy", 0.90), ("mean_latency_seconds", 2.0), ("ece", None), ("other", 1.0)], "metric string, value double")
    new = spark.createDataFrame([("overall_accuracy", 0.84), ("mean_latency_seconds", 2.1), ("ece", 0.1), ("other", 0.0)], "metric string, value double")
    assert {r.metric: (r.delta, r.regression) for r in lab.compare_runs(base, new).collect()} == {"overall_accuracy": (-0.06, True), "mean_latency_seconds": (0.1, True)}
    g = {r.metric: (r.gate_failed, r.passed) for r in lab.regression_gate(base, new).collect()}
    assert g == {"overall_accuracy": (True, False), "mean_latency_seconds": (False, False)}


def test_history(spark):
    t = spark.createDataFrame([(1, i, "user", "x" * 900 if i == 0 else str(i)) for i in range(5)], "conv_id int, turn int, role string, text string")
    h = {r.turn: r.history for r in answering.history_text(t).collect()}
    assert h[0] == "" and h[1] == "user: " + "x" * 800 and h[4] == "user: 1\nuser: 2\nuser: 3"
    q = spark.createDataFrame([("q", "h", " new\nq "), ("q", "", "new"), ("q", "h", None)], "q string, h string, o string")
    assert [r.x for r in q.select(answering.rewritten(F.col("q"), F.col("h"), F.col("o")).alias("x")).collect()] == ["new q", "q", "q"]


def test_usage_and_percentiles(spark):
    r = spark.range(1).select(answering.usage(F.lit(5).cast("long"), F.lit(3).cast("long")).alias("u"), answering.cost(F.lit(1000), F.lit(2000), 1.0, 2.0).alias("c"), answering.cost(F.lit(1), F.lit(1), 0, 0).alias("n")).first()
    assert (r.u, r.c, r.n) == (0, 0.005, None)
    t = spark.createDataFrame([(x * 1000.0,) for x in (1, 2, 4, 10)], "total_ms double").withColumns({c: F.lit(None).cast("double") for c in ("prompt_tokens", "completion_tokens", "total_tokens", "estimated_cost_usd")})
    e = reports.efficiency(t).first()
    assert (e.p50_latency_seconds, e.p95_latency_seconds, e.total_tokens) == (3.0, 9.1, None) and math.isclose(e.mean_latency_seconds, 4.25)


def test_rewrite(spark):
    q = spark.createDataFrame([(1, "and then?", "user: the kite"), (2, "what", "")], "query_id int, query string, history string")
    r = {x.query_id: x for x in answering.rewrite(q, answering.LastQuestion()).collect()}
    assert (r[1].standalone_query, r[2].standalone_query, r[1].rewrite_failed) == ("the kite and then?", "what", False)

    class Down:
        name = model = "down"

        def complete(self, prompts):
            raise OSError

    r = {x.query_id: x for x in answering.rewrite(q, Down()).collect()}
    assert (r[1].standalone_query, r[1].rewrite_failed, r[2].rewrite_failed) == ("and then?", True, False)


def test_collections(spark):
    df = spark.createDataFrame([("a-b_c!" + "9" * 50,), ("--",)], "s string")
    assert [r.x for r in df.select(chunking.collection_name(F.col("s")).alias("x")).collect()] == ["evidence_abc" + "9" * 37, "evidence_session"]
    c = spark.createDataFrame([("h1", "a"), ("h2", "b")], "document_hash string, collection string")
    assert chunking.without_collection(c, "a").count() == 1 and chunking.indexed(spark.createDataFrame([("h1",), ("h9",)], "document_hash string"), c).count() == 1
    up = chunking.upsert(spark.createDataFrame([("k", 1), ("m", 1)], "chunk_id string, v int"), spark.createDataFrame([("k", 2, 1), ("k", 3, 2)], "chunk_id string, v int, seq int"))
    assert {r.chunk_id: r.v for r in up.collect()} == {"k": 3, "m": 1}
