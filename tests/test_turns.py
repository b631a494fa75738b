"""Whole turns, labelled runs, ingestion, judging and stored runs."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from assayer.operators import answering, chunking, evaluation, reports
from assayer.plans import registry
from assayer.sources import labels, regression_set
from assayer.sources.config import Config

DOCS = [("d1", "The red kite needs a permit. Permit review takes two days."), ("d2", "Blue kite sales are open to all.")]


class Logged:
    """Notes each call in a file, as workers are other processes; drafts need a repair."""

    name, model = "logged", "m"

    def __init__(self, path):
        self.path = path

    def counted(self, system, user):
        with open(self.path, "a") as f:
            f.write("repair\n" if "DRAFT:" in user else "draft\n")
        return ('{"can_answer": true, "items": [{"claim": "A kite needs a permit", "source_ids": ["S1"]}]}' if "DRAFT:" in user else "A kite needs a permit."), 10, 5


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(DOCS, "chunk_id string, text string").withColumns({"source_doc": F.concat("chunk_id", F.lit(".txt")), "page_number": F.lit(1)})


def test_the_provider_is_asked_once(spark, chunks, tmp_path):
    log = tmp_path / "log"
    q = spark.createDataFrame([(i, f"kite permit {i}") for i in range(10)], "query_id int, query string")
    traces = answering.turn(q, chunks, Logged(str(log)), "lexical", 0.2, rewriter=answering.LastQuestion(), prices=(1.0, 2.0))
    rows = traces.collect()
    reports.trace_view(traces).collect()
    assert sorted(log.read_text().split()) == ["draft"] * 10 + ["repair"] * 10
    r = rows[0]
    assert not r.is_refusal and r.citation_repair_used and (r.prompt_tokens, r.completion_tokens, r.total_tokens) == (20, 10, 30)
    assert r.estimated_cost_usd == pytest.approx(4e-5) and r.total_ms >= r.generation_ms > 0 and r.retrieval_ms > 0 and r.retrieval_mode == "lexical"
    assert r.metrics.citation_coverage == 1.0 and r.metrics.latency_seconds is not None and r.retrieved[0].lexical_score == r.retrieved[0].similarity
    assert reports.efficiency(traces).first().total_tokens == 300


def test_one_failing_prompt_costs_its_row_alone(spark, chunks):
    class Picky:
        name = model = "picky"

        def complete(self, prompts):
            if any("sales" in u.split("QUESTION:")[-1] for _, u in prompts):
                raise OSError
            return ["Kites need [S1] permits."] * len(prompts)

    q = spark.createDataFrame([(1, "kite permit"), (2, "kite sales")], "query_id int, query string").coalesce(1)
    got = {r.query_id: r.refusal_reason for r in answering.turn(q, chunks, Picky(), "lexical", 0.2).collect()}
    assert got == {1: None, 2: "provider_error"}


def test_history_is_rewritten_and_no_label_is_asked(spark):
    gold = regression_set.cases(spark).filter("case_id like 'talk-%' or case_id like 'fact-00%'")
    c, traces = registry.full_run(spark, "lexical", 0.2, gold)
    asked = {r.case_id: (r.query, r.standalone_query) for r in traces.collect()}
    assert len(asked) == gold.count()
    for r in gold.collect():
        assert asked[r.case_id][0] == r.query
        assert asked[r.case_id][1] == (f"Tell me about the {r.query and r.expected_source_docs[0][:-3]} {r.query}" if r.history else r.query)
    f1 = [r.rewrite_token_f1 for r in c.filter("rewrite_token_f1 is not null").collect()]
    assert f1 and max(f1) < 1.0


def test_cases_and_traces_must_match(spark, chunks):
    gold = regression_set.cases(spark).filter("case_id like 'fact-00%'")
    _, traces = registry.full_run(spark, "lexical", 0.2, gold)
    one = traces.limit(1)
    for cases, told in ((gold, one), (gold.limit(0), one)):
        with pytest.raises(Exception, match="no case or no trace"):
            evaluation.evaluate(cases, told).collect()


def test_ingestion(spark):
    small = replace(Config(), max_files=4)
    files = [("a.txt", b"One. Two."), ("b/a2.txt", b"One. Two."), ("c.exe", b"x"), ("e.txt", b"  ")]
    df = spark.createDataFrame(files, "filename string, content binary")
    chunks, done = chunking.ingest(df, small)
    assert {r.source_doc: r.error_code for r in done.collect()} == {"a.txt": None, "a2.txt": "duplicate", "c.exe": "unsupported_type", "e.txt": "no_text"}
    assert chunks.count() == 1 == chunking.total_chunks(done).first().total_chunks
    with pytest.raises(ValueError, match="at most 3"):
        chunking.ingest(df, replace(small, max_files=3))
    again = chunking.ingest(df, small, known=chunks)[1]
    assert {r.source_doc: r.error_code for r in again.collect()}["a.txt"] == "duplicate"
    corpus, told = regression_set.load(spark, Config())
    assert told.count() == 10 and corpus.count() == chunking.total_chunks(told).first().total_chunks > 10
    assert regression_set.load(spark, Config(), known=corpus)[0].count() == 0


def test_judge(spark, chunks):
    class Judge:
        name = model = "judge"

        def complete(self, prompts):
            return ['{"score": 0.5, "unsupported_claims": ["x"], "reasoning": "r"}' if "permit" in u.split("ANSWER:")[-1] else "no" for _, u in prompts]

    q = spark.createDataFrame([(1, "kite permit"), (2, "sales"), (3, "zzz")], "query_id int, query string")
    traces = answering.turn(q, chunks, answering.Extractive(), "lexical", 0.3, k=1)
    told = evaluation.judged(traces, Judge())
    got = {r.query_id: (r.faithfulness, r.judge_failed) for r in told.collect()}
    assert got == {1: (0.5, False), 2: (None, True), 3: (None, False)}
    none = traces.filter("query_id = 1").withColumn("retrieved", F.filter("retrieved", lambda r: F.lit(False)))
    assert evaluation.judged(none, Judge()).first().faithfulness == 0.5

    class Echo(Judge):
        def complete(self, prompts):
            return ['{"score": 1, "unsupported_claims": [], "reasoning": "question was there"}' if u.startswith("QUESTION:\nkite permit\n") else "no" for _, u in prompts]

    assert evaluation.judged(none, Echo()).first().judge_reason == "question was there"


def test_runs_are_read_back(spark, tmp_path):
    c, traces = registry.full_run(spark, "lexical", 0.2, regression_set.cases(spark).filter("case_id like 'fact-00%'"))
    run = reports.benchmark_run(c, "first", traces)
    assert len(run.first().metadata.telemetry) == c.count()
    labels.write_jsonl(run, f"{tmp_path}/run")
    back = labels.read_runs(spark, f"{tmp_path}/run").first()
    metadata = json.loads(back.metadata)
    assert len(metadata["telemetry"]) == c.count() and metadata["efficiency"]
    labels.write_jsonl(labels.read_runs(spark, f"{tmp_path}/run"), f"{tmp_path}/again")
    assert json.loads(labels.read_runs(spark, f"{tmp_path}/again").first().metadata) == metadata
    assert len(back.cases) == c.count() and back.variant == "first" and back.metrics["cases"] == c.count()
    counts = [r["count"] for r in reports.failure_counts(c).collect()]
    assert counts == sorted(counts, reverse=True) and sum(back.failure_counts.values()) == sum(counts)
