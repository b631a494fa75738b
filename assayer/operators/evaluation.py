"""Per-case metrics of traces against labelled cases, all cases at once.

gold: case_id, query, expected_answerable, expected_answer, expected_chunk_ids, expected_source_docs,
expected_standalone_query, tags. traces: case_id, answer, generated_answer, standalone_query, retrieved (array of structs
with chunk_id and source_doc), is_refusal, confidence, confidence_score, total_ms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.citations import cited_ids
from ..functions.numeric import clamp, f1, py_round, ratio
from ..functions.text import all_tokens, strip

# What is dropped before answers are compared, and what labels stand for.
GROUP = r"(?i)\[(?:S|Source)\s*\d+(?:\s*(?:,|;|&|and)\s*(?:S|Source)\s*\d+)*\]"
BULLETS = r"(?m)^\s*(?:[-*+]\s+|\d+[.)]\s+)"
LABEL_SCORES = {"high": 0.85, "medium": 0.65, "low": 0.25}
MISMATCH, SURE, UNSURE = 0.8, 0.8, 0.4
JUDGE_RULES = "Say how far the evidence alone bears out the answer. Reply with JSON: score (0 to 1), unsupported_claims, reasoning."


def clean_answer(c: Column) -> Column:
    """Without citations and bullets, lower-cased, blanks squeezed."""
    return F.regexp_replace(F.lower(strip(F.regexp_replace(F.regexp_replace(c, GROUP, " "), BULLETS, ""))), r"(?U)\s+", " ")


def token_f1(predicted: Column, expected: Column) -> Column:
    """F1 of token multisets; 1 if neither has any, 0 if one hasn't."""
    def of(s: Column) -> Column:
        count = lambda a, t: F.size(F.filter(a, lambda x: x == t))
        both = F.aggregate(F.array_intersect(s["p"], s["g"]), F.lit(0), lambda n, t: n + F.least(count(s["p"], t), count(s["g"], t)))
        n, m = F.size(s["p"]), F.size(s["g"])
        score = F.transform(F.array(both), lambda b: py_round(f1(ratio(b, n), ratio(b, m)), 4))[0]
        return F.when((n == 0) & (m == 0), F.lit(1.0)).when((n == 0) | (m == 0), F.lit(0.0)).otherwise(score)

    tokens = F.struct(all_tokens(clean_answer(predicted)).alias("p"), all_tokens(clean_answer(expected)).alias("g"))
    return F.when(predicted.isNotNull() & expected.isNotNull(), F.transform(F.array(tokens), of)[0])


def exact_match(predicted: Column, expected: Column) -> Column:
    return (clean_answer(predicted) == clean_answer(expected)).cast("double")


def hits(gold: Column, found: Column) -> Column:
    """recall and reciprocal_rank of an ordered array against the wanted one; null where nothing is wanted."""
    wanted = F.array_distinct(gold)
    first = F.array_position(F.transform(found, lambda x: F.array_contains(wanted, x)), True)
    labelled = F.coalesce(F.size(wanted), F.lit(0)) > 0
    return F.struct(
        F.when(labelled, py_round(F.size(F.array_intersect(wanted, found)) / F.size(wanted), 4)).alias("recall"),
        F.when(labelled, F.when(first > 0, py_round(1 / first, 4)).otherwise(F.lit(0.0))).alias("reciprocal_rank"),
    )


def wanted(chunk_ids: Column, source_docs: Column) -> Column:
    """Chunk labels if there are any, else documents without regard to case."""
    return F.when(F.size(F.coalesce(chunk_ids, F.array())) > 0, chunk_ids).otherwise(F.transform(source_docs, lambda x: F.lower(x)))


def identities(chunk_ids: Column, retrieved: Column) -> Column:
    """Of the chunks shown, what is compared with wanted()."""
    return F.when(F.size(F.coalesce(chunk_ids, F.array())) > 0, F.transform(retrieved, lambda r: r["chunk_id"])).otherwise(F.transform(retrieved, lambda r: F.lower(r["source_doc"])))


def citation_scores(answer: Column, gold: Column, shown: Column) -> Column:
    """precision, recall, f1 of the sources cited; null where nothing is wanted, 0 without citations."""
    places = F.filter(F.transform(F.filter(cited_ids(answer), lambda i: i.rlike(r"\A\d{1,9}\z")), lambda i: i.cast("int")), lambda i: (i >= 1) & (i <= F.size(shown)))
    said = F.array_distinct(F.transform(places, lambda i: F.element_at(shown, i)))
    target = F.array_distinct(gold)
    both = F.size(F.array_intersect(said, target))
    p, r = ratio(both, F.size(said)), ratio(both, F.size(target))
    labelled = F.coalesce(F.size(target), F.lit(0)) > 0
    return F.struct(*[F.when(labelled, py_round(x, 4)).alias(n) for n, x in (("precision", p), ("recall", r), ("f1", f1(p, r)))])


def stated_confidence(score: Column, label: Column) -> Column:
    """The explicit score from 0 to 1, else that of the label."""
    by_label = F.coalesce(*[F.when(F.lower(label).startswith(k), F.lit(v)) for k, v in LABEL_SCORES.items()])
    return F.when(score.isNotNull(), clamp(score)).otherwise(by_label)


def failures(expected: Column, answered: Column, correct: Column, recall: Column, citation_recall: Column, rewrite_f1: Column, answer_f1: Column, confidence: Column, latency_s: Column, slo_s: float | None = None) -> Column:
    """Labels of what went wrong, in a fixed order."""
    slow = F.lit(False) if slo_s is None else latency_s > slo_s
    rules = [
        ("WRONG_REFUSAL", expected & ~answered), ("WRONG_ANSWERABILITY", ~expected & answered), ("RETRIEVAL_MISS", expected & (recall == 0)),
        ("QUERY_REWRITE_DRIFT", rewrite_f1 < MISMATCH), ("ANSWER_MISMATCH", answered & (answer_f1 < MISMATCH)),
        ("CITATION_MISS", expected & answered & (citation_recall == 0)), ("CITATION_OFF_GOLD", (citation_recall > 0) & (citation_recall < 1)),
        ("OVERCONFIDENT_ERROR", ~correct & (confidence >= SURE)), ("UNDERCONFIDENT_CORRECT", answered & correct & (confidence <= UNSURE)), ("LATENCY_REGRESSION", slow),
    ]
    return F.array_compact(F.array(*[F.when(rule, F.lit(label)) for label, rule in rules]))


def evaluate(gold: DataFrame, traces: DataFrame, answer_f1_threshold: float = 0.8, latency_slo_seconds: float | None = None) -> DataFrame:
    """One row for each case: the labels, all metrics, failures and tags. Cases and traces meet by case_id; a case without a
    trace, or a trace without its case, fails the run."""
    g = gold.select("case_id", "query", "expected_answerable", "expected_answer", "expected_chunk_ids", "expected_source_docs", F.col("expected_standalone_query").alias("_standalone"), "tags")
    both = g.withColumn("_case", F.lit(True)).join(traces.drop("query").withColumn("_trace", F.lit(True)), "case_id", "full_outer")
    alone = F.when(F.col("_case").isNull() | F.col("_trace").isNull(), F.raise_error(F.concat(F.lit("no case or no trace: "), F.col("case_id").cast("string"))).cast("boolean"))
    c = both.withColumn("is_refusal", F.coalesce(alone, F.col("is_refusal")))
    goal, shown = wanted(F.col("expected_chunk_ids"), F.col("expected_source_docs")), identities(F.col("expected_chunk_ids"), F.col("retrieved"))
    has_answer = F.coalesce(F.col("expected_answer"), F.lit("")) != ""
    answered = ~F.col("is_refusal")
    c = c.withColumns({
        "predicted_answerable": answered, "_hit": hits(goal, shown), "_cite": citation_scores(F.coalesce("generated_answer", "answer"), goal, shown),
        "rewrite_token_f1": F.when(F.coalesce("_standalone", F.lit("")) != "", token_f1(F.col("standalone_query"), F.col("_standalone"))),
        "confidence_score": stated_confidence(F.col("confidence_score"), F.col("confidence")), "_s": F.col("total_ms") / 1000,
    })
    compared = F.col("expected_answerable") & has_answer
    c = c.withColumns({n: F.when(compared, F.when(answered, of(F.col("answer"), F.col("expected_answer"))).otherwise(F.lit(0.0))) for n, of in (("answer_exact_match", exact_match), ("answer_token_f1", token_f1))})
    right = (
        F.when(~F.col("expected_answerable"), ~answered).when(~answered, F.lit(False)).when(has_answer, F.col("answer_token_f1") >= answer_f1_threshold)
        .when(F.col("_hit.recall").isNotNull(), F.col("_hit.recall") > 0).otherwise(F.lit(True))
    )
    c = c.withColumn("correct", right)
    wrong = failures(F.col("expected_answerable"), answered, F.col("correct"), F.col("_hit.recall"), F.col("_cite.recall"), F.col("rewrite_token_f1"), F.col("answer_token_f1"), F.col("confidence_score"), F.col("_s"), latency_slo_seconds)
    return c.select(
        "case_id", "query", "expected_answerable", "predicted_answerable", "correct", "answer_exact_match", "answer_token_f1", F.col("_hit.recall").alias("retrieval_recall"),
        F.col("_hit.reciprocal_rank").alias("reciprocal_rank"), F.col("_cite.precision").alias("citation_precision"), F.col("_cite.recall").alias("citation_recall"), F.col("_cite.f1").alias("citation_f1"),
        "rewrite_token_f1", "confidence_score", py_round(F.col("_s"), 4).alias("latency_seconds"), wrong.alias("failures"), "tags",
    )


def judged(traces: DataFrame, provider) -> DataFrame:
    """Adds faithfulness (0 to 1), unsupported_claims, judge_reason and judge_failed, as a judging model says. Refusals aren't
    judged, unless a rejected draft is there: they and failures have null. Answers without evidence are judged."""
    from ..sources.providers import ProviderError, judge
    from .answering import _asked

    draft = F.when(~F.col("is_refusal"), F.coalesce("generated_answer", "answer")).otherwise(F.col("generated_answer"))
    evidence = F.array_join(F.transform("retrieved", lambda r, i: F.concat(F.lit("[S"), (i + 1).cast("string"), F.lit("] "), r["text"])), "\n\n")
    rows = traces.withColumn("_prompt", F.concat(F.lit("QUESTION:\n"), F.coalesce("standalone_query", "query"), F.lit("\n\nEVIDENCE:\n"), evidence, F.lit("\n\nANSWER:\n"), draft))

    @F.udf("score double, claims array<string>, reason string")
    def read(text):
        try:
            return None if text is None else judge(text)
        except ProviderError:
            return None

    asked = _asked(rows.filter("_prompt is not null"), provider, JUDGE_RULES, "_prompt", "_reply")
    asked = asked.withColumn("_j", read(F.col("_reply.text"))).drop("_reply")
    rest = rows.filter("_prompt is null").withColumn("_j", F.lit(None).cast(asked.schema["_j"].dataType))
    out = asked.withColumn("judge_failed", F.col("_j").isNull()).unionByName(rest.withColumn("judge_failed", F.lit(False)))
    return out.withColumns({"faithfulness": F.col("_j.score"), "unsupported_claims": F.col("_j.claims"), "judge_reason": F.col("_j.reason")}).drop("_prompt", "_j")
