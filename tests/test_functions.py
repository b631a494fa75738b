import random

import pytest
from pyspark.sql import functions as F

from assayer.functions import citations, text
from assayer.functions.numeric import f1, py_round, ratio


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_py_round(spark):
    rnd = random.Random(1)
    values = [0.01875, 0.00005, 0.5, 2.5, -0.00001, 1234.56785, 0.0625] + [rnd.randrange(200) / rnd.randrange(1, 200) for _ in range(500)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(py_round(F.col("v"), 4).alias("a"), py_round(F.col("v"), 2).alias("b")).collect()
    assert sum(r.a != round(v, 4) for r, v in zip(got, values, strict=True)) <= 1 and all(r.b == round(v, 2) for r, v in zip(got, values, strict=True))
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "v double").select(py_round(F.col("v"), 4).alias("a")).collect()
    assert odd[0].a is None and odd[1].a != odd[1].a and odd[2].a == float("inf")


def test_ratio(spark):
    r = spark.range(1).select(ratio(F.lit(1), F.lit(0)).alias("a"), f1(F.lit(0.0), F.lit(0.0)).alias("b"), f1(F.lit(1.0), F.lit(0.5)).alias("c")).first()
    assert (r.a, r.b) == (0.0, 0.0) and abs(r.c - 2 / 3) < 1e-12


def test_tokens(spark):
    t = F.col("t")
    r = spark.createDataFrame([("The Café, the x9 of A kite-kite",)], "t string").select(text.tokenize(t).alias("a"), text.all_tokens(t).alias("b"), text.token_set(t).alias("c")).first()
    assert r.a == ["caf", "x9", "kite", "kite"]
    assert r.b == ["the", "caf", "the", "x9", "of", "a", "kite", "kite"]
    assert r.c == ["the", "caf", "x9", "of", "kite"]
    assert one(spark, F.size(text.tokenize(F.col("t"))), t=None) == 0


@pytest.mark.parametrize(("raw", "want"), [
    ("a  b\t c \r\n\r\n\r\n\r\nd", "a b c\n\nd"), ("x\x00y", "xy"), ("ﬁne １", "fine 1"), ("a\x0bb\u2028c", "a\nb\nc"), ("  \n \n", ""), ("é  è \n ü", "é è\nü"),
])
def test_normalize(spark, raw, want):
    from assayer.sources.uploads import normalized

    assert one(spark, text.normalize_text(F.col("t")), t=raw) == want
    assert normalized(raw) == want


def test_units(spark):
    assert one(spark, text.units(F.col("t")), t="One. Two!  Three?\n\nFour\nfive. \n\n ") == ["One.", "Two!", "Three?", "Four\nfive."]


def test_citations(spark):
    t = "As [S1], [source 2 and S3] and 【S4】; not [x], S5 or [S6 maybe]."
    assert one(spark, citations.cited_ids(F.col("t")), t=t) == ["1", "2", "3", "4"]
    assert one(spark, citations.canonical(F.col("t")), t=t) == "As [S1], [S2] [S3] and [S4]; not [x], S5 or [S6 maybe]."
    assert one(spark, citations.citation_validity(F.col("t"), F.lit(1)), t="One [S1] and nine [S9]") == 0.5
    assert one(spark, citations.citation_validity(F.col("t"), F.lit(1)), t="none") is None


@pytest.mark.parametrize(("answer", "want"), [
    ("The kite needs a permit. Permit review takes days [S1].", 0.5), ("# Head\n**Bold words only here**\n- A bullet claim. With two sentences [S2]", 1.0), ("", 1.0), ("Yes [S1]", 0.0), ("no claim", 0.0),
])
def test_claim_coverage(spark, answer, want):
    assert one(spark, citations.claim_coverage(F.col("t")), t=answer) == want


def test_structured_answer():
    p = citations.parse_answer
    good = '{"can_answer": true, "items": [{"claim": "* A  claim.", "source_ids": ["S1", "source 2", "S1"]}]}'
    assert p(good, 2) == (True, "- A claim [S1] [S2].", "", None)
    assert p(f"```json\n{good}\n```", 2)[1] == "- A claim [S1] [S2]."
    assert p(f"well: {good} ok", 2)[0] is True
    assert p('{"can_answer": false, "reason": "no  proof"}', 0) == (False, "", "no proof", None)
    for bad in (good.replace("source 2", "S3"), '{"can_answer": "true"}', '{"can_answer": true, "items": []}', "[1]", "none", None, '{"can_answer": true, "items": [{"claim": 3, "source_ids": ["S1"]}]}', '{"can_answer": true, "items": [{"claim": "x", "source_ids": []}]}'):
        assert p(bad, 2)[0] is None and p(bad, 2)[3]


def test_structured_answer_column(spark):
    df = spark.createDataFrame([('{"can_answer": true, "items": [{"claim": "A", "source_ids": ["S1"]}]}', 1), ("x", 1), (None, 0)], "t string, n int")
    got = df.select(citations.structured_answer("t", "n").alias("p")).select("p.*").collect()
    assert [r.can_answer for r in got] == [True, None, None] and got[0].answer == "- A [S1]"


def test_coverage_and_phrase(spark):
    q, t = F.col("q"), F.col("t")
    assert one(spark, text.coverage(q, t), q="kite permit permit", t="the kite") == 0.5
    assert one(spark, text.coverage(q, t), q="what is the", t="the kite") == 0.0
    assert one(spark, text.phrase_bonus(q, t), q="red kite", t="a Red, kite!") == 1.0
    assert one(spark, text.phrase_bonus(q, t), q="red", t="red") == 0.0
