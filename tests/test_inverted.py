import random

import pytest
from pyspark.sql import functions as F

from assayer.functions import text
from assayer.operators import inverted, retrieval, storage

WORDS = "kite permit red blue sales review days opening hours fee Review1 the of permitted".split()


def made(spark, n, seed=0):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 14)))) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None), (n + 1, ""), (n + 2, "the of"), (n + 3, "kite " * 3000)], "chunk_id int, text string").repartition(5)


ASKED = ["kite permit", "kite kite fee", "the", "", None, "unknown words", "review", "ermit rev", "revie", "kit", "d permit", "sales days opening", "kite kite", "ite kite kit", "1", "review1 red permi"]


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(list(enumerate(ASKED)), "query_id int, query string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("cell", [4, 256])
def test_same_rows_as_a_scan(spark, asked, tmp_path, cell):
    chunks = made(spark, 150)
    index = inverted.build(chunks, str(tmp_path / "index"), cell)
    assert rows(inverted.search(index, asked, 5)) == rows(retrieval.lexical_topk(asked, chunks, 5))
    assert rows(index.chunks().select("chunk_id", "length")) == rows(retrieval.lengths(chunks))


def test_cells_that_cannot_reach_the_best_are_left_out(spark, tmp_path):
    strong = [(i, "kite permit " * 3) for i in range(64)]
    weak = [(i, "fee " * 20 + ("kite" if i % 2 else "red") + " days" * 20) for i in range(64, 1024)]
    chunks = spark.createDataFrame(strong + weak, "chunk_id int, text string").coalesce(1)
    index = inverted.build(chunks, str(tmp_path / "index"), 16)
    q = spark.createDataFrame([(1, "kite permit")], "query_id int, query string")
    with storage.scratch(spark):
        s = inverted._Search(index, q, 10, 1.5, 0.75)
        first = storage.stored(s.first(), "first")
        assert s.cells.count() == 64 and first.count() == 4 and s.rest(first, s.scored(first)).count() == 0
    assert rows(inverted.search(index, q, 10)) == rows(retrieval.lexical_topk(q, chunks, 10))


def test_only_buckets_of_the_terms_are_read(spark, tmp_path):
    index = inverted.build(made(spark, 60), str(tmp_path / "index"))
    terms = spark.createDataFrame([("kite",), ("fee",)], "term string")
    found = index.of(terms)
    assert "PartitionFilters: [bucket" in found._jdf.queryExecution().executedPlan().toString()
    assert {r.bucket for r in found.select("bucket").distinct().collect()} == {r[0] for r in terms.select(inverted.bucket_of(F.col("term"))).collect()}


def test_coverage_and_phrases_as_of_the_texts(spark, asked, tmp_path):
    chunks = made(spark, 80, 1)
    index = inverted.build(chunks, str(tmp_path / "index"), 8)
    pairs = asked.select("query_id").crossJoin(chunks.select("chunk_id"))
    want = pairs.join(asked, "query_id").join(chunks, "chunk_id").select("query_id", "chunk_id", text.coverage(F.col("query"), F.col("text")), text.phrase_bonus(F.col("query"), F.col("text")))
    got = rows(inverted.matches(index, pairs, asked))
    assert got == rows(want) and len({r[3] for r in got}) == 2


def test_empty_index(spark, asked, tmp_path):
    none = spark.createDataFrame([], "chunk_id int, text string")
    index = inverted.build(none, str(tmp_path / "none"))
    assert inverted.search(index, asked, 5).count() == 0
