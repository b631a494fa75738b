import random

import pytest
from pyspark.sql import functions as F

from assayer.operators import answering, grouped, retrieval

WORDS = "kite permit red blue sales review days opening hours fee".split()


def made(spark, n, questions=6, hot=0.9, seed=0):
    """Chunks (most of them in one collection, ids repeated over collections), and questions in every collection."""
    rng = random.Random(seed)
    vec = lambda: [round(rng.uniform(-1, 1), 3) for _ in range(4)]
    line = lambda k: " ".join(rng.choices(WORDS, k=k))
    chunks = [("hot" if i < hot * n else f"c{i % 3}", i % (n // 2), line(rng.randint(0, 12)), vec() if i % 7 else None) for i in range(n)]
    chunks += [(None, 0, "kite permit", vec()), ("unasked", 1, "kite permit", vec())]
    seen, rows = set(), []
    for c in chunks:
        if c[:2] not in seen:
            seen.add(c[:2])
            rows.append(c)
    asked = [(c, q, line(rng.randint(0, 5)), vec()) for c in ("hot", "c0", "c1", "c2", "empty", None) for q in range(questions)]
    return spark.createDataFrame(rows, "collection string, chunk_id int, text string, vec array<double>"), spark.createDataFrame(asked, "collection string, query_id int, query string, vec array<double>")


@pytest.mark.parametrize("mode", retrieval.MODES)
def test_each_collection_as_if_alone(spark, monkeypatch, mode):
    chunks, asked = made(spark, 120)
    monkeypatch.setattr(grouped, "PART_CHUNKS", 16)
    monkeypatch.setattr(grouped, "BLOCK_QUERIES", 2)
    columns = ["query_id", "chunk_id", "similarity", "rank"]
    got = retrieval.retrieve(asked, chunks, 4, mode)
    found = {}
    for r in got.collect():
        found.setdefault(r.collection, set()).add(tuple(r[c] for c in columns))
    want = {}
    for c in ("hot", "c0"):
        own = lambda df: df.filter(F.col("collection") == c).drop("collection")  # noqa: B023, E731
        want[c] = {tuple(r) for r in retrieval.retrieve(own(asked), own(chunks), 4, mode).select(columns).collect()}
    assert set(found) == {"hot", "c0", "c1", "c2"}
    assert {c: found[c] for c in want} == want


def test_large_collections_are_dealt_into_parts(spark, monkeypatch):
    chunks, asked = made(spark, 2000, questions=30)
    monkeypatch.setattr(grouped, "PART_CHUNKS", 64)
    monkeypatch.setattr(grouped, "BLOCK_QUERIES", 10)
    q, c = grouped.dealt(asked, chunks)
    cell = ["collection", "part", "block"]
    sizes = c.groupBy(*cell).count().toPandas()
    # (Ids of the hot collection are fewer than its rows, as repeated ones were left out.)
    assert len(sizes[sizes.collection == "hot"]) > 30 and sizes["count"].max() < 3 * 64
    assert q.groupBy(*cell).count().agg(F.max("count")).first()[0] < 3 * 10
    meetings = c.join(q, cell).groupBy("collection").count().collect()
    every = {r.collection: r.n for r in chunks.join(asked, "collection").groupBy("collection").agg(F.count("*").alias("n")).collect()}
    assert {r.collection: r["count"] for r in meetings} == every


def test_chunks_of_another_collection_are_never_found(spark):
    chunks = spark.createDataFrame([("x", "c1", "red kite", [0.0, 1.0]), ("y", "c2", "red kite permit", [1.0, 1.0])], "collection string, chunk_id string, text string, vec array<double>")
    asked = spark.createDataFrame([("x", 1, "kite permit", [1.0, 1.0])], "collection string, query_id int, query string, vec array<double>")
    for mode in retrieval.MODES:
        assert [(r.collection, r.chunk_id) for r in retrieval.retrieve(asked, chunks, 5, mode).collect()] == [("x", "c1")]


def test_turns_are_answered_from_their_collection(spark):
    rows = [(c, "d1_p1_c1", f"{c}.txt", 1, f"The kite permit of {c} costs {n} coins.") for n, c in enumerate(("a", "b"), 4)]
    chunks = spark.createDataFrame(rows, "collection string, chunk_id string, source_doc string, page_number int, text string")
    asked = spark.createDataFrame([("a", 1, "kite permit"), ("b", 2, "kite permit"), ("none", 3, "kite permit")], "collection string, query_id int, query string")
    got = {r.query_id: r for r in answering.turn(asked, chunks, answering.Extractive(), "lexical", 0.3, k=1).collect()}
    assert [x.source_doc for i in (1, 2) for x in got[i].retrieved] == ["a.txt", "b.txt"]
    assert "4 coins" in got[1].answer and "5 coins" in got[2].answer and got[3].refusal_reason == "no_documents"


def test_an_embedder_sees_each_text_once(spark):
    from assayer.operators import embedding

    seen = spark.sparkContext.accumulator(0)

    def model(texts):
        seen.add(len(texts))
        return embedding.hashed(texts)

    chunks, asked = made(spark, 60)
    alone = lambda df: df.filter("collection = 'hot'").drop("collection", "vec")
    c, q = alone(chunks), alone(asked)
    sizes = c.count() + q.count()
    assert retrieval.hybrid_topk(embedding.embed(q, "query", model), embedding.embed(c, "text", model), 3).count() == 3 * q.count()
    assert seen.value == sizes


def test_refused_files_take_no_place_and_sessions_are_bounded(spark):
    from dataclasses import replace

    from assayer.operators import chunking
    from assayer.sources.config import Config

    limits = replace(Config(), max_files=9, max_session_chunks=3)
    long = b"Word one. " * 300  # two chunks
    files = [(1, "a.exe", b"same"), (2, "z.txt", b"same"), (3, "b.txt", b"same"), (4, "long.txt", long), (5, "long2.txt", long + b"x"), (6, "last.txt", b"Small.")]
    df = spark.createDataFrame(files, "seq int, filename string, content binary")
    chunks, done = chunking.ingest(df, limits)
    assert {r.source_doc: (r.error_code, r.chunks) for r in done.collect()} == {
        "a.exe": ("unsupported_type", 0), "z.txt": (None, 1), "b.txt": ("duplicate", 0), "long.txt": (None, 2), "long2.txt": ("session_limit", 0), "last.txt": ("session_limit", 0),
    }
    assert sorted(r.source_doc for r in chunks.collect()) == ["long.txt", "long.txt", "z.txt"]
    more = chunking.ingest(df.filter("seq = 6"), replace(limits, max_session_chunks=4), known=chunks)[1]
    assert more.first().error_code is None
    assert chunking.ingest(df.filter("seq = 6"), limits, known=chunks)[1].first().error_code == "session_limit"
