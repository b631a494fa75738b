"""What keeps queries within their bounds as tables grow: how often texts are read, and what is shuffled."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assayer.operators import chunking, embedding, grouped, inverted, lab, retrieval, storage, tables
from assayer.plans import registry
from assayer.sources import uploads

WORDS = "kite permit red blue sales review days opening hours fee Kelvin É 42 ſ".split()


def text(rnd, n):
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", ".", "\n\n"]) for _ in range(n))


def pages(spark, n=12, seed=1):
    rnd = random.Random(seed)
    rows = [(f"{i:064x}"[::-1], f"d{i}.txt", 1, text(rnd, 150) if i % 5 else None) for i in range(n)]
    return spark.createDataFrame(rows, "document_hash string, source_doc string, page_number int, text string")


def test_a_grid_has_the_chunks_of_its_cells(spark):
    cells = [("a", 200, 30), ("b", 400, 0), ("c", 90, 80)]
    got = {tuple(r) for r in chunking.chunk_grid(pages(spark), cells).collect()}
    want = {(name, *r) for name, size, overlap in cells for r in map(tuple, chunking.chunk_pages(pages(spark), size, overlap).select("chunk_id", "source_doc", "text").collect())}
    assert got == want and len({r[0] for r in got}) == 3
    assert {r.collection: r.indexed_chunks for r in chunking.grid_counts(pages(spark), cells).collect()} == {c: sum(x[0] == c for x in want) for c, *_ in cells}


def test_the_chunking_grid_embeds_each_chunk_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def model(texts):
        seen.add(len(texts))
        return embedding.hashed(texts)

    p = pages(spark)
    gold = spark.createDataFrame([(1, "red kite", None, True, [], ["d1.txt"])], "case_id long, query string, expected_standalone_query string, expected_answerable boolean, expected_chunk_ids array<string>, expected_source_docs array<string>")
    rows = lab.chunking_ablation(gold, p, lambda df, c="text": embedding.embed(df, c, model), [200, 400], [30]).collect()
    assert len(rows) == 2 and seen.value == 1 + sum(r.indexed_chunks for r in rows)


def collections(spark, n=90):
    rnd = random.Random(4)
    chunks = [(f"c{i % 3}", i, text(rnd, 1 + i % 9), [rnd.uniform(-1, 1) for _ in range(3)]) for i in range(n)]
    asked = [(f"c{c}", q, text(rnd, 3), [rnd.uniform(-1, 1) for _ in range(3)]) for c in range(4) for q in range(5)]
    return spark.createDataFrame(asked, "collection string, query_id int, query string, vec array<double>"), spark.createDataFrame(chunks, "collection string, chunk_id int, text string, vec array<double>")


@pytest.mark.parametrize("mode", retrieval.MODES)
def test_chunks_are_scored_where_they_are_read_within_collections(spark, monkeypatch, mode):
    asked, chunks = collections(spark)
    with monkeypatch.context() as m:
        m.setattr(retrieval, "met", lambda *_: pytest.fail("parts of a collection are gathered"))
        got = {tuple(r) for r in retrieval.retrieve(asked, chunks, 4, mode).collect()}
    # More questions than are broadcast meet parts of their collection; rows are the same.
    monkeypatch.setattr(retrieval, "LEXICAL_BLOCK", 7)
    assert got == {tuple(r) for r in retrieval.retrieve(asked, chunks, 4, mode).collect()} and len(got) == 3 * 5 * 4


def test_a_task_holds_at_most_twice_what_its_questions_keep():
    rng = np.random.default_rng(3)
    best, scores = grouped.Best(40, 0.0), rng.random((200, 6000))
    for a in range(0, 6000, 50):
        best.add(scores[:, a : a + 50], pa.array(range(a, a + 50)))
        assert sum(len(x[0]) for x in best.held) <= 2 * 40 * 200
    got = {}
    for b in best.rows(["q", "c", "s"], pa.array(range(200))):
        for q, c in zip(b["q"].to_pylist(), b["c"].to_pylist(), strict=True):
            got.setdefault(q, set()).add(c)
    assert got == {q: set(np.argsort(-scores[q])[:40].tolist()) for q in range(200)}


def test_all_modes_read_the_chunks_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def model(texts):
        seen.add(len(texts))
        return embedding.hashed(texts)

    asked, chunks = (df.filter("collection = 'c1'").drop("collection", "vec") for df in collections(spark))
    vectors = embedding.embed(asked, "query"), embedding.embed(chunks, "text", model)
    got = {tuple(r) for r in retrieval.every_mode(*vectors, 5).collect()}
    assert seen.value == chunks.count()
    assert got == {tuple(r) for m in retrieval.MODES for r in retrieval.retrieve(*vectors, 5, m).collect()}


def plans(monkeypatch, module):
    """Plans of what a module stores, as they are made."""
    seen, keep = [], module.stored
    monkeypatch.setattr(module, "stored", lambda df, what, **kw: (seen.append((what, df._jdf.queryExecution().executedPlan().toString())), keep(df, what, **kw))[1])
    return seen


def test_an_index_is_searched_without_a_row_for_each_posting_and_question(spark, tmp_path, monkeypatch):
    rnd = random.Random(8)
    chunks = spark.createDataFrame([(i, text(rnd, i % 40)) for i in range(150)], "chunk_id long, text string")
    asked = spark.createDataFrame([(q, text(rnd, q)) for q in range(8)], "query_id long, query string")
    index = inverted.build(chunks, str(tmp_path / "index"), 8)
    seen = plans(monkeypatch, inverted)
    got = {tuple(r) for r in inverted.search(index, asked, 6).collect()}
    assert got == {tuple(r) for r in retrieval.lexical_topk(asked, chunks, 6).collect()} and len(got) == 48
    assert "Generate explode(x" not in "".join(p for _, p in seen)
    cells = spark.range(19).select(F.lit(7).cast("long").alias("query_id"), F.col("id").alias("cell"))
    with storage.scratch(spark):
        s = inverted._Search(index, asked, 2, 1.5, 0.75)
        assert s.scored(cells).count() <= 19 * (2 + 2)


def test_statistics_of_a_table_are_counted_where_rows_are(spark, tmp_path, monkeypatch):
    rnd = random.Random(9)
    rows = spark.createDataFrame([(f"c{i % 2}", i, text(rnd, 60)) for i in range(400)], "collection string, chunk_id long, text string").coalesce(2)
    table = tables.ChunkTable(spark, str(tmp_path / "t"), "collection string, chunk_id long, text string")
    counted = table._counted(rows, 1)
    # A row for a term of a collection and task, and not for each of 400 chunks.
    assert counted.count() <= 2 * 2 * (len(WORDS) + 1)
    monkeypatch.setattr(tables, "COUNTED", 3)
    table.upsert(rows)
    got = {(r.collection, r.term): (r.df, r.total_tf) for r in table.statistics().filter("term is not null").collect()}
    want = {(c, r.term): (r.df, r.total_tf) for c in ("c0", "c1") for r in retrieval.term_stats(rows.filter(F.col("collection") == c)).collect()}
    assert got == want
    (written,) = (p for p in (tmp_path / "t" / "data").iterdir())
    assert {p.name for p in written.iterdir()} >= {"rows", "keys", "statistics"} and table.count() == 400


def test_files_are_parsed_in_batches_bounded_by_bytes(spark, monkeypatch):
    files = spark.createDataFrame([(str(i), f"{i}.txt", b"word " * 40_000) for i in range(60)], "document_hash string, source_doc string, content binary").coalesce(1)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.unset(key)
    try:
        done = uploads.parse_documents(files)
        assert int(spark.conf.get(key)) <= storage.BATCH_BYTES
        assert {(r.source_doc, r.n) for r in done.select("source_doc", F.length("text").alias("n")).collect()} == {(f"{i}.txt", 199_999) for i in range(60)}
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("name", ["labelled_run", "answer_traces"])
def test_answers_read_stored_chunks(spark, tmp_path, monkeypatch, name):
    """Chunks are read several times in a turn: they are cut once."""
    spark.createDataFrame([(i, text(random.Random(i), 40)) for i in range(6)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "red kite permit")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = []

    def turn(asked, chunks, *a, **kw):
        seen.append(chunks._jdf.queryExecution().executedPlan().toString())
        raise InterruptedError

    monkeypatch.setattr(registry.answering, "turn", turn)
    with pytest.raises(InterruptedError):
        registry.QUERIES[name](spark, str(tmp_path))
    assert "FileScan parquet" in seen[0] and "MapInArrow" not in seen[0]
