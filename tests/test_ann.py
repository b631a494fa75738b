import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import ann, retrieval, storage
from assayer.plans import registry


def recall(exact, got):
    want = {(r.query_id, r.chunk_id) for r in exact.collect()}
    return len(want & {(r.query_id, r.chunk_id) for r in got.collect()}) / len(want)


@pytest.fixture(scope="module")
def grouped_vectors(spark):
    rng = np.random.default_rng(0)
    heart = rng.normal(size=(30, 16))
    rows = [(i, (heart[i % 30] + 0.3 * rng.normal(size=16)).tolist()) for i in range(3000)]
    return spark.createDataFrame([*rows, (9000, None), (9001, [0.0] * 16)], "chunk_id int, vec array<double>").repartition(4)


def test_recall_over_the_embeddings(spark):
    for sf in ("sf0.01", "sf0.1"):
        d = f"/root/testdata/{sf}"
        exact = retrieval.dense_topk(registry.vector_queries(spark, d), registry.vector_chunks(spark, d), 10)
        assert recall(exact, registry.dense_index_topk(spark, d)) >= 0.9


def test_only_lists_that_are_looked_at_are_read(spark, grouped_vectors, tmp_path):
    index = ann.build(grouped_vectors, str(tmp_path / "index"), lists=32)
    meta = index.meta()
    assert meta.probes <= 8 and meta.share < 0.3 and index.vectors().count() == 3001
    one = grouped_vectors.filter("chunk_id = 5").select(F.col("chunk_id").alias("query_id"), "vec")
    got = ann.search(index, one, 5)
    exact = retrieval.dense_topk(one, grouped_vectors, 5)
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [tuple(r) for r in exact.orderBy("rank").collect()]
    lists = np.argsort(-(np.array(meta.centres) @ np.array(one.first().vec)))[: meta.probes].tolist()
    read = index.vectors().filter(F.col("list").isin(lists))
    assert "PartitionFilters: [isnotnull(list" in (plan := read._jdf.queryExecution().executedPlan().toString()) or "PartitionFilters: [list" in plan
    assert read.count() < 0.5 * index.vectors().count()


def test_all_lists_are_exact(spark, grouped_vectors, tmp_path, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    index = ann.build(grouped_vectors, str(tmp_path / "index"), lists=8)
    asked = grouped_vectors.filter("chunk_id % 150 = 0 or chunk_id >= 9000").select(F.col("chunk_id").alias("query_id"), "vec")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(ann.search(index, asked, 4, probes=8)) == rows(retrieval.dense_topk(asked, grouped_vectors, 4))


def test_one_list_of_copies_is_split_and_ties_go_by_id(spark, tmp_path):
    rng = random.Random(0)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 else [rng.random() for _ in range(3)]) for i in range(2000)]
    c = spark.createDataFrame(rows, "chunk_id int, vec array<double>").repartition(8)
    q = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "query_id int, vec array<double>")
    with storage.scratch(spark):
        found = ann.search(ann.build(c, storage.place(spark, "index"), lists=4), q, 5)
        assert [r.chunk_id for r in found.orderBy("rank").collect()] == [1, 2, 4, 5, 7]


def test_empty_index_and_no_questions(spark, tmp_path):
    none = spark.createDataFrame([], "chunk_id int, vec array<double>")
    asked = spark.createDataFrame([(7, [1.0, 1.0])], "query_id int, vec array<double>")
    assert ann.search(ann.build(none, str(tmp_path / "none")), asked, 3).count() == 0
    index = ann.build(spark.createDataFrame([(1, [1.0, 0.0])], none.schema), str(tmp_path / "one"))
    assert ann.search(index, none.withColumnRenamed("chunk_id", "query_id"), 3).count() == 0
    assert [tuple(r) for r in ann.search(index, asked, 3).collect()] == [(7, 1, 0.7071, 1)]
