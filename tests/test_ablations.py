import random

import pytest

from assayer.operators import lab
from assayer.plans import registry


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Twelve documents of about 4,000 characters, one twice; two of three items stand in one or two of them."""
    rnd, path = random.Random(3), tmp_path_factory.mktemp("tables")
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(6)]
    docs = []
    for d in range(12):
        parts = [" ".join(word() for _ in range(10)) + "." for _ in range(60)]
        if d % 3:
            parts[30] = items[d % 4][1].upper() if d % 2 else items[d % 4][1]
        docs.append((d, " ".join(parts)))
    docs.append((12, docs[0][1]))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), items, docs


def test_cases_of_documents(spark, tables):
    path, items, docs = tables
    want = {i: sorted(f"doc-{d}.txt" for d, t in docs[:12] if x in t.lower()) for i, x in items}
    got = {r.case_id: r for r in registry.document_cases(spark, path).collect()}
    assert {i: r.expected_source_docs for i, r in got.items()} == want and {i: r.expected_answerable for i, r in got.items()} == {i: bool(x) for i, x in want.items()}
    assert sum(map(bool, want.values())) == 4


def test_chunking_ablation_runs_the_grid_over_documents(spark, tables):
    path, items, docs = tables
    rows = registry.QUERIES["chunking_ablation"](spark, path).collect()
    assert {(r.chunk_size, r.overlap) for r in rows} == {(s, o) for s in lab.CHUNK_SIZES for o in lab.OVERLAPS} and len(rows) == 8
    for r in rows:
        assert r.cases == len(items) and r.indexed_chunks >= sum(len(t) for _, t in docs[:12]) / r.chunk_size


def test_retrieval_ablation_in_all_modes(spark, tables):
    path, items, _ = tables
    rows = registry.QUERIES["retrieval_ablation_modes"](spark, path).collect()
    assert {(r.mode, r.top_k, r.threshold) for r in rows} == {(m, k, t) for m in ("dense", "lexical", "hybrid") for k in lab.TOP_KS for t in lab.ABLATION_THRESHOLDS} and len(rows) == 36
    assert [-r.balanced_accuracy for r in rows] == sorted(-r.balanced_accuracy for r in rows)
    assert all(r.cases == len(items) for r in rows)
    # An item that stands in a document is the best lexical hit.
    assert all(r.mrr == 1.0 for r in rows if r.mode == "lexical")
