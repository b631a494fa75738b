"""The chunking grid, of whose pages tokens are cut once for all cells, against chunks made and embedded one by one."""

import random

import numpy as np
import pytest

from assayer.functions import text as texts
from assayer.operators import chunking, embedding, grid, lab, retrieval

GOLD = "case_id long, query string, expected_standalone_query string, expected_answerable boolean, expected_chunk_ids array<string>, expected_source_docs array<string>"
CELLS = [("a", 60, 20), ("b", 60, 0), ("c", 200, 30), ("d", 25, 24), ("e", 900, 100)]


def odd(rnd, n):
    word = lambda: "".join(rnd.choice("abcdeABé0ſK漢") for _ in range(rnd.choice([1, 2, 2, 3, 3, 4, 90 if rnd.random() < 0.05 else 5])))
    blank = lambda: rnd.choice([" "] * 12 + [". ", "! ", "?\n", ".\n\n", "\n\n", "\t", " \n ", "  ", ".\xa0", "\x1c", ".\x1d ", " 　", "-", ". \x85 "])
    return "".join(word() + blank() for _ in range(n))


def odd_texts(n=120):
    rnd = random.Random(5)
    return ["", " \n\n ", "a", "x" * 1000, "é" * 500 + "a" * 500, "the of and", "...", ". . .", *(odd(rnd, rnd.choice([1, 5, 40, 200])) for _ in range(n))]


def test_units_are_those_of_columns(spark):
    rows = spark.createDataFrame([(t,) for t in odd_texts()], "t string").select("t", texts.units("t").alias("u")).collect()
    assert [grid.units(r.t) for r in rows] == [r.u for r in rows]


@pytest.mark.parametrize("size, overlap", [(60, 20), (60, 0), (25, 24), (7, 30), (1, 1), (900, 100)])
def test_places_are_those_of_packed_texts(size, overlap):
    for t in odd_texts():
        pieces = list(chunking.bounded(grid.units(t), size))
        ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
        whole = " ".join(pieces)
        assert [whole[a:b] for a, b in grid.places(whole, ends.tolist(), size, overlap)] == list(chunking.packed(grid.units(t), size, overlap))


def test_chunks_have_their_vectors_lengths_and_terms():
    pages = odd_texts()
    number = {t.encode(): i for i, t in enumerate(["ab", "aa", "b", "0", "e"])}
    r = grid._Read(pages, CELLS, grid._Codes(number))
    for c, (_, size, overlap) in enumerate(CELLS):
        chunks = [list(chunking.packed(grid.units(t), size, overlap)) for t in pages]
        every = [t for x in chunks for t in x]
        spans = r.spans[r.cell(c)]
        assert r.counts[:, c].tolist() == [len(x) for x in chunks]
        assert (r.vectors(c) == embedding.hashed(every)).all()
        assert spans[:, 2].tolist() == [len(retrieval._terms(t)) for t in every]
        want = [[number[x.encode()] for x in retrieval._terms(t) if x.encode() in number] for t in every]
        assert [r.terms[a:b].tolist() for a, b, _ in spans] == want
        order = grid._rising(spans)
        p = grid.Postings(r.terms, *spans[order, :2].T)
        assert p.df(5).tolist() == [sum(t in w for w in want) for t in range(5)]
        row, term, tf = p.rows()
        assert {(order[i], t): n for i, t, n in zip(row.tolist(), term.tolist(), tf.tolist(), strict=True)} == {(i, t): w.count(t) for i, w in enumerate(want) for t in w} and len(row) == len({*zip(row.tolist(), term.tolist(), strict=True)})


def tables(spark):
    rnd = random.Random(6)
    docs = odd_texts(40)
    asks = [docs[20][30:120], docs[25][:60], "ab", "aa b", "", "the of", "zzzz", None, "a a 0 b", *(odd(rnd, 12) for _ in range(6))]
    asks += [" ".join(retrieval._terms(docs[30])[5:12]), "  ".join(retrieval._terms(docs[33])[:2])]
    pages = spark.createDataFrame([(f"{i:05d}" * 8, f"d{i}.txt", 1 + i % 2, None if i == 9 else t) for i, t in enumerate(docs)], "document_hash string, source_doc string, page_number int, text string").repartition(3)
    gold = spark.createDataFrame([(i, q, None, i % 3 > 0, [], [f"d{i}.txt", f"d{2 * i}.txt"] if i % 3 else []) for i, q in enumerate(asks)], GOLD)
    return gold, pages


def test_the_grid_finds_what_is_found_in_its_chunks(spark):
    gold, pages = tables(spark)
    asked = lab.probe_queries(gold)
    found, chunks = grid.hybrid(asked, pages, CELLS, 4)
    made = chunking.chunk_grid(pages, CELLS)
    cells = spark.createDataFrame([(c,) for c, *_ in CELLS], "collection string")
    want = retrieval.retrieve(cells.crossJoin(embedding.embed(asked, "query")), embedding.embed(made), 4, "hybrid")
    want = want.join(made.select("collection", "chunk_id", "source_doc"), ["collection", "chunk_id"]).select(found.columns)
    got = sorted(map(tuple, found.collect()), key=str)
    assert got == sorted(map(tuple, want.collect()), key=str) and len(got) == len(CELLS) * gold.count() * 4
    assert chunks == {r.collection: r["count"] for r in made.groupBy("collection").count().collect()}


def test_a_default_grid_makes_no_chunks(spark, monkeypatch):
    """Its figures are those of chunks that are made and embedded in each cell."""
    gold, pages = tables(spark)
    want = [tuple(r) for r in lab.chunking_ablation(gold, pages, lambda df, c="text": embedding.embed(df, c), [60, 200], [0, 30]).collect()]
    monkeypatch.setattr(retrieval, "_CELLS", 40)
    monkeypatch.setattr(chunking, "chunk_grid", lambda *_: pytest.fail("chunks are made"))
    assert [tuple(r) for r in lab.chunking_ablation(gold, pages, embedding.embed, [60, 200], [0, 30]).collect()] == want and len(want) == 4
