import random

import pytest

from assayer.llm import components as stars
from assayer.llm import jaccard, native
from assayer.llm.components import components, named


def brute(rows, k=5, percent=75):
    sets = []
    for d, t in rows:
        w = (t or "").lower().split()
        sets.append((d, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    root = {d: d for d, _ in rows}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((top(a), top(b)))
                root[q] = p
    return {d: (len(s), top(d)) for d, s in sets}


@pytest.mark.parametrize(("slice_bytes", "part", "rounds", "broadcast"), [(8 << 20, 1024, 6, 200_000), (600, 2, 4, 10), (600, 1024, 1, 200_000)])
def test_as_brute_force(spark, monkeypatch, slice_bytes, part, rounds, broadcast):
    """Also with parts of few classes and hot names over many, and with all pairs of components right after the first hubs."""
    monkeypatch.setattr(jaccard, "SLICE", slice_bytes)
    monkeypatch.setattr(jaccard, "PART_CLASSES", part)
    monkeypatch.setattr(jaccard, "HUB_ROUNDS", rounds)
    monkeypatch.setattr(native, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(stars, "HOT_LEAST", 3)
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(3))
    bases = [[word() for _ in range(rnd.randrange(5, 60))] for _ in range(12)]
    rows = []
    for i in range(150):
        w = list(rnd.choice(bases))
        for _ in range(rnd.randrange(5)):
            at = rnd.randrange(len(w) + 1)
            w[at : at + rnd.randrange(2)] = [word()] if rnd.random() < 0.7 else []
        rows.append((i * 7 % 1000, " ".join(w)))
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "a b"), (2004, "A  b"), (2005, "a c"), (2006, "x " * 200), (2007, "X " * 90), (2008, "a b c d e")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, c int").repartition(6)
    want = brute(rows)
    assert len({c for _, c in want.values()}) < 130
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df).collect()} == want


def test_odd_rows(spark):
    t = "one two three four five six"
    df = spark.createDataFrame([(5, t), (5, t), (3, t), (None, t), (4, None), (4, "other words")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.join(df).collect())
    assert got == [("3", 2, "3"), ("4", 0, "4"), ("4", 1, "4"), ("5", 2, "3"), ("5", 2, "3"), ("None", 2, "None")]
    assert jaccard.join(df.limit(0)).count() == 0


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 130)] + [(200 + rnd.randrange(40), 200 + rnd.randrange(40)) for _ in range(30)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 100 for i in range(100, 131)) and 5 not in got
    for a, b in edges:
        assert a == b or got[a] == got[b]


def test_few_pairs_in_a_large_group(spark, monkeypatch):
    """Near copies of one text: each meets some hubs, whatever the size of the group; and none is verified twice."""
    asked = []
    plain = jaccard._verified

    def counting(*args):
        asked.append(plain(*args))
        return asked[-1]

    monkeypatch.setattr(jaccard, "_verified", counting)
    monkeypatch.setattr(jaccard, "PART_CLASSES", 32)
    kept = []
    monkeypatch.setattr(jaccard, "scratch", lambda spark: __import__("contextlib").nullcontext())
    for n in (100, 400):
        rnd, rows = random.Random(n), []
        base = [f"w{i}" for i in range(100)]
        for d in range(n):
            w = list(base)
            for _ in range(3):
                w[rnd.randrange(100)] = f"x{rnd.randrange(10**6)}"
            rows.append((d, " ".join(w)))
        asked.clear()
        got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(rows)
        pairs = [(r.c1, r.c2) for x in asked for r in x.collect()]
        assert len(pairs) == len(set(pairs))
        kept.append(len(pairs))
    assert kept[1] <= 6 * kept[0]


def test_very_long_text(spark):
    words = [f"w{i * i % 9973}x{i}" for i in range(150_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-9000])), (3, " ".join(words[: len(words) // 2])), (4, "a b c d e f")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (149_996, 1), 2: (140_996, 1), 3: (74_996, 3), 4: (2, 4)}


def test_names_of_hot_rows(spark, monkeypatch):
    monkeypatch.setattr(native, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(stars, "HOT_LEAST", 3)
    rows = spark.createDataFrame([(i, i % 5 if i < 20 else 7) for i in range(40)] + [(40, 9)], "x long, root long")
    names = jaccard.stored(spark.createDataFrame([(i, 10 * i) for i in range(8)], "root long, top long"), "t")
    got = {r.x: r.top for r in named(rows, names, "root").collect()}
    assert got == {i: 10 * (i % 5) if i < 20 else 70 for i in range(40)} | {40: None}


def test_lists_of_one_class_end_where_they_are_gathered(spark, monkeypatch):
    """Copies in several slices share all their shingles, but are one class: none of these goes on to the later joins."""
    first, keep = {}, jaccard.stored

    def kept(df, what, **kw):
        first.setdefault(what, out := keep(df, what, **kw))
        return out

    monkeypatch.setattr(jaccard, "stored", kept)
    monkeypatch.setattr(jaccard, "scratch", lambda spark: __import__("contextlib").nullcontext())
    monkeypatch.setattr(jaccard, "SLICE", 600)
    texts = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(10)]
    rows = [(30 * k + i, t) for k in range(3) for i, t in enumerate(texts)] + [(900, texts[0] + " more"), (901, texts[0] + " words")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute(rows)
    sizes = [r["count"] for r in first["lists"].groupBy("key").count().collect()]
    assert sizes and min(sizes) > 1
