import hashlib
import random

import pytest

from assayer.llm import substring


def brute(rows, n):
    seen, out = {}, {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        w = (t or "").split(" ") if t else []
        w = [x for x in (t or "").split() if x]
        gone = set()
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            if k in seen:
                gone |= set(range(i, i + n))
            else:
                seen[k] = (d, i)
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(left.encode()).hexdigest(), left)
    return out


def greedy(rows, n):
    """The parse over the texts themselves."""
    words, first = {d: (t or "").split() for d, t in rows}, {}
    at = lambda d, i: tuple(words[d][i : i + n]) if i + n <= len(words[d]) else None
    out = {}
    for d in sorted(words):
        own, p = [], 0
        for i in range(len(words[d]) - n + 1):
            first.setdefault(at(d, i), (d, i))
        while p <= len(words[d]) - n:
            s, q = first[at(d, p)]
            k = 0
            if (s, q) != (d, p):
                while at(d, p + k) is not None and at(d, p + k) == at(s, q + k):
                    k += 1
                own.append((p, k + n - 1, s, q))
            p += max(1, k)
        out[d] = own
    return out


@pytest.mark.parametrize("slice_bytes", [8 << 20, 300])
def test_as_brute_force(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(substring, "SLICE", slice_bytes)
    rnd = random.Random(9)
    passages = [" ".join(rnd.choice("abcdef") for _ in range(rnd.randrange(4, 14))) for _ in range(8)]
    rows = []
    for i in range(80):
        parts = [rnd.choice(passages) if rnd.random() < 0.5 else " ".join(str(rnd.randrange(40)) for _ in range(rnd.randrange(8))) for _ in range(rnd.randrange(6))]
        rows.append((i * 3, " ".join(parts)))
    rows += [(500, "q " * 30), (501, None), (502, ""), (503, "A  B\tC\nD E f g"), (504, "A B C D E f h")]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").repartition(5)
    want = brute(rows, 5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.report(df, min_words=5).collect()}
    assert got == {k: v[:3] for k, v in want.items()}
    assert {r.doc_id: r.text or "" for r in substring.dedup(df, min_words=5).collect()} == {k: v[3] for k, v in want.items()}
    texts, parsed = dict(rows), greedy(rows, 5)
    for r in substring.factors(df, min_words=5).collect():
        assert [tuple(f) for f in r.factors] == parsed[r.doc_id]
        w = (texts[r.doc_id] or "").split()
        for f in r.factors:
            src = (texts[f.source_id] or "").split()
            assert f.length >= 5 and (f.source_id, f.source_start) < (r.doc_id, f.start)
            assert w[f.start : f.start + f.length] == src[f.source_start : f.source_start + f.length]


def test_odd_rows(spark):
    a, b = "one two three four five six", "zero one two three four five six"
    df = spark.createDataFrame([(1, a), (1, a), (2, b), (None, "x1 x2 x3 x4 x5"), (0, "x1 x2 x3 x4 x5"), (3, "k " * 50_000)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substring.report(df, min_words=5).collect())
    assert got == [("0", 5, 5), ("1", 6, 0), ("1", 6, 0), ("2", 7, 6), ("3", 50_000, 49_999), ("None", 5, 0)]
    assert substring.report(df.limit(0)).count() == 0


def test_source_goes_on_past_earlier_places(spark):
    """A copy is one factor, though a passage in its source stands in an earlier document too."""
    passage = " ".join(f"p{i}" for i in range(12))
    source = f"a b c d e f g {passage} h i j k l m n"
    rows = [(1, passage), (2, source), (3, source), (4, f"x {source} y {passage}")]
    got = {r.doc_id: [tuple(f) for f in r.factors] for r in substring.factors(spark.createDataFrame(rows, "doc_id long, text string"), min_words=5).collect()}
    assert got == {1: [], 2: [(7, 12, 1, 0)], 3: [(0, 26, 2, 0)], 4: [(1, 26, 2, 0), (28, 12, 1, 0)]}
