import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from assayer.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"


def plain(rows, least=3, top=200):
    """The contract in plain Python: rows of (text, lang, source)."""
    docs, counts = defaultdict(set), defaultdict(Counter)
    for i, (text, lang, source) in enumerate(rows):
        text, lang, source = text or "", lang or "", source or ""
        counts[lang, source]  # noqa: B018
        for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text):
            t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
            docs[lang, t].add(i)
            counts[lang, source][t] += 1
    out = []
    for lang in {g[0] for g in counts}:
        kept = [t for (k, t), d in docs.items() if k == lang and len(d) >= least]
        sources = [s for k, s in counts if k == lang]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}  # noqa: B023, E731
        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, o, v, r) for r, (v, o) in enumerate(items, 1) if part == "pair" or r <= top]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def made(n, seed=1, words=60, sources=5):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéßд漢XYZ") for _ in range(rng.randint(1, 4))) for _ in range(words)]
    line = lambda: rng.choice([" ", ",", "7", "\n", "_"]).join(rng.choices(vocabulary, k=rng.randint(0, 30)))
    return [(line(), rng.choice(["en", "de", None]), rng.choice([*(f"s{i}" for i in range(sources)), None])) for _ in range(n)]


EDGES = [
    (None, None, None), ("", "en", "empty"), (None, "en", "empty"), ("1 2 3 !", "en", "empty"), ("x " * 5000, "en", "long"),
    ("Same same SAME", "fr", "a"), ("Same same SAME", "fr", "a"), ("same", "fr", "b"), ("rare", "xx", "a"), ("other", "xx", "b"),
    ("tie eit", "zz", "a"), ("tie eit", "zz", "a"), ("eit tie", "zz", "b"), ("none", "zz", "c"),
]


@pytest.mark.parametrize("cells", [1 << 18, 16])
def test_as_in_plain_python(spark, cells):
    rows = made(150) + EDGES
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA).repartition(5)
    assert found(divergence.audit(docs, cells=cells)) == plain(rows)


def test_many_terms_keep_the_best(spark):
    rows = made(1500, seed=2, words=900, sources=2)
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    assert max(x[5] for x in plain(rows)) == 200
    assert found(divergence.audit(docs, cells=200)) == plain(rows)


def test_groups_taken_some_at_a_time(monkeypatch):
    rng = np.random.default_rng(0)
    p = rng.integers(1, 10**9, (7, 11))
    whole = divergence._pairs(p, slice(0, 7))
    monkeypatch.setattr(divergence, "PAIR_CELLS", 10)
    assert (np.concatenate([divergence._pairs(p, slice(a, a + 2)) for a in range(0, 7, 2)]) == whole).all()
    assert [[sum((int(a) - int(b)) ** 2 // int(b) for a, b in zip(x, y, strict=True)) for y in p] for x in p] == whole.tolist()


def test_large_counts_are_exact():
    counts = np.array([0, 10**12, 9 * 10**13 - 1])
    total = 10**14 + 7
    assert divergence.shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in counts]


def test_empty_table_and_clashing_columns(spark):
    assert found(divergence.audit(spark.createDataFrame([], SCHEMA))) == []
    rows = made(40, seed=3)
    docs = spark.createDataFrame([(i, *r, 1, 2, "t", 3, 4) for i, r in enumerate(rows)], f"{SCHEMA}, n long, docs long, term string, block long, kept long")
    assert found(divergence.audit(docs)) == plain(rows)
