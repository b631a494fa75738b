import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import ppm


def coded(t):
    return b"".join(w + b" " for w in t.encode().lower().split()) + b"\xff"


def brute(training, t):
    """PPM with escape method C and exclusion, symbol by symbol over dictionaries."""
    trie = defaultdict(Counter)
    for x in training:
        s = b"\xff" * ppm.ORDER + coded(x)
        for i in range(ppm.ORDER, len(s)):
            for k in range(ppm.ORDER + 1):
                trie[s[i - k : i]][s[i]] += 1
    s, total = b"\xff" * ppm.ORDER + coded(t), 0.0
    for i in range(ppm.ORDER, len(s)):
        excluded = set()
        for k in range(ppm.ORDER, -1, -1):
            seen = {a: n for a, n in trie[s[i - k : i]].items() if a not in excluded}
            whole = sum(seen.values()) + len(seen)
            if s[i] in seen:
                total += math.log10(seen[s[i]] / whole)
                break
            if seen:
                total += math.log10(len(seen) / whole)
            excluded |= set(trie[s[i - k : i]])
        else:
            total += math.log10(1 / (256 - len(excluded)))
    return total


def base(training, t):
    c = Counter(w for x in training for w in [*x.encode().lower().split(), None])
    n, v = sum(c.values()), len(c)
    tokens = [*t.encode().lower().split(), None]
    return len(tokens), sum(c[w] > 0 for w in tokens), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)


@pytest.mark.parametrize(("hot", "pairs", "size"), [(1 << 20, 1 << 12, 16 << 20), (8, 12, 400)])
def test_as_brute_force(spark, monkeypatch, hot, pairs, size):
    """As it is, and with rare words, pairs on both sides of the bound for a split, and slices of a few texts."""
    monkeypatch.setattr(ppm, "HOT_SHARE", hot)
    monkeypatch.setattr(ppm, "HOT_PAIRS", pairs)
    monkeypatch.setattr(ppm, "SLICE", size)
    monkeypatch.setattr(ppm, "PART", size // 4)
    rnd = random.Random(7)
    rows = [(i, " ".join("".join(rnd.choice("abé") for _ in range(rnd.randrange(1, 5))) for _ in range(rnd.randrange(20)))) for i in range(30)]
    rows += [(30, "ZZ top\n\tzz"), (31, ""), (32, None), (33, "ab ab"), (33, "ab ab"), (33, "ba"), (None, "ab é")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int").repartition(3)
    training = [t or "" for d, t in rows if d is not None and d % 3]
    got = ppm.score(df, F.col("doc_id") % 3 != 0).collect()
    want = sorted(((d, *base(training, t or ""), brute(training, t or "")) for d, t in rows), key=str)
    mine = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=str)
    assert [w[:4] for w in mine] == [w[:4] for w in want]
    assert np.allclose([w[4:] for w in mine], [w[4:] for w in want])


def test_probabilities_add_up():
    texts = [b"aba abb", b"bab a", b"cc"]
    g, _ = ppm.grams(texts)
    keys, counts = ppm.counted(g)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    trie = ppm.Trie(keys, counts, ppm.Outline(ppm.counted(keys & np.uint64(0xFFFF), counts), none, np.zeros(1 << 16, bool), 1))
    for context in (b"\xff" * 5, b" aba ", b"azzab", b"xxxxx", b"\xff\xffabb"):
        at = int.from_bytes(context) << 8
        assert abs((10 ** trie.log10p(np.array([at + s for s in range(256)], np.uint64))).sum() - 1) < 1e-9


def test_without_training(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = ppm.score(df, F.lit(False)).collect()[0]
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and abs(r.score - 5 * math.log10(1 / 256)) < 1e-9
    assert ppm.score(df.limit(0), F.lit(True)).count() == 0


def test_very_long_text(spark):
    """One text of some slices among short ones."""
    rnd = random.Random(4)
    long = " ".join("".join(rnd.choice("abcde") for _ in range(rnd.randrange(1, 7))) for _ in range(12_000))
    rows = [(1, long), (2, "abc abd"), (3, "abc")]
    got = {r.doc_id: r for r in ppm.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") != 3).collect()}
    for d, t in rows:
        assert got[d].score == pytest.approx(brute([long, rows[1][1]], t)) and got[d].base_score == pytest.approx(base([long, rows[1][1]], t)[3])
