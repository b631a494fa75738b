import math
import random
from collections import Counter

import numpy as np
import pytest

from assayer.llm import langid, toxicity


def brute_segments(s):
    """Maximal segments by their definition: the best segment, then those left and right of it; ties: shortest."""
    def part(a, b):
        best = None
        for i in range(a, b):
            for j in range(i + 1, b + 1):
                x = sum(s[i:j])
                if x > 0 and (best is None or x > best[2] or x == best[2] and j - i < best[1] - best[0]):
                    best = (i, j, x)
        return [] if best is None else part(a, best[0]) + [best] + part(best[1], b)

    return part(0, len(s))


def test_segments():
    rnd = random.Random(1)
    for _ in range(300):
        s = [rnd.uniform(-2, 1.5) for _ in range(rnd.randrange(25))]
        assert [(a, b) for a, b, _ in toxicity.segments(s)] == [(a, b) for a, b, _ in brute_segments(s)]
    assert toxicity.segments([]) == [] and toxicity.segments([-1.0, 0.0]) == []


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(2)
    letters = {"xx": "abcde", "yy": "klmno"}
    docs, labels = [], []
    for i in range(400):
        lang = "xx" if i % 2 else "yy"
        word = lambda: "".join(rnd.choice(letters[lang]) for _ in range(rnd.randrange(2, 6)))  # noqa: E731, B023
        w = [word() for _ in range(rnd.randrange(5, 120))]
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), rnd.choice(["vile", "rotten", "nasties"]))
        docs.append((i, " ".join(w), lang))
        labels.append((i, toxic))
    return docs, labels


def test_toxicity(spark, corpus):
    docs, labels = corpus
    df, lab = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(df, lab.filter("doc_id % 3 != 1"))
    odd = spark.createDataFrame([(1000, None), (1001, ""), (1000, "vile " * 3000), (None, "abc")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert all(got[i].predicted == y for i, y in labels)
    assert [round(r.score, 2) for r in toxicity.score(odd, model).orderBy("score").collect()][-1] == 1.0
    assert sum(bool(r.passages) for r in toxicity.passages(df, model).collect()) > 40
    where = {r.doc_id: r.passages for r in toxicity.passages(df, model).collect()}
    for i, y in labels:
        w = docs[i][1].split()
        covered = {k for p in where[i] for k in range(p.first_word, p.end_word)}
        assert y or not covered
        assert all(any(w[k] in ("vile", "rotten", "nasties") for k in range(p.first_word, p.end_word)) for p in where[i])
    assert toxicity.train(df, lab.limit(0)) is None
    assert {r.score for r in toxicity.score(df, None).collect()} == {0.0}
    assert toxicity.score(df.limit(0), model).count() == 0


def test_langid(spark, corpus):
    docs, _ = corpus
    df = spark.createDataFrame([(*r, 0.5) for r in docs], "doc_id long, text string, lang string, n double")
    model = langid.train(df.filter("doc_id % 3 != 0"))
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang in docs)
    odd = spark.createDataFrame([(1, None), (2, "12 .,"), (3, ""), (3, "abcde " * 50_000)], "doc_id long, text string")
    assert sorted((r.doc_id, r.lang_pred) for r in langid.identify(odd, model).collect()) == [(1, "und"), (2, "und"), (3, "und"), (3, "xx")]
    kept = langid.identify(df, model, keep=True)
    assert kept.columns == ["doc_id", "text", "lang", "n", "lang_pred", "score"] and kept.count() == 400
    none = langid.train(df.limit(0))
    assert {r.lang_pred for r in langid.identify(df, none).collect()} == {"und"}


def test_decisions_as_plain_kernels():
    """Predictions and scores against kernels, Nyström map and ridge written out over sets of n-grams."""
    rnd = random.Random(3)
    letters = {"aa": "abcé", "bb": "cdeü", "cc": "efab"}
    labels = [rnd.choice(list(letters)) for _ in range(60)]
    texts = ["".join(rnd.choice(letters[x] + " ") for _ in range(rnd.randrange(8, 80))) + x[0] for x in labels]
    fit, rest = texts[:40], texts[40:]

    def slot(g):
        x = int.from_bytes(g, "big") ^ (len(g) * 0x3C6EF372 & 0xFFFFFFFF)
        return (x * 2654435761 & 0xFFFFFFFF) >> (32 - langid.SLOT_BITS)

    def grams(t):
        b = t.lower().encode()
        return {slot(b[i : i + n]) for n in range(1, langid.MAX_N + 1) for i in range(len(b) - n + 1)}

    sets = {t: grams(t) for t in texts}
    kernel = lambda s, t: len(sets[s] & sets[t]) / math.sqrt(len(sets[s]) * len(sets[t]))
    langs = sorted(set(labels[:40]))
    marks = [t for x in langs for t in [t for t, y in zip(fit, labels, strict=False) if y == x][:10]]
    gram = np.array([[kernel(s, t) for t in marks] for s in marks])
    value, vector = np.linalg.eigh(gram)
    root = vector / np.sqrt(np.maximum(value, 1e-6))
    phi = np.array([[kernel(s, t) for t in marks] for s in fit]) @ root
    target = np.array([[1.0 if y == x else -1.0 for x in langs] for y in labels[:40]])
    w = np.linalg.solve(phi.T @ phi + langid.RIDGE * len(fit) * np.eye(len(marks)), phi.T @ target)
    model = langid.Model.fit([t.encode() for t in fit], labels[:40], landmarks=10)
    got, scores = model.predict(rest)
    for t, lang, score in zip(rest, got, scores, strict=True):
        d = np.array([kernel(t, m) for m in marks]) @ root @ w
        low, *_, second, top = sorted(d)
        assert lang == langs[int(d.argmax())]
        assert score == pytest.approx((top - second) / (top - low), abs=2e-3)


def test_toxic_score_as_plain(corpus):
    """Odds, token scores, segments, expectations and the curve written out for each text."""
    docs, labels = corpus
    model = toxicity.Model.fit([t for _, t, _ in docs[:300]], [y for _, y in labels[:300]])
    kept = toxicity._apart([t for _, t, _ in docs[:300]])
    n = [sum(labels[i][1] == y for i in kept) for y in (0, 1)]
    seen = [Counter(w for i in kept if labels[i][1] == y for w in set(docs[i][1].split())) for y in (0, 1)]
    odds = {}
    for word, y1 in seen[1].items():
        y0, prior = seen[0][word], toxicity.PRIOR * (y1 + seen[0][word]) / sum(n)
        a1, a0 = min(y1 + prior, n[1] + toxicity.PRIOR - 1e-9), min(y0 + prior, n[0] + toxicity.PRIOR - 1e-9)
        ratio = math.log(a1 / (n[1] + toxicity.PRIOR - a1) / (a0 / (n[0] + toxicity.PRIOR - a0)))
        if y1 >= 3 and ratio >= toxicity.STRONG and ratio / math.sqrt(1 / a1 + 1 / a0) >= toxicity.CLEAR:
            odds[word] = ratio
    assert odds and model.odds == pytest.approx(odds)
    # A prefix is known by its own counts.
    token = lambda w: odds.get(w, next((model.prefix_odds[w[:k]] for k in toxicity.PREFIXES if len(w) > k and w[:k] in model.prefix_odds), 0.0)) - toxicity.DRIFT
    slope, offset = model.curve
    for _, text, _ in docs[300:]:
        s = [token(w) for w in text.split()]
        expected = [model.k * len(s) * math.exp(-model.lam * x) for _, _, x in brute_segments(s)]
        evidence = sum(-math.log(e) for e in expected if e < 1)
        assert model.evidence(text) == pytest.approx(evidence)
        assert model.score(evidence) == pytest.approx(1 / (1 + math.exp(-(slope * math.log(1 + evidence) + offset))))


def test_toxic_sample_is_thinned_once(spark):
    """Long texts take no place in the sample, and a shared passage drops no text."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    shared = " ".join(word() for _ in range(60))
    texts = [shared + " " + " ".join(word() for _ in range(120)) for _ in range(40)]
    assert len(toxicity._apart(texts)) >= 36
    assert toxicity._apart([texts[0], texts[1], texts[0]]) == [0, 1]
    rows = [(i, "clean " + " ".join(word() for _ in range(20)) if i < 200 else "foulword " + " ".join(word() for _ in range(20)) if i < 300 else "x" * 20_001) for i in range(1300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 200)) for i, _ in rows], "doc_id long, toxic int")
    assert "foulword" in toxicity.train(docs, labels, sample=100).odds
