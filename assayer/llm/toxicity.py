"""Toxic passages by maximum-scoring segments.

Words and their prefixes get log-odds between toxic and other training texts under a Dirichlet prior centred on their
overall rate (counts are of texts, so repetition within one doesn't weigh); only clear ones (z of CLEAR or more) of at least
STRONG count. A
token's score is its word's log-odds, else those of its longest known prefix, less a small drift. All maximal scoring
segments of a text are found in one pass (each is better than any segment that meets it). By extreme-value statistics, the
best score of n background tokens exceeds S with expectation K n exp(-lambda S): segments with an expectation under
SIGNIFICANT are the toxic passages, and the text's evidence is the sum of -ln(expectation) over all segments under 1. A logistic curve on
ln(1 + evidence), fitted on the training texts, makes it a score from 0 to 1.

The sample: at most SAMPLE labelled texts of either class of at most SAMPLE_CHARS characters, those of the smallest hashed
ids. Every text is scored whole. Null and empty texts have no evidence; a label that is null isn't used; of several
labels for one id the largest holds. Without labels of both classes every score is 0.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, sample_ids, slices

SAMPLE = 4000
SAMPLE_CHARS = 20_000
PREFIXES = (7, 6, 5, 4)
PRIOR = 50.0
CLEAR = 3.0
STRONG = 2.0
DRIFT = 0.3
SIGNIFICANT = 0.05
_WORD = re.compile(r"\w+")
_REMEMBERED = 1_000_000


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as start, end (exclusive) and score, in order, in linear time."""
    # Each open segment: start, end, sum before it, sum up to its end, and the nearest open one that begins lower.
    stack: list[tuple[int, int, float, float, int]] = []
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, left, right = i, before, total
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append((start, i + 1, left, right, j))
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, r - left) for a, b, left, r, _ in stack]


class Model:
    def __init__(self, odds: dict[str, float], prefix_odds: dict[str, float], lam: float, k: float, curve: tuple[float, float]):
        self.odds, self.prefix_odds, self.lam, self.k, self.curve = odds, prefix_odds, lam, k, curve
        self.known: dict[str, float] = {}

    def token(self, w: str) -> float:
        s = self.odds.get(w)
        if s is None:
            s = next((self.prefix_odds[w[:n]] for n in PREFIXES if len(w) > n and w[:n] in self.prefix_odds), 0.0)
        return s - DRIFT

    def scores(self, text: str) -> list[float]:
        known = self.known
        if len(known) > _REMEMBERED:
            known.clear()
        out = []
        for w in _WORD.findall(text.lower()):
            s = known.get(w)
            if s is None:
                s = known[w] = self.token(w)
            out.append(s)
        return out

    def passages(self, text: str | None, below: float = SIGNIFICANT) -> list[tuple[int, int, float, float]]:
        """First word, end word, score and expectation of each segment with an expectation under `below`."""
        s = self.scores(text or "")
        if not s or max(s) <= 0:
            return []
        found = ((a, b, x, self.k * len(s) * math.exp(-self.lam * x)) for a, b, x in segments(s))
        return [f for f in found if f[3] < below]

    def evidence(self, text: str | None) -> float:
        return math.fsum(-math.log(max(e, 1e-300)) for _, _, _, e in self.passages(text, 1.0))

    def score(self, evidence: float) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, a * math.log1p(evidence) + b))))

    @classmethod
    def fit(cls, texts: list[str], toxic: list[int]) -> Model | None:
        kept = _apart(texts)
        texts, toxic = [texts[i] for i in kept], [toxic[i] for i in kept]
        if not 0 < sum(toxic) < len(toxic):
            return None
        odds = _learned(texts, toxic)
        model = cls(*odds, 1.0, 1.0, (1.0, 0.0))
        # Background and curve come from texts that the odds used for them haven't seen.
        background: Counter = Counter()
        best, folds = [], []
        for fold in (0, 1):
            seen = [i for i in range(len(texts)) if i % 2 != fold]
            own = _learned([texts[i] for i in seen], [toxic[i] for i in seen])
            other = cls(*own, 1.0, 1.0, (1.0, 0.0))
            folds.append(other)
            for i in range(fold, len(texts), 2):
                if not toxic[i]:
                    s = other.scores(texts[i])
                    background.update(round(x, 2) for x in s)
                    if s:
                        best.append((len(s), max((x for _, _, x in segments(s)), default=0.0)))
        model.lam = _lambda(background)
        # K by maximum likelihood of the largest scores, P(M < x) = exp(-K n exp(-lambda x)); a pseudo-count keeps it off 0.
        model.k = min(1.0, (1 + len(best)) / (1 + sum(m * math.exp(-model.lam * x) for m, x in best)))
        for other in folds:
            other.lam, other.k = model.lam, model.k
        model.curve = _logistic([math.log1p(folds[i % 2].evidence(t)) for i, t in enumerate(texts)], toxic)
        return model


def _apart(texts: list[str]) -> list[int]:
    """Numbers of the texts without near copies of earlier ones: with none of those do three of four minima over word
    5-grams agree."""
    by: dict = {}
    out = []
    for i, t in enumerate(texts):
        w = t.split()
        grams = [zlib.crc32(" ".join(w[j : j + 5]).encode()) for j in range(max(1, len(w) - 4))]
        low = [(k, min((g ^ k) * 2654435761 & 0xFFFFFFFF for g in grams)) for k in (0, 0x55555555, 0x33333333, 0x0F0F0F0F)]
        if max(Counter(j for x in low for j in by.get(x, ())).values(), default=0) < 3:
            out.append(i)
            for x in low:
                by.setdefault(x, []).append(i)
    return out


def _learned(texts: list[str], toxic: list[int]) -> tuple[dict[str, float], dict[str, float]]:
    """Log-odds of words and of prefixes."""
    words, prefixes = (Counter(), Counter()), (Counter(), Counter())
    for t, y in zip(texts, toxic, strict=True):
        own = set(_WORD.findall(t.lower()))
        words[y].update(own)
        prefixes[y].update({w[:m] for w in own for m in PREFIXES if len(w) > m})
    n = [toxic.count(0), toxic.count(1)]
    return _log_odds(*words, n), _log_odds(*prefixes, n)


def _log_odds(clean: Counter, toxic: Counter, n: list[int]) -> dict[str, float]:
    """Log-odds of the words in toxic texts over the others, where clear."""
    out: dict[str, float] = {}
    all_ = sum(n)
    if not all(n):
        return out
    for w in toxic:
        y1, y0 = toxic[w], clean[w]
        if y1 < 3:
            continue
        a = PRIOR * (y1 + y0) / all_
        a1 = min(y1 + a, n[1] + PRIOR - 1e-9)
        a0 = min(y0 + a, n[0] + PRIOR - 1e-9)
        d = math.log(a1 / (n[1] + PRIOR - a1)) - math.log(a0 / (n[0] + PRIOR - a0))
        if d >= STRONG and d / math.sqrt(1 / a1 + 1 / a0) >= CLEAR:
            out[w] = d
    return out


def _lambda(background: Counter) -> float:
    """The positive root of mean(exp(lambda s)) = 1 under the background."""
    total = sum(background.values())
    if not total or max(background) <= 0:
        return 1.0
    f = lambda x: sum(c * math.exp(min(700.0, x * s)) for s, c in background.items()) / total - 1
    high = 1e-3
    while f(high) < 0 and high < 50:
        high *= 2
    low = high / 2
    if f(low) > 0:
        return 1e-3
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return min(low, 1.0)


def _logistic(x: list[float], y: list[int]) -> tuple[float, float]:
    """Slope and offset by Newton steps with a small ridge; the classes weigh alike."""
    a = np.column_stack([x, np.ones(len(x))])
    t = np.array(y, float)
    weight = np.where(t == 1, 0.5 / max(1, t.sum()), 0.5 / max(1, (1 - t).sum())) * len(x)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (p - t)) + 1e-2 * w
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        w = w - np.linalg.solve(h, g)
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model | None:
    """Fits on the texts of the labelled ids: the ids of the sample are chosen first, of texts short enough, then their
    texts are read. Model.fit leaves near copies out."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("x")).filter(F.length("x").between(1, SAMPLE_CHARS))
    marks = labels.select(F.col("doc_id").cast("long").alias("d"), F.col(label_col).cast("int").alias("y")).filter("d is not null and y in (0, 1)").groupBy("d").agg(F.max("y").alias("y"))
    marks = marks.join(rows.select("d"), "d", "left_semi")
    ids = sample_ids(marks.select("d", F.col("y").alias("cls")), sample)
    if not ids:
        return None
    got = rows.join(F.broadcast(spark.createDataFrame(ids, "d long, y int")), "d").collect()
    got.sort(key=lambda r: (r.d, r.x))
    return Model.fit([r.x for r in got], [r.y for r in got])


def _mapped(docs: DataFrame, model: Model | None, id_col: str, text_col: str, names: list[str], schema: str, of) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(None if model is None else (model.odds, model.prefix_odds, model.lam, model.k, model.curve))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None if sent.value is None else Model(*sent.value)
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *of(own, part.column("text").to_pylist())], ["doc_id", *names])

    return id_text(docs, id_col, text_col).mapInArrow(run, f"doc_id long, {schema}")


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted (1 from the threshold on) of every row."""
    def of(own: Model | None, texts: list[str | None]) -> list[pa.Array]:
        s = [own.score(own.evidence(t)) if own else 0.0 for t in texts]
        return [pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())]

    return _mapped(docs, model, id_col, text_col, ["score", "predicted"], "score double, predicted int", of)


def passages(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and passages (first_word, end_word, score, expectation) of every row."""
    kind = pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("score", pa.float64()), ("expectation", pa.float64())]))

    def of(own: Model | None, texts: list[str | None]) -> list[pa.Array]:
        keys = ("first_word", "end_word", "score", "expectation")
        return [pa.array([[dict(zip(keys, p, strict=True)) for p in own.passages(t)] if own else [] for t in texts], kind)]

    return _mapped(docs, model, id_col, text_col, ["passages"], "passages array<struct<first_word:int,end_word:int,score:double,expectation:double>>", of)
