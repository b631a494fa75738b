"""Language ID by string kernels.

A text's features are the byte n-grams it has, for n from 1 to 4 (blended spectrum, presence only, A-Z lower-cased,
hashed to 2**17 slots); the kernel of two texts is the cosine of their presence vectors. Fitting takes a sample of
labelled rows, of them landmarks for a Nyström map, and solves kernel ridge regression one language against the rest.
Decisions are K(x, landmarks) @ A; as K(x, .) is x @ L (scaled by the norms), L @ A is multiplied out once, and texts are
scored in batches as presence @ (L @ A). The positive factor 1/|x| doesn't change the order and is left out.

The sample: at most SAMPLE rows of each language of at most SAMPLE_CHARS characters, those of the smallest hashed ids. It
is all that reaches the driver. Every text is scored whole.

Null texts and texts without a letter are `und`, with score 0. Else the score is the margin between the best and the
second decision, as a share of that between the best and the worst (1 if only one language is known). Equal decisions go
to the language first in order. Without any labelled row all texts are `und`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, bounded, id_text, sample_ids, slices

SLOT_BITS = 17
MAX_N = 4
SAMPLE = 300
SAMPLE_CHARS = 20_000
LANDMARKS = 48
RIDGE = 1e-3
#: Texts whose presence bits are held at once.
HELD = 64
_LETTER = regex.compile(r"\p{L}")


def presence(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For texts in a row: the slots that each has, and where each text's slots start (with the end of all)."""
    bits = np.zeros(len(texts) << SLOT_BITS, bool)
    for i, t in enumerate(texts):
        b = _LOWER[np.frombuffer(t, np.uint8)].astype(np.uint32)
        own = bits[i << SLOT_BITS : (i + 1) << SLOT_BITS]
        gram = b
        for n in range(1, MAX_N + 1):
            if n > 1:
                gram = (gram[:-1] << np.uint32(8)) | b[n - 1 :]
            if not len(gram):
                break
            own[((gram ^ np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(2654435761)) >> np.uint32(32 - SLOT_BITS)] = True
    at = np.flatnonzero(bits)
    starts = np.searchsorted(at, np.arange(len(texts) + 1) << SLOT_BITS)
    return at & ((1 << SLOT_BITS) - 1), starts


class Model:
    def __init__(self, langs: list[str], weights: np.ndarray):
        self.langs, self.weights = langs, weights

    @classmethod
    def fit(cls, texts: list[bytes], labels: list[str], landmarks: int = LANDMARKS) -> Model:
        langs = sorted(set(labels))
        if not langs:
            return cls([], np.zeros((1 << SLOT_BITS, 0), np.float32))
        y = np.array([langs.index(x) for x in labels])
        rows = [presence([t])[0] for t in texts]
        chosen = [i for c in range(len(langs)) for i in np.flatnonzero(y == c)[:landmarks]]
        dense = np.zeros((len(chosen), 1 << SLOT_BITS), np.float32)
        for j, i in enumerate(chosen):
            dense[j, rows[i]] = 1 / np.sqrt(max(1, len(rows[i])))
        k = np.stack([dense[:, r].sum(1) / np.sqrt(max(1, len(r))) for r in rows]).astype(np.float64)
        value, vector = np.linalg.eigh(k[chosen])
        root = vector / np.sqrt(np.maximum(value, 1e-6))
        phi = k @ root
        w = np.linalg.solve(phi.T @ phi + RIDGE * len(texts) * np.eye(phi.shape[1]), phi.T @ np.where(y[:, None] == np.arange(len(langs)), 1.0, -1.0))
        return cls(langs, (dense.T @ (root @ w).astype(np.float32)).astype(np.float32))

    def decisions(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.langs)))
        for a in range(0, len(texts), HELD):
            slots, starts = presence(texts[a : a + HELD])
            full = np.flatnonzero(np.diff(starts))
            if len(full):
                out[a + full] = np.add.reduceat(self.weights[slots].astype(np.float64), starts[full], axis=0)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        has = [bool(t and _LETTER.search(t)) for t in texts]
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        d = self.decisions([t.encode() if ok else b"" for t, ok in zip(texts, has, strict=True)])
        best = d.argmax(1)
        ordered = np.sort(d, axis=1)
        top, low = ordered[:, -1], ordered[:, 0]
        second = ordered[:, -2] if d.shape[1] > 1 else low
        share = np.where(top > low, (top - second) / np.maximum(top - low, 1e-300), 0.0) if d.shape[1] > 1 else np.ones(len(d))
        return [self.langs[i] if ok else "und" for i, ok in zip(best, has, strict=True)], [float(min(1, max(0, s))) if ok else 0.0 for s, ok in zip(share, has, strict=True)]


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Fits on the rows with an id and a language: the ids of the sample are chosen first, then their texts are read."""
    rows = labelled.select(F.col(id_col).cast("long").alias("d"), F.col(lang_col).alias("lang"), F.col(text_col).alias("x"))
    rows = rows.filter(F.col("lang").isNotNull() & (F.length("x") <= SAMPLE_CHARS) & F.col("x").rlike(r"\p{L}")).withColumn("h", F.xxhash64("d"))
    ids = sample_ids(rows.filter(F.col("d").isNotNull()).select("d", F.col("lang").alias("cls")), sample)
    if not ids:
        return Model.fit([], [])
    wanted = labelled.sparkSession.createDataFrame(ids, "d long, lang string").distinct()
    got = rows.join(F.broadcast(wanted), ["d", "lang"]).select("d", "lang", "x", "h").collect()
    got.sort(key=lambda r: (r.h, r.d or 0, r.lang, r.x))
    return Model.fit([r.x.encode() for r in got], [r.lang for r in got])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, lang_pred and score of every row; with keep, all columns of docs and after them lang_pred and score
    (which then must not be names in docs)."""
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.weights))
    rows = bounded(docs).withColumn("text", F.col(text_col)) if keep else id_text(docs, id_col, text_col)
    named = ["lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for part in slices(batches):
            langs, scores = own.predict(part.column("text").to_pylist())
            cols = part.columns if keep else [part.column("doc_id")]
            names = part.schema.names if keep else ["doc_id"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, *named])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) if keep else "doc_id long"
    return rows.mapInArrow(run, f"{fields}, lang_pred string, score double")
