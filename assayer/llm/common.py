"""Helpers shared by the operators: Arrow text columns, vectorised words and hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import release, scratch, shared_dir, stored

__all__ = ["release", "scratch", "shared_dir", "stored"]

#: Texts are handled in slices of about this many bytes, so that a task's memory doesn't follow the batch size.
SLICE_BYTES = 4 << 20
HASHED_BYTES = 1 << 19
BATCH_BYTES = 4 << 20

_U = np.uint64
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded(docs: DataFrame) -> DataFrame:
    """docs, after its session has been told to cut Arrow batches at BATCH_BYTES (where the bound is larger or written with a unit): batches of
    10,000 long texts would not fit a Python worker."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key).lower().rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return docs


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names; so further columns can't clash."""
    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def groups_for(docs: DataFrame, per_split: int = 16) -> int:
    """Number of hash groups for blobs: in proportion to the input splits, so that a group's size stays bounded."""
    return max(64, per_split * docs.rdd.getNumPartitions())


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches (with a text column) where about max_bytes of text are reached; a single long text stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < len(ends):
            upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + max_bytes, "right"))
            upto = max(upto, at + 1)
            yield batch.slice(at, upto - at)
            at = upto
    release()


class Words:
    """The blank-separated words (`[^\\x20\\x09-\\x0D]+`) of a slice of texts.

    buf: all bytes, each text followed by one blank; start, end: of each word in buf; doc: its row in the slice;
    first: for each row its first word's number, with the number of all words at the end.
    """

    def __init__(self, batch: pa.RecordBatch, lower: bool = False):
        texts = batch.column("text").cast(pa.large_binary())
        parts = [x or b"" for x in texts.to_pylist()]
        buf = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
        self.buf = _LOWER[buf] if lower else buf
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        text_end = np.cumsum(lengths)
        blank = _IS_BLANK[self.buf]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if len(blank) and not blank[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.concatenate([[0], np.searchsorted(self.start, text_end)])
        self.doc = np.repeat(np.arange(len(parts)), np.diff(self.first))
        self.parts = parts

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
        """A 64-bit hash of each word's bytes; some words at a time, as the bytes are widened for it."""
        out = np.empty(len(self.start), _U)
        at = 0
        while at < len(out):
            upto = max(at + 1, int(np.searchsorted(self.end, self.start[at] + HASHED_BYTES, "right")))
            low, high = int(self.start[at]), int(self.end[upto - 1])
            up, down = powers(base, high - low)
            sums = np.zeros(high - low + 1, _U)
            sums[1:] = self.buf[low:high]
            sums[1:] += _U(1)
            sums[1:] *= up[: high - low]
            np.cumsum(sums, out=sums)
            start, end = self.start[at:upto] - low, self.end[at:upto] - low
            out[at:upto] = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(_U))
            at = upto
        return out

    def runs(self, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words, and which of the words start one within their text."""
        left = self.first[self.doc + 1] - np.arange(len(h)) if len(h) else np.zeros(0, np.int64)
        return windows(h, n), left >= n


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse for i < n, modulo 2**64 (base is odd)."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, HASHED_BYTES)
        make = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(size - 1, b, _U)]), dtype=_U)
        have = (make(base), make(pow(base, -1, 1 << 64)))
        if size <= 2 * SLICE_BYTES:
            _POWERS[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of h[i:i+n] for each i (at the end, where n aren't left, of what is left)."""
    out, done, power, width = None, 0, h, 1
    while width <= n:
        if n & width:
            if out is None:
                out = power
            else:
                out = mix(out * _U(0xD6E8FEB86659FD93) + shifted(power, done))
            done += width
        width *= 2
        if width <= n:
            power = mix(power * _U(0xA0761D6478BD642F) + shifted(power, width // 2))
    return out


def shifted(x: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros_like(x)
    if k < len(x):
        out[: len(x) - k] = x[k:]
    return out


def crc_remainder(id_col: str, modulus: int):
    """crc32 of the id as decimal text, modulo modulus."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def sample_ids(rows: DataFrame, n: int) -> list[tuple[int, object]]:
    """Of rows (d, cls) for each class the ids of the n smallest hashes (all, if there are fewer), with the class.

    Classes are counted, and then only rows under a bound on the hash that lets about 1.5 n pass reach the driver; so no
    task holds a class. Should fewer than n pass, those are the sample."""
    sizes = {r.cls: r["count"] for r in rows.groupBy("cls").count().collect()}
    if not sizes:
        return []
    limit = F.coalesce(*[F.when(F.col("cls") == c, F.lit(min((1 << 63) - 1, int((1.5 * n + 50) / k * 2**63)))) for c, k in sizes.items()])
    near = rows.select("d", "cls", F.shiftrightunsigned(F.xxhash64("d"), 1).alias("h")).filter(F.col("h") <= limit).distinct().collect()
    out, taken = [], dict.fromkeys(sizes, 0)
    for r in sorted(near, key=lambda r: (r.h, r.d)):
        if taken[r.cls] < n:
            taken[r.cls] += 1
            out.append((r.d, r.cls))
    return out
