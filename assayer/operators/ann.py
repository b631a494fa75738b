"""Approximate dense search: unit vectors in lists around coarse centres, stored by list; exact scores of the lists looked at.

Centres are fitted by spherical k-means on a bounded sample; every vector is indexed, in the list of its nearest centre. How many
lists a question looks at (probes) is measured when the index is built: on the sample, so many that at least TARGET of the
neighbours within it are met. The neighbours of a sample are farther away than those among all vectors, so this errs on the
side of more lists. Vectors without structure need many: that is measured as well (`share` of meta()).

Files lie in a folder for each list, so the lists that no question looks at aren't read. Null vectors are left out; a zero vector is
in the first list and has similarity 0 with all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import py_round
from .grouped import Best
from .retrieval import _ROUNDED, QUERY_BLOCK, _cosines, _top, _unit, _vectors
from .storage import scratch, stored

#: Vectors that the centres are fitted on, at most; questions among them that measure the probes; and neighbours of each.
SAMPLE, TRIED, NEAR = 20_000, 400, 10
LISTS, STEPS, TARGET = 256, 8, 0.96


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str

    def vectors(self) -> DataFrame:
        """chunk_id, vec (unit) and list."""
        return self.spark.read.schema(f"chunk_id {self.meta().key}, vec array<double>, list int").parquet(f"{self.path}/vectors")

    def meta(self):
        """One row: key (the type of chunk_id), centres (of each list), probes, and share (of the sample, in the lists that a
        question of it looks at)."""
        return self.spark.read.parquet(f"{self.path}/meta").first()


def centres(x: np.ndarray, lists: int, steps: int = STEPS) -> np.ndarray:
    """Spherical k-means, from evenly spaced rows; a centre without vectors stays."""
    c = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)] if len(x) else x
    for _ in range(steps):
        at = (x @ c.T).argmax(1) if len(x) else np.zeros(0, int)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(np.bincount(at, minlength=len(c))[:, None] > 0, _unit(sums), c)
    return c


def probes_for(x: np.ndarray, c: np.ndarray, target: float = TARGET) -> tuple[int, float]:
    """Lists to look at so that target of the NEAR neighbours are met, and the share of vectors in them; within the sample."""
    if len(x) < 2:
        return 1, 1.0
    asked = np.linspace(0, len(x) - 1, min(TRIED, len(x))).astype(int)
    at, sim = (x @ c.T).argmax(1), x[asked] @ x.T
    sim[np.arange(len(asked)), asked] = -2
    k = min(NEAR, len(x) - 1)
    near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    order = np.argsort(-(x[asked] @ c.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    need = np.sort(np.take_along_axis(place, at[near], axis=1).ravel())
    probes = int(need[min(len(need) - 1, int(np.ceil(target * len(need))) - 1)]) + 1
    sizes = np.bincount(at, minlength=len(c))
    return probes, float(sizes[order[:, :probes]].sum(1).mean() / len(x))


def build(chunks: DataFrame, path: str, lists: int = LISTS, sample: int = SAMPLE, target: float = TARGET) -> Index:
    """Indexes chunks (chunk_id, vec) at path, which is overwritten."""
    spark = chunks.sparkSession
    key = chunks.schema["chunk_id"].dataType.simpleString()
    rows = chunks.filter(F.col("vec").isNotNull()).select("chunk_id", F.col("vec").cast("array<double>").alias("vec"))
    with scratch(spark):
        rows = stored(rows, "rows")
        n = rows.count()
        near = F.shiftrightunsigned(F.xxhash64("chunk_id", "vec"), 1)
        limit = min((1 << 63) - 1, int(sample / max(1, n) * 2**63))
        some = sorted(rows.select(near.alias("h"), "vec").filter(F.col("h") <= limit).limit(2 * sample).collect())
        x = _unit(np.array([r.vec for r in some], float).reshape(len(some), len(some[0].vec) if some else 1))
        c = centres(x, lists)
        probes, share = probes_for(x, c, target)
        spark.createDataFrame([(key, c.tolist(), probes, share)], "key string, centres array<array<double>>, probes int, share double").write.mode("overwrite").parquet(f"{path}/meta")
        sent = spark.sparkContext.broadcast(c)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = _vectors(b)
                at = (v @ sent.value.T).argmax(1) if len(sent.value) else np.zeros(len(v), int)
                yield pa.RecordBatch.from_arrays([b.column("chunk_id"), pa.array(list(v), pa.list_(pa.float64())), pa.array(at, pa.int32())], ["chunk_id", "vec", "list"])

        told = rows.mapInArrow(run, f"chunk_id {key}, vec array<double>, list int")
        # Large lists are written by several tasks.
        told.hint("rebalance", "list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/vectors")
    return Index(spark, path)


def search(index: Index, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """query_id, chunk_id, dense_score, rank as of retrieval.dense_topk(), of the lists that each question looks at. What is
    found is stored when this is called; blocks of QUERY_BLOCK questions are taken in passes, each over its own lists."""
    meta, found = index.meta(), None
    if not meta.centres:
        nothing = queries.select("query_id", F.lit(None).cast(meta.key).alias("chunk_id"), F.lit(0.0).alias("dense_score"), F.lit(1).alias("rank"))
        return nothing.limit(0)
    c = np.array(meta.centres, float)
    probes = min(len(c), probes or meta.probes)
    kind, every = queries.schema["query_id"].dataType.simpleString(), index.vectors()
    with scratch(index.spark):
        asked = stored(queries.filter(F.col("vec").isNotNull()).select("query_id", F.col("vec").cast("array<double>").alias("vec")), "asked")
        for at in range(0, max(1, asked.count()), QUERY_BLOCK):
            t = asked.orderBy("query_id").offset(at).limit(QUERY_BLOCK).toArrow()
            q = _vectors(t) if len(t) else np.zeros((0, c.shape[1]))
            looks = np.zeros((len(q), len(c)), bool)
            np.put_along_axis(looks, np.argsort(-(q @ c.T), axis=1, kind="stable")[:, :probes], True, axis=1)
            sent = index.spark.sparkContext.broadcast((t["query_id"].combine_chunks(), q, looks))

            def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                ids, q, looks = sent.value
                best = Best(k, _ROUNDED)
                for b in batches:
                    lists = b.column("list").to_numpy()
                    for x in np.unique(lists):
                        part, who = b.filter(pa.array(lists == x)), np.flatnonzero(looks[:, x])
                        if len(who):
                            best.add(_cosines(q[who], _vectors(part)), part.column("chunk_id"), who=who)
                yield from best.rows(["query_id", "chunk_id", "sim"], ids)

            read = every.filter(F.col("list").isin(np.flatnonzero(looks.any(0)).tolist())).select("chunk_id", "vec", "list")
            one = read.mapInArrow(run, f"query_id {kind}, chunk_id {meta.key}, sim double")
            found = one if found is None else found.unionByName(one)
        found = stored(found, "found", keep=True)
    return _top(found.select("query_id", "chunk_id", py_round(F.col("sim"), 4).alias("dense_score")), k, ["query_id"], "dense_score")
