"""k-means over integer vectors, with exact distances only where block norms don't exclude a centroid.

A vector's components x become floor(64 x). It is stored with its compressed form, the norms of its SEGMENTS blocks of components,
which never changes. By the Cauchy-Schwarz inequality in each block, |x - c|**2 >= |x|**2 + |c|**2 - 2 sum(|x_s| |c_s|): of a
batch, that bound comes from one product of two small matrices, less a margin for its rounding. The centroid with the least
bound gets its exact distance first; only centroids whose bound isn't over the least exact distance so far get theirs, in
ascending order of their bounds, so ties are seen as well. Distances are int64 sums of squares.

Kept are vectors with exactly DIMENSIONS components, none null or not finite. A component beyond LIMIT in size (after scaling) stops
the job with an error, as its distances could overflow; sums over vectors are decimals. Repeated rows are vectors of their own. A
null id counts as the empty text in the hash that chooses the first centroids; equal hashes go by the vectors. With fewer vectors
than centroids there are only as many; without any, no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, scratch, stored

DIMENSIONS, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64
SEGMENTS = 16
#: With 64 components a squared distance stays under 2**63.
LIMIT = 1 << 27
#: Vectors handled at once.
_ROWS = 1 << 14


def kept(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, q (the integer components) and norms (of its blocks) of the vectors that count."""
    v = F.col(vec_col).cast("array<double>")
    rows = bounded(vectors).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.size("v") == DIMENSIONS)
    rows = rows.filter(F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))
    scaled = F.transform("v", lambda x: F.floor(F.when(F.abs(x) * SCALE <= LIMIT, x * SCALE).otherwise(F.raise_error(F.lit(f"a component is beyond {LIMIT} / {SCALE}")).cast("double"))))
    width = DIMENSIONS // SEGMENTS
    block = lambda s: F.sqrt(F.aggregate(F.slice("q", s * width + 1, width), F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return rows.select("vec_id", scaled.cast("array<int>").alias("q")).withColumn("norms", F.transform(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)), block))


def first_centroids(vectors: DataFrame, k: int, prefix: str = "1:") -> np.ndarray:
    """The vectors with the k smallest hashes of their ids."""
    name = F.sha2(F.concat(F.lit(prefix), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(name.alias("h"), "q").orderBy("h", "q").limit(k).collect()
    return np.array([r.q for r in rows], np.int64).reshape(len(rows), DIMENSIONS)


def nearest(x: np.ndarray, norms: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each vector (integers, and its block norms) the number of the nearest centroid (the smaller of equals) and the
    squared distance; and how many exact distances that took."""
    own = np.sqrt((c.astype(float) ** 2).reshape(len(c), SEGMENTS, -1).sum(2))
    size, other = (norms**2).sum(1), (own**2).sum(1)
    low = size[:, None] + other - 2 * norms @ own.T
    low -= 1e-9 * (size[:, None] + other) + 1e-6
    order = np.argsort(low, axis=1)
    best, at, asked = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64), 0
    open_ = np.arange(len(x))
    for step in range(len(c)):
        j = order[open_, step]
        going = low[open_, j] <= best[open_]
        open_, j = open_[going], j[going]  # bounds ascend, so what stops here is done
        if not len(open_):
            break
        asked += len(open_)
        d = ((x[open_] - c[j]) ** 2).sum(1)
        better = (d < best[open_]) | ((d == best[open_]) & (j < at[open_]))
        best[open_[better]], at[open_[better]] = d[better], j[better]
    return at, best, asked


def _numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    flat = lambda name: batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return flat("q").astype(np.int64), flat("norms")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for a in range(0, b.num_rows, _ROWS):
            yield b.slice(a, _ROWS)


def moved(vectors: DataFrame, c: np.ndarray) -> np.ndarray:
    """The centroids after one round: each task sends one row of sums for each centroid that got vectors."""
    sent = vectors.sparkSession.sparkContext.broadcast(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        sums, n = np.zeros(c.shape, np.int64), np.zeros(len(c), np.int64)
        for part in _parts(batches):
            x, norms = _numbers(part)
            at = nearest(x, norms, c)[0]
            n += np.bincount(at, minlength=len(c))
            for j in np.unique(at):
                sums[j] += x[at == j].sum(0)
        j = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(j), pa.array(n[j]), pa.array(list(sums[j]), pa.list_(pa.int64()))], ["j", "n", "sums"])

    each = vectors.mapInArrow(run, "j long, n long, sums array<long>")
    total = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(DIMENSIONS)]
    out = c.copy()
    for r in each.groupBy("j").agg(F.sum("n").alias("n"), *total).collect():
        out[r.j] = [int(r[f"s{i}"]) // r.n for i in range(DIMENSIONS)]
    return out


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance (squared, to its centroid), cluster_inertia and inertia (distances summed over the cluster and over
    all), centroid_sha256 (of the centroid's components, joined by commas) and exact_share (of all pairs of vectors and centroids
    in the last assignment, how many exact distances were computed) of every kept vector."""
    with scratch(vectors.sparkSession):
        every = stored(kept(vectors, id_col, vec_col), "vectors")
        c = first_centroids(every, k)
        for _ in range(rounds if len(c) else 0):
            c = moved(every, c)
        sent = vectors.sparkSession.sparkContext.broadcast(c)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _parts(batches):
                at, d, asked = nearest(*_numbers(part), sent.value)
                exact = np.zeros(len(at), np.int64)
                exact[:1] = asked
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(at.astype(np.int32)), pa.array(d), pa.array(exact)], ["vec_id", "cluster", "distance", "exact"])

        told = stored(every.mapInArrow(run, "vec_id long, cluster int, distance long, exact long"), "told")
        sums = told.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"), F.sum("exact").alias("e"), F.count("*").alias("n")).collect()
        inertia, share = sum(int(r.d) for r in sums), sum(r.e for r in sums) / max(1, len(c) * sum(r.n for r in sums))
        sha = lambda row: hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()
        rows = [(r.cluster, int(r.d), inertia, sha(c[r.cluster]), share) for r in sums]
        known = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, exact_share double")
        # At most k rows.
        out = told.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "exact_share")
        return stored(out, "clusters", keep=True)


def _oracle() -> str:
    """Components are rows (v, i, x) here; each round is four queries."""
    floor = lambda s, n: f"(({s}) - ((({s}) % ({n}) + ({n})) % ({n}))) // ({n})"
    steps = [
        f"""r as (select row_number() over () as v, vec_id, [floor({SCALE} * x::double)::bigint for x in embedding] as q from embeddings
             where len(embedding) = {DIMENSIONS} and len([x for x in embedding if x is null or not isfinite(x)]) = 0)""",
        f"c0 as (select row_number() over (order by sha256('1:' || coalesce(vec_id::varchar, '')), q) - 1 as j, q as c from r qualify j < {CENTROIDS})",
    ]
    distance = "list_sum([(a - b) * (a - b) for a, b in z])".replace("for a, b in z", "for ab in z").replace("a - b", "ab[1] - ab[2]")
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} as materialized (select v, vec_id, q, j, d from (select v, vec_id, q, j, {distance} as d from (select v, vec_id, q, j, list_zip(q, c) as z from r, c{i}))
            qualify row_number() over (partition by v order by d, j) = 1)""")
        if i < ROUNDS:
            steps.append(f"s{i} as (select j, i, {floor('sum(x)', 'count(*)')} as m from (select j, unnest(q) as x, unnest(range({DIMENSIONS})) as i from a{i}) group by j, i)")
            steps.append(f"c{i + 1} as materialized (select c.j, coalesce(m.q, c.c) as c from c{i} c left join (select j, list(m::bigint order by i) as q from s{i} group by j) m using (j))")
    return f"""with {', '.join(steps)}
        select vec_id, a.j::int as cluster, d::bigint as distance, sum(d) over (partition by a.j)::bigint as cluster_inertia, sum(d) over ()::bigint as inertia,
               sha256(array_to_string(c.c, ',')) as centroid_sha256
        from a{ROUNDS} a join c{ROUNDS} c using (j)"""


ORACLE = _oracle()
