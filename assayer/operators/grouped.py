"""Search within collections: blocks of a collection's questions meet parts of its chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a counted side is broadcast.
BROADCAST_ROWS = 500_000
#: About as many chunks and questions meet in a cell. A larger collection is dealt into several parts and blocks.
PART_CHUNKS, BLOCK_QUERIES = 1 << 14, 1 << 11
#: Pairs up to which a Best isn't pruned; beyond, it holds at most twice what its questions may keep.
LEAST_HELD = 1 << 13


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


class Best:
    """The k best chunks of each question over many batches, and those whose score is no further than slack from the k-th."""

    def __init__(self, k: int, slack: float | np.ndarray):
        self.k, self.slack, self.held, self.size, self.kept, self.floor = k, slack, [], 0, 0, np.zeros(0)

    def add(self, scores: np.ndarray, ids: pa.Array, over: float = -np.inf, who: np.ndarray | None = None) -> None:
        """scores: of questions (all, or those numbered in who) by chunks; only those above `over` count."""
        slack = self.slack if who is None or not np.ndim(self.slack) else self.slack[who]
        floor = np.full(len(scores), -np.inf)
        if scores.shape[1] > self.k:
            floor = np.partition(scores, -self.k, axis=1)[:, -self.k] - slack
        last = len(scores) if who is None else int(who.max(initial=-1)) + 1
        if last > len(self.floor):
            self.floor = np.concatenate([self.floor, np.full(last - len(self.floor), -np.inf)])
        floor = np.maximum(floor, self.floor[:last] if who is None else self.floor[who])
        i, j = np.nonzero((scores >= floor[:, None]) & (scores > over))
        if not len(i):
            return
        # Numbers of questions in four bytes; a task holds two of these for each collection.
        self.held.append(((i if who is None else who[i]).astype(np.int32), ids.take(pa.array(j)), scores[i, j]))
        self.size += len(i)
        if self.size > max(LEAST_HELD, 2 * self.k * len(scores), 2 * self.kept):
            self._prune()

    def _prune(self) -> None:
        i, score = (np.concatenate([x[n] for x in self.held]) for n in (0, 2))
        ids = pa.concat_arrays([x[1] for x in self.held])
        order = pc.sort_indices(pa.table({"i": i, "score": score, "id": ids}), [("i", "ascending"), ("score", "descending"), ("id", "ascending")]).to_numpy()
        i, score, n = i[order], score[order], np.arange(len(i))
        begin = lambda change: np.maximum.accumulate(np.where(np.concatenate([[True], change]), n, 0)) if len(n) else n
        first, same = begin(i[1:] != i[:-1]), begin((i[1:] != i[:-1]) | (score[1:] != score[:-1]))
        last = np.minimum(first + self.k - 1, np.searchsorted(i, i, "right") - 1)
        # Of equal scores the k smallest ids are enough; so copies don't pile up.
        enough = n - first == self.k - 1
        # From now on only what reaches the k-th best of a question is looked at.
        self.floor[i[enough]] = score[enough] - (self.slack[i[enough]] if np.ndim(self.slack) else self.slack)
        keep = (n - same < self.k) & (score >= score[last] - (self.slack[i] if np.ndim(self.slack) else self.slack))
        self.held = [(i[keep], ids.take(pa.array(order[keep])), score[keep])]
        self.size = self.kept = int(keep.sum())

    def rows(self, names: list[str], questions: pa.Array, collection: pa.Scalar | None = None) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._prune()
            (i, ids, score), = self.held
            cols = [questions.take(pa.array(i)), ids, pa.array(score)]
            yield pa.RecordBatch.from_arrays([*([pa.repeat(collection, len(i))] if collection is not None else []), *cols], names)


def dealt(queries: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with `part` and `block` added, and repeated, so that each question of a collection is in one cell with each of
    its chunks. Collections without questions or chunks go. Chunks are repeated for each block of questions, and these for each
    part, as in a product of matrices in blocks; a cell holds about PART_CHUNKS and BLOCK_QUERIES rows, whatever the collection."""
    c = chunks.groupBy("collection").agg(F.ceil(F.count("*") / PART_CHUNKS).alias("parts"))
    q = queries.groupBy("collection").agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("blocks"))
    cells = small(c.join(small(q), "collection"))
    number = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).alias(n[:-1])
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(n[:-1])
    side = lambda df, *more: df.join(cells, "collection").select(*[df[x] for x in df.columns], *more)
    return side(queries, number("query_id", "blocks"), every("parts")), side(chunks, number("chunk_id", "parts"), every("blocks"))


def met(queries: DataFrame, chunks: DataFrame, score: Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]], out: str) -> DataFrame:
    """collection, query_id, chunk_id and out (double): what score(chunks, questions) gives for each cell of dealt(). Both are
    stored tables, as they are read twice."""
    asked, parts = dealt(queries, chunks)
    kind, key = (df.schema[n].dataType.simpleString() for df, n in ((queries, "query_id"), (chunks, "chunk_id")))
    schema = f"collection string, query_id {kind}, chunk_id {key}, {out} double"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return none
        found = list(score(left, right))
        return pa.Table.from_batches(found) if found else none

    none = chunks.sparkSession.createDataFrame([], schema).toArrow()
    cell = ["collection", "part", "block"]
    return parts.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInArrow(run, schema)
