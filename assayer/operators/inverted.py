"""A stored inverted index with block bounds and positions: BM25 that stops early, coverage and phrases without the texts.

Chunks are dealt into cells of CELL consecutive ones as they are read. The postings of a term in a cell are one row, so no term's
row grows with the chunks, and the rows of all terms in a cell cover the same chunks. A row carries bounds, the largest frequency
and the smallest length: with them, from these columns alone, no chunk of the cell can score more than a sum over the question's
terms. search() scores each question's most promising cells, takes the k-th best score there, and then scores only cells whose bound
reaches it. Rows are the same as those of retrieval.lexical_topk().

Files lie in folders by a hash of the term, so a search reads those of its terms. Bucket -1 has a row for each cell, with its
chunks. Null texts are empty; chunk_id is unique and not null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokenize
from .grouped import Best, small
from .retrieval import _raw, _terms, ranked
from .storage import scratch, stored

CELL, BUCKETS = 256, 64
#: Cells of each question that are scored before anything is left out.
FIRST_CELLS = 4


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _schema(key: str) -> str:
    return f"term string, cell long, n long, max_tf int, min_length long, chunk_ids array<{key}>, lengths array<long>, tfs array<int>, positions array<array<int>>"


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str

    def blocks(self) -> DataFrame:
        """term, cell, n, max_tf, min_length, chunk_ids, lengths, tfs, positions, bucket."""
        key = self.spark.read.parquet(f"{self.path}/meta").first().key
        return self.spark.read.schema(f"{_schema(key)}, bucket int").parquet(f"{self.path}/blocks")

    def of(self, terms: DataFrame) -> DataFrame:
        """The blocks in the buckets of some terms (term)."""
        return self.blocks().filter(F.col("bucket").isin([r[0] for r in terms.select(bucket_of(F.col("term"))).distinct().collect()]))

    def chunks(self) -> DataFrame:
        """chunk_id, length and cell of each chunk."""
        every = self.blocks().filter("bucket = -1").select("cell", F.explode(F.arrays_zip("chunk_ids", "lengths")).alias("x"))
        return every.select(F.col("x.chunk_ids").alias("chunk_id"), F.col("x.lengths").alias("length"), "cell")


def build(chunks: DataFrame, path: str, cell: int = CELL) -> Index:
    """Indexes chunks (chunk_id, text) at path, which is overwritten."""
    key = chunks.schema["chunk_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a in range(0, batch.num_rows, cell):
                part, of, lengths = batch.slice(a, cell), {}, []
                for row, text in enumerate(part.column("text").to_pylist()):
                    terms = _terms(text)
                    lengths.append(len(terms))
                    own: dict[str, list[int]] = {}
                    for i, t in enumerate(terms):
                        own.setdefault(t, []).append(i)
                    for t, places in own.items():
                        of.setdefault(t, []).append((row, places))
                of[None] = [(row, []) for row in range(part.num_rows)]
                posted = list(of.values())
                tfs = [[len(p) for _, p in x] for x in posted]
                own_lengths = [[lengths[row] for row, _ in x] for x in posted]
                flat = part.column("chunk_id").take(pa.array([row for x in posted for row, _ in x], pa.int32()))
                ends = [0]
                for x in posted:
                    ends.append(ends[-1] + len(x))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(list(of), pa.string()), pa.array([at] * len(of), pa.int64()), pa.array(list(map(len, posted)), pa.int64()), pa.array(list(map(max, tfs)), pa.int32()), pa.array(list(map(min, own_lengths)), pa.int64()),
                        ids, pa.array(own_lengths, pa.list_(pa.int64())), pa.array(tfs, pa.list_(pa.int32())), pa.array([[p for _, p in x] for x in posted], pa.list_(pa.list_(pa.int32()))),
                    ],
                    ["term", "cell", "n", "max_tf", "min_length", "chunk_ids", "lengths", "tfs", "positions"],
                )
                at += 1

    rows = chunks.select("chunk_id", "text").mapInArrow(run, _schema(key))
    rows = rows.withColumn("bucket", F.when(F.col("term").isNull(), -1).otherwise(bucket_of(F.col("term"))))
    # Large buckets are written by several tasks; in a file terms are in order, so its parts without a term are skipped.
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "cell").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")
    chunks.sparkSession.createDataFrame([(key,)], "key string").write.mode("overwrite").parquet(f"{path}/meta")
    return Index(chunks.sparkSession, path)


def _share(tf: str, length: str, mean: float, k1: float, b: float) -> Column:
    return F.col(tf) * (k1 + 1) / F.greatest(F.col(tf) + k1 * (1 - b + b * F.col(length) / F.lit(mean)), F.lit(1e-12))


class _Search:
    """The steps of one search; tables are stored in the scratch() around it."""

    def __init__(self, index: Index, queries: DataFrame, k: int, k1: float, b: float):
        self.k = max(1, k)
        asked = queries.select("query_id", F.explode(tokenize(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        asked = stored(asked, "asked")
        terms = small(asked.select("term").distinct())
        self.postings = index.of(asked).join(terms, "term", "left_semi")
        sums = index.blocks().filter("bucket = -1").agg(F.sum("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
        chunks, mean = sums[0] or 0, max(1.0, (sums[1] or 0) / sums[0] if sums[0] else 0.0)
        self.model = mean, k1, b
        bounds = stored(self.postings.select("term", "cell", "n", _share("max_tf", "min_length", mean, k1, b).alias("bound")), "bounds")
        df = bounds.groupBy("term").agg(F.sum("n").alias("df"))
        idf = F.ln(1 + (F.lit(chunks) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        self.weights = stored(asked.join(small(df), "term").select("query_id", "term", (F.col("qtf") * idf).alias("weight")), "weights")
        #: For each question and cell with one of its terms what a chunk there can score at most.
        self.cells = stored(bounds.join(small(self.weights), "term").groupBy("query_id", "cell").agg(F.sum(F.col("weight") * F.col("bound")).alias("most")), "cells")
        self.slack = self.weights.groupBy("query_id").agg((2e-6 * (k1 + 1) * F.sum("weight")).alias("slack"))

    def scored(self, cells: DataFrame) -> DataFrame:
        """query_id, chunk_id, raw: of the chunks in some cells of questions (query_id, cell) that share a term with them, for each
        cell what can be among a question's k best. A cell's postings and questions meet in one task; no posting is repeated."""
        k, (mean, k1, b) = self.k, self.model
        own = self.weights.groupBy("query_id").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"))
        wanted = cells.select("query_id", "cell").join(small(own), "query_id")
        rows = self.postings.select("term", "cell", "chunk_ids", "lengths", "tfs").join(small(cells.select("cell").distinct()), "cell", "left_semi")
        schema = f"query_id {wanted.schema['query_id'].dataType.simpleString()}, chunk_id {rows.schema['chunk_ids'].dataType.elementType.simpleString()}, raw double"
        none = cells.sparkSession.createDataFrame([], schema).toArrow()

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return none
            left, right = left.combine_chunks(), right.combine_chunks()
            flat = lambda t, c: pc.list_flatten(t[c].combine_chunks())
            of = lambda t, c: pc.list_parent_indices(t[c].combine_chunks()).to_numpy()
            coded, row = flat(left, "chunk_ids").dictionary_encode(), of(left, "chunk_ids")
            chunk, lengths = coded.indices.to_numpy(), np.zeros(len(coded.dictionary))
            lengths[chunk] = flat(left, "lengths").to_numpy()
            query, weight = of(right, "terms"), flat(right, "weights").to_numpy()
            slack = 2e-6 * (k1 + 1) * np.bincount(query, weight, right.num_rows)
            term = pc.index_in(flat(right, "terms"), left["term"].combine_chunks()).fill_null(-1).to_numpy()
            order = np.argsort(term, kind="stable")[np.count_nonzero(term < 0) :]
            first = np.searchsorted(term[order], np.arange(left.num_rows + 1))
            raw = _raw(right.num_rows, query[order], weight[order], first, chunk, row, flat(left, "tfs").to_numpy().astype(float), lengths, mean, k1, b)
            best = Best(k, slack)
            best.add(raw, coded.dictionary, 0.0)
            found = list(best.rows(["query_id", "chunk_id", "raw"], right["query_id"].combine_chunks()))
            return pa.Table.from_batches(found) if found else none

        return rows.groupBy("cell").cogroup(wanted.groupBy("cell")).applyInArrow(run, schema)

    def first(self) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.desc("most"), "cell")
        return self.cells.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= FIRST_CELLS).drop("_n")

    def rest(self, first: DataFrame, scored: DataFrame) -> DataFrame:
        """The other cells that can hold one of the k best."""
        w = Window.partitionBy("query_id").orderBy(F.desc("raw"))
        floor = scored.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == self.k).select("query_id", F.col("raw").alias("floor"))
        left = self.cells.join(small(first.select("query_id", "cell")), ["query_id", "cell"], "left_anti").join(small(self.slack), "query_id").join(small(floor), "query_id", "left")
        return left.filter(F.col("floor").isNull() | (F.col("most") * (1 + 1e-9) >= F.col("floor") - F.col("slack"))).select("query_id", "cell")


def search(index: Index, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, chunk_id, lexical_score, rank as of retrieval.lexical_topk(); stored when this is called."""
    with scratch(index.spark):
        s = _Search(index, queries, k, k1, b)
        first = stored(s.first(), "first")
        best = stored(s.scored(first), "best")
        more = s.scored(stored(s.rest(first, best), "rest"))
        return stored(ranked(best.unionByName(more), queries, index.chunks(), k), "ranked", keep=True)


def _ends(term: Column, sizes: list[int], kind: str) -> Column:
    """The parts of a term of the given lengths: at its begin, at its end, or anywhere."""
    at = F.array(*[F.lit(n) for n in sizes]) if sizes else F.array().cast("array<int>")
    fits = F.filter(at, lambda n: n <= F.length(term))
    if kind == "begin":
        return F.transform(fits, lambda n: F.substring(term, F.lit(1), n))
    if kind == "end":
        return F.transform(fits, lambda n: F.substring(term, F.length(term) - n + 1, n))
    return F.array_distinct(F.flatten(F.transform(fits, lambda n: F.transform(F.sequence(F.lit(1), F.length(term) - n + 1), lambda i: F.substring(term, i, n)))))


def matches(index: Index, pairs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, chunk_id, coverage and phrase of pairs (query_id, chunk_id), as text.coverage() and text.phrase_bonus() of the
    texts. A phrase begins with the end of a term and ends with the begin of one, as its tokens joined by blanks are sought in
    joined tokens: such terms are found among those of the pairs' cells, by equal parts; their positions meet where all fit."""
    with scratch(index.spark):
        asked = stored(queries.select("query_id", tokenize(F.col("query")).alias("q")), "asked")
        pairs = stored(pairs.select("query_id", "chunk_id").join(index.chunks().select("chunk_id", "cell"), "chunk_id"), "pairs")
        cells = small(pairs.select("cell").distinct())
        here = index.blocks().filter("bucket >= 0").join(cells, "cell", "left_semi")

        token = asked.select("query_id", F.size("q").alias("m"), F.length(F.array_join("q", " ")).alias("size"), F.posexplode("q").alias("slot", "token"))
        kind = F.when(F.col("m") == 1, "any").when(F.col("slot") == 0, "end").when(F.col("slot") == F.col("m") - 1, "begin").otherwise("whole")
        token = stored(token.withColumn("kind", kind), "tokens")
        sizes: dict[str, list[int]] = {}
        for r in token.filter("size >= 5").select("kind", F.length("token").alias("n")).distinct().collect():
            sizes.setdefault(r.kind, []).append(r.n)
        words = stored(here.select("term").distinct(), "words")
        parts = [words.select("term", F.lit(kind).alias("kind"), F.explode(_ends(F.col("term"), sorted(sizes[kind]), kind)).alias("token")) for kind in ("begin", "end", "any") if kind in sizes]
        every = words.select("term", F.lit("whole").alias("kind"), F.col("term").alias("token"))
        for part in parts:
            every = every.unionByName(part)
        slots = stored(token.filter("size >= 5").join(every, ["kind", "token"]).select("query_id", "m", "slot", "term"), "slots")

        zipped = here.select("term", "cell", F.arrays_zip("chunk_ids", "positions").alias("x"))
        distinct = token.select("query_id", F.col("token").alias("term")).distinct()

        def met(terms: DataFrame) -> DataFrame:
            """Places of the questions' terms in the pairs' chunks: blocks of the terms in their cells, then those chunks alone."""
            wanted = pairs.select("query_id", "cell").distinct().join(small(terms), "query_id")
            rows = zipped.join(small(wanted), ["term", "cell"]).withColumn("x", F.explode("x"))
            rows = rows.select(*terms.columns, F.col("x.chunk_ids").alias("chunk_id"), F.col("x.positions").alias("at"))
            return rows.join(small(pairs.select("query_id", "chunk_id").distinct()), ["query_id", "chunk_id"], "left_semi")

        covered = met(distinct).groupBy("query_id", "chunk_id").agg(F.count("*").alias("covered"))
        begun = met(slots).select("query_id", "chunk_id", "m", "slot", F.explode(F.transform("at", lambda i: i - F.col("slot"))).alias("begin"))
        found = begun.groupBy("query_id", "chunk_id", "m", "begin").agg(F.count_distinct("slot").alias("n")).filter("n = m").select("query_id", "chunk_id", F.lit(1.0).alias("phrase")).distinct()
        terms_of = asked.select("query_id", F.size(F.array_distinct("q")).alias("terms"))
        out = pairs.select("query_id", "chunk_id").join(terms_of, "query_id").join(covered, ["query_id", "chunk_id"], "left").join(found, ["query_id", "chunk_id"], "left")
        coverage = F.when(F.col("terms") > 0, F.coalesce("covered", F.lit(0)) / F.col("terms")).otherwise(F.lit(0.0))
        return stored(out.select("query_id", "chunk_id", coverage.alias("coverage"), F.coalesce("phrase", F.lit(0.0)).alias("phrase")), "matches", keep=True)
