"""Lexical, dense and hybrid retrieval for whole batches of queries.

queries: query_id, query (and vec for dense); chunks: chunk_id, text (and vec). Statistics are those of the chunks given.

With `collection` columns on both sides every mode keeps collections apart: blocks of a collection's questions meet parts of
its chunks (grouped.py), statistics are of the collection, and ids need be unique within it alone. A null collection is none: it
is never searched.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clamp, py_round
from ..functions.text import LOWERED, STOP_WORDS, joined_phrase, token_coverage, token_phrase, tokenize
from .grouped import BROADCAST_ROWS, Best, met, small
from .storage import release, scratch, small_batches, stored

#: Query vectors held at once in a task; more are taken in further passes.
QUERY_BLOCK = 4096
#: The same for lexical queries, and cells of queries and chunks scored at once.
LEXICAL_BLOCK = 1 << 15
#: Bytes of query vectors that are broadcast at once.
VECTOR_BYTES = 32 << 20
_CELLS = 1 << 22
MODES = ("dense", "lexical", "hybrid")


def _by(queries: DataFrame, chunks: DataFrame) -> list[str]:
    return ["collection"] if "collection" in chunks.columns and "collection" in queries.columns else []


def term_stats(chunks: DataFrame) -> DataFrame:
    """term, df, total_tf over all chunks."""
    tf = chunks.select("chunk_id", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total_tf"))


def lengths(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", F.size(tokenize(F.col("text"))).alias("length"))


def bm25(queries: DataFrame, chunks: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, chunk_id, score (over the query's best, 6 digits) of all chunks that share a term with the query: its result
    is as large as there are such pairs. lexical_topk() doesn't make them all, but for collections.

    Postings of the queries' terms alone leave a task, summed by chunk before the shuffle."""
    by = _by(queries, chunks)
    q = queries.select(*by, "query_id", F.explode(tokenize(F.col("query"))).alias("term")).groupBy(*by, "query_id", "term").agg(F.count("*").alias("qtf"))
    terms = small(q.select(*by, "term").distinct())
    tokens = chunks.select(*by, "chunk_id", tokenize(F.col("text")).alias("tokens"))
    sizes = tokens.groupBy(*by).agg(F.count("*").alias("n"), F.greatest(F.lit(1.0), F.avg(F.size("tokens"))).alias("mean_length"))
    posting = tokens.select(*by, "chunk_id", F.size("tokens").alias("length"), F.explode("tokens").alias("term")).join(terms, [*by, "term"])
    tf = posting.groupBy(*by, "chunk_id", "length", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy(*by, "term").agg(F.count("*").alias("df"))
    weighed = (q.join(df, [*by, "term"]).join(F.broadcast(sizes), by) if by else q.join(df, "term").crossJoin(F.broadcast(sizes)))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = small(weighed.select(*by, "query_id", "term", "qtf", "mean_length", idf.alias("idf")))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / F.greatest(F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")), F.lit(1e-12))
    raw = tf.join(weighed, [*by, "term"]).groupBy(*by, "query_id", "chunk_id").agg(F.sum(F.col("qtf") * part).alias("raw"))
    best = raw.groupBy(*by, "query_id").agg(F.max("raw").alias("best"))
    return raw.join(best, [*by, "query_id"]).filter("best > 0").select(*by, "query_id", "chunk_id", py_round(F.col("raw") / F.col("best"), 6).alias("score"))


def _top(scored: DataFrame, k: int, by: list[str], score: str = "score") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(score), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


_TOKEN = re.compile("[a-zA-Z0-9]+")
_STOP = frozenset(STOP_WORDS)


def _terms(text: str | None) -> list[str]:
    """As tokenize()."""
    return [t for t in " ".join(_TOKEN.findall(text or "")).lower().split() if t not in _STOP]


_STOPPED = {w.encode(): -1 for w in STOP_WORDS}


def _postings(texts: pa.Array, number: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of the texts in tokens; and row, term and count of the numbered terms in them. number: with _STOPPED."""
    lengths, sizes, terms, counts = [], [], [], []
    for t in texts.cast(pa.binary()).to_pylist():
        tokens = (t or b"").translate(LOWERED).split()
        found = Counter(map(number.get, tokens))
        found.pop(None, None)
        lengths.append(len(tokens) - found.pop(-1, 0))
        sizes.append(len(found))
        terms.extend(found)
        counts.extend(found.values())
    return np.array(lengths, np.int64), np.repeat(np.arange(len(sizes)), sizes), np.array(terms, np.int64), np.array(counts, np.float64)


@dataclass
class _Asked:
    """The questions of one collection. own: the numbers of their terms; query, term (its place in own) and n: what each asks
    for. at and vectors: those that have a vector. Once chunks are counted: their mean length, and as of _weights()."""

    ids: pa.Array
    own: np.ndarray
    query: np.ndarray
    term: np.ndarray
    n: np.ndarray
    at: np.ndarray
    vectors: np.ndarray | None
    mean: float = 1.0
    weights: tuple | None = None
    most: np.ndarray | None = None

    def places(self, term: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray | slice]:
        """Places in own of numbered terms, and which of them are there. terms: how many there are in all."""
        if len(self.own) == terms or not len(self.own):
            return term[: len(term) if len(self.own) else 0], slice(None) if len(self.own) else slice(0)
        at = np.minimum(np.searchsorted(self.own, term), len(self.own) - 1)
        here = self.own[at] == term
        return at[here], here


def _questions(block: pa.Table) -> tuple[dict[str | None, _Asked], dict[bytes, int]]:
    """Questions by collection (None: there are none), and numbers of all their terms."""
    texts = block["query"].to_pylist() if "query" in block.column_names else [None] * len(block)
    counted = {t: Counter(_terms(t)) for t in set(texts)}
    number = {t: i for i, t in enumerate(sorted({t for w in counted.values() for t in w}))}
    numbered = {t: (np.array([number[x] for x in w], np.int64), np.array(list(w.values()), float)) for t, w in counted.items()}
    rows: dict[str | None, list[int]] = {}
    for i, c in enumerate(block["collection"].to_pylist() if "collection" in block.column_names else [None] * len(block)):
        rows.setdefault(c, []).append(i)
    groups = {}
    for c, own_rows in rows.items():
        part = block.take(pa.array(own_rows)).combine_chunks()
        asked = [numbered[texts[i]] for i in own_rows]
        term, n = np.concatenate([x[0] for x in asked]), np.concatenate([x[1] for x in asked])
        own, at = np.unique(term, return_inverse=True)
        where, vectors = np.zeros(0, np.int64), None
        if "vec" in block.column_names:
            valid = pc.is_valid(part["vec"])
            where = np.flatnonzero(valid.to_numpy())
            vectors = _vectors(part.filter(valid).combine_chunks()) if len(where) else None
        ids = part["query_id"]
        groups[c] = _Asked(ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids, own, np.repeat(np.arange(len(asked)), [len(x[0]) for x in asked]), at, n, where, vectors)
    return groups, {t.encode(): i for t, i in number.items()}


def _apart(batch: pa.RecordBatch, groups: dict[str | None, _Asked]) -> Iterator[tuple[str | None, pa.RecordBatch]]:
    """The rows of each collection that is asked in."""
    if "collection" not in batch.schema.names:
        if None in groups:
            yield None, batch
        return
    coded = batch.column("collection").dictionary_encode()
    code = coded.indices.fill_null(-1).to_numpy()
    order = np.argsort(code, kind="stable")
    ends = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))
    for i, c in enumerate(coded.dictionary.to_pylist()):
        if c in groups:
            yield c, batch.take(pa.array(order[ends[i] : ends[i + 1]]))


def _count(chunks: DataFrame, groups: dict[str | None, _Asked], number: dict[bytes, int], k1: float, b: float) -> None:
    """Weighs the questions' terms by the chunks of their collection, of which a task tells the numbers for these terms alone."""
    sent = chunks.sparkSession.sparkContext.broadcast((groups, number))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, number = sent.value
        known, held = number | _STOPPED, {}
        for batch in batches:
            for c, part in _apart(batch, groups):
                g, (lengths, _, term, _) = groups[c], _postings(part.column("text"), known)
                # Behind the terms: chunks, and the sum of their lengths.
                n = held.setdefault(c, np.zeros(len(g.own) + 2, np.int64))
                n[: len(g.own)] += np.bincount(g.places(term, len(number))[0], minlength=len(g.own))
                n[-2:] += len(lengths), lengths.sum()
        for c, n in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(n), pa.string()), pa.array(np.arange(len(n))), pa.array(n)], ["c", "at", "n"])
        release()

    columns = [x for x in ("collection", "text") if x in chunks.columns]
    told = chunks.select(columns).mapInArrow(run, "c string, at long, n long").groupBy("c", "at").agg(F.sum("n").alias("n")).toArrow()
    totals = {c: np.zeros(len(g.own) + 2) for c, g in groups.items()}
    coded = told["c"].combine_chunks()
    who, at, n = coded.to_pylist(), told["at"].to_numpy(), told["n"].to_numpy()
    for c, i, x in zip(who, at, n, strict=True):
        totals[c][i] = x
    for c, g in groups.items():
        _weighed(g, totals[c], k1)


def _weighed(g: _Asked, total: np.ndarray, k1: float) -> _Asked:
    """g, with its terms weighed. total: of each the chunks that have it; behind them all chunks, and the sum of their lengths."""
    df, chunks, length = total[:-2], total[-2], total[-1]
    g.mean = max(1.0, length / chunks if chunks else 0.0)
    weight = g.n * np.log(1 + (chunks - df + 0.5) / (df + 0.5))[g.term]
    order = np.argsort(g.term, kind="stable")
    g.weights = g.query[order], weight[order], np.searchsorted(g.term[order], np.arange(len(g.own) + 1))
    g.most = np.bincount(g.query, weight * (k1 + 1), len(g.ids))
    return g


def _here(asked: DataFrame, chunks: DataFrame, k: int, block: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, chunk_id, raw and sim (one of them null), by collection if there is one: of each task's chunks the k best of each
    question by terms (where it has a query) and by vectors (where it has one), and all that could round to them. Chunks are
    scored where they are read: no pair of question and chunk is shuffled but these. Statistics are of all chunks."""
    spark, found = chunks.sparkSession, None
    by = [x for x in ("collection",) if x in asked.columns]
    lexical, dense = "query" in asked.columns, "vec" in asked.columns
    asked, total = asked.orderBy(*by, "query_id"), asked.count()
    kind, key = asked.schema["query_id"].dataType.simpleString(), chunks.schema["chunk_id"].dataType.simpleString()
    chunks = small_batches(chunks).select(*[F.col(c).cast("string") for c in by], "chunk_id", *["text"] * lexical, *[F.col("vec").cast("array<double>").alias("vec")] * dense)
    for start in range(0, max(total, 1), block):
        groups, number = _questions(asked.offset(start).limit(block).toArrow())
        if lexical:
            _count(chunks.drop("vec"), groups, number, k1, b)
        sent = spark.sparkContext.broadcast((groups, number))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            groups, number = sent.value
            known, best = number | _STOPPED, {}
            for batch in batches:
                for c, rows in _apart(batch, groups):
                    g = groups[c]
                    if c not in best:
                        best[c] = Best(k, 2e-6 * g.most if lexical else 0.0), Best(k, _ROUNDED)
                    size = max(1, _CELLS // max(1, len(g.ids)))
                    for a in range(0, rows.num_rows, size):
                        part = rows.slice(a, size)
                        if lexical:
                            lengths, row, term, tf = _postings(part.column("text"), known)
                            at, here = g.places(term, len(number))
                            if len(at):
                                best[c][0].add(_raw(len(g.ids), *g.weights, row[here], at, tf[here], lengths, g.mean, k1, b), part.column("chunk_id"), 0.0)
                        if g.vectors is not None:
                            part = part.filter(pc.is_valid(part.column("vec")))
                            if part.num_rows:
                                best[c][1].add(_cosines(g.vectors, _vectors(part)), part.column("chunk_id"), who=g.at)
            # What has been passed on is let go, and an idle worker holds none of it.
            for c in list(best):
                terms, vectors = best.pop(c)
                for which, x in (("raw", terms), ("sim", vectors)):
                    for r in x.rows(["q", "c", which], groups[c].ids):
                        no = pa.nulls(r.num_rows, pa.float64())
                        scores = [r.column(2), no] if which == "raw" else [no, r.column(2)]
                        yield pa.RecordBatch.from_arrays([*[pa.repeat(pa.scalar(c, pa.string()), r.num_rows) for _ in by], r.column(0), r.column(1), *scores], [*by, "query_id", "chunk_id", "raw", "sim"])
            release()

        one = chunks.mapInArrow(run, f"{'collection string, ' if by else ''}query_id {kind}, chunk_id {key}, raw double, sim double")
        found = one if found is None else found.unionByName(one)
    return found


def _weights(wanted: list[dict[str, float]], number: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By term: its questions and their weights, and where each term's begin."""
    of = sorted((number[t], q, c) for q, w in enumerate(wanted) for t, c in w.items())
    term, query, weight = (np.array(x) for x in zip(*of, strict=True)) if of else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return query, weight, np.searchsorted(term, np.arange(len(number) + 1))


def _raw(asked: int, query: np.ndarray, weight: np.ndarray, first: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray, lengths: np.ndarray, mean: float, k1: float, b: float) -> np.ndarray:
    """Scores of all questions for some chunks, from the chunks' postings (row, term, tf)."""
    share = tf * (k1 + 1) / np.maximum(tf + k1 * (1 - b + b * lengths[row] / mean), 1e-12)
    many = first[term + 1] - first[term]
    each = np.repeat(np.arange(len(row)), many)
    place = first[term[each]] + np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
    return np.bincount(query[place] * len(lengths) + row[each], weight[place] * share[each], asked * len(lengths)).reshape(asked, -1)


def _tokens(chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """collection, chunk_id, length (of all terms), terms and tfs of each chunk: of the terms asked for, if these are few."""
    key = chunks.schema["chunk_id"].dataType.simpleString()
    some = asked.limit(BROADCAST_ROWS + 1).toArrow()["term"].to_pylist()
    wanted = chunks.sparkSession.sparkContext.broadcast(frozenset(some) if len(some) <= BROADCAST_ROWS else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [Counter(_terms(t)) for t in b.column("text").to_pylist()]
            lengths = pa.array([sum(c.values()) for c in counts], pa.int64())
            if (few := wanted.value) is not None:
                counts = [{t: n for t, n in c.items() if t in few} for c in counts]
            yield pa.RecordBatch.from_arrays(
                [b.column("collection"), b.column("chunk_id"), lengths, pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))],
                ["collection", "chunk_id", "length", "terms", "tfs"],
            )

    return chunks.select(F.col("collection").cast("string"), "chunk_id", "text").mapInArrow(run, f"collection string, chunk_id {key}, length long, terms array<string>, tfs array<long>")


def _lexical_cell(left: pa.Table, right: pa.Table, k: int, k1: float, b: float) -> Iterator[pa.RecordBatch]:
    """Chunks (as _tokens()) and questions (terms, weights, mean_length) of one collection."""
    left, right = left.combine_chunks(), right.combine_chunks()
    wanted = [dict(zip(t, w, strict=True)) for t, w in zip(right["terms"].to_pylist(), right["weights"].to_pylist(), strict=True)]
    every = sorted({t for w in wanted for t in w})
    query, weight, first = _weights(wanted, {t: i for i, t in enumerate(every)})
    most = np.bincount(query, weight * (k1 + 1), len(wanted)) if len(query) else np.zeros(len(wanted))
    best, size, known = Best(k, 2e-6 * most), max(1, _CELLS // max(1, len(wanted))), pa.array(every, pa.string())
    for a in range(0, left.num_rows, size):
        part = left.slice(a, size).combine_chunks()
        term = pc.index_in(pc.list_flatten(part["terms"]), known)
        row, tf = pc.list_parent_indices(part["terms"]).to_numpy(), pc.list_flatten(part["tfs"]).to_numpy()
        here = pc.is_valid(term).to_numpy()
        if here.any():
            raw = _raw(len(wanted), query, weight, first, row[here], term.drop_null().to_numpy(), tf[here].astype(float), part["length"].to_numpy(), right["mean_length"][0].as_py(), k1, b)
            best.add(raw, part["chunk_id"].combine_chunks(), 0.0)
    return best.rows(["collection", "query_id", "chunk_id", "raw"], right["query_id"].combine_chunks(), left["collection"][0])


def _lexical_grouped(queries: DataFrame, chunks: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """As _here() by terms, for more questions than are broadcast: chunks are cut into tokens once, and go to where their collection's questions are."""
    q = queries.select(F.col("collection").cast("string"), "query_id", F.explode(tokenize(F.col("query"))).alias("term")).groupBy("collection", "query_id", "term").agg(F.count("*").alias("qtf"))
    q = stored(q.filter("collection is not null"), "asked")
    tokens = stored(_tokens(chunks.join(small(q.select("collection").distinct()), "collection", "left_semi"), q.select("term").distinct()), "tokens")
    sizes = tokens.groupBy("collection").agg(F.count("*").alias("n"), F.greatest(F.lit(1.0), F.avg("length")).alias("mean_length"))
    posting = tokens.select("collection", F.explode("terms").alias("term")).join(small(q.select("collection", "term").distinct()), ["collection", "term"], "left_semi")
    df = posting.groupBy("collection", "term").agg(F.count("*").alias("df"))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = q.join(small(df), ["collection", "term"]).join(small(sizes), "collection")
    weighed = weighed.groupBy("collection", "query_id").agg(F.collect_list("term").alias("terms"), F.collect_list(F.col("qtf") * idf).alias("weights"), F.first("mean_length").alias("mean_length"))
    return met(stored(weighed, "weighed"), tokens, lambda left, right: _lexical_cell(left, right, k, k1, b), "raw")


def _vector_rows(df: DataFrame, by: list[str], key: str) -> DataFrame:
    return df.filter(F.col("vec").isNotNull()).select(*[F.col(c).cast("string") for c in by], key, F.col("vec").cast("array<double>").alias("vec"))


def _lists(queries: DataFrame, chunks: DataFrame, k: int, lexical: bool, dense: bool, **kw) -> tuple[DataFrame | None, DataFrame | None]:
    """What can be among each question's k best: by terms (raw), and by vectors (sim). Stored.

    Questions are broadcast, and chunks scored where they are read; within collections so long as all questions fit one
    block, else blocks of a collection's questions meet parts of its chunks."""
    by, spark = _by(queries, chunks), chunks.sparkSession
    with scratch(spark):
        asked = queries.select(*[F.col(c).cast("string") for c in by], "query_id", *["query"] * lexical, *[F.col("vec").cast("array<double>").alias("vec")] * dense)
        asked = stored(asked.filter("collection is not null") if by else asked, "asked")
        block = LEXICAL_BLOCK
        if dense:
            first = asked.filter("vec is not null").select(F.size("vec").alias("n")).first()
            block = min(block if by else QUERY_BLOCK, max(1, VECTOR_BYTES // (8 * max(1, first.n if first else 1))))
        if by and asked.limit(block + 1).count() > block:
            x = stored(_lexical_grouped(asked, chunks.drop("vec"), k, **kw), "lexical", keep=True) if lexical else None
            d = None
            if dense:
                vectors = [stored(_vector_rows(df, by, i), i) for df, i in ((asked, "query_id"), (chunks, "chunk_id"))]
                d = stored(met(*vectors, lambda left, right: _dense_cell(left, right, k), "sim"), "dense", keep=True)
            return x, d
        found = stored(_here(asked, chunks, k, block, **kw), "best", keep=True)
    return tuple(found.filter(f"{n} is not null").select(*by, "query_id", "chunk_id", n) if on else None for n, on in (("raw", lexical), ("sim", dense)))


def lexical_topk(queries: DataFrame, chunks: DataFrame, k: int, **kw) -> DataFrame:
    """query_id, chunk_id, lexical_score (4 digits), rank. Chunks without a common term fill up to k by id; at least one.

    What is scored is stored when this is called."""
    return ranked(_lists(queries, chunks, max(1, k), True, False, **kw)[0], queries, chunks, k)


def ranked(raw: DataFrame, queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """As lexical_topk(), from raw, which holds each question's best and all that may round to them. Of chunks only ids are read,
    and only if a question has fewer than k with a common term."""
    by, k = _by(queries, chunks), max(1, k)
    best = F.max("raw").over(Window.partitionBy(*by, "query_id"))
    scored = raw.select(*by, "query_id", "chunk_id", py_round(F.col("raw") / best, 6).alias("score"))
    scored = _top(scored, k, [*by, "query_id"])
    full = scored.filter(F.col("rank") == k).select(*by, "query_id")
    short = queries.select(*by, "query_id").join(full, [*by, "query_id"], "left_anti")
    if not short.isEmpty():
        scored = scored.drop("rank")
        if by:
            first = _top(chunks.select(*by, "chunk_id").withColumn("score", F.lit(0.0)), k, by).select(*by, "chunk_id")
            pad = short.join(first, by)
        else:
            pad = short.crossJoin(F.broadcast(chunks.select("chunk_id").orderBy("chunk_id").limit(k)))
        rest = pad.join(scored, [*by, "query_id", "chunk_id"], "left_anti").withColumn("score", F.lit(0.0))
        scored = _top(scored.unionByName(rest), k, [*by, "query_id"])
    return scored.select(*by, "query_id", "chunk_id", py_round(F.col("score"), 4).alias("lexical_score"), "rank")


def _vectors(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    v = batch.column("vec")
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    return _unit(np.asarray(v.flatten(), float).reshape(batch.num_rows, -1))


def _cosines(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.clip(q @ d.T, -1, 1)


#: Scores are compared after rounding: whatever may round to the k-th best goes on.
_ROUNDED = 1e-4


def _dense_cell(left: pa.Table, right: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
    best, q = Best(k, _ROUNDED), _vectors(right)
    for a in range(0, left.num_rows, QUERY_BLOCK):
        part = left.slice(a, QUERY_BLOCK).combine_chunks()
        best.add(_cosines(q, _vectors(part)), part["chunk_id"].combine_chunks())
    return best.rows(["collection", "query_id", "chunk_id", "sim"], right["query_id"].combine_chunks(), left["collection"][0])


def dense_topk(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, dense_score (cosine, 4 digits, from -1 to 1), rank: exact, ties by id. A null vector is never
    found; a zero vector has similarity 0.

    Similarities that can be among the k best are stored when this is called, so that vectors are made once."""
    return _nearest(_lists(queries, chunks, k, False, True)[1], k, _by(queries, chunks))


def _nearest(found: DataFrame, k: int, by: list[str]) -> DataFrame:
    scored = found.select(*by, "query_id", "chunk_id", py_round(F.col("sim"), 4).alias("dense_score"))
    return _top(scored, k, [*by, "query_id"], "dense_score")


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


def rrf(dense_rank: Column, lexical_rank: Column, k: int = 60) -> Column:
    """Reciprocal-rank fusion of two lists; a null rank adds nothing."""
    of = lambda r: F.coalesce(F.lit(1.0) / (k + r), F.lit(0.0))
    return of(dense_rank) + of(lexical_rank)


def rerank(query: Column, text: Column, dense: Column, lexical: Column, fused: Column, dense_weight: float = 0.6, rerank_weight: float = 0.2) -> Column:
    """Weighted similarity blended with term coverage, phrase and rank fusion; 0 to 1, 6 digits."""
    return rerank_tokens(tokenize(query), tokenize(text), dense, lexical, fused, dense_weight, rerank_weight)


def rerank_tokens(query: Column, text: Column, dense: Column, lexical: Column, fused: Column, dense_weight: float = 0.6, rerank_weight: float = 0.2) -> Column:
    """As rerank(), of arrays of tokens."""
    return _blended(token_coverage(query, text), token_phrase(query, text), dense, lexical, fused, dense_weight, rerank_weight)


def _blended(coverage: Column, phrase: Column, dense: Column, lexical: Column, fused: Column, dense_weight: float, rerank_weight: float) -> Column:
    w, r = min(1.0, max(0.0, dense_weight)), min(1.0, max(0.0, rerank_weight))
    base = w * F.greatest(F.lit(0.0), dense) + (1.0 - w) * F.greatest(F.lit(0.0), lexical)
    signal = 0.55 * coverage + 0.25 * phrase + 0.20 * F.least(F.lit(1.0), fused * 30.5)
    return py_round(clamp((1.0 - r) * base + r * signal), 6)


def hybrid_topk(queries: DataFrame, chunks: DataFrame, k: int, dense_weight: float = 0.6, rerank_weight: float = 0.2, rrf_k: int = 60, lexical_candidates: int = 40, texts: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """query_id, chunk_id, dense_score, lexical_score, rerank_score, rank: both lists merged, each to its depth.

    The result is stored when this is called; so an embedder that made the vectors sees each text once. texts: where chunks are
    costly to make, what gives the texts of some (chunk_id, and collection if there is one) without making all."""
    by, depth = _by(queries, chunks), _depth(k, lexical_candidates)
    with scratch(chunks.sparkSession):
        raw, sim = _lists(queries, chunks, depth, True, True)
        d, x = _nearest(sim, depth, by), ranked(raw, queries.drop("vec"), chunks.drop("vec"), depth)
        return stored(_merged(d, x, queries, chunks, k, by, dense_weight, rerank_weight, rrf_k, texts), "hybrid", keep=True)


def _depth(k: int, lexical_candidates: int = 40) -> int:
    return max(3 * k, k, lexical_candidates)


def _fused(d: DataFrame, x: DataFrame, pair: list[str], rrf_k: int) -> DataFrame:
    both = d.withColumnRenamed("rank", "dense_rank").join(x.withColumnRenamed("rank", "lexical_rank"), pair, "full_outer")
    return both.withColumn("fused", rrf(F.col("dense_rank"), F.col("lexical_rank"), rrf_k)).fillna(0.0, ["dense_score", "lexical_score"])


def _merged(d: DataFrame, x: DataFrame, queries: DataFrame, chunks: DataFrame, k: int, by: list[str], dense_weight: float = 0.6, rerank_weight: float = 0.2, rrf_k: int = 60, texts: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """As hybrid_topk(), from both lists."""
    pair = [*by, "query_id", "chunk_id"]
    both = stored(_fused(d, x, pair, rrf_k), "merged")
    # Of the candidates alone the texts are cut into tokens, each once; a text meets all its questions, so it is moved once at most.
    own = small(both.groupBy(*by, "chunk_id").agg(F.collect_list(F.struct("query_id", "dense_score", "lexical_score", "fused")).alias("_c")))
    some = chunks if texts is None else texts(both.select(*by, "chunk_id").distinct())
    each = some.select(*by, "chunk_id", "text").join(own, [*by, "chunk_id"]).select(*by, "chunk_id", F.array_join(tokenize(F.col("text")), " ").alias("_t"), "_c")
    full = each.select(*by, "chunk_id", "_t", F.explode("_c").alias("_c")).select(*by, "chunk_id", "_t", "_c.*")
    full = full.join(small(queries.select(*by, "query_id", tokenize(F.col("query")).alias("_q"))), [*by, "query_id"])
    scored = full.withColumn("rerank_score", _blended(token_coverage(F.col("_q"), F.split("_t", " ")), joined_phrase(F.col("_q"), F.col("_t")), F.col("dense_score"), F.col("lexical_score"), F.col("fused"), dense_weight, rerank_weight))
    return _top(scored.select(*pair, "dense_score", "lexical_score", "rerank_score"), k, [*by, "query_id"], "rerank_score")


def _retrieved(found: DataFrame, mode: str, by: list[str], *more: str) -> DataFrame:
    null = F.lit(None).cast("double")
    if mode == "dense":
        out = found.withColumns({"similarity": F.col("dense_score"), "lexical_score": null, "rerank_score": F.col("dense_score")})
    elif mode == "lexical":
        out = found.withColumns({"similarity": F.col("lexical_score"), "dense_score": null, "rerank_score": F.col("lexical_score")})
    else:
        out = found.withColumn("similarity", F.col("rerank_score"))
    return out.select(*by, "query_id", "chunk_id", "similarity", "rank", "dense_score", "lexical_score", "rerank_score", F.lit(mode).alias("retrieval_method"), *more)


def retrieve(queries: DataFrame, chunks: DataFrame, k: int, mode: str = "dense", **kw) -> DataFrame:
    """query_id, chunk_id, similarity, rank, dense_score, lexical_score, rerank_score, retrieval_method; before them
    collection, if both sides have one."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}: {mode}")
    found = hybrid_topk(queries, chunks, k, **kw) if mode == "hybrid" else (dense_topk if mode == "dense" else lexical_topk)(queries, chunks, k)
    return _retrieved(found, mode, _by(queries, chunks))


def every_mode(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """retrieve() in all modes, the chunks scored once: the k best by terms or vectors lead the lists that hybrid search merges."""
    by, depth = _by(queries, chunks), _depth(k)
    with scratch(chunks.sparkSession):
        raw, sim = _lists(queries, chunks, depth, True, True)
        d = stored(_nearest(sim, depth, by), "dense")
        x = stored(ranked(raw, queries.drop("vec"), chunks.drop("vec"), depth), "lexical")
        best = {"dense": d.filter(F.col("rank") <= k), "lexical": x.filter(F.col("rank") <= max(1, k)), "hybrid": _merged(d, x, queries, chunks, k, by)}
        dense, lexical, hybrid = (_retrieved(best[m], m, by) for m in MODES)
        return stored(dense.unionByName(lexical).unionByName(hybrid), "modes", keep=True)


def candidates(queries: DataFrame, chunks: DataFrame, top_k: int = 4, multiplier: int = 3, mode: str = "dense", **kw) -> DataFrame:
    """What a gate of top_k chooses from: multiplier times as many."""
    return retrieve(queries, chunks, top_k * multiplier, mode, **kw)
