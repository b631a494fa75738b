"""Hybrid search in all cells of a chunking grid, for vectors that are counts of tokens (embedding.embed).

In every cell a chunk is a run of its page's tokens. So a page is cut into units and tokens once; a cell's chunks are places among
them, their vectors and lengths differences of running sums. What is stored of a page are the questions' terms in their
order and the chunks' places among these: statistics, lexical scores and the share of a question's terms come from there, and
texts are read again only where a chunk may hold a whole question.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import replace
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LOWERED, STOP_WORDS
from . import embedding, retrieval
from .chunking import bounded, packed
from .grouped import Best, small
from .storage import release, scratch, small_batches, stored

#: Tokens whose codes a task remembers.
KNOWN = 1 << 18
_TOKEN = np.array([c != 32 for c in LOWERED])
_STOP = frozenset(w.encode() for w in STOP_WORDS)
#: Blanks as of Unicode, without the four separators that only strip() takes for some.
_SENTENCE = re.compile(r"(?<=[.!?])[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")

Cell = tuple[str, int, int]


def units(text: str) -> list[str]:
    """As functions.text.units()."""
    return [u for p in text.split("\n\n") for x in _SENTENCE.split(p.strip()) if (u := x.strip())]


def _tail(text: str, begin: int, end: int, n: int) -> int:
    """Where chunking.tail() of text[begin:end] begins."""
    if n <= 0:
        return end
    begin = max(begin, end - n)
    at = text.find(" ", begin, end)
    return at + 1 if at >= 0 else begin


def places(text: str, ends: list[int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Begin and end of what chunking.packed() makes of pieces no longer than size. text: these, joined by blanks; ends: of each its end."""
    begin = i = 0
    while i < len(ends):
        i = bisect_right(ends, begin + size, i)
        end = ends[i - 1]
        yield begin, end
        if i < len(ends):
            room, again = max(0, size - (ends[i] - end - 1) - 1), _tail(text, begin, end, overlap)
            begin = _tail(text, again, end, room) if end - again > room else again
            while text[begin].isspace():
                begin += 1


class _Codes(dict):
    """Of each token one number: its bucket, a bit for stop words, and from bit 7 on one more than the number of an asked term."""

    def __init__(self, number: dict[bytes, int]):
        self.number = number

    def __missing__(self, token: bytes) -> int:
        self[token] = code = embedding.bucket(token.decode()) | (token in _STOP) << 6 | (self.number.get(token, -1) + 1) << 7
        return code


class _Read:
    """Pages of a batch cut in all cells. terms: the asked ones in order; counts: chunks of each page (row) in each cell (column).
    Of the chunks, cell by cell: page, and spans (begin and end among the terms, length). cell() has those of one cell."""

    def __init__(self, texts: list[str], cells: list[Cell], codes: _Codes):
        joined, base, first, sizes = [], 0, [], {}
        begins, ends, counts = [[] for _ in cells], [[] for _ in cells], np.zeros((len(texts), len(cells)), np.int64)
        for c, (_, size, _) in enumerate(cells):
            sizes.setdefault(size, []).append(c)
        for page, text in enumerate(texts):
            parts, shared = units(text), None
            longest = max(map(len, parts), default=0)
            first.append(base)
            for size, own in sizes.items():
                if longest > size or shared is None:
                    pieces = parts if longest <= size else list(bounded(parts, size))
                    now = " ".join(pieces), [x - 1 for x in accumulate(len(p) + 1 for p in pieces)], base
                    joined.append(now[0])
                    base += len(now[0]) + 1
                    shared = now if longest <= size else shared
                else:
                    now = shared
                whole, stops, at = now
                for c in own:
                    n = len(begins[c])
                    for a, b in places(whole, stops, size, cells[c][2]):
                        if a and whole[a - 1] != " ":
                            # It may begin within a token, and is read apart.
                            joined.append(whole[a:b])
                            a, b = base - at, base - at + b - a
                            base = at + b + 1
                        begins[c].append(at + a)
                        ends[c].append(at + b)
                    counts[page, c] = len(begins[c]) - n
        begin, end = (np.array([p for c in x for p in c], np.int64) for x in (begins, ends))
        raw, first = "\n".join(joined).encode(), np.array([*first, base], np.int64)
        if len(raw) >= base:
            # Places of characters become places of bytes.
            at = np.append(np.flatnonzero(np.frombuffer(raw, np.int8) >= -64), [len(raw)] * 2)
            begin, end, first = at[begin], at[end], at[first]
        inside = _TOKEN[np.frombuffer(raw, np.uint8)]
        starts = np.flatnonzero(inside & ~np.concatenate([[False], inside])[:-1])
        tokens = raw.translate(LOWERED).split()
        code = np.fromiter(map(codes.__getitem__, tokens), np.int64, len(tokens))
        begin, end, first = (np.searchsorted(starts, x) for x in (begin, end, first))
        words, asked = (np.concatenate([[0], np.cumsum(x)]) for x in ((code & 64) == 0, code > 127))
        self.counts, self.terms, self.first = counts, (code[code > 127] >> 7) - 1, asked[first]
        self.page = np.concatenate([np.repeat(np.arange(len(texts)), n) for n in counts.T]) if len(texts) else begin
        self.spans = np.stack([asked[begin], asked[end], words[end] - words[begin]], axis=1)
        self._from = np.concatenate([[0], np.cumsum(counts.sum(axis=0))])
        # Counts of buckets up to each place where a chunk begins or ends.
        at, self._at = np.unique(np.concatenate([begin, end]), return_inverse=True)
        part, n = np.searchsorted(at, np.arange(len(code)), "right"), embedding.DIMENSIONS
        self._sums = np.cumsum(np.bincount(part * n + (code & 63), minlength=(len(at) + 1) * n).reshape(-1, n), axis=0, dtype=np.int32)

    def cell(self, c: int) -> slice:
        return slice(self._from[c], self._from[c + 1])

    def vectors(self, c: int) -> np.ndarray:
        n, s = len(self.spans), self.cell(c)
        return (self._sums[self._at[n + s.start : n + s.stop]] - self._sums[self._at[s]]).astype(float)

    def stored(self, kind: str) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Of each page its terms, its chunks by cell, and their spans from its own first term on, as bytes."""
        cell = np.repeat(np.arange(self.counts.shape[1]), np.diff(self._from))
        order = np.lexsort((cell, self.page))
        spans = self.spans - self.first[self.page][:, None] * [1, 1, 0]
        ends = np.concatenate([[0], np.cumsum(self.counts.sum(axis=1))]) * 12
        return _bytes(self.terms.astype(kind), self.first * np.dtype(kind).itemsize), _bytes(self.counts.astype("<i4"), np.arange(len(self.counts) + 1) * 4 * self.counts.shape[1]), _bytes(spans[order].astype("<i4"), ends)


def _bytes(x: np.ndarray, ends: np.ndarray) -> pa.Array:
    raw = x.tobytes()
    return pa.array([raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())


def _numbers(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column, and how many each row has."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind), np.array([len(r) for r in rows], np.int64) // np.dtype(kind).itemsize


class Postings:
    """Of chunks that begin and end at places among terms (neither falls from chunk to chunk). A chunk's posting of a term starts at
    the term's first place in it and ends at its last; both make lists in the order of terms and chunks, so no pair is sorted."""

    def __init__(self, terms: np.ndarray, begin: np.ndarray, end: np.ndarray):
        order = np.argsort(terms, kind="stable")
        self.terms = terms[order]
        begun, self._ended = (np.cumsum(np.bincount(x, minlength=len(terms) + 1))[order] for x in (begin, end))
        self._first, last = self._ended.copy(), begun.copy()
        again = np.flatnonzero(self.terms[1:] == self.terms[:-1])
        self._first[again + 1] = np.maximum(self._ended[again + 1], begun[again])
        last[again] = np.minimum(begun[again], self._ended[again + 1])
        self._opened, self._closed = np.maximum(begun - self._first, 0), np.maximum(last - self._ended, 0)

    def df(self, n: int) -> np.ndarray:
        """In how many chunks each of n terms is."""
        return np.bincount(self.terms, self._opened, n).astype(np.int64)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunk, term and its count in the chunk."""
        place, many = np.arange(len(self.terms)), self._opened
        first, last = np.repeat(place, many), np.repeat(place, self._closed)
        row = self._first[first] + np.arange(len(first)) - np.repeat(np.cumsum(many) - many, many)
        return row, self.terms[first].astype(np.int64), (last - first + 1).astype(float)


def _rising(spans: np.ndarray) -> np.ndarray:
    """The order in which begins and ends of spans rise: chunks that were read apart stand behind their page."""
    if (np.diff(spans[:, 0]) >= 0).all() and (np.diff(spans[:, 1]) >= 0).all():
        return np.arange(len(spans))
    return np.lexsort((spans[:, 1], spans[:, 0]))


def _ids(pages: list[str], counts: np.ndarray) -> pa.Array:
    return pa.array([f"{p}{k}" for p, n in zip(pages, counts.tolist(), strict=True) for k in range(1, n + 1)], pa.string())


def _key() -> Column:
    """What the ids of a page's chunks begin with."""
    return F.concat(F.substring("document_hash", 1, 12), F.lit("_p"), F.coalesce(F.col("page_number").cast("int").cast("string"), F.lit("None")), F.lit("_c"))


def _read(pages: DataFrame, cells: list[Cell], asked: retrieval._Asked, number: dict[bytes, int], k: int, kind: str, query: str) -> DataFrame:
    """Rows of three sorts. Of pages: page (what the ids of its chunks begin with), source_doc, terms, counts, spans (as of
    _Read.stored()). Of the terms in a collection's chunks: at and n; behind the terms the chunks and their lengths. Of what can be
    among the k nearest chunks of each question: query_id, chunk_id, sim."""
    sent, most = pages.sparkSession.sparkContext.broadcast((asked, number)), retrieval._CELLS
    fields = {"page": pa.string(), "source_doc": pa.string(), "terms": pa.binary(), "counts": pa.binary(), "spans": pa.binary(), "collection": pa.string(), "at": pa.int64(), "n": pa.int64(), "chunk_id": pa.string(), "sim": pa.float64()}
    names = [*fields, "query_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, number = sent.value
        codes, told, best = _Codes(number), np.zeros((len(cells), len(number) + 2), np.int64), [Best(k, retrieval._ROUNDED) for _ in cells]
        kinds = fields | {"query_id": asked.ids.type}

        def out(rows: int, **cols: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([cols[x] if x in cols else pa.nulls(rows, kinds[x]) for x in names], names)

        for b in batches:
            if len(codes) > KNOWN:
                codes.clear()
            page = b.column("page").to_pylist()
            r = _Read([t.decode("utf-8", "replace") for t in b.column("text").cast(pa.binary()).to_pylist()], cells, codes)
            own = r.terms.astype(kind)
            for c in range(len(cells)):
                spans = r.spans[r.cell(c)]
                told[c, -2:] += len(spans), spans[:, 2].sum()
                told[c, :-2] += Postings(own, *spans[_rising(spans), :2].T).df(len(number))
                if asked.vectors is not None and len(spans):
                    ids, vectors, size = _ids(page, r.counts[:, c]), retrieval._unit(r.vectors(c)), max(1, most // len(asked.ids))
                    for a in range(0, len(spans), size):
                        best[c].add(retrieval._cosines(asked.vectors, vectors[a : a + size]), ids.slice(a, size), who=asked.at)
            terms, counts, places_ = r.stored(kind)
            yield out(len(page), page=b.column("page"), source_doc=b.column("source_doc"), terms=terms, counts=counts, spans=places_)
        named = lambda c, n: pa.repeat(pa.scalar(cells[c][0], pa.string()), n)
        for c, n in enumerate(told):
            at = np.flatnonzero(n)
            yield out(len(at), collection=named(c, len(at)), at=pa.array(at, pa.int64()), n=pa.array(n[at]))
        for c, found in enumerate(best):
            for x in found.rows(["q", "c", "s"], asked.ids):
                yield out(x.num_rows, collection=named(c, x.num_rows), query_id=x.column(0), chunk_id=x.column(1), sim=x.column(2))
        best.clear()
        release()

    ready = small_batches(pages).filter(F.col("text").isNotNull()).select(_key().alias("page"), "source_doc", "text")
    return ready.mapInArrow(run, f"page string, source_doc string, terms binary, counts binary, spans binary, collection string, at long, n long, chunk_id string, sim double, query_id {query}")


def _scored(read: DataFrame, cells: list[Cell], asked: list[retrieval._Asked], k: int, kind: str, query: str, k1: float, b: float) -> DataFrame:
    """collection, query_id, chunk_id, raw: of each task's chunks the k best of each question by terms, and all that could round to them."""
    sent, most = read.sparkSession.sparkContext.broadcast(asked), retrieval._CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        best = [Best(k, 2e-6 * g.most) for g in asked]
        for batch in batches:
            page, (terms, many), (spans, _) = batch.column("page").to_pylist(), _numbers(batch.column("terms"), kind), _numbers(batch.column("spans"), "<i4")
            counts, spans = _numbers(batch.column("counts"), "<i4")[0].reshape(-1, len(cells)), spans.reshape(-1, 3).astype(np.int64)
            spans[:, :2] += np.repeat(np.cumsum(many) - many, counts.sum(axis=1))[:, None]
            cell = np.repeat(np.tile(np.arange(len(cells)), len(page)), counts.ravel())
            for c, g in enumerate(asked):
                own = spans[cell == c]
                order = _rising(own)
                own, ids = own[order], _ids(page, counts[:, c]).take(pa.array(order))
                size = max(1, most // len(g.ids))
                for a in range(0, len(own), size):
                    s = own[a : a + size]
                    row, term, tf = Postings(terms[s[0, 0] : s[-1, 1]], s[:, 0] - s[0, 0], s[:, 1] - s[0, 0]).rows()
                    if len(row):
                        best[c].add(retrieval._raw(len(g.ids), *g.weights, row, term, tf, s[:, 2], g.mean, k1, b), ids.slice(a, size), 0.0)
        for c, found in enumerate(best):
            yield from found.rows(["collection", "query_id", "chunk_id", "raw"], asked[c].ids, pa.scalar(cells[c][0], pa.string()))
        best.clear()
        release()

    return read.select("page", "terms", "counts", "spans").mapInArrow(run, f"collection string, query_id {query}, chunk_id string, raw double")


def _numbered(read: DataFrame, cells: list[Cell], k: int) -> DataFrame:
    """collection, chunk_id: the k smallest ids of each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[str]] = [[] for _ in cells]
        for b in batches:
            page, counts = b.column("page").to_pylist(), _numbers(b.column("counts"), "<i4")[0].reshape(-1, len(cells))
            for c, ids in enumerate(held):
                held[c] = sorted([*ids, *_ids(page, counts[:, c]).to_pylist()])[:k]
        for (name, *_), ids in zip(cells, held, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids), pa.string()), pa.array(ids, pa.string())], ["collection", "chunk_id"])

    return read.select("page", "counts").mapInArrow(run, "collection string, chunk_id string")


def _shared(read: DataFrame, pairs: DataFrame, cells: list[Cell], asked: retrieval._Asked, number: dict[bytes, int], texts: dict, kind: str) -> DataFrame:
    """pairs (page, collection, k, query_id) with source_doc, coverage, and inner: whether the chunk has all of the question's terms but the first and
    the last, without which it doesn't hold the question."""
    places_ = {q: i for i, q in enumerate(asked.ids.to_pylist())}
    sent = read.sparkSession.sparkContext.broadcast(({q: ([number[t.encode()] for t in dict.fromkeys(texts[q])], frozenset(number[t.encode()] for t in texts[q][1:-1])) for q in places_}, {name: c for c, (name, *_) in enumerate(cells)}))
    query = pairs.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, at = sent.value
        for b in batches:
            rows = []
            for page, name, terms, counts, spans, sought in zip(*(b.column(c).to_pylist() for c in ("page", "source_doc", "terms", "counts", "spans", "sought")), strict=True):
                terms, spans = np.frombuffer(terms, kind), np.frombuffer(spans, "<i4").reshape(-1, 3)
                first, known = np.concatenate([[0], np.cumsum(np.frombuffer(counts, "<i4"))]), {}
                for x in sought:
                    n = first[at[x["collection"]]] + x["k"] - 1
                    if n not in known:
                        known[n] = frozenset(terms[spans[n, 0] : spans[n, 1]].tolist())
                    every, inner = wanted[x["query_id"]]
                    rows.append((x["collection"], x["query_id"], f"{page}{x['k']}", name, sum(t in known[n] for t in every) / len(every) if every else 0.0, inner <= known[n]))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.string(), asked_type, pa.string(), pa.string(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], ["collection", "query_id", "chunk_id", "source_doc", "coverage", "inner"])

    asked_type = asked.ids.type
    sought = small(pairs.groupBy("page").agg(F.collect_list(F.struct("collection", "k", "query_id")).alias("sought")))
    own = read.select("page", "source_doc", "terms", "counts", "spans").join(sought, "page")
    return own.mapInArrow(run, f"collection string, query_id {query}, chunk_id string, source_doc string, coverage double, inner boolean")


def _phrases(pages: DataFrame, pairs: DataFrame, cells: list[Cell], texts: dict, asked_type: pa.DataType) -> DataFrame:
    """The pairs (page, collection, k, query_id) whose chunk holds the question, as collection, query_id, chunk_id."""
    sent = pages.sparkSession.sparkContext.broadcast(({q: " ".join(t) for q, t in texts.items()}, {name: (size, overlap) for name, size, overlap in cells}))
    query = pairs.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, cell = sent.value
        for b in batches:
            rows = []
            for page, text, sought in zip(*(b.column(c).to_pylist() for c in ("page", "text", "sought")), strict=True):
                parts, cut, joined = units(text.decode("utf-8", "replace")), {}, {}
                for x in sought:
                    name, k = x["collection"], x["k"]
                    if name not in cut:
                        cut[name] = list(packed(parts, *cell[name]))
                    if (name, k) not in joined:
                        joined[name, k] = " ".join(retrieval._terms(cut[name][k - 1]))
                    if asked[x["query_id"]] in joined[name, k]:
                        rows.append((name, x["query_id"], f"{page}{k}"))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, [pa.string(), asked_type, pa.string()], strict=True)], ["collection", "query_id", "chunk_id"])

    sought = small(pairs.groupBy("page").agg(F.collect_list(F.struct("collection", "k", "query_id")).alias("sought")))
    own = pages.filter("text is not null").select(_key().alias("page"), F.col("text").cast("binary").alias("text")).join(sought, "page")
    return small_batches(own).mapInArrow(run, f"collection string, query_id {query}, chunk_id string")


def fits(questions: DataFrame, cells: list[Cell]) -> bool:
    """Whether there are questions, and no more than a task holds in all cells."""
    most = min(retrieval.LEXICAL_BLOCK, retrieval.VECTOR_BYTES // (8 * embedding.DIMENSIONS))
    return 0 < questions.limit(most + 1).count() * len(cells) <= most


def hybrid(questions: DataFrame, pages: DataFrame, cells: list[Cell], k: int, dense_weight: float = 0.6, rerank_weight: float = 0.2, rrf_k: int = 60, lexical_candidates: int = 40, k1: float = 1.5, b: float = 0.75) -> tuple[DataFrame, dict[str, int]]:
    """retrieve() in mode hybrid in the chunks of each cell (chunking.chunk_grid()), for questions (query_id, query) that fits()
    allows, with source_doc; and the number of chunks of each cell that has any. The result is stored."""
    spark, depth, by = pages.sparkSession, retrieval._depth(k, lexical_candidates), ["collection"]
    query, pair = questions.schema["query_id"].dataType.simpleString(), ["collection", "query_id", "chunk_id"]
    with scratch(spark):
        asked = stored(embedding.embed(questions.select("query_id", "query"), "query"), "asked")
        table = asked.orderBy("query_id").toArrow()
        groups, number = retrieval._questions(table)
        g, kind = groups[None], "<u2" if len(number) <= 1 << 16 else "<u4"
        texts = {q: retrieval._terms(t) for q, t in zip(table["query_id"].to_pylist(), table["query"].to_pylist(), strict=True)}
        both = stored(_read(pages, cells, g, number, depth, kind, query), "read")
        read = both.filter("page is not null")
        totals = {name: np.zeros(len(number) + 2) for name, *_ in cells}
        for r in both.filter("n is not null").groupBy("collection", "at").agg(F.sum("n").alias("n")).toArrow().to_batches():
            for name, at, n in zip(*(r.column(c).to_pylist() for c in ("collection", "at", "n")), strict=True):
                totals[name][at] = n
        chunks = {name: int(n[-2]) for name, n in totals.items() if n[-2]}
        weighed = [retrieval._weighed(replace(g), totals[name], k1) for name, *_ in cells]
        raw = stored(_scored(read, cells, weighed, depth, kind, query, k1, b), "lexical")
        every = spark.createDataFrame([(name,) for name in chunks], "collection string").crossJoin(F.broadcast(asked.select("query_id", "query")))
        d = retrieval._nearest(both.filter("sim is not null").select(*pair, "sim"), depth, by)
        x = retrieval.ranked(raw, every, _numbered(read, cells, max(1, depth)), depth)
        fused = stored(retrieval._fused(d, x, pair, rrf_k), "merged")
        number_ = F.substring_index("chunk_id", "_c", -1)
        placed = lambda df: df.select("collection", "query_id", F.expr("substring(chunk_id, 1, length(chunk_id) - length(substring_index(chunk_id, '_c', -1)))").alias("page"), number_.cast("int").alias("k"))
        shares = stored(_shared(read, placed(fused), cells, g, number, texts, kind), "shares")
        long = [q for q, t in texts.items() if len(" ".join(t)) >= 5]
        asks = spark.createDataFrame([(q,) for q in long], f"query_id {query}")
        held = stored(_phrases(pages, placed(shares.filter("inner").join(F.broadcast(asks), "query_id", "left_semi")), cells, texts, g.ids.type), "phrases")
        full = fused.join(shares, pair).join(small(held.withColumn("_phrase", F.lit(1.0))), pair, "left")
        score = retrieval._blended(F.col("coverage"), F.coalesce("_phrase", F.lit(0.0)), F.col("dense_score"), F.col("lexical_score"), F.col("fused"), dense_weight, rerank_weight)
        best = retrieval._top(full.select(*pair, "source_doc", "dense_score", "lexical_score", score.alias("rerank_score")), k, [*by, "query_id"], "rerank_score")
        out = stored(best, "hybrid", keep=True)
    return retrieval._retrieved(out, "hybrid", by, "source_doc"), chunks
