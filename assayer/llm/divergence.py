"""How the sources of a language differ in the terms they use.

A term is a run of ASCII letters and characters outside ASCII, A-Z lower-cased. Each language keeps the terms that are in at
least three of its documents. A group is a source of a language; its share of a kept term is p = 1 + floor(10**9 (count + 1) /
(all + kept terms)), and what it has beyond q, another share of that term, is floor((p - q)**2 / q). All is exact in int64, up to
2.8e14 occurrences in a language.

Slices of the texts send a row for each distinct term of a group. Kept terms are dealt by hash into blocks, so that a block's
dense matrix of groups by terms has about CELLS cells; in it all pairs of groups are computed by broadcasting, some terms at
a time. Blocks send partial matrices of pairs, which are summed, and of each group the best terms, whose heaps are merged.

Null text, language and source count as ''. A group without terms, and one of a language that keeps none, still has its pairs
(of value 0 where nothing is kept). Repeated rows are documents of their own. Ties go by item, as UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _LOWER, bounded, scratch, slices, stored
from .native import small

LEAST_DOCS = 3
TOP = 200
#: Of a block's matrix (groups by terms), and of the broadcast pairs (groups by groups by terms).
CELLS = 1 << 18
PAIR_CELLS = 1 << 20
_SCALE = (31250, 32000)

_IN_TERM = np.zeros(256, bool)
_IN_TERM[65:91] = _IN_TERM[97:123] = _IN_TERM[128:] = True

_ROWS = "lang string, source string, part string, item string, value long"


def _slice_terms(part: pa.RecordBatch) -> pa.RecordBatch:
    """lang, source, term, n (occurrences), docs (rows of the slice that have it); and a row with a null term for each group."""
    groups: dict[tuple[str, str], int] = {}
    group = np.array([groups.setdefault(g, len(groups)) for g in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True)], np.int64)
    parts = [x or b"" for x in part.column("text").cast(pa.large_binary()).to_pylist()]
    buf = _LOWER[np.frombuffer(b" ".join(parts) + b" ", np.uint8)]
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    inside = _IN_TERM[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start = np.concatenate([[0], edge])[0 if inside[0] else 1 :: 2]
    doc = np.searchsorted(ends, start, "right")
    end = edge[1 if not inside[0] else 0 :: 2]
    offsets = np.concatenate([[0], np.cumsum(end - start)])
    words = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(buf[inside])])
    coded = words.dictionary_encode()
    size = max(1, len(coded.dictionary))
    pair, n = np.unique(doc * size + coded.indices.to_numpy().astype(np.int64), return_counts=True)
    key, at = np.unique(group[pair // size] * size + pair % size, return_inverse=True)
    names = list(groups)
    of = pa.array(np.concatenate([key // size, np.arange(len(names))]))
    take = lambda i: pa.array([g[i] for g in names], pa.string()).take(of)
    none = np.zeros(len(names), np.int64)
    term = pa.concat_arrays([coded.dictionary.take(pa.array(key % size)).cast(pa.string()), pa.nulls(len(names), pa.string())])
    n, docs = np.bincount(at, n, len(key)).astype(np.int64), np.bincount(at, minlength=len(key))
    return pa.RecordBatch.from_arrays([take(0), take(1), term, pa.array(np.concatenate([n, none])), pa.array(np.concatenate([docs, none]))], ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it) of every group; with a null term, one row for each group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield _slice_terms(part)

    rows = bounded(docs).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    each = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total) -> np.ndarray:
    """1 + floor(10**9 (counts + 1) / total), the product taken in two steps so that it doesn't overflow."""
    a, b = _SCALE
    whole, rest = np.divmod((counts + 1) * a, total)
    return 1 + whole * b + rest * b // total


def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _pairs(p: np.ndarray, rows: slice) -> np.ndarray:
    """Of the groups in rows against every group: excess summed over the block's terms."""
    own = p[rows]
    out = np.zeros((len(own), len(p)), np.int64)
    step = max(1, PAIR_CELLS // max(1, out.size))
    for a in range(0, p.shape[1], step):
        out += excess(own[:, None, a : a + step], p[None, :, a : a + step]).sum(2)
    return out


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one block: with a term its count in a group, without one a group with its sum n of all kept terms, and how many
    these are. Gives the block's part of each pair, and for each group what can be among its best terms."""
    t = pa.Table.from_batches(batches).combine_chunks()
    marks, cells = t.filter(pc.is_null(t["term"])), t.filter(pc.is_valid(t["term"]))
    marks = marks.take(pc.sort_indices(marks["source"]))
    sources, total, kept = marks["source"].combine_chunks(), marks["n"].to_numpy(), marks["kept"].to_numpy()
    terms = pc.unique(cells["term"])
    terms = terms.take(pc.sort_indices(terms))
    counts = np.zeros((len(sources), len(terms)), np.int64)
    counts[pc.index_in(cells["source"], sources).to_numpy(), pc.index_in(cells["term"], terms).to_numpy()] = cells["n"].to_numpy()
    lang, per = t["lang"][0].as_py(), max(1, PAIR_CELLS // max(1, len(sources)))
    # (total + kept is 0 only where there are no terms.)
    p = shares(counts, np.maximum(1, total + kept)[:, None])

    def rows(part: str, g: np.ndarray, items: pa.Array, value: np.ndarray) -> pa.RecordBatch:
        same = lambda x: pa.repeat(pa.scalar(x, pa.string()), len(g))
        return pa.RecordBatch.from_arrays([same(lang), sources.take(pa.array(g)), same(part), items, pa.array(value)], ["lang", "source", "part", "item", "value"])

    for a in range(0, len(sources), per):
        sums = _pairs(p, slice(a, a + per))
        i, j = np.nonzero(np.arange(a, a + len(sums))[:, None] != np.arange(len(sources)))
        yield rows("pair", i + a, sources.take(pa.array(j)), sums[i, j])
    q = shares(counts.sum(0), max(1, int(total.sum() + kept[0])))
    for g in range(len(sources)):
        at = np.flatnonzero((counts[g] > 0) & (p[g] > q))
        value = excess(p[g, at], q[at])
        best = np.argsort(-value, kind="stable")[:TOP]  # terms are in order, so ties are
        yield rows("term", np.full(len(best), g), terms.take(pa.array(at[best])), value[best])


def audit(docs: DataFrame, least: int = LEAST_DOCS, cells: int = CELLS) -> DataFrame:
    """docs (lang, source, text) to lang, source, part, item, value, rank: for part `pair` every other source of the language,
    for part `term` the TOP terms that the group has beyond its language, by value."""
    with scratch(docs.sparkSession):
        counts = stored(term_counts(docs), "counts")
        found = counts.filter("term is not null")
        words = stored(found.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least).select("lang", "term"), "kept")
        entries = stored(found.join(words, ["lang", "term"]).select("lang", "source", "term", "n"), "entries")
        of_group = entries.groupBy("lang", "source").agg(F.sum("n").alias("n"))
        groups = stored(counts.filter("term is null").select("lang", "source").join(of_group, ["lang", "source"], "left").fillna(0, ["n"]), "groups")
        langs = groups.groupBy("lang").agg(F.count("*").alias("groups")).join(words.groupBy("lang").agg(F.count("*").alias("kept")), "lang", "left").fillna(0, ["kept"])
        blocks = F.greatest(F.lit(1), F.least(F.col("kept"), F.ceil(F.col("groups") * F.col("kept") / cells)))
        langs = stored(langs.select("lang", "kept", blocks.cast("long").alias("blocks")), "langs")
        # Languages of one block need no look-up; the others have many terms each.
        large = small(langs.filter("blocks > 1").select("lang", "blocks"))
        block = F.pmod(F.xxhash64("term"), F.coalesce("blocks", F.lit(1)))
        tiles = entries.join(large, "lang", "left").select("lang", block.cast("long").alias("block"), "source", "term", "n", F.lit(None).cast("long").alias("kept"))
        marks = groups.join(small(langs), "lang").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), "n", "kept")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _block(batches)

        parts = stored(tiles.unionByName(marks).groupBy("lang", "block").applyInArrow(run, _ROWS), "parts")
        ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
        pairs = parts.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
        best = ranked(parts.filter("part = 'term'")).filter(F.col("rank") <= TOP)
        return stored(ranked(pairs).unionByName(best), "audit", keep=True)


_A = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE = rf"""
with d as (select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
w as (select doc, lang, source, unnest(regexp_extract_all(translate(text, '{_A}', '{_A.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term from w group by lang, term having count(distinct doc) >= {LEAST_DOCS}),
v as (select lang, count(*) as v from kept group by lang),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from w join kept using (lang, term) group by lang, source, term),
f as (select g.lang, g.source, kept.term, coalesce(c.n, 0) as n from g join kept on kept.lang = g.lang
      left join c on c.lang = g.lang and c.source = g.source and c.term = kept.term),
p as (select lang, source, term, n, sum(n) over (partition by lang, source) as s, sum(n) over (partition by lang, term) as ln, sum(n) over (partition by lang) as ls from f),
x as (select lang, source, term, n, 1 + (1000000000::hugeint * (n + 1)) // (s + v) as p, 1 + (1000000000::hugeint * (ln + 1)) // (ls + v) as q from p join v using (lang)),
pairs as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
          from x a join x b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source),
every as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
          from g a join g b on a.lang = b.lang and a.source <> b.source left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source
          union all select lang, source, 'term', term, ((p - q) * (p - q)) // q from x where n > 0 and p > q)
select lang, source, part, item, value::bigint as value, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank
from every qualify part = 'pair' or rank <= {TOP}
"""
