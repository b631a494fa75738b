"""Substring dedup by relative Lempel-Ziv parsing.

The reference of a document is all text before it: documents of smaller ids, and its own words up to there. The reference
is indexed in blocks: each holds the windows of MIN_WORDS words whose hash falls in its range, with the earliest place of
each. Every document is looked up in every block its windows fall in. Then it is parsed greedily: a factor begins at the
first window that the reference has, and follows that window's earliest place for as long as the text there goes on alike,
also where single windows have earlier places still. At a factor's end, windows that overlap it are checked: the first
that the reference has begins the next factor; if there is none, the parse goes on behind. Factors are MIN_WORDS words or
longer, each window that has an earlier equal lies within one, and the words of all factors are the duplicate spans.

Whether a source goes on needs no texts: two windows are equal if their earliest places are. A document's windows are
runs of one earliest place after another, and a source's own runs are asked for where a run ends right before another.
Documents with the same runs (copies) are parsed once.

Tasks settle windows that recur within their own slice of documents, and send one entry for each distinct window: a
passage that is everywhere costs one entry a slice. Entries are packed in binary rows for each block, and blocks grow in
number with the input. Back come only the windows with an earlier source, packed by document.

Windows are compared by a hash of 64 bits and another of 32. A null text has no words. A null id comes before all others. Rows alike in id and
text are one document: they are kept or cut alike. Rows of one id with different texts: the place with the smaller start
is the earlier, and equal starts are both kept; a factor isn't followed on into such an id if both have earlier sources.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import cuts, group_of, pack_sorted, slice_name, squeezed, unpack_sorted, unsqueezed
from .common import Words, bounded, groups_for, mix, scratch, slices, stored, windows

MIN_WORDS = 20
SLICE = 4 << 20
_FIRST = -(1 << 63)
_U = np.uint64
_SENT = "side byte, grp int, slice long, n int, a binary, b binary, c binary, d binary, e binary"
_NAMES = ["side", "grp", "slice", "n", "a", "b", "c", "d", "e"]
_TYPES = [pa.int8(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
#: Kinds of rows: windows for a block of the reference; places with a source, and the documents, of a slice.
_WINDOWS, _PLACES, _ROWS = 0, 1, 2


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], _NAMES)


def _home(name: int, groups: int) -> int:
    """The group of a slice."""
    return (name & 0xFFFFFFFF) % groups


def _steps(x: np.ndarray) -> bytes:
    return squeezed(np.diff(x, prepend=x.dtype.type(0)))


def _sums(raw: bytes, kind) -> np.ndarray:
    return np.cumsum(unsqueezed(raw, kind), dtype=kind)


def _places(name: int, groups: int, doc: np.ndarray, pos: np.ndarray, src: np.ndarray, src_pos: np.ndarray, src_doc: np.ndarray | None = None) -> tuple:
    """A row of places that have a source, for their slice; src_doc: the sources' numbers, where the slice has them itself."""
    order = np.lexsort((pos, doc))
    doc, pos, src, src_pos = (x[order] for x in (doc, pos, src, src_pos))
    own = b"" if src_doc is None else _steps(src_doc[order].astype(np.int32))
    return (_PLACES, _home(name, groups), name, len(doc), _steps(doc.astype(np.int32)), _steps(pos.astype(np.int32)), _steps(src.astype(np.int64)), _steps(src_pos.astype(np.int32)), own)


def _sliced(groups: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE):
            w = Words(part)
            h = w.hashes()
            keys, whole = w.runs(h, n)
            at = np.flatnonzero(whole)
            if not len(at):
                continue
            ids, marks = part.column("d").to_numpy(), part.column("mark").to_numpy()
            name = slice_name(ids, marks)
            # Rows in the order of their ids, so that a stable sort by key leaves each key's places in order.
            keys, doc = keys[at], w.doc[at].astype(np.int32)
            more = (windows(mix(h ^ _U(0x5851F42D4C957F2D)), n) >> _U(32)).astype(np.uint32)[at]
            pos = (at - w.first[doc]).astype(np.int32)
            if np.any(ids[1:] <= ids[:-1]):
                by_place = np.lexsort((pos, ids[doc]))
                keys, more, doc, pos = keys[by_place], more[by_place], doc[by_place], pos[by_place]
            order = np.lexsort((more, keys))
            keys, more, doc, pos = keys[order], more[order], doc[order], pos[order]
            head = np.concatenate([[True], (keys[1:] != keys[:-1]) | (more[1:] != more[:-1])])
            first = np.maximum.accumulate(np.where(head, np.arange(len(keys), dtype=np.int32), 0))
            later = (ids[doc] > ids[doc[first]]) | (pos > pos[first])
            rows = [(_ROWS, _home(name, groups), name, len(ids), _steps(ids), squeezed(marks), b"", b"", b"")]
            if later.any():
                rows.append(_places(name, groups, doc[later], pos[later], ids[doc[first[later]]], pos[first[later]], doc[first[later]]))
            # What ties with the first place isn't later; it is sent on by itself, as it may be later than another slice's.
            keys, more, doc, pos = keys[~later], more[~later], doc[~later], pos[~later]
            rows += [(_WINDOWS, g, name, b - a, pack_sorted(keys[a:b]), squeezed(doc[a:b]), squeezed(pos[a:b]), _steps(ids[np.unique(doc[a:b])]), more[a:b].tobytes()) for g, a, b in cuts(group_of(keys, groups))]
            for a in range(0, len(rows), 64):
                yield _batch(rows[a : a + 64])

    return run


def _block(groups: int):
    """One block of the reference: the earliest place of each window, and what is later."""
    def run(table: pa.Table) -> pa.Table:
        if table["side"][0].as_py() != _WINDOWS:
            return table
        rows = table.select(["slice", "a", "b", "c", "d", "e"]).to_pylist()
        keys = np.concatenate([unpack_sorted(r["a"]) for r in rows])
        which = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r["a"]) // 8 for r in rows])
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        if not len(order):
            return pa.Table.from_batches([_batch([])])
        docs = [unsqueezed(r["b"], np.int32) for r in rows]
        # A row's ids are those of its own documents alone.
        d = np.concatenate([_sums(r["d"], np.int64)[np.unique(x, return_inverse=True)[1]] for r, x in zip(rows, docs, strict=True)])[order]
        doc, pos = np.concatenate(docs)[order], np.concatenate([unsqueezed(r["c"], np.int32) for r in rows])[order]
        keys, which, more = keys[order], which[order], np.concatenate([np.frombuffer(r["e"], np.uint32) for r in rows])[order]
        order = np.lexsort((pos, d, more, keys))
        keys, more, which, doc, pos, d = (x[order] for x in (keys, more, which, doc, pos, d))
        head = np.concatenate([[True], (keys[1:] != keys[:-1]) | (more[1:] != more[:-1])])
        first = np.maximum.accumulate(np.where(head, np.arange(len(keys)), 0))
        later = np.flatnonzero((d > d[first]) | (pos > pos[first]))
        out = []
        for i in np.unique(which[later]):
            at = later[which[later] == i]
            out.append(_places(rows[i]["slice"], groups, doc[at], pos[at], d[first[at]], pos[first[at]]))
        return pa.Table.from_batches([_batch(out)])

    return run


def _gathered(table: pa.Table) -> pa.Table:
    """The documents of a group's slices, each with its places that have a source, in order."""
    kind = pa.schema([("fd", pa.int64()), ("fm", pa.int64()), ("start", pa.list_(pa.int32())), ("windows", pa.list_(pa.int32())), ("src", pa.list_(pa.int64())), ("src_start", pa.list_(pa.int32()))])
    names, side = table["slice"].to_numpy(), table["side"].to_numpy()
    out = []
    for name in np.unique(names):
        rows = table.filter(pa.array((names == name) & (side == _ROWS))).slice(0, 1).to_pylist()
        places = table.filter(pa.array((names == name) & (side == _PLACES))).to_pylist()
        if rows and places:
            out.append(_of_slice(_sums(rows[0]["a"], np.int64), unsqueezed(rows[0]["b"], np.int64), places).cast(kind))
    return pa.concat_tables(out) if out else kind.empty_table()


def _of_slice(ids: np.ndarray, marks: np.ndarray, places: list[dict]) -> pa.Table:
    read = lambda rows: tuple(np.concatenate([np.zeros(0, t), *[_sums(r[k], t) for r in rows]]) for k, t in zip("abcd", (np.int32, np.int32, np.int64, np.int32), strict=True))
    told, own = [r for r in places if not r["e"]], [r for r in places if r["e"]]
    doc, pos, src, src_pos = read(told)
    if own:
        # The slice's own sources may have earlier equals elsewhere, which their blocks have told.
        at = lambda d, p: (d.astype(np.int64) << 32) | p
        more = read(own)
        wanted = at(np.concatenate([_sums(r["e"], np.int32) for r in own]), more[3])
        order = np.lexsort((src_pos, src, at(doc, pos)))
        known = at(doc, pos)[order]
        i = np.searchsorted(known, wanted)
        have = np.flatnonzero(i < len(known))
        have = have[known[i[have]] == wanted[have]]
        first, first_pos = more[2], more[3]
        first[have], first_pos[have] = src[order[i[have]]], src_pos[order[i[have]]]
        doc, pos, src, src_pos = np.concatenate([doc, more[0]]), np.concatenate([pos, more[1]]), np.concatenate([src, first]), np.concatenate([src_pos, first_pos])
    # A place may have a source in its own slice and an earlier one elsewhere: the earliest holds.
    order = np.lexsort((src_pos, src, pos, doc))
    doc, pos, src, src_pos = (x[order] for x in (doc, pos, src, src_pos))
    keep = np.concatenate([[True], (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])])
    doc, pos, src, src_pos = (x[keep] for x in (doc, pos, src, src_pos))
    at = np.concatenate([[0], np.flatnonzero(doc[1:] != doc[:-1]) + 1])
    # Rows alike in id and text are one document, told once.
    _, once = np.unique(np.stack([ids[doc[at]], marks[doc[at]]]), axis=1, return_index=True)
    # Runs with one source are one entry: start, windows, source.
    turn = np.concatenate([[True], (np.diff(pos) != 1) | (src[1:] != src[:-1]) | (np.diff(src_pos) != 1)])
    turn[at] = True
    begin = np.flatnonzero(turn)
    n = np.diff(np.append(begin, len(pos))).astype(np.int32)
    at = np.searchsorted(begin, at)
    doc, pos, src, src_pos = (x[begin] for x in (doc, pos, src, src_pos))
    lists = lambda x: pa.ListArray.from_arrays(pa.array(np.append(at, len(x)).astype(np.int32)), pa.array(x))
    found = pa.table({"fd": ids[doc[at]], "fm": marks[doc[at]], "start": lists(pos), "windows": lists(n), "src": lists(src), "src_start": lists(src_pos)})
    return found.take(pa.array(np.sort(once)))


def _alike(runs: tuple | None, s: int, q: int, t: int, u: int, n: int) -> int:
    """How many of n windows from (s, q) on have the same earliest places as those from (t, u) on. runs: those of s."""
    begin, windows, src, src_start = runs or ((), (), (), ())
    done = 0
    while done < n:
        k = bisect_right(begin, q + done) - 1
        if k >= 0 and q + done < begin[k] + windows[k]:
            same, end = (src[k], src_start[k] + q - begin[k]) == (t, u), begin[k] + windows[k]
        else:
            same, end = (s, q) == (t, u), begin[k + 1] if k + 1 < len(begin) else q + n
        if not same:
            break
        done = min(n, end - q)
    return done


def parse(start: list[int], windows: list[int], src: list[int], src_start: list[int], sources: dict[int, tuple]) -> list[tuple[int, int, int, int]]:
    """The factors (start, windows, source, source's start) of a document's runs; sources: runs of the documents it refers to."""
    out, i, at = [], 0, 0
    while i < len(start):
        s, p, q, n = src[i], start[i] + at, src_start[i] + at, windows[i] - at
        i, at = i + 1, 0
        while i < len(start) and start[i] == p + n:
            at = _alike(sources.get(s), s, q + n, src[i], src_start[i], windows[i])
            n += at
            if at < windows[i]:
                break
            i, at = i + 1, 0
        out.append((p, n, s, q))
    return out


def _parsed(runs: DataFrame) -> DataFrame:
    """runs (of documents fd, fm) with factors in their place."""
    cols = ["start", "windows", "src", "src_start"]
    runs = runs.withColumns({"h1": F.xxhash64(*cols), "h2": F.xxhash64(F.lit(1), *cols)})
    kinds = stored(runs.select("h1", "h2", *cols).dropDuplicates(["h1", "h2"]), "kinds")
    # A run that ends right before another asks for the runs of its source behind that, as far as windows follow.
    last = F.size("start") - 1
    ask = lambda i: F.when(F.get("start", i + 1) == F.get("start", i) + F.get("windows", i), F.struct(F.get("src", i).alias("s"), (F.get("src_start", i) + F.get("windows", i)).alias("q")))
    asks = F.when(last > 0, F.array_compact(F.transform(F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0))), ask)))
    reach = (F.get("start", last) + F.get("windows", last) - F.get("start", F.lit(0))).alias("reach")
    asked = kinds.select("h1", "h2", reach, F.explode(asks).alias("ask")).groupBy("h1", "h2", F.col("ask.s").alias("s"), "reach").agg(F.min("ask.q").alias("q"), F.max("ask.q").alias("q1"))
    own = runs.select(F.col("fd").alias("s"), F.arrays_zip(*cols).alias("own"))
    near = F.filter("own", lambda z: (z["start"] + z["windows"] > F.col("q")) & (z["start"] < F.col("q1") + F.col("reach")))
    told = stored(asked, "asked").join(own, "s").select("h1", "h2", "s", near.alias("own")).groupBy("h1", "h2").agg(F.collect_list(F.struct("s", *[F.col(f"own.{c}").alias(c) for c in cols])).alias("told"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h1", "h2", *cols]
        for b in batches:
            out = []
            for row in b.to_pylist():
                of: dict[int, tuple] = {}
                for x in row["told"] or []:
                    # Of an id with two texts it isn't known which one is meant.
                    of[x["s"]] = ([0], [1 << 30], [None], [0]) if x["s"] in of else tuple(x[c] for c in cols)
                found = parse(*(row[c] for c in cols), of)
                out.append((row["h1"], row["h2"], *(list(c) for c in zip(*found, strict=True))))
            types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 6, types, strict=True)], names)

    found = kinds.join(told, ["h1", "h2"], "left").mapInArrow(run, "h1 long, h2 long, start array<int>, windows array<int>, src array<long>, src_start array<int>")
    return runs.select("fd", "fm", "h1", "h2").join(stored(found, "parsed"), ["h1", "h2"]).drop("h1", "h2")


def _factored(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """doc_id and text of every row, with its factors (null: none)."""
    groups = groups_for(bounded(docs))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST)).alias("d"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("mark"), F.col(text_col).alias("text"))
    with scratch(docs.sparkSession):
        entries = rows.select("d", "mark", "text").mapInArrow(_sliced(groups, n), _SENT)
        places = entries.groupBy("side", "grp").applyInArrow(_block(groups), _SENT)
        kind = "fd long, fm long, start array<int>, windows array<int>, src array<long>, src_start array<int>"
        runs = stored(places.groupBy("grp").applyInArrow(_gathered, kind).dropDuplicates(["fd", "fm"]), "runs")
        found = stored(_parsed(runs), "factors", keep=True)
    return rows.join(found, (rows.d == found.fd) & (rows.mark == found.fm), "left").select("doc_id", "text", "start", "windows", "src", "src_start")


def _kept(words: list[bytes], start: np.ndarray, runs: np.ndarray, n: int) -> list[bytes]:
    gone = np.zeros(len(words) + 1, np.int32)
    np.add.at(gone, start, 1)
    np.add.at(gone, start + runs + n - 1, -1)
    return [x for x, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]


def _mapped(found: DataFrame, names: list[str], kinds: list[pa.DataType], schema: str, n: int, of) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = []
            for text, start, windows in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("start").to_pylist(), part.column("windows").to_pylist(), strict=True):
                words = (text or b"").split()
                left = words if start is None else _kept(words, np.array(start), np.array(windows), n)
                out.append(of(text, words, left))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], ["doc_id", *names])

    return found.select("doc_id", "text", "start", "windows").mapInArrow(run, f"doc_id long, {schema}")


def factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id and its factors in order: start, length (both in words), source_id, source_start; neighbours may overlap in
    fewer words than a window has."""
    found = _factored(docs, id_col, text_col, min_words)
    zipped = F.arrays_zip("start", "windows", "src", "src_start")
    one = lambda z: F.struct(z["start"].alias("start"), (z["windows"] + (min_words - 1)).alias("length"), F.nullif(z["src"], F.lit(_FIRST)).alias("source_id"), z["src_start"].alias("source_start"))
    none = F.array().cast("array<struct<start:int,length:int,source_id:bigint,source_start:int>>")
    return found.select("doc_id", F.coalesce(F.transform(zipped, one), none).alias("factors"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id and text: the kept words joined by blanks (null stays null)."""
    of = lambda text, words, left: (None if text is None else b" ".join(left).decode(),)
    return _mapped(_factored(docs, id_col, text_col, min_words), ["text"], [pa.string()], "text string", min_words, of)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one blank) of every row."""
    of = lambda text, words, left: (len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest())
    return _mapped(_factored(docs, id_col, text_col, min_words), ["n_words", "n_removed", "kept_sha256"], [pa.int64(), pa.int64(), pa.string()], "n_words long, n_removed long, kept_sha256 string", min_words, of)
