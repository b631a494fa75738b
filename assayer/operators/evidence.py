"""Which texts hold which items, letter by letter, without comparing an item with every text.

An item is looked for by an anchor that each text holding it must have: a run of its inner words (all but the first and the last,
which may go on in the text), four at most; of an item under three words, its first characters, eight at most. Texts are read
once for the anchors of all items; of an item's the one in the fewest texts is followed, and an item with an anchor in no text
is in none. What is left are pairs of an item and a text that has its rarest run; these are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grouped import BROADCAST_ROWS, small
from .storage import scratch, small_batches, stored

ANCHOR_WORDS, ANCHOR_CHARS = 4, 8
#: Words of a run are digits of one number to this base, modulo 2**64.
_BASE = np.uint64(0x9E3779B97F4A7C15)


def flat(c: Column) -> Column:
    """Lower case, runs of blanks as one, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(c), r"\s+", " "))


#: Characters whose lower case isn't looked up here: standards differ in the newest, and lengths in some.
_OTHER = "[^\\x00-\u012f\u0131-\u017f]"


def _flat_words(text: bytes, done: bool) -> list[bytes]:
    """Words of a text as flat() leaves them. done: it is flat already; else it has no character of _OTHER."""
    if done:
        return text.split(b" ")
    return (text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()).split()


def _kind(c: Column) -> Column:
    """How an item is anchored: by so many words or, below zero, characters."""
    n = F.size(F.split(c, " "))
    return F.when(n > 2, F.least(n - 2, F.lit(ANCHOR_WORDS))).otherwise(-F.least(F.length(c), F.lit(ANCHOR_CHARS)))


def _runs(words: Column, k: int) -> Column:
    """All runs of k words. The array is bound once, as a lambda would cut the text anew for each run."""
    of = lambda w: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (k - 1))), lambda i: F.array_join(F.slice(w, i, k), " ")))
    return F.coalesce(F.transform(F.array(words), of)[0], F.array().cast("array<string>"))


def _inner(c: Column, k: int) -> Column:
    w = F.split(c, " ")
    return F.array_distinct(_runs(F.slice(w, F.lit(2), F.greatest(F.lit(0), F.size(w) - 2)), k))


def _anchors(c: Column, kind: int, item: bool) -> Column:
    """Distinct anchors of one kind: of an item those of its inner words, or its beginning; of a text all."""
    if kind > 0:
        return F.array_distinct(F.transform(_inner(c, kind) if item else _runs(F.split(c, " "), kind), lambda r: F.xxhash64(F.lit(kind), r)))
    start = F.array(F.substring(c, 1, -kind)) if item else F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{-kind}}}))"), F.lit(1))
    return F.array_distinct(F.transform(start, lambda t: F.xxhash64(F.lit(kind), t)))


class _Runs:
    """Runs of words (kind, run, a), found in texts by the numbers of their words."""

    def __init__(self, rows: list):
        words = {w for r in rows for w in r.run.split(" ")}
        self.number = {w.encode(): i for i, w in enumerate(sorted(words), 1)} | {b"\n": -1}
        self.keys: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in {r.kind for r in rows}:
            own = [r for r in rows if r.kind == k]
            key = self._key(np.array([[self.number[w.encode()] for w in r.run.split(" ")] for r in own], np.uint64).T)
            order = np.argsort(key)
            self.keys[k] = key[order], np.array([r.a for r in own], np.int64)[order]
        #: Whether no two runs share a number.
        self.apart = all((np.diff(key) != 0).all() for key, _ in self.keys.values())

    @staticmethod
    def _key(digits) -> np.ndarray:
        key = digits[0]
        for d in digits[1:]:
            key = key * _BASE + d
        return key

    def found(self, pages: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Page and a, once for each pair, of pages' words as of flat(), which have no line ends."""
        words = [w for p in pages for w in (*p, b"\n")]
        n = np.fromiter(map(self.number.get, words, repeat(0)), np.int64, len(words))
        page, out = np.cumsum(n < 0), [np.zeros((0, 2), np.int64)]
        for k, (keys, a) in self.keys.items():
            known, m = n > 0, max(0, len(n) - k + 1)
            at = np.flatnonzero(np.logical_and.reduce([known[i : m + i] for i in range(k)]))
            key = self._key([n[at + i].astype(np.uint64) for i in range(k)])
            i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            here = keys[i] == key
            out.append(np.unique(np.stack([page[at[here]], a[i[here]]], axis=1), axis=0))
        return tuple(np.concatenate(out).T)


def _met(texts: DataFrame, runs: _Runs) -> DataFrame:
    """t and a of the runs that texts (t, text) have, made flat; they are looked for where texts are read."""
    sent = texts.sparkSession.sparkContext.broadcast(runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, a = sent.value.found(list(map(_flat_words, b.column("text").to_pylist(), b.column("done").to_pylist())))
            yield pa.RecordBatch.from_arrays([b.column("t").take(pa.array(at)), pa.array(a)], ["t", "a"])

    done = F.col("text").rlike(_OTHER)
    ready = small_batches(texts).filter("text is not null").select("t", F.when(done, flat(F.col("text"))).otherwise(F.col("text")).cast("binary").alias("text"), done.alias("done"))
    return ready.mapInArrow(run, f"t {texts.schema['t'].dataType.simpleString()}, a long")


def holders(items: DataFrame, texts: DataFrame, item_id: str, item_text: str, text_id: str, text: str) -> DataFrame:
    """item_id and text_id, once for each pair of which the text holds the item, both made flat().

    Null texts hold nothing, null and empty items are held by none. Items alike are looked for once. Rows of one id are one:
    it holds what any of them holds. The pairs are stored when this is called. Items and their anchors are broadcast up to a
    counted bound, and shuffled beyond it; an anchor that is in many texts stays where these are read. So long as they are
    broadcast, runs of words are looked for by their numbers, without a hash for each run of a text."""
    with scratch(texts.sparkSession):
        named = items.select(F.col(item_id).alias("i"), flat(F.col(item_text)).alias("item")).filter("item <> ''")
        sought = stored(named.select("item", _kind(F.col("item")).alias("kind")).distinct(), "sought")
        kinds = sorted(r.kind for r in sought.select("kind").distinct().collect())
        page = texts.select(F.col(text_id).alias("t"), flat(F.col(text)).alias("page")).filter("page <> ''")
        if not kinds:
            return stored(named.select("i").crossJoin(page.select("t")).limit(0).toDF(item_id, text_id), "held", keep=True)
        own = F.coalesce(*[F.when(F.col("kind") == k, _anchors(F.col("item"), k, True)) for k in kinds])
        ways = stored(sought.select("item", F.explode(own).alias("a")), "ways")
        runs, parts = None, []
        if any(k > 0 for k in kinds):
            of = F.explode(F.coalesce(*[F.when(F.col("kind") == k, _inner(F.col("item"), k)) for k in kinds if k > 0]))
            rows = sought.filter("kind > 0").select("kind", of.alias("run")).distinct().withColumn("a", F.xxhash64("kind", "run")).limit(BROADCAST_ROWS + 1).collect()
            runs = _Runs(rows) if len(rows) <= BROADCAST_ROWS else None
            runs = runs if runs is not None and runs.apart else None
        if runs is not None:
            parts.append(_met(texts.select(F.col(text_id).alias("t"), F.col(text).alias("text")), runs))
        if rest := [k for k in kinds if k < 0 or runs is None]:
            every = F.explode(F.concat(*[_anchors(F.col("page"), k, False) for k in rest]))
            parts.append(page.select("t", every.alias("a")).join(small(ways.select("a").distinct()), "a", "left_semi").select("t", "a"))
        met = stored(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), "met")
        often = met.groupBy("a").agg(F.count("*").alias("n"))
        rarest = F.min(F.struct(F.coalesce("n", F.lit(0).cast("long")).alias("n"), "a")).alias("x")
        chosen = ways.join(small(often), "a", "left").groupBy("item").agg(rarest).filter("x.n > 0").select("item", F.col("x.a").alias("a"))
        pairs = stored(met.join(small(chosen), "a").select("t", "item").distinct(), "pairs")
        # Texts that an anchor joins to an item alone are made flat again.
        some = texts.select(F.col(text_id).alias("t"), F.col(text).alias("_text")).join(small(pairs.select("t").distinct()), "t", "left_semi")
        found = some.select("t", flat(F.col("_text")).alias("page")).join(small(pairs), "t").filter(F.contains("page", "item")).select("t", "item")
        held = found.join(small(named), "item").select(F.col("i").alias(item_id), F.col("t").alias(text_id)).distinct()
        return stored(held, "held", keep=True)
