"""Packing of token sequences into windows by non-negative least squares.

A document's ids end with END. Each whole window of it is a sequence of its own; the remainders are counted by length, rounded
up to units. Every combination of at most DEPTH lengths that fills a window is a column of a matrix, and the repeat counts of
the combinations are the non-negative least-squares solution against the histogram, rounded, and lowered until no length is
used more often than there is and what is left over can fill the gaps that rounding up leaves. What is left over is packed
greedily: laid end to end it fills the gaps in order, and after them new windows, cut wherever one is full; the last tokens go
into sequences of powers of two, which need no padding. So a planned remainder is never cut, and a sequence is padded only where
the left-over tokens don't reach.

The histogram has size / unit bins, and the solution at most as many combinations, whatever the input. Remainders are numbered
within their bin by slices (the tasks that encoded them) and sums over slices; the line of left-over tokens is cut by blocks of
fixed length. No group grows with the input, but for one row for each slice.

A null text is empty, and so a document of one token. Rows with a null or repeated id are packed each for itself. An empty table
gives no pieces.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import default_vocabulary
from .common import id_text, scratch, slices, stored

SIZE, UNIT, DEPTH = 2048, 16, 4
#: The id after each document.
END = 1
#: Bytes of a run without a blank, or of blanks, from which on a text takes the slower way.
LONG_RUN = 4096
#: Sequences, and tokens of the left-over line, that one window handles.
GROUP, BLOCK = 4096, 1 << 14

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


class Encoder:
    """The ids of the vocabulary file's own library, which is slow: texts go through a faster one with the same ranks (tests
    hold both against each other for every character), but for those with long runs, which only the first takes in linear time."""

    def __init__(self, path: str):
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        from .bpe import PATTERN, encoder

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        known = encoder(path)  # refuses a vocabulary whose ids are not the ranks of its merges
        ranks = {t: i for i, t in enumerate(known.bytes_of) if t and i not in known.special.values()}
        self.fast = Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=known.special)
        self.special = list(known.special)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, with END behind them."""
        out = []
        for raw in texts:
            text = raw.decode()
            blank = _BLANK[np.frombuffer(raw, np.uint8)]
            edge = np.flatnonzero(blank[1:] != blank[:-1]) if len(raw) > LONG_RUN else ()
            slow = len(raw) > LONG_RUN and np.diff(edge, prepend=0, append=len(raw)).max() > LONG_RUN
            if slow:
                ids = self.library.encode(text, add_special_tokens=False).ids
            elif any(s in text for s in self.special):
                ids = self.fast.encode(text, allowed_special="all")
            else:
                ids = self.fast.encode_ordinary(text)
            out.append(np.array([*ids, END], "<u4"))
        return out


_READY: dict[str, Encoder] = {}


def encoded(docs: DataFrame, id_col: str, text_col: str, path: str, size: int, unit: int) -> DataFrame:
    """slice, row, doc_id, n, bin (of the remainder's length in units, rounded up), k (its number in the slice's bin), whole
    (whole windows before it in the slice) and ids (little-endian, 32 bits, compressed) of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        words = _READY[path] = _READY.get(path) or Encoder(path)
        seen, row, whole = np.zeros(size // unit + 1, np.int64), 0, 0
        for part in slices(batches):
            ids = words.encode([x or b"" for x in part.column("text").cast(pa.large_binary()).to_pylist()])
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            bins = -(-(n % size) // unit)
            order = np.argsort(bins, kind="stable")
            count = np.bincount(bins, minlength=len(seen))
            k = np.empty(len(n), np.int64)
            k[order] = np.arange(len(n)) - np.repeat(np.cumsum(count) - count, count)
            before = whole + np.cumsum(n // size) - n // size
            packed = [pa.compress(x.tobytes(), "zstd", asbytes=True) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), at, np.int64)), pa.array(row + np.arange(len(n))), part.column("doc_id"), pa.array(n), pa.array(bins), pa.array(k + seen[bins]), pa.array(before), pa.array(packed, pa.binary())],
                ["slice", "row", "doc_id", "n", "bin", "k", "whole", "ids"],
            )
            seen, row, whole = seen + count, row + len(n), whole + int((n // size).sum())

    return id_text(docs, id_col, text_col).mapInArrow(run, "slice long, row long, doc_id long, n long, bin long, k long, whole long, ids binary")


def combinations(units: int, depth: int) -> list[tuple[int, ...]]:
    """All falling sequences of at most depth positive lengths with the sum units."""
    def of(left: int, most: int, depth: int) -> Iterator[tuple[int, ...]]:
        if left == 0:
            yield ()
        elif depth:
            for x in range(min(left, most), -(-left // depth) - 1, -1):
                for rest in of(left - x, x, depth - 1):
                    yield (x, *rest)

    return list(of(units, units, depth))


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """The x >= 0 with the least |a x - b|, by active sets (Lawson and Hanson): at most len(b) of it aren't 0."""
    x, used = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(3 * len(b)):
        gain = a.T @ (b - a @ x)
        gain[used] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= tolerance or used.sum() >= len(b):
            break
        used[best] = True
        while True:
            at = np.flatnonzero(used)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            low = z <= 0
            if not low.any():
                break
            step = np.min(x[at][low] / np.maximum(x[at][low] - z[low], 1e-300))
            x[at] += step * (z - x[at])
            used[at[low & (x[at] <= 1e-12)]] = False
            x[~used] = 0
            if not used.any():
                z, at = np.zeros(0), np.zeros(0, int)
                break
        x[:] = 0
        x[at] = z
    return x


def plan(counts: np.ndarray, tokens: np.ndarray, unit: int, depth: int) -> list[tuple[tuple[int, ...], int]]:
    """Combinations with their repeat counts. counts, tokens: how many remainders each bin (0 to units) has, and their
    lengths' sum; a plan never takes more of a bin than there is, and leaves tokens to fill its gaps."""
    units = len(counts) - 1
    every = combinations(units, depth)
    if not counts[1:].any():
        return []
    a = np.zeros((units, len(every)))
    for j, c in enumerate(every):
        np.add.at(a[:, j], np.array(c) - 1, 1)
    x = nnls(a, counts[1:] / counts[1:].max()) * counts[1:].max()
    order = [int(j) for j in np.argsort(-x, kind="stable") if x[j] > 0]
    mean = np.divide(tokens, counts, out=np.zeros(len(counts)), where=counts > 0)

    def rounded(scale: float) -> tuple[list[tuple[tuple[int, ...], int]], float]:
        left, out = counts.astype(np.int64).copy(), []
        for j in order:
            bins, many = np.unique(every[j], return_counts=True)
            n = min(int(x[j] * scale + 0.5), int((left[bins] // many).min()))
            if n > 0:
                left[bins] -= n * many
                out.append((every[j], n))
        gaps = ((counts - left) * (np.arange(units + 1) * unit - mean))[1:].sum()
        return out, float((left * mean)[1:].sum() - 1.02 * gaps - (unit * depth if out else 0))

    found, spare = rounded(1.0)
    if spare < 0:
        low, high = 0.0, 1.0
        for _ in range(40):
            middle = (low + high) / 2
            low, high = (middle, high) if rounded(middle)[1] >= 0 else (low, middle)
        found, _ = rounded(low)
    return found


def _before(df: DataFrame, value: str, out: str, order: list[str], by: list[str]) -> DataFrame:
    """Adds the sum of value over the rows before; without any, 0."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0).cast("long")))


def _cut(line: DataFrame, gaps: DataFrame) -> DataFrame:
    """line (a, b, and what it carries as struct own), gaps (a, b, struct gap): both without holes from 0 on, each row no
    longer than BLOCK. The pieces of their overlay: own, gap, a, b. Blocks are swept from bound to bound."""
    def spread(df: DataFrame) -> DataFrame:
        first, last = F.floor(F.col("a") / BLOCK), F.floor((F.col("b") - 1) / BLOCK)
        return df.withColumn("block", F.explode(F.sequence(first, last)))

    own = spread(line).select("block", F.struct("a", "b", "own").alias("x"))
    gap = spread(gaps).select("block", F.struct("a", "b", "gap").alias("y"))
    start = F.col("block") * BLOCK
    both = own.withColumn("y", F.lit(None).cast(gap.schema["y"].dataType)).unionByName(gap.withColumn("x", F.lit(None).cast(own.schema["x"].dataType)))
    both = both.withColumn("at", F.greatest(start, F.coalesce("x.a", "y.a")))
    w = Window.partitionBy("block").orderBy("at", F.col("x").isNull())
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    both = both.select("block", "at", F.last("x", True).over(so_far).alias("x"), F.last("y", True).over(so_far).alias("y"), F.lead("at").over(w).alias("next"))
    both = both.filter("x is not null and y is not null")
    end = F.least(F.coalesce("next", start + BLOCK), start + BLOCK, F.col("x.b"), F.col("y.b"))
    return both.withColumn("end", end).filter("end > at").select("x.own", "y.gap", F.col("x.a").alias("own_a"), F.col("y.a").alias("gap_a"), F.col("at").alias("a"), F.col("end").alias("b"))


def _pieces(lengths: DataFrame, size: int, unit: int, depth: int) -> DataFrame:
    """slice, row, first_whole (the sequence of its first whole window) and tails (start, length, sequence_id, offset) of
    each row of lengths (slice, row, n, bin, k, whole)."""
    spark, units = lengths.sparkSession, size // unit
    bins = stored(lengths.groupBy("slice", "bin").agg(F.count("*").alias("m"), F.sum(F.col("n") % size).alias("tokens"), F.sum(F.floor(F.col("n") / size)).alias("wholes")), "bins")
    counts, tokens = np.zeros(units + 1, np.int64), np.zeros(units + 1, np.int64)
    for r in bins.groupBy("bin").agg(F.sum("m").alias("m"), F.sum("tokens").alias("tokens")).collect():
        counts[r.bin], tokens[r.bin] = r.m, r.tokens
    wholes = bins.agg(F.coalesce(F.sum("wholes"), F.lit(0))).first()[0]
    segments, used, planned = [], np.zeros(units + 1, np.int64), 0
    for lengths_in, n in plan(counts, tokens, unit, depth):
        for slot, b in enumerate(lengths_in):
            segments.append((b, int(used[b]), int(used[b]) + n, planned, slot))
            used[b] += n
        planned += n
    of = spark.createDataFrame(segments, "bin long, low long, high long, first long, slot int")

    # Numbers in a bin and whole windows over all slices; then the planned place.
    slice_sums = bins.groupBy("slice").agg(F.sum("wholes").alias("wholes"))
    base = _before(bins.select("slice", "bin", "m"), "m", "base", ["slice"], ["bin"]).join(_before(slice_sums, "wholes", "whole_base", ["slice"], []), "slice")
    known = lengths.join(base.select("slice", "bin", "base", "whole_base"), ["slice", "bin"])
    known = known.select("slice", "row", "n", "bin", (F.col("n") % size).alias("r"), (F.col("k") + F.col("base")).alias("k"), (planned + F.col("whole") + F.col("whole_base")).alias("first_whole"))
    places = known.alias("x").join(F.broadcast(of).alias("s"), (F.col("x.bin") == F.col("s.bin")) & (F.col("x.k") >= F.col("s.low")) & (F.col("x.k") < F.col("s.high")), "left")
    placed = stored(places.select("slice", "row", "n", "r", "first_whole", (F.col("first") + F.col("k") - F.col("low")).alias("seq"), "slot"), "placed")

    # Offsets within the planned sequences, and their gaps on a line.
    group = F.floor(F.col("seq") / GROUP)
    inside = placed.filter("seq is not null").withColumn("group", group)
    inside = _before(inside, "r", "offset", ["slot"], ["group", "seq"])
    inside = inside.withColumn("gap", F.when(F.col("slot") == 0, size - F.sum("r").over(Window.partitionBy("group", "seq"))).otherwise(0))
    inside = stored(_before(inside, "gap", "gap_at", ["seq", "slot"], ["group"]), "inside")
    sums = _before(inside.groupBy("group").agg(F.sum("gap").alias("gap")), "gap", "base", ["group"], [])
    gap = F.struct("seq", (size - F.col("gap")).alias("offset")).alias("gap")
    gaps = inside.filter("gap > 0").join(sums.select("group", "base"), "group").select((F.col("gap_at") + F.col("base")).alias("a"), (F.col("gap_at") + F.col("base") + F.col("gap")).alias("b"), gap)

    # What is left over, on a line as well, and new sequences behind the gaps.
    over = placed.filter("seq is null and r > 0")
    over = stored(_before(over, "r", "at", ["row"], ["slice"]), "over")
    sums_over = stored(_before(over.groupBy("slice").agg(F.sum("r").alias("r")), "r", "base", ["slice"], []), "sums")
    total_gap = inside.agg(F.coalesce(F.sum("gap"), F.lit(0))).first()[0]
    total_over = sums_over.agg(F.coalesce(F.sum("r"), F.lit(0))).first()[0]
    own = F.struct("slice", "row", "n", "r", "first_whole").alias("own")
    line = over.join(sums_over.select("slice", "base"), "slice").select((F.col("at") + F.col("base")).alias("a"), (F.col("at") + F.col("base") + F.col("r")).alias("b"), own)
    more, rest = divmod(max(0, total_over - total_gap), size)
    at = lambda i: total_gap + i * size
    fresh = spark.range(more).select(at(F.col("id")).alias("a"), at(F.col("id") + 1).alias("b"), F.struct((planned + wholes + F.col("id")).alias("seq"), F.lit(0).cast("long").alias("offset")).alias("gap"))
    last, begin = [], at(more)
    for bit in reversed(range(size.bit_length())):
        if rest >> bit & 1:
            last.append((begin, begin + (1 << bit), (planned + wholes + more + len(last), 0)))
            begin += 1 << bit
    ends = spark.createDataFrame(last, "a long, b long, gap struct<seq: long, offset: long>")
    cut = _cut(line, gaps.unionByName(fresh).unionByName(ends))
    start = F.col("own.n") - F.col("own.r") + F.col("a") - F.col("own_a")
    cut = cut.select("own.*", start.alias("start"), (F.col("b") - F.col("a")).alias("length"), F.col("gap.seq").alias("seq"), (F.col("gap.offset") + F.col("a") - F.col("gap_a")).alias("offset"))
    # A piece that goes over a block's bound is one again.
    cut = cut.groupBy("slice", "row", "first_whole", "seq").agg(F.min("start").alias("start"), F.sum("length").alias("length"), F.min("offset").alias("offset"))

    tail = F.struct("start", "length", "seq", "offset")
    one = inside.select("slice", "row", "first_whole", F.array(F.struct((F.col("n") - F.col("r")).alias("start"), F.col("r").alias("length"), "seq", "offset")).alias("tails"))
    some = cut.groupBy("slice", "row", "first_whole").agg(F.collect_list(tail).alias("tails"))
    none = placed.filter("r = 0").select("slice", "row", "first_whole", F.array().cast(one.schema["tails"].dataType).alias("tails"))
    return one.unionByName(some).unionByName(none)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, size: int = SIZE, unit: int = UNIT, depth: int = DEPTH, value: Column | None = None) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset and ids of each piece: its place in the document, in tokens,
    and in its sequence; ids are bytes, each id little-endian in 32 bits. value: a column of these in place of ids."""
    if size & (size - 1) or size % unit or size > BLOCK:
        raise ValueError(f"size must be a power of two, of whole units, and at most {BLOCK}: {size}, {unit}")
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc, n, first, raw, tails in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "first_whole", "ids", "tails")), strict=True):
                ids = memoryview(pa.decompress(raw, 4 * n, "zstd", asbytes=True))
                for i in range(n // size):
                    rows.append((doc, i * size, size, n, first + i, 0, ids[4 * i * size : 4 * (i + 1) * size]))
                for t in tails:
                    a = t["start"]
                    rows.append((doc, a, t["length"], n, t["seq"], t["offset"], ids[4 * a : 4 * (a + t["length"])]))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(list(map(bytes, cols[6])), pa.binary())], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    with scratch(docs.sparkSession):
        every = stored(encoded(docs, id_col, text_col, path, size, unit), "encoded")
        tails = _pieces(every.drop("doc_id", "ids"), size, unit, depth)
        out = every.select("slice", "row", "doc_id", "n", "ids").join(tails, ["slice", "row"]).select("doc_id", "n", "first_whole", "ids", "tails")
        out = out.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]
        return stored(out.select(*names, value if value is not None else F.col("ids")), "pieces", keep=True)
