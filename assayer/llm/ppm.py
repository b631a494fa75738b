"""Language-model scoring by prediction by partial matching (PPM) over bytes.

A text is coded as its lower-cased words, each with a blank after it, and an end symbol: all bytes, in contexts of up to
ORDER bytes before them. The trie's counts come from all training texts. A symbol not seen in a context costs an escape,
with probability q / (n + q) for q distinct symbols seen n times there (escape method C), and is then looked for in the
next shorter context, where the symbols of the longer one are excluded from both counts; below all contexts, the symbols
never seen are equally likely. The score is the log10 of the product.

* Training: tasks count (ORDER + 1)-grams and words of their share; sums are shuffled by key. All shorter grams are sums of
  these. So what is gathered grows with the corpus, and no count is cut.
* Scoring: a symbol's whole chain of contexts shares the two bytes before it, by which the grams are dealt into groups;
  pairs of bytes with over 1/HOT_PAIRS of all grams are split by a third byte (which leaves 2**24 grams at most in one
  part). The texts are cut into slices, and a slice sends its distinct grams to the groups, where each is scored, and gets
  their values back. What no group has whole is broadcast: the counts of two bytes (2**16 at most), and those of three
  bytes that begin with a split pair (256 * HOT_PAIRS at most). No other gram reaches the driver.
* Words: those with at least 1/2**20 of all tokens (so at most 2**20 of them) are broadcast; the counts of the others reach
  the texts by a join on the word's hash, in which no key has more than that share.

Words are compared by 64-bit hashes. A null text is the empty one, with just an end. Rows with the same id and text are
scored alike; each input row gives one. Without training texts all scores are those of the empty model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blobs import cuts, squeezed, unsqueezed
from .common import Words, bounded, mix, release, slices, stored

ORDER = 5
GROUP_GRAMS = 250_000
GROUPS_LEAST = 64
HOT_PAIRS = 1 << 12
HOT_SHARE = 1 << 20
END = 0xFF
PART = 2 << 20
SLICE = 16 << 20
_U = np.uint64


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The (ORDER + 1)-grams of all coded symbols of the texts, as numbers, and where each text's begin."""
    pad = bytes([END]) * ORDER
    coded = [pad + b"".join(w + b" " for w in t.lower().split()) + bytes([END]) for t in texts]
    raw = np.frombuffer(b"".join(coded), np.uint8)
    g = np.zeros(len(raw), _U)
    for i in range(ORDER + 1):
        g[ORDER:] |= raw[i : len(raw) - ORDER + i].astype(_U) << _U(8 * (ORDER - i))
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    real = np.ones(len(raw), bool)
    begin = np.cumsum(sizes) - sizes
    for i in range(ORDER):
        real[begin + i] = False
    sizes -= ORDER
    return g[real], np.cumsum(sizes) - sizes


def counted(keys: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often (or with what weight) each occurs."""
    if weight is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, weight = keys[order], weight[order]
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    if weight is None:
        return keys[at], np.diff(np.concatenate([at, [len(keys)]]))
    return keys[at], np.add.reduceat(weight, at) if len(at) else weight


class Table:
    """Open addressing over arrays: find() gives each key's number, or -1."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, _U(0))
        self.mask = (1 << max(4, int(2 * len(keys)).bit_length())) - 1
        self.slots = np.full(self.mask + 1, -1, np.int32)
        left, home, step = np.arange(len(keys)), self._home(keys), 0
        while len(left):
            at = (home[left] + step) & self.mask
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            left = left[self.slots[at] != left]
            step += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) & _U(self.mask)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        home = self._home(keys)
        got = self.slots[home]
        open_ = np.flatnonzero((got >= 0) & (self.keys[got] != keys))
        step = 1
        while len(open_):
            s = self.slots[(home[open_] + step) & self.mask]
            got[open_] = s
            open_ = open_[(s >= 0) & (self.keys[s] != keys[open_])]
            step += 1
        return got


@dataclass
class Outline:
    """What all groups of grams share; its size has a bound.

    pairs, triples: grams of two bytes, and those of three bytes that begin with a split pair, each with counts;
    split: for each pair of bytes whether its grams are dealt by a third byte; groups: how many there are."""

    pairs: tuple[np.ndarray, np.ndarray]
    triples: tuple[np.ndarray, np.ndarray]
    split: np.ndarray
    groups: int

    def group(self, g: np.ndarray) -> np.ndarray:
        before = g >> _U(8)
        pair = before & _U(0xFFFF)
        shard = np.where(self.split[pair.astype(np.int64)], (before & _U(0xFFFFFF)) | _U(1 << 24), pair)
        return ((mix(shard) >> _U(32)) * _U(self.groups) >> _U(32)).astype(np.int32)

    def dealt(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order that brings rising grams group by group, and the groups in it."""
        group = self.group(g)
        order = np.argsort(group, kind="stable")
        return order, group[order]


class Trie:
    """A group of the model: counts of its (ORDER + 1)-grams, and of the shorter ones that the outline has."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, outline: Outline):
        self.single = np.bincount((outline.pairs[0] & _U(255)).astype(np.int64), outline.pairs[1], 256).astype(np.int64)
        self.levels = {}
        full = counts.astype(np.int64)
        for k in range(ORDER, 0, -1):
            # grams of k + 1 bytes: a context of k bytes and a symbol
            if k == 2:
                whole = ~outline.split[(keys >> _U(8)).astype(np.int64)]
                keys, full = np.concatenate([keys[whole], outline.triples[0]]), np.concatenate([full[whole], outline.triples[1]])
            if k == 1:
                keys, full = outline.pairs
            self.levels[k] = (Table(keys), keys, full)
            if k > 2:
                keys, full = counted(keys & _U((1 << 8 * k) - 1), full)
        self.contexts = {}
        for k in range(1, ORDER + 1):
            _, g, c = self.levels[k]
            ctx, n = counted(g >> _U(8), c)
            _, q = counted(g >> _U(8))
            below = self.single[(g & _U(255)).astype(np.int64)] if k == 1 else self.levels[k - 1][2][self.levels[k - 1][0].find(g & _U((1 << 8 * k) - 1))]
            _, e = counted(g >> _U(8), below)
            self.contexts[k] = (Table(ctx), np.append(n, 0), np.append(q, 0), np.append(e, 0))

    def log10p(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros(len(g))
        live = np.arange(len(g))
        e = q_out = np.zeros(len(g), np.int64)
        for k in range(ORDER, -1, -1):
            own = g[live] & _U((1 << 8 * (k + 1)) - 1)
            if k:
                table, n, q, mass = self.contexts[k]
                c = table.find(own >> _U(8))
                n, q, mass = n[c], q[c], mass[c]
                at = self.levels[k][0].find(own)
                count = np.append(self.levels[k][2], 0)[at]
            else:
                n = np.full(len(live), self.single.sum())
                q = np.full(len(live), np.count_nonzero(self.single))
                mass = np.zeros(len(live), np.int64)
                count = self.single[own.astype(np.int64)]
            seen = n > 0
            whole, kinds = n + q - e - q_out, q - q_out
            hit = count > 0
            out[live[hit]] += np.log10(count[hit] / whole[hit])
            miss = ~hit & seen & (kinds > 0)
            out[live[miss]] += np.log10(kinds[miss] / whole[miss])
            e, q_out = np.where(seen, mass, e)[~hit], np.where(seen, q, q_out)[~hit]
            live = live[~hit]
        out[live] += np.log10(1.0 / np.maximum(1, 256 - q_out))
        return out


def _train(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts of words and of grams over the training rows: two tables of key and n."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {0: [], 1: []}

        def put(kind: int, found: tuple[np.ndarray, np.ndarray], last: bool = False) -> Iterator[pa.RecordBatch]:
            if not last:
                held[kind].append(found)
            if held[kind] and (last or sum(len(k) for k, _ in held[kind]) > 1_500_000):
                k, n = counted(np.concatenate([k for k, _ in held[kind]]), np.concatenate([n for _, n in held[kind]]))
                held[kind] = [] if last or len(k) > 700_000 else [(k, n)]
                if not held[kind]:
                    for a in range(0, len(k), 100_000):
                        part = k[a : a + 100_000]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int8)), pa.array(part.view(np.int64)), pa.array(n[a : a + 100_000])], ["kind", "key", "n"])

        for part in slices(batches, PART):
            words = Words(part, lower=True)
            yield from put(0, counted(words.hashes()))
            yield from put(1, counted(grams(words.parts)[0]))
        yield from put(0, None, True)
        yield from put(1, None, True)

    found = stored(rows.select("text").mapInArrow(run, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm-counts")
    return found.filter("kind = 0").select("key", "n"), found.filter("kind = 1").select("key", "n")


def _outline(found: DataFrame, splits: int) -> Outline:
    """splits: of the input; there is a group for every 16 of them at least."""
    triples = stored(found.groupBy(F.col("key").bitwiseAND(F.lit(0xFFFFFF)).alias("key")).agg(F.sum("n").alias("n"), F.count("*").alias("grams")), "lm-triples")

    def told(t: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        t = t.toArrow()
        return t["key"].to_numpy().view(_U), t["n"].to_numpy().astype(np.int64)

    pairs = told(triples.groupBy(F.col("key").bitwiseAND(F.lit(0xFFFF)).alias("key")).agg(F.sum("n").alias("n")))
    pair, size = told(triples.groupBy(F.shiftright("key", 8).alias("key")).agg(F.sum("grams").alias("n")))
    total = int(size.sum())
    often = pair[size * HOT_PAIRS > total].astype(np.int64)
    split = np.zeros(1 << 16, bool)
    split[often] = True
    return Outline(pairs, told(triples.filter(F.shiftright("key", 8).isin(often.tolist())).select("key", "n")), split, max(GROUPS_LEAST, total // GROUP_GRAMS, splits // 16))


_SLICE = "slice long, kind byte, grp int, texts binary, grams binary, n binary"


def _rows(of: list[tuple]) -> pa.RecordBatch:
    """Rows of slice, kind, grp, texts, grams and n."""
    kinds = (pa.int64(), pa.int8(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*of, strict=True), kinds, strict=True)], ["slice", "kind", "grp", "texts", "grams", "n"])


def _texts(part: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]


def _distinct(parts: list[pa.RecordBatch]) -> np.ndarray:
    """The distinct grams of a slice, from those of its parts."""
    return counted(np.concatenate([counted(grams(_texts(p))[0])[0] for p in parts]))[0]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Slices of about SLICE bytes, in parts of PART: the larger a slice, the fewer distinct grams for its size."""
    held, size = [], 0
    for part in slices(batches, PART):
        if held and size + part.nbytes > SLICE:
            yield held
            held, size = [], 0
        held.append(part)
        size += part.nbytes
    if held:
        yield held


def _cut(rows: DataFrame, sent) -> DataFrame:
    """rows in slices: for each a row (of grp -1) with its texts and other columns, and one for each group with its distinct
    grams. A slice has its task's number in the upper half of its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for i, parts in enumerate(_gathered(batches)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for part in parts:
                    out.write_batch(part)
            yield _rows([(task | i, 1, -1, sink.getvalue().to_pybytes(), None, None)])
            g = _distinct(parts)
            order, group = sent.value.dealt(g)
            g = g[order]
            yield _rows([(task | i, 1, k, None, squeezed(np.diff(g[a:b], prepend=_U(0))), None) for k, a, b in cuts(group)])

    return stored(rows.mapInArrow(run, _SLICE), "lm-slices")


def _model(found: DataFrame, sent) -> DataFrame:
    """The grams and their counts in groups: some rows for each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def put() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            g, n = counted(t["key"].to_numpy().view(_U), t["n"].to_numpy())
            order, group = sent.value.dealt(g)
            g, n = g[order], n[order]
            return _rows([(0, 0, k, None, squeezed(np.diff(g[a:b], prepend=_U(0))), squeezed(n[a:b])) for k, a, b in cuts(group)])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 1_000_000:
                yield put()
                held, size = [], 0
        if size:
            yield put()

    return found.mapInArrow(run, _SLICE)


def _keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unsqueezed(raw, _U), dtype=_U)


def _valued(model: DataFrame, asked: DataFrame, sent) -> DataFrame:
    """slice, kind 0, grp and n, the values of the grams that the slice has sent to the group. A task has one group: first its
    grams, then those asked of it, one slice after the other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, trie = [], None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    held.append((_keys(r["grams"]), unsqueezed(r["n"], np.int64)))
                    continue
                if trie is None:
                    none = [(np.zeros(0, _U), np.zeros(0, np.int64))]
                    trie = Trie(*counted(*map(np.concatenate, zip(*(held or none), strict=True))), sent.value)
                    held = []
                g = _keys(r["grams"])
                p = [trie.log10p(g[a : a + (1 << 18)]) for a in range(0, len(g), 1 << 18)]
                out.append((r["slice"], 0, r["grp"], None, None, squeezed(np.concatenate(p))))
            if out:
                yield _rows(out)
        trie = None
        release()

    groups = sent.value.groups
    return model.unionByName(asked).repartitionById(groups, "grp").sortWithinPartitions("kind", "slice").mapInArrow(run, _SLICE)


def _summed(parts: list[pa.RecordBatch], values: list[np.ndarray], outline: Outline) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The parts of a slice, and for each text the sum over its symbols, from the values that the groups have sent, in their
    order."""
    keys = _distinct(parts)
    p = np.empty(len(keys))
    p[outline.dealt(keys)[0]] = np.concatenate(values)
    table = Table(keys)
    for part in parts:
        g, begin = grams(_texts(part))
        yield part, np.add.reduceat(p[table.find(g)], begin)


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, training, n_tokens, n_known, train_tokens, base_score (of a smoothed unigram model of the words) and score.

    training: a boolean column over docs that tells which rows to learn from (null: not)."""
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(training, F.lit(False)).alias("training"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words, found = _train(rows.filter("training"))
    n_docs = rows.filter("training").count()
    sums = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_tokens, distinct = (sums.n or 0) + n_docs, sums.v + (n_docs > 0)
    hot_from = max(2, n_tokens // HOT_SHARE + 1)
    t = words.filter(F.col("n") >= hot_from).orderBy("key").toArrow() if distinct > HOT_SHARE else words.toArrow()
    keys, counts = t["key"].to_numpy().view(_U), t["n"].to_numpy().astype(np.float64)
    order = np.argsort(keys)
    hot = rows.sparkSession.sparkContext.broadcast((keys[order], counts[order]))
    rare = words.filter(F.col("n") < hot_from) if distinct > HOT_SHARE else words.limit(0)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """The parts of each slice with their scores; a slice's values come before it."""
        values = []
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    values.append(unsqueezed(r["n"], np.float64))
                else:
                    yield from _summed(list(pa.ipc.open_stream(r["texts"])), values, sent.value)
                    values = []
        release()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each row one entry with what is known of it here, and one for each distinct other word."""
        keys, counts = hot.value
        for part, score in told(batches):
            w = Words(part, lower=True)
            h = w.hashes()
            by_key = np.argsort(h, kind="stable")
            h, doc = h[by_key], w.doc[by_key]
            new = np.concatenate([np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
            at = np.flatnonzero(new)
            n = np.diff(np.concatenate([at, [len(h)]]))
            h, doc = h[at], doc[at]
            i = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
            here = keys[i] == h if len(keys) else np.zeros(len(h), bool)
            k = len(w.first) - 1
            base = np.bincount(doc[here], n[here] * np.log10(counts[i[here]] + 0.1), k) if here.any() else np.zeros(k)
            known = np.bincount(doc[here], n[here], k) if here.any() else np.zeros(k)
            ids, marks = part.column("doc_id"), part.column("mark").to_numpy()
            rest, n = doc[~here], n[~here]
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([ids, ids.take(pa.array(rest))]), pa.array(np.concatenate([marks, marks[rest]])),
                pa.array(np.concatenate([marks, h[~here].view(np.int64)])), pa.array(np.concatenate([np.diff(w.first), n])),
                pa.array(np.concatenate([base, np.zeros(len(rest))])), pa.array(np.concatenate([known.astype(np.int64), np.zeros(len(rest), np.int64)])),
                pa.concat_arrays([pa.array(score), pa.nulls(len(rest), pa.float64())]), pa.concat_arrays([part.column("training"), pa.nulls(len(rest), pa.bool_())]),
            ], ["doc_id", "mark", "key", "n", "base", "known", "score", "training"])

    sent = rows.sparkSession.sparkContext.broadcast(_outline(found, rows.rdd.getNumPartitions()))
    cut = _cut(rows.withColumn("mark", F.xxhash64("text", "training")), sent)
    task = F.shiftright("slice", 32).cast("int")
    tasks = (cut.filter("grp = -1").agg(F.max(task).alias("n")).first().n or 0) + 1
    asked = cut.filter("grp >= 0").select("slice", "kind", "grp", F.lit(None).cast("binary").alias("texts"), "grams", "n")
    texts = cut.filter("grp = -1").select("slice", "kind", "grp", "texts", F.lit(None).cast("binary").alias("grams"), "n")
    back = _valued(_model(found, sent), asked, sent).unionByName(texts).repartitionById(tasks, task).sortWithinPartitions("slice", "kind", "grp")
    entries = back.mapInArrow(run, "doc_id long, mark long, key long, n long, base double, known long, score double, training boolean")
    joined = entries.join(rare.withColumnsRenamed({"key": "word", "n": "c"}), F.col("key") == F.col("word"), "left")
    own = F.col("score").isNotNull()
    word_known = F.when(own, F.col("known")).otherwise(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0))
    word_base = F.when(own, F.col("base")).otherwise(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1)))
    each = joined.groupBy("doc_id", "mark").agg(
        F.count_if(own).alias("copies"), F.sum(F.when(own, F.col("n"))).alias("words"), F.sum(word_known).alias("known"),
        F.sum(word_base).alias("base"), F.max("score").alias("score"), F.max("training").alias("training"),
    )
    copies = F.col("copies")
    tokens = (F.col("words") / copies).cast("long") + 1
    norm = float(np.log10(n_tokens + 0.1 * (distinct + 1)))
    one = each.select(
        "doc_id", "training", tokens.alias("n_tokens"), ((F.col("known") / copies).cast("long") + F.lit(int(n_docs > 0))).alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"), (F.col("base") / copies + F.lit(float(np.log10(n_docs + 0.1))) - tokens * F.lit(norm)).alias("base_score"), "score", "copies",
    )
    return one.withColumn("copies", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).drop("copies")
