"""N-gram Jaccard join: all links between texts whose sets of word shingles have a similarity of 0.75 or more.

A text's set holds its distinct runs of five lower-cased words (a text of fewer: its whole sequence; none: the empty set,
linked with nothing). Texts of equal word sequences are one class, and links are found between classes.

1. Sharing. Of each shingle the task's slice sends one entry with the number of its classes; what recurs within the slice
   is settled there. A shingle's group sums them up, and tells each slice in how many classes its shingles are. A class
   with a link shares 75 % of its set or more; the others end here. Those left keep the shingles that are shared, and the
   number of all.
2. Rare-first prefixes. The order of shingles is by that number, ties by hash; those of one class alone (never sent) come
   first. Two linked classes share a shingle among their first n - ceil(0.75 n) + 1.
3. Candidates, under the length and the positional filter; later also under a suffix filter, which bounds the difference
   of two whole sets by parity sketches. First each list of a shingle is cut into parts of about PART_CLASSES classes, and
   each class meets one class (the hub) of its part. Then, round by round, of each component that a list holds one class,
   another each time, meets one of the list's largest component, until few pairs are left or a round hardly lessens them.
   Last, what is still of several components: every class beside the largest component meets those of other components.
   Pairs within a component can't change it. Each pair is verified once: those that failed are remembered. Edges lead from
   component to component.

Shingles are compared by 64-bit hashes. A class is a 64-bit hash of its word sequence. Null texts have no words; rows
with null ids are in no component (component_id null), and link nothing. Rows of one id with different texts are nodes
apart, both under that id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blobs import cuts, group_of, pack, pack_sorted, slice_name, squeezed, unpack, unpack_sorted, unsqueezed
from .common import Words, bounded, groups_for, mix, powers, release, scratch, slices, stored, windows
from .components import components, named
from .native import small

SHINGLE_WORDS = 5
PERCENT = 75
SKETCH_BITS = 512
#: Classes of a list that meet one hub, about; a power of two.
PART_CLASSES = 1 << 10
#: Rounds in which lists meet hubs before all pairs of components are looked at; at most, as they end when these are no more
#: than FEW_PAIRS for each row of the lists.
HUB_ROUNDS = 6
FEW_PAIRS = 8
SLICE = 4 << 20
#: Rows of a group after which a worker gives memory back.
TRIMMED_ROWS = 256
_U = np.uint64
_SENT = "side byte, grp int, slice long, a binary, b binary, c binary"
_NAMES = ["side", "grp", "slice", "a", "b", "c"]
_TYPES = [pa.int8(), pa.int32(), pa.int64(), *[pa.binary()] * 3]
#: Kinds of rows: shingles for their group; then, for their slice, what the groups tell, its own repeats, and its classes.
_SHINGLES, _TOLD, _OWN, _CLASSES = 0, 1, 2, 3


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 64], strict=True), _TYPES, strict=True)], _NAMES)


def _home(name: int, groups: int) -> int:
    """The group of a slice."""
    return (name & 0xFFFFFFFF) % groups


class Sets:
    """Of a slice: each row's class, its number of distinct shingles, and all (row, shingle) pairs once, by row."""

    def __init__(self, part: pa.RecordBatch, k: int):
        w = Words(part, lower=True)
        h = w.hashes()
        n = np.diff(w.first)
        up, down = powers(0xBF58476D1CE4E5B9, max(1, len(h)))
        total = np.concatenate([np.zeros(1, _U), np.cumsum(h * up[: len(h)], dtype=_U)])
        start = w.first[:-1]
        whole = (total[w.first[1:]] - total[start]) * down[np.minimum(start, max(0, len(down) - 1))]
        self.cls = mix(whole + mix(n.astype(_U)))
        at = np.flatnonzero(w.runs(h, k)[1]) if len(h) else np.zeros(0, np.int64)
        short = np.flatnonzero((n > 0) & (n < k))
        rows = np.concatenate([w.doc[at], short])
        keys = np.concatenate([windows(h, k)[at] if len(h) else h, mix(self.cls[short] ^ _U(0xA5A5A5A5A5A5A5A5))])
        order = np.lexsort((keys, rows))
        rows, keys = rows[order], keys[order]
        new = np.concatenate([np.ones(min(1, len(rows)), bool), (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])])
        self.rows, self.keys = rows[new], keys[new]
        self.n = np.bincount(self.rows, minlength=len(n))


def _sliced(groups: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE):
            s = Sets(part, k)
            # One row for each class in the slice.
            _, lead = np.unique(s.cls, return_index=True)
            number = np.full(len(s.cls), -1, np.int32)
            number[lead] = np.arange(len(lead))
            own = number[s.rows] >= 0
            keys, cls = s.keys[own], number[s.rows[own]]
            if not len(keys):
                continue
            order = np.argsort(keys, kind="stable")
            keys, cls = keys[order], cls[order]
            name = slice_name(s.cls[lead])
            home = (name & 0xFFFFFFFF) % groups
            at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            size = np.diff(np.append(at, len(keys))).astype(np.int32)
            many = np.repeat(size > 1, size)
            rows = [(_CLASSES, home, name, pack(s.cls[lead]), squeezed(s.n[lead].astype(np.int32)), b"")]
            if many.any():
                rows.append((_OWN, home, name, pack_sorted(keys[many]), squeezed(cls[many]), b""))
            # A class's number and 1; or 0 where there are several, whose number follows.
            keys, cls = keys[at], np.where(size > 1, 0, cls[at] + 1).astype(np.int32)
            rows += [(_SHINGLES, g, name, pack_sorted(keys[a:b]), squeezed(cls[a:b]), squeezed(size[a:b][size[a:b] > 1])) for g, a, b in cuts(group_of(keys, groups))]
            yield from _batches(rows)

    return run


def _sharing(groups: int):
    """In how many classes each of a group's shingles is, told to its slices where that is more than one.

    A class that is in two slices counts twice: it is then looked at further, and nothing is lost."""
    def run(table: pa.Table) -> pa.Table:
        if table["side"][0].as_py() != _SHINGLES:
            return table
        rows = table.select(["slice", "a", "b", "c"]).to_pylist()
        keys = np.concatenate([unpack_sorted(r["a"]) for r in rows])
        which = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r["a"]) // 8 for r in rows])
        cls = np.concatenate([unsqueezed(r["b"], np.int32) for r in rows])
        count = np.ones(len(keys), np.int64)
        count[cls == 0] = np.concatenate([unsqueezed(r["c"], np.int32) for r in rows])
        order = np.argsort(keys, kind="stable")
        keys, which, cls = keys[order], which[order], cls[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        total = np.minimum(np.add.reduceat(count[order], at), (1 << 31) - 1).astype(np.int32)
        total = np.repeat(total, np.diff(np.append(at, len(keys))))
        keys, which, cls, total = (x[total > 1] for x in (keys, which, cls, total))
        order = np.argsort(which, kind="stable")
        keys, which, cls, total = (x[order] for x in (keys, which, cls, total))
        out = []
        for i, a, b in cuts(which):
            name = rows[i]["slice"]
            out.append((_TOLD, (name & 0xFFFFFFFF) % groups, name, pack_sorted(keys[a:b]), squeezed(cls[a:b]), squeezed(total[a:b])))
        return pa.Table.from_batches(list(_batches(out)) or [pa.RecordBatch.from_arrays([pa.array([], t) for t in _TYPES], _NAMES)])

    return run


def sketch(keys: np.ndarray) -> list[int]:
    """The parities of the counts in SKETCH_BITS bins. A shingle in which two sets differ turns one bit; so sets differ in
    at least as many shingles as their sketches in bits."""
    odd = np.bincount((keys & _U(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _of_slice(first: dict, own: list[dict], told: list[dict], percent: int) -> Iterator[tuple]:
    c, n = unpack(first["a"], _U).view(np.int64), unsqueezed(first["b"], np.int32)
    keys, cls, total = (np.concatenate(x) for x in ([unpack_sorted(r["a"]) for r in told], [unsqueezed(r["b"], np.int32) for r in told], [unsqueezed(r["c"], np.int32) for r in told]))
    # The slice's repeats have their numbers from what is told of them.
    several = cls == 0
    known, numbers = keys[several], total[several]
    order = np.argsort(known, kind="stable")
    known, numbers = known[order], numbers[order]
    keys, cls, total = keys[~several], cls[~several] - 1, total[~several]
    if own:
        more = np.concatenate([unpack_sorted(r["a"]) for r in own])
        keys, cls = np.concatenate([keys, more]), np.concatenate([cls, *[unsqueezed(r["b"], np.int32) for r in own]])
        total = np.concatenate([total, numbers[np.searchsorted(known, more)]])
    order = np.lexsort((keys, total, cls))
    keys, cls, total = keys[order], cls[order], total[order]
    # Slices alike have one name, and are told twice.
    new = np.concatenate([np.ones(min(1, len(keys)), bool), (keys[1:] != keys[:-1]) | (cls[1:] != cls[:-1])])
    keys, cls, total = keys[new], cls[new], total[new]
    for i, a, b in cuts(cls):
        if 100 * (b - a) >= percent * int(n[i]):
            size = int(n[i])
            p = max(0, size - _least(percent, size) + 1 - (size - (b - a)))
            yield int(c[i]), size, keys[a:b].tobytes(), squeezed(total[a : a + p]), sketch(keys[a:b])


def _survivors(percent: int):
    """The classes of a group's slices of which enough is shared: c, n, the shared shingles in order, and in how many
    classes those of the prefix are."""
    def run(table: pa.Table) -> pa.Table:
        names, side = table["slice"].to_numpy(), table["side"].to_numpy()
        out = []
        for name in np.unique(names):
            of = lambda kind: table.filter(pa.array((names == name) & (side == kind))).to_pylist()  # noqa: B023, E731
            first, told = of(_CLASSES), of(_TOLD)
            if first and told:
                out += _of_slice(first[0], of(_OWN), told, percent)
        if len(table) > TRIMMED_ROWS:
            release()
        cols = zip(*out, strict=True) if out else [()] * 5
        return pa.table([pa.array(x, t) for x, t in zip(cols, [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())], strict=True)], ["c", "n", "keys", "numbers", "sketch"])

    return run


def _least(percent: int, n):
    """Smallest number of common shingles that a partner of a set of n must have."""
    return -(-percent * n // 100)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, c, n, pos (in the whole order), part (of the key's list) and parts of each class's prefix."""
    names = ["key", "c", "n", "pos", "part", "parts"]
    for b in batches:
        out: list[tuple] = []
        for c, n, raw, numbers in zip(*(b.column(x).to_pylist() for x in ("c", "n", "keys", "numbers")), strict=True):
            number = unsqueezed(numbers, np.int32).astype(np.int64)
            p, alone = len(number), n - len(raw) // 8
            parts = np.int64(1) << np.maximum(0, np.ceil(np.log2(number / PART_CLASSES))).astype(np.int64)
            part = int(mix(np.array([c], np.int64).view(_U))[0] >> _U(1)) & (parts - 1)
            out.append((np.frombuffer(raw, np.int64, p), np.full(p, c), np.full(p, n, np.int32), (alone + np.arange(p)).astype(np.int32), part, parts))
            if sum(len(x[0]) for x in out[-200:]) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names)


def _possible(percent: int, sketches: bool):
    """Rows with n1, n2, pos1, pos2 (and sketches, alone1, alone2) of which the sets may reach the similarity."""
    least = F.ceil(percent * (F.col("n1") + F.col("n2")) / F.lit(100 + percent) - 1e-9)
    room = lambda i: F.col(f"n{i}") - F.col(f"pos{i}") - 1
    # Two sets of n1 and n2 must have `least` in common. What is left after a common place bounds it.
    may = (100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2")) & (F.least("pos1", "pos2") + 1 + F.least(room(1), room(2)) >= least)
    if not sketches:
        return may
    # So do the sketches: shingles of one class alone, and those that the sketches tell apart, aren't in common.
    apart = F.col("alone1") + F.col("alone2")
    for i in range(SKETCH_BITS // 64):
        apart = apart + F.bit_count(F.get(F.col("sketch1"), F.lit(i)).bitwiseXOR(F.get(F.col("sketch2"), F.lit(i))))
    return may & (apart <= F.col("n1") + F.col("n2") - 2 * least)


def _verified(pairs: DataFrame, sets: DataFrame, tried: DataFrame | None, percent: int) -> DataFrame:
    """Of pairs c1, root1, c2, root2 those that weren't tried, once each, with ok: whether they reach the similarity."""
    turned = F.col("c1") > F.col("c2")
    side = lambda n, i: F.when(turned, F.col(f"{n}{3 - i}")).otherwise(F.col(f"{n}{i}")).alias(f"{n}{i}")
    new = pairs.select(side("c", 1), side("root", 1), side("c", 2), side("root", 2)).distinct()
    if tried is not None:
        new = new.join(tried.select("c1", "c2"), ["c1", "c2"], "left_anti")
    new = stored(new, "pairs")
    # Only sets that are asked for are shuffled, where that can be told in advance.
    asked = small(new.select(F.col("c1").alias("c")).unionByName(new.select(F.col("c2").alias("c"))).distinct())
    sets = sets.join(asked, "c", "left_semi")
    for i in (2, 1):
        new = new.join(sets.select(F.col("c").alias(f"c{i}"), F.col("n").alias(f"n{i}"), F.col("keys").alias(f"keys{i}")), f"c{i}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok = []
            for n1, k1, n2, k2 in zip(*(t.column(x).to_pylist() for x in ("n1", "keys1", "n2", "keys2")), strict=True):
                common = len(np.intersect1d(np.frombuffer(k1, _U), np.frombuffer(k2, _U), assume_unique=True))
                ok.append(100 * common >= percent * (n1 + n2 - common))
            names = ["c1", "root1", "c2", "root2"]
            yield pa.RecordBatch.from_arrays([*(t.column(x) for x in names), pa.array(ok, pa.bool_())], [*names, "ok"])

    cols = [f"{x}{i}" for i in (1, 2) for x in ("c", "root", "n", "keys")]
    return stored(new.select(cols).mapInArrow(run, "c1 long, root1 long, c2 long, root2 long, ok boolean"), "tried")


def _merged(tried: DataFrame) -> DataFrame:
    """root and top: the components that the links join, by the smallest."""
    return stored(components(tried.filter("ok").select(F.col("root1").alias("u"), F.col("root2").alias("v"))).select(F.col("node").alias("root"), F.col("root").alias("top")), "tops")


def _moved(rows: DataFrame, tops: DataFrame) -> DataFrame:
    return named(rows, tops, "root").withColumn("root", F.coalesce("top", "root")).drop("top")


def _sides(a: DataFrame, b: DataFrame, on: list[str], cols: list[str]) -> DataFrame:
    side = lambda df, i: df.select(*on, *[F.col(n).alias(f"{n}{i}") for n in cols])
    return side(a, 1).join(side(b, 2), on)


def links(docs: DataFrame, text_col: str = "text", percent: int = PERCENT, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """c and root (the component) of each class that shares enough with others to be linked at all."""
    with scratch(docs.sparkSession):
        return stored(_links(docs, text_col, percent, shingle_words), "linked", keep=True)


def _links(docs: DataFrame, text_col: str, percent: int, shingle_words: int) -> DataFrame:
    groups = groups_for(bounded(docs))
    sent = docs.select(F.col(text_col).alias("text")).mapInArrow(_sliced(groups, shingle_words), _SENT)
    sent_back = sent.groupBy("side", "grp").applyInArrow(_sharing(groups), _SENT)
    # A class is told by each slice that it is in, in the same words.
    told = sent_back.groupBy("grp").applyInArrow(_survivors(percent), "c long, n int, keys binary, numbers binary, sketch array<long>")
    sets = stored(told.groupBy("c").agg(*[F.first(x).alias(x) for x in ("n", "keys", "numbers", "sketch")]), "sets")
    lists = sets.select("c", "n", "keys", "numbers").mapInArrow(_prefixes, "key long, c long, n int, pos int, part long, parts long")
    full = ["c", "root", "n", "pos", "sketch", "alone"]

    # A part of a list meets its hub where it is gathered. Lists of one class (whose copies are in several slices) end here.
    here = Window.partitionBy("key", "part")
    lists = lists.withColumn("hub", F.min(F.struct("n", "c", "pos")).over(here)).withColumn("k", F.count("*").over(here)).filter("k > 1 or parts > 1")
    lists = stored(lists.select("key", "c", "n", "pos", "parts", "hub"), "lists")
    side = lambda at, i: [F.col(f"{at}{n}").alias(f"{n}{i}") for n in ("c", "n", "pos")] + [F.col(f"{at}c").alias(f"root{i}")]
    near = lists.select(*side("", 1), *side("hub.", 2)).filter((F.col("c1") != F.col("c2")) & _possible(percent, False))
    tried = _verified(near, sets, None, percent)
    tops = _merged(tried)
    part = _moved(sets.select("c", F.col("c").alias("root")), tops)

    shown = sets.select("c", "sketch", (F.col("n") - F.length("keys") / 8).cast("int").alias("alone"))
    lists, left, size = _mixed(_moved(lists.select("key", "c", "n", "pos", "parts", F.col("c").alias("root")), tops))
    if not size:
        return part
    lists = stored(lists.join(shown, "c"), "shown")
    for seed in range(1, HUB_ROUNDS):
        # Of each list one class of each component, another each round; and of the largest of them, the one to meet.
        one = lists.groupBy("key", "root", "parts").agg(F.count("*").alias("k"), F.min_by(F.struct("c", "n", "pos", "sketch", "alone"), F.xxhash64("c", "key", F.lit(seed))).alias("x"))
        one = stored(one.select("key", F.pmod(F.xxhash64("root"), F.greatest(F.lit(1), F.shiftright("parts", 10 * seed))).alias("part"), "root", "k", "x.*"), "ones")
        hub = one.groupBy("key", "part").agg(F.max_by(F.struct(*full), F.struct("k", F.xxhash64("c", "key", F.lit(seed)))).alias("hub")).select("key", "part", "hub.*")
        near = _sides(one, hub, ["key", "part"], full).filter((F.col("root1") != F.col("root2")) & _possible(percent, True))
        more = _verified(near, sets, tried, percent)
        tried = tried.unionByName(more)
        if more.filter("ok").isEmpty():
            break
        tops = _merged(more)
        part = _moved(part, tops)
        before = left
        lists, left, size = _mixed(_moved(lists.drop("most"), tops))
        # All pairs that are left are few, or further rounds would hardly make them fewer.
        if left <= FEW_PAIRS * size or left > before * 7 / 8:
            break
    if not size:
        return part
    beside = lists.filter("root <> most").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    every = lists.withColumn("part", F.pmod(F.xxhash64("c"), "parts"))
    pairs = _sides(beside, every, ["key", "part"], [*full, "most"]).filter((F.col("root1") != F.col("root2")) & ((F.col("root2") == F.col("most2")) | (F.col("root1") < F.col("root2"))) & _possible(percent, True))
    return _moved(part, _merged(_verified(pairs, sets, tried, percent)))


def _mixed(lists: DataFrame) -> tuple[DataFrame, int, int]:
    """The lists that hold several components, with the largest of them (most); the number of pairs of a class beside it with
    any class of the list; and the number of rows."""
    lists = stored(lists, "lists")
    sizes = lists.groupBy("key", "root").agg(F.count("*").alias("k")).groupBy("key").agg(F.count("*").alias("roots"), F.sum("k").alias("k"), F.max("k").alias("top"), F.max_by("root", F.struct("k", "root")).alias("most"))
    several = stored(sizes.filter("roots > 1").select("key", "most", "k", (F.col("k") * (F.col("k") - F.col("top"))).cast("double").alias("left")), "several")
    left, size = several.agg(F.coalesce(F.sum("left"), F.lit(0.0)), F.coalesce(F.sum("k"), F.lit(0))).first()
    return stored(lists.join(several.select("key", "most"), "key"), "mixed"), left, size


def _classes(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE):
            s = Sets(part, k)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s.cls.view(np.int64)), pa.array(s.n.astype(np.int64))], ["doc_id", "c", "n_shingles"])

    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, c long, n_shingles long")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row."""
    rows = stored(_classes(docs, id_col, text_col, shingle_words), "classes")
    low = rows.filter("n_shingles > 0").groupBy("c").agg(F.min("doc_id").alias("low"))
    each = stored(low.join(links(docs.filter(F.col(id_col).isNotNull()), text_col, percent, shingle_words), "c", "left").withColumn("root", F.coalesce("root", "c")), "components")
    tops = each.groupBy("root").agg(F.min("low").alias("top"), F.count("*").alias("k")).filter("k > 1").select("root", "top")
    each = named(each, stored(tops, "tops"), "root").select("c", F.coalesce("top", "low").alias("component_id"))
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return rows.join(each, "c", "left").select("doc_id", "n_shingles", own.alias("component_id"))
