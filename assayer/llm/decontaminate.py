"""Benchmark decontamination in DataFrame functions only: SimHash fingerprints of item-sized windows.

Texts are lower-cased and cut at blanks into words; a shingle is five words (an item of fewer is one shingle of its
own length). An item of m shingles is compared with windows of m consecutive shingles of a document (the whole of a
shorter document). A document is contaminated by an item if some window reaches a weighted-shingle similarity
sum(min(count)) / sum(max(count)) of 0.75 or more.

1. Hits: places where a document has a shingle of an item (the items' side is counted, and broadcast if small).
2. Windows: those that start at a hit and hold enough hits to reach the similarity. No other window can be better:
   slid on to its first hit, a window loses none. So nothing is lost here.
3. Each window gets a 64-bit SimHash of its shingles, numbered where they are repeated; so no shingle outweighs another,
   and the weighted similarity is that of sets. Windows meet items in a multi-index: 24 blocks of bits, of which two fingerprints
   within radius 23 must share one. A pair at similarity 0.75 differs in 11 bits on average (deviation 3).
4. Pairs within the radius are verified by the exact weighted similarity.

A null or empty text has no shingle, and is clean; so is every document beside empty items. Rows with one id and
different texts are judged apart; null ids are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .native import let, row_key, shingles, small, words

SHINGLE_WORDS = 5
SIMILARITY = 0.75
RADIUS = 23
#: Shingles of all items up to which they are broadcast, 8 bytes each.
BROADCAST_SHINGLES = 2_000_000
#: Bits of the radius + 1 blocks; they add up to 64.
BLOCK_BITS = [3] * 16 + [2] * 8


def numbered(hashes: Column) -> Column:
    """The hashes in any order, each with its occurrence number hashed in (but the first of each as it is), so that the
    weighted similarity of two arrays is that of their numbered ones as sets."""
    def of(s: Column) -> Column:
        steps = F.filter(F.array(*[F.lit(1 << b) for b in range(30, -1, -1)]), lambda b: b < F.size(s))

        def one(x: Column, i: Column) -> Column:
            # Equal hashes stand together: the occurrence number is the longest step back to an equal one.
            n = F.aggregate(steps, F.lit(0), lambda n, b: F.when(F.get(s, i - n - b) == x, n + b).otherwise(n))
            return F.when(F.coalesce(F.get(s, i - 1) == x, F.lit(False)), F.xxhash64(x, n)).otherwise(x)

        return F.transform(s, one)

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), h).otherwise(let(F.array_sort(h), of)))


def simhash(hashes: Column) -> Column:
    """64-bit SimHash of an array of 64-bit hashes; of equal ones each counts as an element of its own."""
    def of(h: Column) -> Column:
        bit = lambda x, b: F.call_function("shiftrightunsigned", x, b).bitwiseAND(F.lit(1))
        ones = lambda b: F.aggregate(h, F.lit(0).cast("long"), lambda n, x: n + bit(x, b))
        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda fp, b: F.when(2 * ones(b) > F.size(h), fp.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))).otherwise(fp))

    return let(numbered(hashes), of)


def _blocks(fp: str) -> Column:
    out, at = [], 0
    for j, bits in enumerate(BLOCK_BITS):
        out.append(F.struct(F.lit(j).alias("block"), F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << bits) - 1)).alias("value")))
        at += bits
    return F.array(*out)


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two arrays of hashes, each hash weighing as often as it occurs."""
    def of(x: Column, y: Column) -> Column:
        plain = (F.size(F.array_distinct(x)) == F.size(x)) | (F.size(F.array_distinct(y)) == F.size(y))
        count = lambda z, v: F.size(F.filter(z, lambda w: w == v))
        common = F.array_intersect(x, y)
        both = F.when(plain, F.size(common)).otherwise(F.aggregate(common, F.lit(0), lambda n, v: n + F.least(count(x, v), count(y, v))))
        return let(both, lambda n: n / (F.size(x) + F.size(y) - n))

    return let(F.struct(a.alias("x"), b.alias("y")), lambda s: of(s["x"], s["y"]))


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("x")).distinct()
    items = items.withColumn("k", F.least(F.size(words(F.col("x"))), F.lit(SHINGLE_WORDS)))
    sh = F.coalesce(*[F.when(F.col("k") == k, shingles(F.col("x"), k)) for k in range(1, SHINGLE_WORDS + 1)])
    return items.filter("k > 0").select("item", "k", sh.alias("item_sh")).withColumn("m", F.size("item_sh"))


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """d, t (id and row_key of a document), item: every pair at or over the threshold, once."""
    items = _items(benchmark, item_col, item_text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("d"), row_key(text_col).alias("t"), F.col(text_col).alias("x"))
    found = [_of_length(rows, items.filter(F.col("k") == r.k), r.k, threshold) for r in items.select("k").distinct().collect()]
    if not found:
        return rows.select("d", "t", F.lit(0).cast("long").alias("item")).limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _of_length(rows: DataFrame, items: DataFrame, k: int, threshold: float) -> DataFrame:
    index = small(items.select("item", "m", F.explode(F.array_distinct("item_sh")).alias("s")))
    placed = rows.select("d", "t", F.posexplode(shingles(F.col("x"), k)).alias("pos", "s"))
    hits = placed.join(index, "s").groupBy("d", "t", "item", "m").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    least = F.ceil(F.col("m") * F.lit(threshold) - 1e-9).cast("int")
    # A window from a hit on holds enough if the last hit that it needs lies within it.
    held = lambda p, i: F.coalesce(F.get("at", i + least - 1) < p + F.col("m"), F.lit(False))
    full = hits.filter(F.size("at") >= least).select("d", "t", "m", F.filter("at", held).alias("at"))
    starts = full.filter(F.size("at") > 0).groupBy("d", "t").agg(F.collect_list(F.struct("m", "at")).alias("wanted"))

    named = starts.withColumnsRenamed({"d": "sd", "t": "st"})
    there = rows.join(named, rows.d.eqNullSafe(named.sd) & (rows.t == named.st)).select("d", "t", shingles(F.col("x"), k).alias("sh"), "wanted").dropDuplicates(["d", "t"])

    def cut(w: Column) -> Column:
        """The windows of one item's hits, equal ones once; made before they become rows, so that none carries the text."""
        win = lambda p: F.slice("sh", F.greatest(F.lit(0), F.least(p, F.size("sh") - w["m"])) + 1, w["m"])
        first = lambda h: F.filter(w["at"], lambda p, i: F.array_position(h, F.get(h, i)) == i + 1)
        return F.transform(let(F.transform(w["at"], lambda p: F.xxhash64(win(p))), first), lambda p: F.struct(w["m"].alias("m"), win(p).alias("win")))

    windows = there.select("d", "t", F.inline(F.flatten(F.transform("wanted", cut)))).distinct().withColumn("fp", simhash(F.col("win")))
    keyed = items.select("item", "m", "item_sh", simhash(F.col("item_sh")).alias("item_fp"))
    index2 = small(keyed.select("item", "m", "item_fp", F.inline(_blocks("item_fp"))))
    met = windows.select("*", F.inline(_blocks("fp"))).join(index2, ["m", "block", "value"])
    near = met.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    # A pair may meet in several blocks: only in the first that both share is it looked at.
    both = F.transform(F.arrays_zip(_blocks("fp").alias("a"), _blocks("item_fp").alias("b")), lambda z: F.when(z["a"]["value"] == z["b"]["value"], z["a"]["block"]))
    near = near.filter(F.array_min(both) == F.col("block"))
    # The items' shingles are broadcast by their number, as a row's has no bound.
    shown = keyed.select("item", "item_fp", "item_sh")
    total = shown.agg(F.sum(F.size("item_sh"))).first()[0] or 0
    near = near.join(F.broadcast(shown) if total <= BROADCAST_SHINGLES else shown, ["item", "item_fp"])
    return near.filter(similarity(F.col("win"), F.col("item_sh")) >= threshold - 1e-12).select("d", "t", "item").distinct()


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, contaminated, n_items, items (their ids, ascending, comma-joined) of every row."""
    found = matches(docs, benchmark, id_col, text_col).groupBy("d", "t").agg(F.array_sort(F.collect_set("item")).alias("found")).withColumnsRenamed({"d": "fd", "t": "ft"})
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(text_col).alias("t"))
    joined = rows.join(found, rows.doc_id.eqNullSafe(found.fd) & (rows.t == found.ft), "left")
    return joined.select("doc_id", F.col("found").isNotNull().alias("contaminated"), F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_items"), F.coalesce(F.array_join(F.col("found").cast("array<string>"), ","), F.lit("")).alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't contaminated."""
    found = matches(docs, benchmark, id_col, text_col).select(F.col("d").alias("fd"), F.col("t").alias("ft")).distinct()
    found = small(stored(found, "contaminated"))
    return docs.join(found, F.col(id_col).cast("long").eqNullSafe(found.fd) & (row_key(text_col) == found.ft), "left_anti")


ORACLE = """
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM benchmark),
it AS (SELECT item_id, w, least(len(w), 5) AS k FROM iw WHERE len(w) > 0),
ish AS (SELECT item_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS s, len(w) - k + 1 AS m FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM it)),
ic AS (SELECT item_id, k, s, m, count(*) AS c FROM ish GROUP BY ALL),
dsh AS (SELECT doc_id, k, p, len(w) - k + 1 AS n, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM dw, (SELECT DISTINCT k FROM it))),
hit AS (SELECT doc_id, item_id, p, n, m, c, dsh.s FROM dsh JOIN ic ON dsh.s = ic.s AND dsh.k = ic.k),
win AS (SELECT DISTINCT doc_id, item_id, n, m, greatest(1, least(p, n - m + 1)) AS b FROM hit),
cnt AS (SELECT win.doc_id, win.item_id, win.n, win.m, b, hit.s, any_value(hit.c) AS c, count(*) AS q FROM win JOIN hit ON win.doc_id = hit.doc_id AND win.item_id = hit.item_id AND hit.p >= b AND hit.p < b + win.m GROUP BY ALL),
sim AS (SELECT doc_id, item_id, b, any_value(n) AS n, any_value(m) AS m, sum(least(c, q)) AS i FROM cnt GROUP BY doc_id, item_id, b),
bad AS (SELECT DISTINCT doc_id, item_id FROM sim WHERE i / (least(n, m) + m - i) >= 0.75 - 1e-12),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items FROM bad GROUP BY doc_id)
SELECT documents.doc_id, g.doc_id IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(items, '') AS items
FROM documents LEFT JOIN g ON documents.doc_id = g.doc_id
"""
