import random
from collections import Counter

from pyspark.sql import functions as F

from assayer.llm.decontaminate import RADIUS, _blocks, clean, matches, numbered, report, simhash


def brute(docs, items):
    out = set()
    for item, text in items:
        w = text.lower().split()
        k = min(5, len(w))
        if not k:
            continue
        want = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        m = sum(want.values())
        for d, t in docs:
            v = (t or "").lower().split()
            sh = [tuple(v[i : i + k]) for i in range(len(v) - k + 1)]
            for b in range(max(1, len(sh) - m + 1)):
                win = Counter(sh[b : b + m])
                both = sum((win & want).values())
                if win and both / (sum(win.values()) + m - both) >= 0.75:
                    out.add((d, item))
    return out


def test_as_brute_force(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(rnd.randrange(20, 45)))) for i in range(12)] + [(50, "a b c"), (51, ""), (52, None), (53, "x x x x x x x x x x y")]
    docs = []
    for i in range(150):
        base = [word() for _ in range(rnd.randrange(0, 80))]
        for _ in range(rnd.randrange(3)):
            p = items[rnd.randrange(12)][1].split()
            for _ in range(rnd.randrange(4)):
                at, what = rnd.randrange(len(p)), rnd.randrange(3)
                p[at : at + 1] = [] if what == 0 else [word()] if what == 1 else [p[at], word()]
            cut = rnd.randrange(len(base) + 1)
            base[cut:cut] = p
        docs.append((i, " ".join(base)))
    docs += [(900, "z a b c z"), (901, "A\tB\nC"), (902, ""), (903, None), (904, "x x x x x x x x x y"), (905, "x x x x x x x x x x x")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, [(i, t or "") for i, t in items])
    assert {(r.d, r.item) for r in matches(df, bench).collect()} == want and len(want) > 40
    bad = {d for d, _ in want}
    assert {r.doc_id for r in report(df, bench).collect() if r.contaminated} == bad
    assert {r.doc_id for r in clean(df, bench).collect()} == {d for d, _ in docs} - bad


def test_odd_rows(spark):
    p = "one two three four five six seven"
    df = spark.createDataFrame([(1, p, 1), (1, "other text", 2), (1, p, 3), (None, p, 4), (2, None, 5)], "doc_id long, text string, item long")
    bench = spark.createDataFrame([(7, p), (7, p)], "item_id long, text string")
    assert sorted(r.item for r in clean(df, bench).collect()) == [2, 5]
    assert sorted((str(r.doc_id), r.items) for r in report(df, bench).collect()) == [("1", ""), ("1", "7"), ("1", "7"), ("2", ""), ("None", "7")]
    assert clean(df.limit(0), bench).count() == 0 and clean(df, bench.limit(0)).count() == 5


def test_repeated_shingles(spark):
    """Items with a long run of one word, in documents with other words for the run: similarity 0.769."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    items, docs = [], []
    for i in range(12):
        plain = [word() for _ in range(144)]
        items.append((i, " ".join(plain + ["_"] * 21)))
        docs += [(3 * i, " ".join(plain + [word() for _ in range(21)])), (3 * i + 1, " ".join(["_"] * 300)), (3 * i + 2, " ".join(plain + ["_"] * 60))]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert len(want) == 24
    assert {(r.d, r.item) for r in matches(df, bench).collect()} == want


def test_numbered(spark):
    rows = [([5, 7, 5, 5, 9, 7] + [3] * 70,), ([4, 2, 8],), ([],)]
    got = [r.n for r in spark.createDataFrame(rows, "h array<bigint>").select(numbered("h").alias("n")).collect()]
    assert len(set(got[0])) == len(rows[0][0]) and {3, 5, 7, 9} <= set(got[0]) and got[1:] == [[4, 2, 8], []]
    more = [([5] * 4 + [3] * 100,)]
    other = spark.createDataFrame(more, "h array<bigint>").select(numbered("h").alias("n")).first().n
    assert len(set(got[0]) & set(other)) == 3 + 70


def test_item_everywhere_in_a_long_text(spark):
    """An item's shingle at each place of a long text: windows are found in one pass over the hits."""
    items = [(1, "x " * 30), (2, "a b c d e f g h i j")]
    docs = [(1, "x " * 40_000), (2, "x y " * 30_000), (3, "a b c d e f g h i j " * 3000), (4, "w " * 50_000)]
    got = {r.doc_id: r.items for r in report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {1: "1", 2: "", 3: "2", 4: ""}


def test_radius_at_the_threshold(spark):
    """Pairs of sets at a similarity of exactly 0.75: nearly all fingerprints are within the radius, and all of these share a
    block. The binomial tail gives 0.00009 beyond it at most, so that 6000 pairs have four with a probability under 0.01."""
    # x and y share 6/7 of m elements each
    part = lambda name, n: F.transform(F.sequence(F.lit(1), (F.col("m") * n / 7).cast("int")), lambda i: F.xxhash64("id", F.lit(name), i))
    pairs = spark.range(6000).withColumn("m", F.element_at(F.array(*map(F.lit, (7, 28, 56))), (F.col("id") % 3 + 1).cast("int")))
    pairs = pairs.withColumn("m", F.col("m").cast("int")).select(*[F.array_union(part("c", 6), part(s, 1)).alias(s) for s in "xy"])
    told = pairs.select(simhash(F.col("x")).alias("x"), simhash(F.col("y")).alias("y"))
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= RADIUS
    got = told.select(near.alias("near"), F.arrays_overlap(_blocks("x"), _blocks("y")).alias("meet")).groupBy("near", "meet").count().collect()
    got = {(r.near, r.meet): r["count"] for r in got}
    assert (True, False) not in got and got[True, True] >= 5997
