import random
from types import SimpleNamespace

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assayer.operators import evidence

WORDS = ["a", "b", "ab", "ba", "aab", "é", "字字", "Ab"]


def plain(items, texts):
    flat = lambda s: " ".join(s.lower().split())
    return sorted({(i, t) for i, x in items if x and flat(x) for t, y in texts if y and flat(x) in flat(y)})


def found(spark, items, texts):
    a = spark.createDataFrame(items, "item long, x string")
    b = spark.createDataFrame(texts, "doc string, y string")
    return sorted(tuple(r) for r in evidence.holders(a, b, "item", "x", "doc", "y").collect())


def test_holders_equal_plain_search(spark):
    rnd = random.Random(5)
    text = lambda n: rnd.choice(["", " ", "\n"]).join(["", " ".join(rnd.choice(WORDS) for _ in range(n))])
    texts = [(f"d{i}", text(rnd.randrange(60))) for i in range(80)] + [("null", None), ("empty", ""), ("blank", " \t "), ("d1", text(30))]
    items = [(i, text(rnd.randrange(9))) for i in range(120)]
    # Parts cut out of texts begin and end within words.
    for i in range(120, 200):
        t = rnd.choice([y for _, y in texts if y])
        a = rnd.randrange(len(t))
        items.append((i, t[a : a + rnd.randrange(1, 40)].upper()))
    items += [(300, None), (301, ""), (302, "  "), (303, "not there at all"), (0, items[130][1])]
    want = plain(items, texts)
    assert len(want) > 500 and found(spark, items, texts) == want


def test_holders_of_nothing(spark):
    assert found(spark, [(1, None), (2, " ")], [("d", "a b c")]) == []
    assert found(spark, [(1, "a b c")], [("d", None), ("e", "")]) == []


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("ab 😀", max_size=12), min_size=1, max_size=6), st.lists(st.text("ab 😀", max_size=30), min_size=1, max_size=6))
def test_holders_of_any_texts(spark, items, texts):
    items, texts = list(enumerate(items)), [(str(i), t) for i, t in enumerate(texts)]
    assert found(spark, items, texts) == plain(items, texts)


def test_an_item_in_most_texts_and_a_long_text(spark):
    item = "one phrase that stands in most of all texts"
    texts = [(f"d{i}", f"{i} {item} {i}" if i % 4 else f"{i} one phrase that stands elsewhere") for i in range(2000)]
    texts.append(("long", " ".join(str(i) for i in range(60_000)) + f" {item}"))
    got = found(spark, [(1, item.upper()), (2, "59998 59999 one")], texts)
    assert got == sorted([(1, f"d{i}") for i in range(2000) if i % 4] + [(1, "long"), (2, "long")])


def test_no_nested_loop(spark, tmp_path):
    """No text is compared with an item unless an anchor joins them."""
    seen = []
    keep, evidence.stored = evidence.stored, lambda df, what, **kw: (seen.append(df._jdf.queryExecution().executedPlan().toString()), keep(df, what, **kw))[1]
    try:
        found(spark, [(1, "a b c d e f"), (2, "x")], [("d", "z a b c d e f")])
    finally:
        evidence.stored = keep
    assert seen and not any("NestedLoop" in p or "Cartesian" in p for p in seen)


def test_runs_are_found_by_their_words():
    runs = [SimpleNamespace(kind=k, run=r, a=i) for i, (k, r) in enumerate([(2, "a b"), (1, "é"), (2, "b a"), (3, "a b a")])]
    at, a = evidence._Runs(runs).found([t.encode().split(b" ") for t in ["a b a", "x a", "b é\xa0 é", "é", "aa b a b"]])
    assert sorted(zip(at.tolist(), a.tolist(), strict=True)) == [(0, 0), (0, 2), (0, 3), (2, 1), (3, 1), (4, 0), (4, 2)]


def test_no_hash_is_made_for_each_run_of_a_text(spark, monkeypatch):
    seen = []
    keep = evidence.stored
    monkeypatch.setattr(evidence, "stored", lambda df, what, **kw: (seen.append((what, df._jdf.queryExecution().executedPlan().toString())), keep(df, what, **kw))[1])
    assert found(spark, [(1, "a b c d e f")], [("d", "z a b c d e f"), ("e", "a b c d e")]) == [(1, "d")]
    met = dict(seen)["met"]
    assert "MapInArrow" in met and "xxhash64" not in met
    # Beyond what is broadcast texts' runs are hashed and shuffled; pairs are the same.
    monkeypatch.setattr(evidence, "BROADCAST_ROWS", 0)
    assert found(spark, [(1, "a b c d e f")], [("d", "z a b c d e f"), ("e", "a b c d e")]) == [(1, "d")]
    assert "xxhash64" in dict(seen)["met"]


def test_lower_case_and_blanks_are_those_of_flat(spark):
    """Every character that is not left to flat() itself, alone and among others; and some that are."""
    every = [chr(c) for c in range(1, 0x180) if c != 0x130]
    texts = [f"a{c}B{c} C" for c in every] + [f"{c} x{c}\t{c}Y" for c in every] + ["A\u2003b Σας ΣΑΣ K", "İ x y z", "\x1c A \x85 B\xa0C ", " "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    done = F.col("t").rlike(evidence._OTHER)
    for r in rows.select("t", evidence.flat(F.col("t")).alias("f"), done.alias("done")).collect():
        got = evidence._flat_words((r.f if r.done else r.t).encode(), r.done)
        assert b" ".join(got) == r.f.encode() and r.done == any(c > "\u017f" or c == "İ" for c in r.t)
