import hashlib
import random
from collections import defaultdict

from assayer.llm.line_dedup import line_dedup, line_report


def brute(rows):
    seen, out = set(), {}
    for d, text in sorted(rows, key=lambda r: r[0]):
        lines = text.split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if w in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(w)
        left = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out[d] = (len(lines), len(gone), hashlib.sha256(left.encode()).hexdigest(), left)
    return out


def test_as_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, "\n".join(rnd.choice("abc") for _ in range(rnd.randrange(9)))) for i in range(60)]
    rows += [(100, "q\nq\nq\nq\nq"), (101, ""), (102, "one"), (103, "x\ny\n"), (104, "x\ny\n")]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = brute(rows)
    assert {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in line_report(df).collect()} == {k: v[:3] for k, v in want.items()}
    assert {r.doc_id: r.text for r in line_dedup(df).collect()} == {k: v[3] for k, v in want.items()}


def test_odd_rows(spark):
    t = "a\nb\nc\nd"
    df = spark.createDataFrame([(1, None, 0, 5), (2, t, 7, 5), (2, t, 7, 6), (3, t, 7, 5), (None, "k\nl\nm", 5, 5)], "doc_id long, text string, n_chars int, pos int")
    got = defaultdict(list)
    for r in line_dedup(df).collect():
        got[r.doc_id].append((r.text, r.n_chars))
    assert got == {1: [(None, None)], 2: [(t, 7), (t, 7)], 3: [("", 0)], None: [("k\nl\nm", 5)]}
    assert line_dedup(df).columns == df.columns
    assert line_dedup(df.limit(0)).count() == 0 and line_report(df.limit(0)).count() == 0


def test_long_text(spark):
    t = "\n".join(str(i % 5000) for i in range(40_000))
    df = spark.createDataFrame([(1, t)], "doc_id long, text string")
    r = line_report(df).collect()[0]
    assert (r.n_lines, r.n_removed) == (40_000, 35_000)
