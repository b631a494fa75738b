import random
import re

from tokenizers import Tokenizer

import pytest

import corpus_pipeline
from assayer.llm import bpe

from .test_decontaminate import brute as leaks
from .test_jaccard import brute as groups
from .test_line_dedup import brute as cut


def test_as_brute_force(spark, tmp_path):
    rnd = random.Random(13)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(25))) for i in range(3)]
    rows = []
    for i in range(120):
        w = [word() for _ in range(rnd.randrange(10, 60))]
        if i % 10 == 0:
            w[5:5] = items[i % 3][1].split()
        for at in range(7, len(w), 8):
            w[at] += "\n"
        rows.append((i, " ".join(w)))
        if i % 7 == 0:
            w[3] = word()
            rows.append((200 + i, " ".join(w)))
    rows += [(500, "12 34 ."), (501, ""), (502, None), (503, rows[0][1])]
    docs = spark.createDataFrame([(d, t, "xx" if d % 2 else "yy", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = [(d, t) for d, t in rows if t and re.search(r"[^\W\d_]", t)]
    left = [(d, x[3]) for d, x in cut(left).items() if x[3]]
    of = groups(left)
    left = [(d, t) for d, t in left if of[d][1] == d]
    bad = {d for d, _ in leaks(left, items)}
    left = [(d, t) for d, t in left if d not in bad]
    t = Tokenizer.from_file(bpe.default_vocabulary())
    want = {d: t.encode(x, add_special_tokens=False).ids for d, x in left}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.ids for r in got} == want and all(r.n_tokens == len(r.ids) for r in got)
    assert bad and len(left) < len(rows) - 12


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["score", "lang_pred", "h", "d", "t", "x", "row", "fd", "ft", "c", "root", "component_id", "ids", "n_tokens", "pos", "item", "own"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_with_nulls_and_clashing_columns(spark, tmp_path, name):
    """Every stage stands nulls in any column and further columns by names that it uses itself; an empty table too."""
    stage, rnd = dict(corpus_pipeline.STAGES)[name], random.Random(5)
    spark.createDataFrame([(1, "one two three four five six"), (2, None), (None, "seven eight")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(12))
    rows = [(i, text(), "aa", "s", 5) for i in range(8)] + [(None, "d e", None, None, None), (20, None, None, None, None), (21, "", "aa", None, 0), (20, text(), "aa", "s", 1)]
    docs = spark.createDataFrame([(*r, *CLASHING) for r in rows], f"{DOCS}, {', '.join(f'{c} string' for c in CLASHING)}")
    got = stage(spark, docs, str(tmp_path))
    kept = got.collect()
    if name == "tokens":
        assert len(kept) == len(rows) and got.columns == ["doc_id", "n_tokens", "ids"]
    else:
        assert got.columns == docs.columns
        assert all(all(r[c] == c for c in CLASHING) for r in kept)
        gone = {"language": 2, "lines": 2}.get(name, 0)
        assert len(kept) == len(rows) - gone
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids"] and got.count() == 0


def test_language_is_told(spark):
    rnd = random.Random(2)
    text = lambda letters: " ".join("".join(rnd.choice(letters) for _ in range(5)) for _ in range(30))
    rows = [(i, text("abcde" if i % 2 else "vwxyz"), "aa" if i % 2 else "zz") for i in range(60)]
    rows += [(100, text("abcde"), None), (101, text("vwxyz"), None), (102, "1 2", "aa"), (103, None, "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = corpus_pipeline.language(spark, docs, "")
    assert got.columns == docs.columns
    assert {r.doc_id: r.lang for r in got.collect()} == {i: "aa" if "a" in x or "b" in x else "zz" for i, x, _ in rows[:62]}


def test_language_without_a_model(spark):
    """No label at all, or only texts too long for the sample: nothing is dropped that has a letter."""
    long = "word " * 5000
    for rows in ([(1, "a b", None), (2, "12", None), (3, None, None)], [(1, long, "aa"), (2, "1", None), (3, None, "aa")]):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        assert [tuple(r) for r in corpus_pipeline.language(spark, docs, "").collect()] == rows[:1]
