import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import unicodedata
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assayer.llm import packing
from assayer.llm.bpe import default_vocabulary

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_vocabulary())


def checked(rows, docs, library, size=2048):
    """Holds pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids) against the texts; gives the padded share."""
    want = Counter()
    for i, t in docs:
        want[i, np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()] += 1
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length > 0 and len(r.ids) == 4 * r.length
        sequences[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id, r.doc_tokens].append((r.start, bytes(r.ids)))
    tokens = padded = 0
    for s in sequences.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False))
        full = s[-1][0] + s[-1][1]
        assert full <= size
        tokens += full
        padded += 0 if full & (full - 1) == 0 else size - full
    # Pieces of rows with one id and length are told apart by their contents.
    ids = defaultdict(list)
    for (i, raw), n in want.items():
        ids[i, len(raw) // 4] += [raw] * n
    assert set(ids) == set(by_doc)
    for key, raws in ids.items():
        got = Counter(by_doc[key])
        if len(set(raws)) == 1:
            (raw,) = set(raws)
            assert all(raw[4 * a : 4 * a + len(x)] == x for a, x in got)
        ends = sorted((a, 1) for a, _ in by_doc[key]), sorted((a + len(x) // 4, -1) for a, x in by_doc[key])
        depth, marks = 0, sorted([*ends[0], *ends[1]])
        cover = Counter()
        for at, step in marks:
            cover[at] += step
        for at in sorted(cover)[:-1]:
            depth += cover[at]
            assert depth == len(raws)
    assert tokens == sum(len(raw) // 4 * n for (_, raw), n in want.items())
    return padded / max(1, tokens)


def texts(lengths, seed=0):
    rng = random.Random(seed)
    return [" ".join(rng.choices(["alpha", "beta", "x", "übung", "12", "don't", "…"], k=n)) for n in lengths]


def test_mixed_lengths_are_packed_without_padding(spark, library):
    rng = random.Random(1)
    every = texts([int(rng.lognormvariate(5, 1.2)) for _ in range(400)])
    docs = [*enumerate(every), (None, "no id"), (7, every[7]), (7, every[7]), (400, None), (401, ""), (402, " \n\t"), (403, "<|endoftext|> and <|endoftext|>"), (404, "y" * 9000), (405, " " * 9000), (406, "long " * 30000)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(4)
    assert checked(packing.pack(df).collect(), docs, library) == 0


@pytest.mark.parametrize("lengths", [[0] * 300, [700] * 50, [3] * 2000, [1] * 5, [1700] * 40])
def test_one_length_alone(spark, library, lengths):
    docs = list(enumerate(texts(lengths)))
    rows = packing.pack(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect()
    assert checked(rows, docs, library) < 0.01


def test_planned_remainders_are_whole(spark, library):
    rng = random.Random(3)
    docs = list(enumerate(texts([rng.randint(1, 1200) for _ in range(1500)], 3)))
    rows = packing.pack(spark.createDataFrame(docs, SCHEMA).repartition(4), size=1024, unit=16).collect()
    assert checked(rows, docs, library, 1024) == 0
    tails = Counter(r.doc_id for r in rows if r.start + r.length == r.doc_tokens or r.length < 1024)
    assert sum(n == 1 for n in tails.values()) > 0.8 * len(tails)


def test_value_and_clashing_columns(spark, library):
    docs = list(enumerate(texts([5, 50, 500])))
    df = spark.createDataFrame([(*d, 1, 2, 3, 4) for d in docs], f"{SCHEMA}, slice int, n int, ids int, row int")
    rows = packing.pack(df, value=F.crc32("ids").alias("c")).collect()
    whole = {i: library.encode(t).ids + [1] for i, t in docs}
    assert rows and all(r.c == zlib.crc32(np.array(whole[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) for r in rows)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).collect() == []


def test_combinations_are_all():
    assert len(packing.combinations(12, 3)) == 19 and all(sum(c) == 12 and sorted(c, reverse=True) == list(c) for c in packing.combinations(12, 3))


def test_least_squares_against_projected_gradient():
    rng = np.random.default_rng(0)
    a, b = rng.random((12, 40)), rng.random(12) * 3 - 0.5
    x = packing.nnls(a, b)
    y = np.zeros(40)
    for _ in range(200_000):
        y = np.maximum(0, y - 0.005 * a.T @ (a @ y - b))
    assert (x >= 0).all() and np.sum((a @ x - b) ** 2) <= np.sum((a @ y - b) ** 2) + 1e-6
    exact = np.array([3.0, 0, 2])
    assert np.allclose(packing.nnls(np.eye(3), exact), exact)


def test_plan_takes_no_more_than_there_is():
    rng = np.random.default_rng(1)
    for _ in range(5):
        counts = rng.integers(0, 50, 17) * (rng.random(17) < 0.7)
        found = packing.plan(counts, counts * np.arange(17) * 16 - counts * 5, 16, 3)
        used = Counter(b for c, n in found for b in c for _ in range(n))
        assert all(used[b] <= counts[b] for b in used) and all(sum(c) == 16 for c, _ in found)


def test_both_libraries_agree_on_every_character(library):
    fast = packing.Encoder(default_vocabulary()).fast
    every = [c for i in range(128, 0x110000) if unicodedata.category(c := chr(i))[0] != "C"]
    for a in range(0, len(every), 5000):
        parts = [f"x{c}x7{c}7{c} {c}!{c} " for c in every[a : a + 5000]]
        assert [fast.encode_ordinary(p) for p in parts] == [e.ids for e in library.encode_batch(parts, add_special_tokens=False)]
