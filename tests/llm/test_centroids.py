import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from assayer.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, k=16, rounds=3):
    """The contract in plain Python: rows of (vec_id, vector)."""
    rows = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    rows.sort(key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in rows[:k]]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    told = lambda: [min((distance(v, m), j) for j, m in enumerate(c)) for _, v in rows]
    for _ in range(rounds):
        members = defaultdict(list)
        for (_, v), (_, j) in zip(rows, told(), strict=True):
            members[j].append(v)
        for j, m in members.items():
            c[j] = [sum(x) // len(m) for x in zip(*m, strict=True)]
    at, sums = told(), defaultdict(int)
    for d, j in at:
        sums[j] += d
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i, j, d, sums[j], sum(sums.values()), sha[j]) for (i, _), (d, j) in zip(rows, at, strict=True)), key=repr)


def found(df):
    return sorted((tuple(r)[:6] for r in df.collect()), key=repr)


def made(n, seed=0, spread=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread) for _ in range(64)]) for i in range(n)]


@pytest.mark.parametrize("rows", [made(300), made(5), made(1), [(i, [0.5] * 64) for i in range(40)], [(i, [float(i % 3)] * 64) for i in range(90)], made(60, 1, 5000.0)])
def test_as_in_plain_python(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(3)
    assert found(centroids.cluster(df)) == plain(rows)


def test_rows_that_do_not_count_and_clashing_columns(spark):
    bad = [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [None, *[1.0] * 63]), (905, [math.nan, *[1.0] * 63]), (906, [math.inf, *[1.0] * 63]), (907, [-math.inf, *[1.0] * 63])]
    rows = [*made(50), (None, [0.1] * 64), (None, [0.2] * 64), (3, [0.3] * 64), (3, [0.3] * 64), (3, [-0.001] * 64)]
    df = spark.createDataFrame([(*r, 1, [2], [3.0], "x") for r in rows + bad], f"{SCHEMA}, q array<int>, norms array<double>, v string").repartition(4)
    assert found(centroids.cluster(df)) == plain(rows)
    assert found(centroids.cluster(df.filter("vec_id >= 900"))) == []


def test_too_large_components_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e300] * 64, 1)], SCHEMA)
    with pytest.raises(Exception, match="a component is beyond"):
        centroids.cluster(df).collect()


def test_bounds_exclude_and_lose_nothing():
    rng = np.random.default_rng(0)
    # Groups of different block norms.
    x = np.concatenate([rng.integers(-50, 50, (200, 64)) * (rng.random(64) < 0.3) * 2**s for s in range(0, 20, 3)])
    c = x[::90]
    norms = np.sqrt((x.astype(float) ** 2).reshape(len(x), centroids.SEGMENTS, -1).sum(2))
    at, d, asked = centroids.nearest(x, norms, c)
    full = ((x[:, None] - c[None]) ** 2).sum(2)
    assert (at == full.argmin(1)).all() and (d == full.min(1)).all()
    assert asked < 0.5 * full.size
    limit = np.full((2, 64), centroids.LIMIT)
    limit[1] *= -1
    norms = np.sqrt((limit.astype(float) ** 2).reshape(2, centroids.SEGMENTS, -1).sum(2))
    at, d, _ = centroids.nearest(limit, norms, limit[::-1].copy())
    assert at.tolist() == [1, 0] and d.tolist() == [0, 0]
    assert centroids.nearest(limit[:1], norms[:1], limit[1:])[1][0] == 64 * (2 * centroids.LIMIT) ** 2
