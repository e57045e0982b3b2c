"""Nearest neighbours against a comparison of every query with every row."""

import math
import random

import numpy as np
import pytest

from segtrans.llm.neighbours import Coded, bounds, fewer_copies, nearest

SCHEMA = "vec_id long, embedding array<float>, label int"


def takes_part(v):
    return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def distance(a, b):
    total = 0.0
    for x, y in zip(a, b):  # in order; sum() would compensate
        total += (x - y) * (x - y)
    return math.sqrt(total)


def plain(rows, every, k=10, single=True):
    rows = [(i, tuple(np.array(v, np.float32 if single else np.float64).tolist())) for i, v in rows if i is not None and takes_part(v)]
    rows = sorted(set(rows))
    found = []
    for q, a in rows:
        if q % every == 0:
            near = sorted({(distance(a, b), i) for i, b in rows if i != q and len(a) == len(b)})
            found += [(q, rank, i, score) for rank, (score, i) in enumerate(near[:k], 1)]
    return sorted(found)


def found(df, **options):
    return sorted(tuple(r) for r in nearest(df, **options).collect())


def test_whole_table(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    assert found(vectors, every=20) == plain(rows, 20)
    assert found(vectors, every=7, k=3, band_bytes=40_000, group_bytes=4000) == plain(rows, 7, 3)


@pytest.mark.parametrize("kind", ["copies", "line", "far", "double"])
def test_hard_vectors(spark, kind):
    """Groups of copies, many ties, great and tiny values, doubles, more rows than a tile."""
    rng = random.Random(kind)
    make = {
        "copies": lambda i: [1.0, 2.0, 3.0] if i % 3 else [rng.gauss(0, 1) for _ in range(3)],
        "line": lambda i: [float(rng.randrange(40)), 1.0],
        "far": lambda i: [rng.gauss(0, 1) * 10 ** rng.randrange(-30, 30) for _ in range(4)],
        "double": lambda i: [rng.gauss(0, 1e-9) + 1 for _ in range(5)],
    }[kind]
    rows = [(i, make(i)) for i in range(2500)]
    kind_of = "array<double>" if kind == "double" else "array<float>"
    df = spark.createDataFrame(rows, f"vec_id long, embedding {kind_of}")
    assert found(df) == plain(rows, 100, single=kind != "double")


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 1.0], 1), (0, [1.0, 1.0], 1), (0, [5.0, 5.0], 1), (100, [1.0, 1.0], None), (None, [1.0, 1.0], 1),
        (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [None, 1.0], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1),
        (7, [1.0, 1.0], 1), (7, [1.0, 1.0], 1), (8, [1.0, 2.0], 1), (9, [1.0], 1), (200, [3.0, 3.0, 3.0], 1), (-100, [-0.0, 2.0], 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = found(df)
    assert got == plain([r[:2] for r in rows], 100)
    assert not any(r[0] == 200 for r in got) and [r[2] for r in got if r[0] == 100][:2] == [0, 7]
    clashing = ("id", "vector", "mark", "band", "size", "cell", "candidate", "score", "rank", "query_id")
    assert found(df.selectExpr("*", *(f"'x' as {c}" for c in clashing))) == got
    assert nearest(df.limit(0)).count() == 0 and nearest(df.limit(0)).schema == nearest(df).schema


def test_bounds_hold():
    rng = np.random.default_rng(3)
    for size in (1, 64, 1500):
        a, b = (rng.normal(0, 1, (50, size)) * 10.0 ** rng.integers(-6, 6, (50, 1)) for _ in range(2))
        low, high = bounds(Coded(a), Coded(b))
        exact = ((a[:, None] - b[None]) ** 2).sum(axis=2)
        assert (low <= exact).all() and (exact <= high).all()
        assert np.median((high - low) / np.add.outer((a**2).sum(1), (b**2).sum(1))) < 0.2


def test_fewer_copies():
    ids, vectors = np.array([5, 3, 9, 3, 1, 7, 2]), np.array([[1.0], [1], [1], [1], [2], [1], [1]])
    assert fewer_copies(ids, vectors, 2).tolist() in ([0, 1, 4, 6], [0, 3, 4, 6])
