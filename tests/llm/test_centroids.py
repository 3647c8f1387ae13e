from __future__ import annotations

import hashlib
from fractions import Fraction
from math import floor

import duckdb
import numpy as np
import pytest

from driftwell.llm import centroids

ROWS = "vec_id long, embedding array<double>, cluster int, distance string"


def expected(rows, k, rounds, dims):
    """One by one, in Python integers."""
    kept = [(i, [floor(256 * Fraction(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    middles = [v for _, v in sorted((r for r in kept if r[0] is not None), key=key)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), c) for c, m in enumerate(middles))

    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for c in range(len(middles)):
            own = [v for (_, v), x in zip(kept, of, strict=True) if x == c]
            if own:
                middles[c] = [sum(xs) // len(own) for xs in zip(*own, strict=True)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    most = (1 << 63) - 1
    by = {c: sum(min(most, d) for _, x, d in found if x == c) for c in range(len(middles))}
    return sorted(((i, c, min(most, d), min(most, by[c]), min(most, sum(by.values())), hashlib.sha256(",".join(map(str, middles[c])).encode()).hexdigest()) for i, c, d in found), key=str)


def run(spark, rows, k=5, rounds=3, dims=6, **more):
    df = spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], ROWS)
    return sorted((tuple(r) for r in centroids.cluster(df.repartition(3), k, rounds, dims, **more).collect()), key=str)


@pytest.mark.parametrize("block", [1, 2, 4, 5])
def test_blocks_of_any_width_equal_one_by_one(spark, block):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(0, 0.1, 6).round(2).tolist()) for k in range(120)]
    assert run(spark, rows, block=block) == expected(rows, 5, 3, 6)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, []), (3, [1.0] * 5), (4, [1.0] * 7), (5, [None] + [0.0] * 5), (6, [nan] + [0.0] * 5), (7, [-inf] + [0.0] * 5), (None, [0.5] * 6)]
    rows = [*odd, *[(8, [0.25] * 6)] * 40, (8, [0.125] * 6), (9, [0.0] * 6), (10, [-1 / 256] * 6), (11, [-1 / 300] * 6)]
    assert run(spark, rows) == expected(rows, 5, 3, 6)
    # Fewer vectors than centroids, none at all, and none with an id.
    assert run(spark, rows[-2:]) == expected(rows[-2:], 5, 3, 6)
    assert run(spark, odd[:-1]) == run(spark, odd) == run(spark, []) == []


def test_huge_components_are_exact(spark):
    rows = [(k, [float(k), -1e9 * k, 3e38 * (k % 3), 1e305 * (k % 2), 1.7e308 if k == 5 else 0.1, 0.0]) for k in range(12)] + [(k, [0.01 * k] * 6) for k in range(12, 30)]
    assert run(spark, rows) == expected(rows, 5, 3, 6)


def test_dictionaries_lose_nothing():
    rng = np.random.default_rng(1)
    values = rng.integers(-40, 40, (3000, 64)).astype(np.int32)
    tile = centroids.Tile.encode(values, centroids.BLOCK)
    assert (tile.values() == values).all() and max(map(len, tile.words)) < 3000
    near, far = tile.nearest(values[:7].tolist())
    all_far = ((values[:, None].astype(np.int64) - values[None, :7]) ** 2).sum(2)
    assert (near == all_far.argmin(1)).all() and (far == all_far.min(1)).all()
    assert (tile.sums(near, 7) == [values[near == c].sum(0, dtype=np.int64) for c in range(7)]).all()


@pytest.mark.parametrize("x", [0, -5, (1 << 62) - 1, 1 << 62, -(1 << 200) - 12345])
def test_parts_add_up(x):
    assert sum(v << centroids.PART * k for k, v in enumerate(centroids.parts_of(x))) == x


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = [tuple(r) for r in centroids.op13_centroids(spark, sf).collect()]
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert sorted(got) == sorted(con.execute(centroids.oracle()).fetchall())
