"""Clustering with bounds against plain rounds over all centroids."""

import hashlib
import random

import numpy as np
import pytest
from conftest import SF, same_rows

from tidewright.llm import centroids, queries

ROWS = "vec_id long, embedding array<double>, cluster string, v int, distance int"


def plain(rows, k, rounds):
    """(vec_id, cluster, distance) and centroids, by measuring everything."""
    kept = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centers = [list(v) for _, v in order[:k]]

    def assign():
        out = []
        for i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centers]
            out.append((i, d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        own = assign()
        for c in range(len(centers)):
            mine = [v for (_, v), (_, a, _) in zip(kept, own, strict=True) if a == c]
            if mine:
                centers[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return assign(), centers


def found(spark, rows, k, rounds, groups):
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], ROWS)
    out, centers = centroids.clustered(centroids.vectors(df, dimensions=len(rows[0][1])), k, rounds, groups)
    return out.collect(), centers.tolist()


@pytest.mark.parametrize("k,groups", [(1, 1), (3, 1), (9, 3), (12, 5)])
def test_brute_force(spark, k, groups):
    rng = random.Random(k)
    rows = [(i, [rng.gauss(rng.choice((-1, 0, 1)), 0.3) for _ in range(4)]) for i in range(150)]
    rows += [(200 + i, [0.5, -0.5, 0.25, 0.0]) for i in range(60)]  # one vector very often
    rows += [(300, [1.0, None, 0.0, 0.0]), (301, [float("nan"), 0.0, 0.0, 0.0]), (302, [float("inf"), 0.0, 0.0, 0.0]), (303, None), (5, [0.0, 0.0, 0.0, 0.0]), (None, [0.1, 0.2, 0.3, 0.4])]
    got, centers = found(spark, rows, k, 4, groups)
    want, expected = plain(rows, k, 4)
    assert centers == expected
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=key) == sorted(want, key=key)


def test_ties_few_large_and_empty(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(8)]  # equal centroids: the smaller number takes all
    got, centers = found(spark, rows, 5, 3, 2)
    want, expected = plain(rows, 5, 3)
    assert centers == expected and sorted((r[0], r[1], r[2]) for r in got) == sorted(want)
    few = [(1, [0.5, 0.5]), (2, [3.0, 0.0])]
    assert len(found(spark, few, 16, 3, 4)[1]) == 2
    large = [(i, [float(x), float(-x)]) for i, x in enumerate((2**20, -(2**20), 2**20 - 1, 5, 0, 2**21 - 1))]
    got, centers = found(spark, large, 2, 3, 1)
    assert (sorted((r[0], r[1], r[2]) for r in got), centers) == (sorted(plain(large, 2, 3)[0]), plain(large, 2, 3)[1])
    assert found(spark, [(1, [2.0**22, 0.0]), (2, [1.0, 0.0])], 2, 3, 1)[1] == [[64, 0]]
    assert found(spark, [(1, [None, 1.0])], 2, 3, 1)[0] == []


def test_filters_pass_over_most_distances():
    rng = np.random.default_rng(2)
    means = rng.integers(-3000, 3000, (40, 16))
    x = (means[rng.integers(0, 40, 4000)] + rng.normal(0, 30, (4000, 16))).astype(np.int64)
    centers = means + rng.integers(-40, 40, means.shape)
    group = centroids.grouped(centers, 6)
    own, upper, lower = centroids.assigned(x, centers, group)
    for _ in range(5):
        before, centers = centers, np.array([np.floor(x[own == c].mean(0)) if (own == c).any() else centers[c] for c in range(40)]).astype(np.int64)
        own, upper, lower, measured = centroids.reassigned(x, own, upper, lower, centers, centroids.moved_by(before, centers), group)
        d = centroids.squared(x, centers)
        assert (own == d.argmin(1)).all() and measured.mean() < 4
        far = np.sqrt(d)
        assert (upper >= far[np.arange(len(x)), own] - 1e-6).all()
        far[np.arange(len(x)), own] = np.inf
        assert all((lower[:, g] <= far[:, group == g].min(1) + 1e-6).all() for g in range(group.max() + 1))


def test_query(spark, duck):
    got = queries.QUERIES["op12_centroids"](spark, SF)
    same_rows(got, duck.sql(queries.ORACLES["op12_centroids"]))
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, centers = plain([(i, v) for i, v in rows if v is not None and len(v) == 64], 16, 3)
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in got.collect()) == sorted(want)
