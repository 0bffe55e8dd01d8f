"""Orchard's clusters and the whitening against plain computations in exact numbers."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from songloom.llm import orchard, whitening

SCHEMA = "vec_id long, embedding array<double>, cluster string"
NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)


def vectors(n, dims, seed=3, step=8):
    """Coarse values, so that distances tie."""
    rng = np.random.default_rng(seed)
    return [(int(i), [float(x) / step for x in rng.integers(-8, 9, dims)]) for i in range(n)]


def brute_clusters(rows, clusters, rounds, dims, scale):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    points = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in kept]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    order = sorted(range(len(kept)), key=lambda k: (name(kept[k][0]), kept[k][1]))
    centres = [points[k][1] for k in order[:clusters]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min(range(len(centres)), key=lambda c: (far(p, centres[c]), c)) for _, p in points]
    for _ in range(rounds):
        held = assign()
        for c in range(len(centres)):
            mine = [p for (_, p), h in zip(points, held) if h == c]
            if mine:
                centres[c] = [sum(x) // len(mine) for x in zip(*mine)]
    held = assign()
    distance = [far(p, centres[c]) for (_, p), c in zip(points, held)]
    inertia = [sum(d for d, h in zip(distance, held) if h == c) for c in range(len(centres))]
    fits = lambda x: x if x < 2**63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(
        ((i, c, fits(d), fits(inertia[c]), fits(sum(distance)), digest[c]) for (i, _), c, d in zip(points, held, distance)), key=str
    )


def odd(dims):
    return [
        (900, None), (901, []), (902, [1.0] * (dims + 1)), (903, [None] + [1.0] * (dims - 1)), (904, [NAN] * dims),
        (905, [INF] + [0.0] * (dims - 1)), (906, [0.0] * dims), (906, [0.5] * dims), (None, [0.25] * dims),
    ]


@pytest.mark.parametrize("extra", [[], [(950, [2.0**40] * 6), (951, [-(2.0**45)] + [0.3] * 5)]])
def test_clusters(spark, extra):
    rows = vectors(300, 6) + [(1000 + i, [0.125] * 6) for i in range(150)] + odd(6) + extra
    df = table(spark, rows).repartition(5)
    got = orchard.clustered(df, clusters=9, rounds=3, dims=6)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_clusters(rows, 9, 3, 6, 64)


def test_few_vectors(spark):
    rows = vectors(3, 6)
    assert sorted(map(tuple, orchard.clustered(table(spark, rows), dims=6).collect()), key=str) == brute_clusters(rows, 16, 3, 6, 64)
    assert orchard.clustered(table(spark, odd(6)[:6]), dims=6).count() == 0
    assert orchard.clustered(table(spark, rows[:1]), dims=6).count() == 1


def test_search_measures_less_than_all():
    rng = np.random.default_rng(0)
    centres = (rng.standard_normal((64, 2)) * 1000).astype(np.int64)
    points = centres[rng.integers(0, 64, 2000)] + rng.integers(-20, 20, (2000, 2))
    held = orchard.Centroids(centres.tolist())
    measured = []
    plain = orchard.squares
    orchard.squares = lambda d: measured.append(len(d)) or plain(d)
    try:
        cluster, distance = held.nearest(points)
    finally:
        orchard.squares = plain
    every = ((points[:, None] - centres[None]) ** 2).sum(-1)
    assert (distance == every.min(1)).all() and (cluster == every.argmin(1)).all()
    assert sum(measured) < 64 * 2000 / 2


def plain_whitening(rows, scale=1024, shift=100000):
    x = [[math.floor(Fraction(c) * scale) + shift for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    away = [[n * c - s for c, s in zip(r, sums)] for r in x]
    y = np.array([[c / n for c in r] for r in away])
    values, axes = np.linalg.eigh(y.T @ y / n)
    return n, [sum(c * c for c in r) for r in away], y, values[::-1], axes[:, ::-1]


@pytest.mark.parametrize("dims, n", [(12, 400), (5, 60), (30, 9)])
def test_whitening(spark, dims, n):
    rng = np.random.default_rng(dims)
    values = rng.standard_normal((n, dims)) * np.linspace(4, 1, dims) + 3
    rows = [(i, v) for i, v in enumerate(values.tolist())]
    left_out = [r for r in odd(dims) if r[1] is None or not r[1] or len(r[1]) != dims or any(x is None or not math.isfinite(x) for x in r[1])]
    got = whitening.whitened(table(spark, rows + left_out).repartition(3)).toPandas()
    count, deviation, y, e, axes = plain_whitening(rows)
    found = min(8, dims, n - 1)
    assert sorted(zip(got.vec_id, got.component)) == [(i, c) for i in range(n) for c in range(1, found + 1)]
    got = got.sort_values(["vec_id", "component"])
    assert (got.n == count).all() and got.deviation.tolist() == [d for d in deviation for _ in range(found)]
    mine = got.whitened.to_numpy().reshape(n, found)
    want = y @ axes[:, :found] / np.sqrt(e[:found])
    assert np.abs(np.abs(mine) - np.abs(want)).max() < 1e-8
    assert np.abs(mine.T @ mine / n - np.eye(found)).max() < 1e-9 and got.identity_error.max() < 1e-9
    assert np.abs(got.explained.to_numpy()[:found] / (e[:found] / e.sum()) - 1).max() < 1e-10


def test_whitening_without_variance(spark):
    same = [(i, [1.0, 2.0, 3.0]) for i in range(5)]
    assert whitening.whitened(table(spark, same)).count() == 0
    assert whitening.whitened(table(spark, same[:1])).count() == 0
    assert whitening.whitened(table(spark, odd(3)[:6])).count() == 0
    line = [(i % 3, [float(i), 2.0 * i, 0.0]) for i in range(6)]  # one direction, ids twice
    got = whitening.whitened(table(spark, line)).toPandas()
    assert got.component.tolist() == [1] * 6 and sorted(got.vec_id) == [0, 0, 1, 1, 2, 2]
    assert abs(got.explained[0] - 1) < 1e-9


def test_whitening_of_large_numbers(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-(2**42), 2**42, 3)]) for i in range(40)]
    got = whitening.whitened(table(spark, rows)).toPandas()
    _, deviation, *_ = plain_whitening(rows)
    wanted = {i: (d if d < 2**63 else None) for (i, _), d in zip(rows, deviation)}
    assert all(wanted[i] is None and math.isnan(d) for i, d in zip(got.vec_id, got.deviation.astype(float)))
    assert got.identity_error.max() < 1e-9
