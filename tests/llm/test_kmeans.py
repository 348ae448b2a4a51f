import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import kmeans

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, distance long, v string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 1, 7, 5, "x") for i, v in rows], schema).repartition(3)


def brute(rows, dims, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min(range(len(centroids)), key=lambda j: (away(v, centroids[j]), j))
    for _ in range(rounds):
        mine = [near(v) for _, v in kept]
        groups = [[v for (_, v), m in zip(kept, mine, strict=True) if m == j] for j in range(len(centroids))]
        centroids = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, centroids, strict=True)]
    out = [(i, near(v), away(v, centroids[near(v)])) for i, v in kept]
    total = {j: sum(d for _, m, d in out if m == j) for j in range(len(centroids))}
    named = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, total[j], sum(total.values()), named[j]) for i, j, d in out), key=repr)


def got(spark, rows, dims, **more):
    out = kmeans.with_inertia(*kmeans.cluster(frame(spark, rows), dims=dims, **more))
    return sorted((tuple(r) for r in out.collect()), key=repr)


def vectors(n, dims, seed=1, grid=None):
    rng = random.Random(seed)
    draw = (lambda: rng.choice(grid)) if grid else (lambda: rng.gauss(0, 0.2))
    return [(i, [draw() for _ in range(dims)]) for i in range(n)]


def test_against_brute_force(spark):
    rows = vectors(300, 64) + [(400 + i, [0.01] * 64) for i in range(50)]
    rows += [(500, None), (501, []), (502, [0.1] * 63), (503, [0.1] * 65), (504, [float("nan")] + [0.0] * 63), (505, [float("inf")] + [0.0] * 63), (506, [None] + [0.0] * 63)]
    rows += [(None, [0.2] * 64), (None, [0.3] * 64), (7, [-0.5] * 64), (7, [-0.5] * 64)]
    assert got(spark, rows, 64) == brute(rows, 64)


def test_ties_go_to_the_smaller_number(spark):
    """Few values a component: many vectors are equally far from two centroids, and centroids are equal to one another."""
    rows = vectors(200, 3, 5, grid=[-1 / 1024, 0.0, 1 / 1024, 2 / 1024]) + [(900 + i, [0.0] * 3) for i in range(20)]
    assert got(spark, rows, 3) == brute(rows, 3)
    same = [(i, [0.5] * 3) for i in range(30)]
    assert got(spark, same, 3) == brute(same, 3) and {r[1] for r in brute(same, 3)} == {0}


def test_large_components_and_few_vectors(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([130_000.0, -130_000.0, 129_999.9, 0.001]) for _ in range(5)]) for i in range(40)]
    assert got(spark, rows, 5) == brute(rows, 5)
    assert got(spark, rows[:3], 5) == brute(rows[:3], 5)


def test_components_that_do_not_fit_are_refused(spark):
    with pytest.raises(Exception, match="would not fit 64 bits"):
        kmeans.cluster(frame(spark, [(1, [200_000.0] * 3)]), dims=3)


def test_empty_table(spark):
    assert got(spark, [], 64) == [] and got(spark, [(1, None)], 64) == []


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([1, 3, 64]), st.sampled_from([2, 2000, 1 << 20, kmeans.LARGEST - 1]), st.integers(0, 3))
def test_nearest_is_exact(seed, dims, size, spread):
    """Centroids close to one another, so that float32 cannot tell them apart."""
    rng = np.random.default_rng(seed)
    base = rng.integers(-size, size, dims)
    centroids = np.clip(base + rng.integers(-spread, spread + 1, (8, dims)), -size, size)
    x = np.clip(np.concatenate([rng.integers(-size, size, (20, dims)), base + rng.integers(-2, 3, (20, dims))]), -size, size)
    exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, c, strict=True)) for c in centroids] for r in x]
    mine, _ = kmeans.nearest(x, centroids)
    assert mine.tolist() == [d.index(min(d)) for d in exact]
    left = kmeans.shortlist(x, centroids)
    assert all(left[i, d.index(min(d))] for i, d in enumerate(exact))


def test_screening_settles_most_rows():
    rng = np.random.default_rng(3)
    x, centroids = rng.integers(-500, 500, (5000, 64)), rng.integers(-500, 500, (8, 64))
    mine, decided = kmeans.nearest(x, centroids)
    assert decided < 50
