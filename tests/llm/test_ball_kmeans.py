import hashlib
import math
import random

import numpy as np
import pytest

from loomframe.llm import ball_kmeans
from loomframe.llm.queries import QUERIES, SQL
from tests.compare import assert_same, connect


def plain(rows, k, rounds, dims, scale=256, seed=2):
    """Every distance of every round, in Python's whole numbers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(scale * x) < 2**27 for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)
    centroids = [q for _, q in first[:k]]
    if not centroids:
        return [], centroids

    def nearest(q):
        d = [sum((a - b) ** 2 for a, b in zip(q, c)) for c in centroids]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        found = [nearest(q)[0] for _, q in kept]
        for j in range(len(centroids)):
            own = [q for (_, q), c in zip(kept, found) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    return [(i, *nearest(q)) for i, q in kept], centroids


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<float>, cluster string, q int")


def random_rows(n, dims, seed, step=0.25):
    """Few values a component, so that distances tie."""
    rng = random.Random(seed)
    return [(k, [rng.randrange(-4, 5) * step for _ in range(dims)]) for k in range(n)]


@pytest.mark.parametrize("dims, k, rounds", [(2, 5, 5), (3, 40, 3), (4, 7, 1), (2, 1, 2)])
def test_equals_plain_k_means(spark, dims, k, rounds):
    rows = random_rows(400, dims, dims)
    rows += rows[:50] + [(7, rows[3][1]), (None, rows[5][1]), (900, None), (901, [None] * dims), (902, [0.5] * (dims + 1)), (903, [float("nan")] * dims), (904, [float("inf")] * dims), (905, []), (906, [1e30] * dims), (907, [-0.0] * dims)]
    found, centroids = ball_kmeans.ball_kmeans(frame(spark, rows), k=k, rounds=rounds, dims=dims)
    expected, at = plain(rows, k, rounds, dims)
    assert centroids == at
    key = lambda r: (r[0] is None, r)
    assert sorted([(r.id, r.cluster, r.distance) for r in found.collect()], key=key) == sorted(expected, key=key)
    out = ball_kmeans.with_inertia(found, centroids).collect()
    assert len(out) == len(expected)
    for r in out:
        assert r.inertia == sum(d for *_, d in expected) and r.cluster_inertia == sum(d for _, c, d in expected if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, at[r.cluster])).encode()).hexdigest()


def test_few_and_no_vectors(spark):
    for rows in ([], [(1, [0.5, 0.5])], [(1, [0.5, 0.5])] * 3, [(None, [0.5, 0.5])], [(3, [float("nan"), 0.0])]):
        found, centroids = ball_kmeans.ball_kmeans(frame(spark, rows), k=4, rounds=2, dims=2)
        expected, at = plain(rows, 4, 2, 2)
        assert centroids == at and sorted((r.id, r.cluster, r.distance) for r in found.collect()) == sorted(expected)
        assert ball_kmeans.with_inertia(found, centroids).count() == len(expected)


def test_balls_compare_less():
    """Well separated groups: after a round nearly all members are in the core."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-(10**6), 10**6, (20, 8))
    vectors = (centres[np.repeat(np.arange(20), 100)] + rng.integers(-50, 50, (2000, 8))).astype(np.int64)
    balls = ball_kmeans.Balls(centres.tolist())
    clusters = np.repeat(np.arange(20), 100)
    found, least = balls.assigned(vectors, clusters)
    assert (found == clusters).all() and balls.compared == 2000
    anywhere = ball_kmeans.Balls(centres.tolist())
    again, same = anywhere.assigned(vectors, np.zeros(2000, np.int64))
    assert (again == clusters).all() and (same == least).all() and anywhere.compared <= 2000 * 20


def test_query(spark, sf_dir):
    assert_same(QUERIES["op13_ball_kmeans"](spark, sf_dir), connect(sf_dir), SQL["op13_ball_kmeans"])
