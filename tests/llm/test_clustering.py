"""Centroid clustering against plain loops over whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest
from llm_fixtures import good_vector, vector_rows

from spindrift.llm import clustering


def brute(rows, clusters, rounds):
    """(vec_id, cluster, distance, ...) with Python's own integers; components beyond 2**27 are held there."""
    clip = lambda x: max(-(1 << 27), min(1 << 27, math.floor(256 * x)))
    kept = [(i, [clip(float(np.float32(x))) for x in v], [float(np.float32(x)) for x in v]) for i, v in rows if good_vector(v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[2]))
    centroids = [r[1] for r in order[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        member = [nearest(v)[1] for _, v, _ in kept]
        for k in range(len(centroids)):
            own = [v for (_, v, _), m in zip(kept, member) if m == k]
            if own:
                centroids[k] = [sum(x) // len(own) for x in zip(*own)]
    out = [(i, *reversed(nearest(v))) for i, v, _ in kept]
    sums = {k: sum(d for _, c, d in out if c == k) for k in range(len(centroids))}
    fits = lambda n: n if n < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, d, fits(sums[c]), fits(sum(sums.values())), digest[c]) for i, c, d in out]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, cluster string").repartition(3)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("clusters, rounds", [(40, 5), (3, 2), (1000, 1), (1, 0)])
def test_clusters_equal_plain_loops(spark, monkeypatch, clusters, rounds):
    monkeypatch.setattr(clustering, "LEAF", 4)
    rows = vector_rows()
    assert ordered(map(tuple, clustering.cluster(frame(spark, rows), clusters, rounds).collect())) == ordered(brute(rows, clusters, rounds))


def test_no_vector_and_one_vector(spark):
    assert clustering.cluster(frame(spark, [(1, None), (2, [0.1] * 63)])).collect() == []
    assert clustering.cluster(frame(spark, vector_rows()).limit(0)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    (row,) = clustering.cluster(frame(spark, [(4, [0.25] * 64)])).collect()
    assert tuple(row)[:5] == (4, 0, 0, 0, 0) and row.centroid_sha256 == hashlib.sha256(",".join(["64"] * 64).encode()).hexdigest()


def test_balls_are_given_away_whole_only_where_they_belong():
    rng = np.random.default_rng(4)
    for spread in (0.5, 20, 400):
        x = rng.integers(-300, 300, (12, 64))[rng.integers(0, 12, 900)] + rng.normal(0, spread, (900, 64)).astype(np.int64)
        centroids = np.concatenate((x[:9], x[:1], rng.integers(-300, 300, (3, 64))))
        balls = clustering.Balls(x, leaf=8)
        assert sorted(balls.order.tolist()) == list(range(900)) and (balls.x == x[balls.order]).all()
        for a, b, child, r, total in zip(balls.start, balls.end, balls.child, balls.radius, balls.sums):
            own = balls.x[a:b]
            assert (own.sum(axis=0) == total).all() and np.sqrt(((own - total / (b - a)) ** 2).sum(axis=1)).max() <= r + 1e-9
            if child >= 0:
                assert (balls.start[child], balls.end[child], balls.start[child + 1], balls.end[child + 1]) == (a, balls.end[child], balls.end[child], b)
        exact = ((balls.x[:, None] - centroids) ** 2).sum(axis=2)
        labels, d = clustering.Balls.unpacked(balls.packed()).labels(centroids)
        assert (labels == exact.argmin(axis=1)).all() and (d == exact.min(axis=1)).all()
        n, sums = balls.totals(centroids)
        assert all(n[k] == (labels == k).sum() and (sums[k] == balls.x[labels == k].sum(axis=0)).all() for k in range(13))
        given, _, leaves = balls.sorted_out(centroids)
        if spread < 1:
            assert sum(balls.end[given] - balls.start[given]) > 500  # tight balls are given away, but for those near centroids that coincide
        assert sorted(np.concatenate((balls.rows_of(given), balls.rows_of(leaves))).tolist()) == list(range(900))


def test_large_components_stay_exact():
    rng = random.Random(6)
    x = np.array([[rng.randrange(-(1 << 27), 1 << 27) for _ in range(64)] for _ in range(300)])
    c = x[:5] + 1
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, k)), i) for i, k in enumerate(c))[1] for v in x]
    assert clustering.nearest_rows(x, c).tolist() == want
