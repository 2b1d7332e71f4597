"""Pivot search against brute force, and that it rules rows out."""

import numpy as np
import pytest

from pulsegrid.plans import neighbours


def brute(test, train, k):
    out = {}
    for i, x in test:
        near = sorted((sum((a - b) ** 2 for a, b in zip(x, q, strict=True)), j, y) for j, q, y in train)[:k]
        w = [1 / max(d ** 0.5, 1e-12) for d, _, _ in near]
        out[i] = (sum(y for _, _, y in near) / len(near), sum(a * y for a, (_, _, y) in zip(w, near, strict=True)) / sum(w))
    return out


def rows(n, seed, clusters):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(clusters, 5)) * 20
    return [(i, [float(v) for v in np.round(middle[i % clusters] + r.normal(size=5), 1)], int(r.random() < 0.4)) for i in range(n)]


@pytest.mark.parametrize(("pivots", "rings", "group", "k"), [(12, 4, 2048, 5), (3, 1, 20, 3), (400, 8, 2048, 7)])
def test_votes_equal_brute_force(spark, pivots, rings, group, k):
    every = rows(260, 1, 9)
    train, test = [r for r in every if r[0] % 4], [r for r in every if not r[0] % 4]
    train += [(1000, train[0][1], 1), (1001, train[0][1], 0)]
    schema = "pid long, x array<double>, label int"
    got = {r.id: r for r in neighbours.neighbour_votes(spark.createDataFrame(test, schema), spark.createDataFrame(train, schema), "pid", "x", "label", k, pivots, rings, group).collect()}
    want = brute([r[:2] for r in test], train, k)
    assert set(got) == set(want)
    for i, (a, b) in want.items():
        assert (got[i].uniform, got[i].by_distance) == (pytest.approx(a), pytest.approx(b))
    if pivots == 12:
        assert sum(r.pairs for r in got.values()) < len(test) * len(train) / 2


def test_fewer_rows_than_neighbours_and_none(spark):
    schema = "pid long, x array<double>, label int"
    one = spark.createDataFrame([(1, [0.0, 0.0], 1)], schema)
    assert [tuple(r) for r in neighbours.neighbour_votes(one, one, "pid", "x", "label", 5).collect()] == [(1, 1.0, 1.0, 1)]
    assert [tuple(r) for r in neighbours.neighbour_votes(one, one.where("false"), "pid", "x", "label", 5).collect()] == [(1, None, None, 0)]
    assert neighbours.neighbour_votes(one.where("false"), one, "pid", "x", "label", 5).count() == 0
