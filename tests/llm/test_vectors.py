"""Centroids and near-duplicate vectors against plain Python, on nulls, ties, repeated rows, huge values and large groups."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import centroids, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, node string, n_links string"


def rows_of(found):
    return [(k, v, 0, "c", "n", "l") for k, v in found]


def plain_clusters(rows, k=8, rounds=10, scale=1024):
    kept = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]

    def nearest(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, row, strict=True)) for row in c]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        own = [nearest(v)[0] for _, v in kept]
        c = [[sum(col) // own.count(j) for col in zip(*[v for (_, v), o in zip(kept, own, strict=True) if o == j], strict=True)] if j in own else c[j] for j in range(len(c))]
    found = [(i, *nearest(v)) for i, v in kept]
    fits = lambda v: v if v < 2**63 else None
    inertia = [sum(d for _, j, d in found if j == k) for k in range(len(c))]
    names = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c]
    return sorted(((i, j, fits(d), fits(inertia[j]), fits(sum(inertia)), names[j]) for i, j, d in found), key=str)


def drawn(seed, n, width=64, size=0.3):
    draw = np.random.default_rng(seed)
    return [v.tolist() for v in (draw.standard_normal((n, width)) * size).astype("f4")]


@pytest.mark.parametrize("size", [0.3, 3e4, 3e9, 3e30])
def test_clusters_equal_plain_integers(spark, size):
    some = drawn(1, 120, size=size)
    rows = [(k, v) for k, v in enumerate(some)]
    rows += [(200, None), (201, some[0][:63]), (202, [*some[1][:63], None]), (203, [*some[1][:63], float("nan")]), (204, [*some[1][:63], float("inf")]), (5, some[7]), (5, some[7]), (None, some[9]), (None, None), (300, [])]
    table = spark.createDataFrame(rows_of(rows), SCHEMA).repartition(5)
    got = [tuple(r) for r in centroids.cluster(table)[0].collect()]
    assert sorted(got, key=str) == plain_clusters(rows)


def test_ties_and_few_vectors(spark):
    """Equally near centroids: the smaller number; fewer vectors than centroids; one vector many times; empty tables."""
    one = [0.5] * 64
    rows = [(k, one) for k in range(20)]
    got = centroids.cluster(spark.createDataFrame(rows_of(rows), SCHEMA))[0].collect()
    assert {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)} and len(got) == 20
    rows = [(k, [float(k)] * 64) for k in range(3)]
    assert sorted((tuple(r) for r in centroids.cluster(spark.createDataFrame(rows_of(rows), SCHEMA))[0].collect()), key=str) == plain_clusters(rows)
    none = spark.createDataFrame([], SCHEMA)
    assert centroids.cluster(none)[0].count() == 0 and centroids.cluster(spark.createDataFrame(rows_of([(1, None)]), SCHEMA))[0].count() == 0


def test_distances_by_every_arithmetic():
    draw = random.Random(4)
    for size in (10, 2**20, 2**27, 2**31, 2**70):
        x = [[draw.randint(-size, size) for _ in range(64)] for _ in range(7)]
        c = [[draw.randint(-size, size) for _ in range(64)] for _ in range(3)]
        kind = float if size < 2**40 else object
        want = [[sum((a - b) ** 2 for a, b in zip(r, q, strict=True)) for q in c] for r in x]
        assert centroids.distances(np.array(x, kind), c).tolist() == want
        own = np.array([0, 1, 1, 2, 2, 2, 0])
        assert centroids.sums(np.array(x, kind), own, 4) == [[sum(r[j] for r, o in zip(x, own, strict=True) if o == k) for j in range(64)] for k in range(4)]
    assert centroids.integers(np.array([[-0.0001, 1e-9, 1.0, -1.0]])).tolist() == [[-1, 0, 1024, -1024]]
    assert centroids.integers(np.array([[1e300, -1e300]]))[0].tolist() == [int(1e300) * 1024, -int(1e300) * 1024]


def plain_links(rows, threshold=0.95):
    fine = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if f else None for (_, v), f in zip(rows, fine, strict=True)]
    near = [[b for b in range(len(rows)) if a != b and fine[a] and fine[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold] for a in range(len(rows))]
    out = []
    for a in range(len(rows)):
        seen, left = {a}, [a]
        while left:
            for b in near[left.pop()]:
                if b not in seen:
                    seen.add(b)
                    left.append(b)
        ids = [rows[b][0] for b in seen if rows[b][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[a][0], len(near[a]), least, rows[a][0] is None or rows[a][0] == least))
    return sorted(out, key=str)


def spread(seed, centre, n, size):
    draw = np.random.default_rng(seed)
    return [(np.array(centre) + size * draw.standard_normal(len(centre))).astype("f4").tolist() for _ in range(n)]


@pytest.mark.parametrize("block", [4096, 16])
def test_near_vectors_equal_brute_force(spark, monkeypatch, block):
    """A tight group, whose core needs no comparison, a loose one, chains, copies, scaled copies, other widths and broken vectors."""
    monkeypatch.setattr(vectors, "BLOCK", block)
    a, b, c, d = drawn(5, 4)
    found = [*spread(1, a, 60, 0.02), *spread(2, b, 60, 0.055), *drawn(6, 60), *[c] * 25, *[[2 * x for x in c]] * 3, [-x for x in c]]
    chain = np.array(d)
    for v in drawn(7, 12):  # each within the threshold of the one before
        chain = chain + 0.28 * np.linalg.norm(chain) * np.array(v) / np.linalg.norm(v)
        found.append(chain.astype("f4").tolist())
    found += [None, [], [0.0] * 64, [*a[:63], None], [*a[:63], float("nan")], [*a[:63], float("inf")], a[:32], [2 * x for x in a[:32]], [1e-38] * 64, [1e38] * 64]
    draw = random.Random(2)
    ids = draw.sample(range(10_000), len(found))
    rows = [*zip(ids, found, strict=True), (None, c), (None, a), (None, None), (ids[0], b)]
    draw.shuffle(rows)
    got = vectors.near_vectors(spark.createDataFrame(rows_of(rows), SCHEMA).repartition(3))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    got = sorted((tuple(r) for r in got.collect()), key=str)
    want = plain_links(rows)
    twice = {ids[0]}  # the least id of a component may be one that several rows have
    assert [g for g in got if g[0] not in twice] == [w for w in want if w[0] not in twice] and got == want
    assert sum(w[1] > 20 for w in want) > 80 and len({w[2] for w in want}) > 60


def test_near_vectors_of_doubles_and_of_nothing(spark):
    assert vectors.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, [1e200, 0.0]), (2, [1e-200, 1e-202]), (3, [0.0, 1.0]), (4, None)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)]


def test_plan_keeps_its_promise():
    """Pairs at the threshold share a bucket as often as the plan says, and right angles hardly ever do."""
    step, projections, tables = vectors.plan(10_000, miss=0.05)
    hasher = vectors.Hasher(step, projections, tables)
    draw = np.random.default_rng(8)
    x = draw.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = draw.standard_normal((1500, 64))
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = 0.95 * x + math.sqrt(1 - 0.95**2) * y
    a, b, c = (hasher.buckets(v) for v in (x, near, y))
    assert 0.92 < (a == b).any(1).mean() < 0.98 and (a == c).mean() < 5e-5
