"""Similarity joins and point sets against plain versions, through random changes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brooklet.functions.vec import numpy_metric
from brooklet.operators import simjoin
from brooklet.operators.pointset import PointSet
from brooklet.plans.lineage import written


def frame(spark, points, key="key"):
    return spark.createDataFrame([(int(k), [float(c) for c in v]) for k, v in points], f"{key} long, vec array<double>")


@pytest.fixture(scope="module")
def sets(spark):
    rng = np.random.default_rng(0)
    return [(i, v) for i, v in enumerate(np.round(rng.random((300, 3)), 2))], [(i, v) for i, v in enumerate(np.round(rng.random((40, 3)), 2))]


@pytest.mark.parametrize("metric,params", [("euclidean", None), ("cityblock", None), ("chebyshev", None), ("minkowski", {"p": 3})])
def test_joins_against_plain(spark, sets, metric, params):
    points, queries = sets
    p, q, measure = frame(spark, points), frame(spark, queries, "query_id"), numpy_metric(metric, params)
    d = np.array([measure(np.array([v for _, v in points]), v) for _, v in queries])
    got = {(r.query_id, r.key): r.distance for r in simjoin.range_join(q, p, 0.3, metric, params).collect()}
    sure = {(int(i), int(j)) for i, j in np.argwhere(d <= 0.3 - 1e-12)}
    assert sure <= set(got) <= {(int(i), int(j)) for i, j in np.argwhere(d <= 0.3 + 1e-12)}
    assert all(abs(v - d[k]) < 1e-12 for k, v in got.items())
    for reverse in (False, True):
        near = simjoin.knn_join(q, p, 4, reverse=reverse, metric=metric, metric_params=params, block_bytes=700).collect()
        for i in range(40):
            own = sorted(r.distance for r in near if r.query_id == i)
            assert np.allclose(own, (np.sort(d[i])[-4:] if reverse else np.sort(d[i])[:4]))
    ring = simjoin.knn_join(q, p, 3, min_radius=0.2, max_radius=0.5, metric=metric, metric_params=params).collect()
    for i in range(40):
        inside = np.sort(d[i][(d[i] >= 0.2 - 1e-12) & (d[i] <= 0.5 + 1e-12)])[:3]
        assert abs(len([r for r in ring if r.query_id == i]) - len(inside)) <= 1


def test_ties(spark):
    p = frame(spark, [(i, [d]) for i, d in enumerate([5, 3, 4, 5, 2, 4])])
    q = frame(spark, [(0, [0])], "query_id")
    assert [(r.rank, r.key, r.distance) for r in simjoin.knn_join(q, p, 3).orderBy("rank").collect()] == [(1, 4, 2), (2, 1, 3), (3, 2, 4)]
    assert [r.distance for r in simjoin.knn_join(q, p, 3, extend_for_ties=True).orderBy("rank").collect()] == [2, 3, 4, 4]
    assert simjoin.knn_join(q, p, 50).count() == 6
    assert simjoin.range_join(q, p, 0).count() == 0 and simjoin.range_join(q, frame(spark, []), 1).count() == 0
    assert simjoin.knn_join(q, frame(spark, []), 1).count() == 0


def test_random_changes(spark, tmp_path):
    """The index's own test: random inserts, deletes and queries against a dictionary."""
    rng = np.random.default_rng(1)
    live, tree, counter = {}, PointSet.empty(spark), 0
    for turn in range(4):
        new = np.round(rng.random((int(rng.binomial(40, 0.7)), 4)), 3)
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(new)], "n long, vec array<double>")
        tree, keys = tree.insert(rows, "n")
        placed = {r.row: r.key for r in keys.collect()}
        assert sorted(placed.values()) == list(range(counter, counter + len(new))) and [placed[i] for i in range(len(new))] == sorted(placed.values())
        counter += len(new)
        live |= {placed[i]: v for i, v in enumerate(new)}
        gone = rng.choice(sorted(live), 9, replace=False).tolist()
        tree = tree.delete(spark.createDataFrame([(int(k),) for k in gone + gone[:2]], "key long"))
        live = {k: v for k, v in live.items() if k not in gone}
        tree.save(str(tmp_path / str(turn)))
        tree = PointSet(PointSet.load(spark, str(tmp_path / str(turn))).points, counter)
        assert tree.count() == len(live) and tree.dimension() == 4
        x, radius, k = rng.random(4), float(rng.gamma(1, 0.5)), int(rng.poisson(5)) + 1
        q = frame(spark, [(0, x)], "query_id")
        d = sorted((float(np.sqrt(((v - x) ** 2).sum())), key) for key, v in live.items())
        assert {r.key for r in tree.neighbors(q, radius).collect()} == {key for dist, key in d if dist <= radius}
        assert [r.key for r in tree.knn(q, k).orderBy("rank").collect()] == [key for _, key in d[:k]]


def test_lookups(spark):
    tree = PointSet(frame(spark, [(10, [1, 1]), (20, [2, 2]), (30, [3, 3]), (40, [4, 4]), (50, [5, 5])]), counter=20)
    keys = spark.createDataFrame([(20,), (25,)], "key long")
    assert [(r.key, r.vec, r.found) for r in tree.get_points(keys).orderBy("key").collect()] == [(20, [2, 2], True), (25, [0, 0], False)]
    with pytest.raises(Exception, match="no such key"):
        tree.get(keys).collect()
    with pytest.raises(Exception, match="no such key"):
        tree.delete(keys).points.collect()
    after, found = tree.remove(keys)
    assert after.count() == 4 and {(r.key, r.found) for r in found.collect()} == {(20, True), (25, False)}
    assert [(r.ix, r.key) for r in tree.itok().orderBy("ix").collect()] == [(0, 10), (1, 20), (2, 30), (3, 40), (4, 50)]
    assert {r.key: r.ix for r in tree.ktoi(keys).collect()} == {20: 1, 25: None}
    for s in (slice(None, None, 2), slice(-2, None), slice(None, None, -2), slice(4, 0, -3), slice(7, 9)):
        assert sorted(r.ix for r in tree.by_index(s.start, s.stop, s.step).collect()) == sorted(range(5)[s])
    # 20 is in use, so the next free keys from the counter on are 21 and 22
    new = spark.createDataFrame([(1, [6.0, 6.0]), (0, [7.0, 7.0])], "n long, vec array<double>")
    grown, placed = tree.insert(new, "n")
    assert {r.row: r.key for r in placed.collect()} == {0: 21, 1: 22} and grown.counter == 23
    moved = tree.update_by_index(spark.createDataFrame([(0, [9.0, 9.0])], "ix long, vec array<double>"))
    assert moved.get(spark.createDataFrame([(10,)], "key long")).first().vec == [9, 9]
    with pytest.raises(Exception, match="no such ordinal"):
        tree.update_by_index(spark.createDataFrame([(9, [9.0, 9.0])], "ix long, vec array<double>")).points.collect()
    assert tree.delete_by_index(0, None, 2).count() == 2 and tree.clear().count() == 0 and tree.clear().dimension() is None
    ragged = PointSet.ragged(tree.knn(frame(spark, [(0, [0, 0])], "query_id"), 2)).first()
    assert ragged.keys == [10, 20] and ragged.length == 2


def test_lists_of_ordinals(spark):
    own = PointSet(spark.createDataFrame([(k, [float(k)]) for k in (3, 9, 4, 20)], "key long, vec array<double>"))
    got = sorted((r.place, r.ix, r.key) for r in own.by_index([2, -1, 0, 2]).collect())
    assert got == [(0, 2, 9), (1, 3, 20), (2, 0, 3), (3, 2, 9)]
    frame = spark.createDataFrame([(1,), (-4,)], "ix long")
    assert sorted(r.key for r in own.by_index(frame).collect()) == [3, 4]
    assert sorted(r.key for r in own.delete_by_index([0, -1, 0]).points.collect()) == [4, 9]
    new = spark.createDataFrame([(-1, [0.5])], "ix long, vec array<double>")
    assert {r.key: r.vec for r in own.update_by_index(new).points.collect()}[20] == [0.5]
    for bad in ([4], [-5]):
        with pytest.raises(Exception, match="no such ordinal"):
            own.by_index(bad).collect()
        with pytest.raises(Exception, match="no such ordinal"):
            own.delete_by_index(bad).points.collect()


def test_churn(spark):
    """Many random changes of a large set against a plain dict; lookups by key, place and distance."""
    rng, plain = np.random.default_rng(8), {}
    own = PointSet.empty(spark)
    for step in range(5):
        new = rng.random((2000, 4))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(new)], "row long, vec array<double>")
        own, keys = own.insert(df, "row")
        own = own.__class__(written(own.points, "churn"), own.counter)
        plain |= {r.key: new[r.row] for r in keys.collect()}
        gone = rng.choice(sorted(plain), int(rng.integers(200, 900)), replace=False).tolist()
        own, found = own.remove(spark.createDataFrame([(k,) for k in [*gone, 10**9]], "key long"))
        assert {r.key for r in found.collect() if not r.found} == {10**9}
        for k in gone:
            del plain[k]
        moved = rng.choice(sorted(plain), 300, replace=False).tolist()
        to = rng.random((300, 4))
        own = own.upsert(spark.createDataFrame([(k, v.tolist()) for k, v in zip(moved, to)], "key long, vec array<double>"))
        plain |= dict(zip(moved, to))
        own = own.__class__(written(own.points, "churn"), own.counter)
        places = rng.integers(-len(plain), len(plain), 50).tolist()
        order = sorted(plain)
        assert [r.key for r in own.by_index(places).orderBy("place").collect()] == [order[i] for i in places]
        data, asked = np.array([plain[k] for k in order]), rng.random((20, 4))
        q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, vec array<double>")
        d = np.sqrt(((asked[:, None] - data[None]) ** 2).sum(-1))
        radius, k = float(rng.gamma(1, 0.3)), int(rng.poisson(5)) + 1
        assert {(r.query_id, r.key) for r in own.neighbors(q, radius).collect()} == {(i, order[j]) for i, j in zip(*np.nonzero(d <= radius))}
        near = sorted((r.query_id, r.rank, r.key) for r in own.knn(q, k).collect())
        assert near == [(i, n + 1, order[j]) for i in range(20) for n, j in enumerate(np.argsort(d[i], kind="stable")[:k])]
    assert own.count() == len(plain)


def test_a_callable_that_is_no_metric(spark):
    squared = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    df = spark.createDataFrame([(i, [float(i)]) for i in range(30)], "key long, vec array<double>")
    q = df.selectExpr("key AS query_id", "vec")
    got = {(r.query_id, r.key) for r in simjoin.range_join(q, df, 9.0, squared, {"metric": False}).collect()}
    assert got == {(i, j) for i in range(30) for j in range(30) if (i - j) ** 2 <= 9}
    absolute = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, v: s + v)
    got = {(r.query_id, r.key) for r in simjoin.range_join(q, df, 3.0, absolute).collect()}
    assert got == {(i, j) for i in range(30) for j in range(30) if abs(i - j) <= 3}
