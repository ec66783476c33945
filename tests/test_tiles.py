"""Tiles of pairs against plain matrices, and the joins that stand on them."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brooklet import queries
from brooklet.functions.vec import numpy_metric
from brooklet.operators import simjoin, tiles

RNG = np.random.default_rng(3)


def _met(tile, q, p, parts=3):
    tile.hold(pa.array(range(len(q))), q)
    out = []
    for at in np.array_split(np.arange(len(p)), parts):
        out += list(tile.meet(pa.array(at), p[at]))
    return [r for b in [*out, *tile.close()] for r in zip(*(c.to_pylist() for c in b.columns))]


@pytest.mark.parametrize("metric,params", [("euclidean", None), ("cityblock", None), ("chebyshev", None), ("minkowski", {"p": 3}), ("minkowski", {"p": 17})])
def test_tiles_against_matrices(metric, params):
    # equal points, far from the origin, and one at infinity
    p = np.round(RNG.normal(0, 1, (4000, 5)), 1) + 1000
    p[7, 2] = np.inf
    q = np.vstack([p[:30], RNG.normal(1000, 1, (20, 5))])
    q = q[np.isfinite(q).all(1)]
    measure, plain = tiles.measure_of(metric, params), numpy_metric(metric, params)
    d = np.array([plain(p, row) for row in q])
    got = _met(tiles.RangeTile(measure, 0.3, 0.9), q, p)
    assert {(i, j) for i, j, _ in got} >= {(int(i), int(j)) for i, j in np.argwhere((d >= 0.3 + 1e-9) & (d <= 0.9 - 1e-9))}
    assert all(0.3 <= v <= 0.9 and abs(v - d[i, j]) < 1e-9 for i, j, v in got)
    counts = dict(_met(tiles.CountTile(measure, 0.3, 0.9), q, p))
    assert counts == {i: sum(1 for g in got if g[0] == i) for i in {g[0] for g in got}}
    for reverse in (False, True):
        near = _met(tiles.NearestTile(measure, 0.0, np.inf, 6, reverse, False), q, p)
        for i in range(len(q)):
            own = sorted(v for r, _, v in near if r == i)
            assert len(own) == 6 and np.allclose(own, np.sort(d[i])[-6:] if reverse else np.sort(d[i])[:6])


def test_a_tile_sends_no_more_than_its_answers():
    """Ten points of each of 20 places: k rows a query whatever lies within the radius, the least keys of equal distances."""
    p = np.repeat(np.arange(20.0), 500)[:, None]
    got = _met(tiles.NearestTile(tiles.measure_of("euclidean"), 0.0, 30.0, 3, False, False), np.array([[4.0], [9.0]]), p)
    assert sorted(got) == [(0, 2000, 0.0), (0, 2001, 0.0), (0, 2002, 0.0), (1, 4500, 0.0), (1, 4501, 0.0), (1, 4502, 0.0)]


def test_joins_by_radius_go_by_tiles(spark, sf):
    for name in ("range_join", "range_count", "knn_ring", "knn", "knn_callable"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_ties_are_dealt_out_from_distinct_vectors(spark, monkeypatch):
    """Many equal points: the tiles meet distinct vectors only, and every query of a vector gets all its answers."""
    met = []
    monkeypatch.setattr(simjoin, "meet", lambda q, p, *rest: met.append((q.count(), p.count())) or tiles.meet(q, p, *rest))
    monkeypatch.setattr(simjoin, "SLICE_ROWS", 50)  # answers of a class in several slices
    p = spark.range(400).select(F.col("id").alias("key"), F.array((F.col("id") % 5).cast("double")).alias("vec"))
    q = p.filter("key % 20 < 2").select(F.col("key").alias("query_id"), "vec")
    for reverse in (False, True):
        got = simjoin.knn_join(q, p, 81, extend_for_ties=True, reverse=reverse).collect()
        for row in q.collect():
            d = sorted((abs(k % 5 - row.vec[0]), k) for k in range(400))
            last = sorted((v for v, _ in d), reverse=reverse)[80]
            own = [(v, k) for v, k in d if (v >= last if reverse else v <= last)]
            own = sorted(own, key=lambda r: (-r[0] if reverse else r[0], r[1]))
            assert sorted((r["rank"], r.key, r.distance) for r in got if r.query_id == row.query_id) == [(i + 1, k, v) for i, (v, k) in enumerate(own)]
    assert met == [(2, 5), (2, 5)]


def test_every_row_is_counted(spark, sf):
    counts = {r.query_id: r["count"] for r in queries.range_count(spark, sf).collect()}
    x = np.array([r.vec for r in queries.points(spark, sf).orderBy("key").collect()])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert len(counts) == len(x) and all(n == (d[k] <= 1.2).sum() for k, n in counts.items())
