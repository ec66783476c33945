"""Windows on a time axis against plain ones: many buckets a window, many windows a bucket."""

import numpy as np
import pytest

from brooklet.operators import stats, timed
from brooklet.sources.stream import Stream


@pytest.mark.parametrize("rows", [3, 40, 16_384])
def test_time_windows_against_plain(spark, monkeypatch, rows):
    monkeypatch.setattr(timed, "BUCKET_ROWS", rows)
    rng = np.random.default_rng(5)
    data, at = [], {"a": 0, None: -700}
    for i in range(600):
        k = "a" if rng.random() < 0.6 else None
        at[k] += int(rng.choice([1, 2, 9, 40]))
        data.append((i, k, at[k], float(np.round(rng.normal(1e6, 3), 2)), float(rng.integers(0, 5))))
    df = spark.createDataFrame(data, "seq long, k string, t long, x double, y double")
    s = Stream(df, ["x", "y"], "seq", time="t", key=["k"])
    got = {r.seq: r for r in stats.sliding_stats(s, 97, ["sum", "average", "squares_sum", "variance", "min", "max"], [0, 1]).collect()}
    scaled = {r.seq: r for r in stats.zscore_scale(s, 97).collect()}
    assert len(got) == len(scaled) == 600
    for i, k, t, *_ in data:
        v = np.array([r[3:] for r in data[: i + 1] if r[1] == k and r[2] > t - 97])
        assert got[i]["count"] == len(v) and got[i].k == k
        for j, f in enumerate("xy"):
            c = v[:, j]
            assert np.allclose([got[i][f"{f}_{n}"] for n in ("sum", "average", "squares_sum", "min", "max", "q0", "q1")], [c.sum(), c.mean(), (c * c).sum(), c.min(), c.max(), c.min(), c.max()], rtol=1e-13)
            assert np.isclose(got[i][f"{f}_variance"], c.var(), rtol=1e-7, atol=1e-12)
            assert np.isnan(scaled[i][f]) if c.min() == c.max() else np.isclose(scaled[i][f], (c[-1] - c.mean()) / c.std(), atol=1e-6)


def test_no_frame_is_added_up_for_each_row(spark):
    df = spark.range(10).selectExpr("id AS seq", "id AS t", "double(id) AS x")
    plan = stats.sliding_stats(Stream(df, ["x"], "seq", time="t", dense=True), 5, "sum")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


@pytest.mark.parametrize("radius", [1.0, 0.3])
def test_neighbors_of_long_frames_by_rank(radius):
    """Counts by rank are those of looking through, at the edge of the radius too, in runs of any length; a frame
    is never gathered."""
    from brooklet.functions.vec import numpy_metric
    from brooklet.operators.kernels import NeighborKernel

    rng = np.random.default_rng(7)
    x, t = np.round(rng.random(4000) * 20, 1)[:, None], np.cumsum(rng.random(4000))
    plain = NeighborKernel(700, numpy_metric("euclidean"), radius=radius).many(x, t)
    ranked = NeighborKernel(700, None, radius=radius, line=True)
    ranked.SHORT = 0
    got = [v for part in np.array_split(np.arange(4000), 7) for v in ranked.many(x[part], t[part])]
    assert got == plain and len(ranked.x) < 1800
