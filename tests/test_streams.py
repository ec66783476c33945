"""Golden micro streams, plain row-by-row versions, and properties of the stream operators."""

import math

import numpy as np
import pytest

from brooklet.functions import vec
from brooklet.operators import detectors as det
from brooklet.operators import kernels as ker
from brooklet.operators import stats
from brooklet.plans import blocks
from brooklet.sources.stream import Stream, ingest

X, Y = [1.0, 2.0, 2.0, 5.0, 1.0, 9.0], [0.0, 1.0, 3.0, 4.0, 8.0, 9.5]
INF, NAN = math.inf, math.nan


def stream(spark, rows, features=("x",), **options) -> Stream:
    rows = [(i, *(r if isinstance(r, (tuple, list)) else (r,))) for i, r in enumerate(rows)]
    schema = "seq long, " + ", ".join(f"{f} double" for f in features)
    return Stream(spark.createDataFrame(rows, schema), list(features), "seq", **options)


def scores(df, column="score"):
    return [r[column] for r in df.orderBy("seq").collect()]


def close(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        if isinstance(b, (list, tuple)):
            close(a, b)
        else:
            assert (a != a and b != b) or a == b or abs(a - b) < 2e-6, (got, want)


def test_golden_statistics(spark):
    got = stats.sliding_stats(stream(spark, X), 4, list(stats.STATS), [0.75, 0.0, 1.0])
    want = {
        "count": [1, 2, 3, 4, 4, 4], "x_sum": [1, 3, 5, 10, 10, 17], "x_average": [1, 1.5, 5 / 3, 2.5, 2.5, 4.25], "x_squares_sum": [1, 5, 9, 34, 34, 111],
        "x_variance": [0, 0.25, 0.222222, 2.25, 2.25, 9.6875], "x_min": [1] * 6, "x_max": [1, 2, 2, 5, 5, 9], "x_median": [1, 1, 2, 2, 2, 2], "`x_q0.75`": [1, 1, 2, 2, 2, 5], "x_q0": [1] * 6, "x_q1": [1, 2, 2, 5, 5, 9],
    }
    rows = got.orderBy("seq").collect()
    for name, values in want.items():
        close([r[name.strip("`")] for r in rows], values)


def test_golden_scalers(spark):
    close(scores(stats.zscore_scale(stream(spark, X), 4), "x"), [NAN, 1, 0.707107, 1.666667, -1, 1.526117])
    close(scores(stats.quantile_scale(stream(spark, X), 4, 0.25), "x"), [NAN, INF, 1, 4, 0, 2])
    close(scores(stats.quantile_scale(stream(spark, X), 4, 0), "x"), [NAN, 1, 1, 1, 0, 1])
    assert all(math.isnan(v) for v in scores(stats.zscore_scale(stream(spark, [0.1] * 5), 3), "x"))


def test_golden_neighbours(spark):
    close(scores(det.SWDBOR(4, 1).transform(stream(spark, X))), [1, 0.5, 1 / 3, 1, 1 / 3, 1])
    want = [[INF, INF], [1, INF], [0, 1], [3, 3], [1, 1], [4, 7]]
    close(scores(det.SWKNN(4, 2, k_is_max=True).transform(stream(spark, X))), want)
    close(scores(det.SWKNN(4, 2).transform(stream(spark, X))), [w[-1] for w in want])
    close(scores(ker.ArrivalOrder(4, k=2, k_is_max=True).transform(stream(spark, X))), want)


def test_golden_lof(spark):
    close(scores(ker.SWLOF(4, 2, k_is_max=True).transform(stream(spark, X))), [[0, 0], [1, 1], [NAN, 1], [INF, 3], [INF, 1], [4 / 3, 1.276786]])
    close(scores(ker.SWLOF(4, 2, simplified=True, k_is_max=True).transform(stream(spark, X))), [[0, 0], [1, 1], [NAN, 1], [NAN, 1], [NAN, 1], [3, 0.8125]])
    close(scores(ker.SWLOF(4, 2, k_is_max=True).transform(stream(spark, Y))), [[0, 0], [1, 1], [2, 0.916667], [1, 1], [4, 1.65], [1, 1.027778]])
    close(scores(ker.SWLOF(4, 2, simplified=True, k_is_max=True).transform(stream(spark, Y))), [[0, 0], [1, 1], [1, 0.916667], [1, 0.8], [1, 0.916667], [1, 0.865497]])


def test_golden_histograms(spark):
    close(scores(ker.LODA(4, n_bins=2).transform(stream(spark, X))), [0, 0, 0, 0.255273, 0, 0.342423])
    close(scores(ker.LODA(4, n_bins=2).transform(stream(spark, Y))), [0, 0, 0.30103, 0, 0.255273, 0.066947])


def test_golden_half_space_tree(spark):
    trees = [([0], [3.0])]
    close(scores(det.HSTrees(3, 1, 1, size_limit=0).transform(stream(spark, X), trees)), [NAN, NAN, NAN, 0, -6, 0])


def test_golden_time_axis(spark):
    times = [1.0, 1.0, 2.0, 3.5, 3.0, 6.0]
    s = stream(spark, [(t, t) for t in times], ("x", "t"))
    got = ker.ArrivalOrder(2, radius=1e9).transform(Stream(s.df, ["x"], "seq", time="t"))
    assert [round(1 / v) for v in scores(got)] == [1, 2, 3, 2, 3, 1]


# --- plain versions on random streams -------------------------------------------------


def plain_windows(rows, n):
    return [rows[max(0, i - n + 1) : i + 1] for i in range(len(rows))]


@pytest.fixture(scope="module")
def random_rows():
    rng = np.random.default_rng(0)
    return np.round(rng.random((700, 2)), 2).tolist()


def test_overlap_blocks_are_the_window(spark, random_rows):
    s = stream(spark, random_rows, ("u", "v"))
    for w in (1, 2.5, 37):
        got = stats.sliding_stats(s, w, ["sum", "min", "median"], [0.3]).orderBy("seq").collect()
        n = math.ceil(w)
        for r, win in zip(got, plain_windows(random_rows, n)):
            u = sorted(x[0] for x in win)
            assert r["count"] == len(win) and abs(r.u_sum - sum(u)) < 1e-9 and r.u_min == u[0]
            assert r.u_median == u[math.floor((len(u) - 1) * 0.5)] and r["u_q0.3"] == u[math.floor((len(u) - 1) * 0.3)]


def test_overlap_copies_are_few(spark, random_rows):
    df = blocks.by_rows(ingest(stream(spark, random_rows, ("u", "v"))), 20, factor=4, least=80)
    assert df.filter("home").count() == 700 and df.count() < 700 * 1.35


@pytest.mark.parametrize("metric,params", [("euclidean", None), ("cityblock", None), ("chebyshev", None), ("minkowski", {"p": 3})])
def test_neighbours_against_plain(spark, random_rows, metric, params):
    s, n = stream(spark, random_rows, ("u", "v")), 60
    measure = vec.numpy_metric(metric, params)
    near = scores(det.SWDBOR(n, 0.15, metric, params).transform(s))
    kth = scores(det.SWKNN(n, 4, metric=metric, metric_params=params).transform(s))
    for i, (a, b) in enumerate(zip(near, kth)):
        before = np.array(random_rows[max(0, i - n + 1) : i])
        d = np.sort(measure(before, np.array(random_rows[i]))) if len(before) else np.zeros(0)
        assert abs(a - 1 / (1 + (d <= 0.15).sum())) < 1e-12 or np.abs(d - 0.15).min() < 1e-12
        assert b == INF if len(d) < 4 else abs(b - d[3]) < 1e-12


def plain_lof(window, k, simplified):
    n = len(window)
    if n == 1:
        return 0.0
    p = np.array(window)
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    np.fill_diagonal(d, INF)
    kd = np.sort(d, 1)[:, min(k, n - 1) - 1]
    hood = [np.flatnonzero(d[i] <= kd[i]) for i in range(n)]
    with np.errstate(all="ignore"):
        lrd = np.array([len(h) / np.float64(sum(kd[o] if simplified else max(d[i, o], kd[o]) for o in h)) for i, h in enumerate(hood)])
        return float(sum(lrd[o] for o in hood[-1]) / (len(hood[-1]) * lrd[-1]))


@pytest.mark.parametrize("simplified", [False, True])
def test_lof_against_plain(spark, random_rows, simplified):
    rows = random_rows[:250]
    got = scores(ker.SWLOF(25, 3, simplified).transform(stream(spark, rows, ("u", "v"))))
    close(got, [plain_lof(w, 3, simplified) for w in plain_windows(rows, 25)])


def test_hash_counts_against_plain(spark, random_rows):
    h, s = det.RSHash(6, 50, seed=2), stream(spark, random_rows, ("u", "v"))
    draws, got = h.draw(2), scores(h.transform(s))
    cells = [[tuple(math.trunc((r[d] + a) / p["f"]) for d, a in zip(p["dims"], p["alpha"])) for r in random_rows] for p in draws]
    for i, v in enumerate(got):
        assert abs(v - np.mean([-math.log2(1 + c[max(0, i - 49) : i].count(c[i])) for c in cells])) < 1e-9
    wide = scores(det.RSHash(6, 50, cms_w=2, cms_d=7, seed=2).transform(s))
    assert all(a <= b + 1e-12 for a, b in zip(wide, got))  # sketches count too much, never too little
    odd = stream(spark, [(INF, 0.1), (-INF, 0.1), (INF, 0.1)], ("u", "v"))
    assert all(math.isfinite(v) for v in scores(h.transform(odd)))


def test_half_space_trees_against_plain(spark, random_rows):
    h = det.HSTrees(100, 4, 3, size_limit=5, seed=1)
    got = scores(h.transform(stream(spark, random_rows, ("u", "v"))))
    trees = h.draw(2)

    def path(tree, r):
        node, out = 0, [0]
        for _ in range(3):
            node = 2 * node + 1 + (r[tree[0][node]] >= tree[1][node])
            out.append(node)
        return out

    for i, v in enumerate(got):
        b = i // 100
        if not b:
            assert math.isnan(v)
            continue
        each = []
        for tree in trees:
            mass = [path(tree, r) for r in random_rows[(b - 1) * 100 : b * 100]]
            for depth, node in enumerate(path(tree, random_rows[i])):
                r = sum(m[depth] == node for m in mass)
                if depth == 3 or r <= 5:
                    each.append(-r * 2**depth)
                    break
        assert abs(v - np.mean(each)) < 1e-9


def test_chains_first_sample_sets_ranges(spark, random_rows):
    x, s = det.XStream(100, 3, 2, 3, seed=1), stream(spark, random_rows, ("u", "v"))
    own, given = scores(x.transform(s)), scores(x.transform(s, initial_sample=s.df.select("u", "v")))
    assert all(math.isnan(v) for v in own[:100]) and all(v <= 0 for v in own[100:])
    assert own[200:] == given[200:] and own != given


# --- forest and observers ------------------------------------------------------------------


def test_cut_trees_keep_their_invariants():
    rng = np.random.default_rng(3)
    tree, live = ker.CutTree(rng), []

    def check(node):
        if node[4] < 0:
            return node[1], node[2], node[3]
        (m1, a1, b1), (m2, a2, b2) = check(node[6]), check(node[7])
        low, high = [min(p) for p in zip(a1, a2)], [max(p) for p in zip(b1, b2)]
        assert node[1] == m1 + m2 and node[2] == low and node[3] == high
        assert node[6][0] is node and node[7][0] is node
        assert b1[node[4]] <= node[5] < a2[node[4]] or (b1[node[4]] <= node[5] and a2[node[4]] > node[5])
        return node[1], low, high

    for i in range(600):
        x = tuple(np.round(rng.random(3) * 4).tolist())
        live.append(tree.insert(x))
        if len(live) > 40:
            tree.delete(live.pop(0))
        assert check(tree.root)[0] == len(live)
    while live:
        tree.delete(live.pop())
    assert tree.root is None


def test_forest_finds_the_outlier_and_is_stable(spark):
    rng = np.random.default_rng(4)
    rows = rng.random((400, 2))
    rows[350] = (9, 9)
    f = ker.SWRRCT(100, 8, seed=1)
    got = scores(f.transform(stream(spark, rows.tolist(), ("u", "v"))))
    assert np.argmax(got) == 350
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        close(got, scores(f.transform(stream(spark, rows.tolist(), ("u", "v")))))  # means add up in any order
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_observers(spark):
    rng = np.random.default_rng(5)
    rows = np.vstack([rng.normal(0, 1, (500, 2)), [[30.0, 30.0]]])
    d = ker.SDOstream(20, 100, seed=1, return_sampling=True)
    got = d.transform(stream(spark, rows.tolist(), ("u", "v"))).orderBy("seq").collect()
    assert got[0].score == 0 and got[0].sampled == 1 and got[-1].score > 20
    assert 1 < sum(r.sampled for r in got) < 300
    seen = d.observers(stream(spark, rows.tolist(), ("u", "v"))).collect()
    assert 1 < len(seen) <= 20 and all(r.observations > 0 for r in seen)


# --- shapes, parameters, edges -----------------------------------------------------------------


def test_bad_values_raise(spark):
    for bad in (NAN, None):
        with pytest.raises(Exception, match="null or NaN"):
            stats.sliding_stats(stream(spark, [1.0, bad]), 3, "sum").collect()
    for make in (lambda: det.SWDBOR(0, 1), lambda: det.SWKNN(5, 0), lambda: ker.SDOstream(5, 5, qv=1), lambda: det.RSHash(2, 3), lambda: det.HSTrees(5, 0, 2), lambda: ker.LODA(5, n_bins=0), lambda: ker.SWLOF(-1, 2)):
        with pytest.raises(ValueError):
            make()
    with pytest.raises(TypeError):
        vec.metric_of("minkowski")
    with pytest.raises(ValueError):
        stats.sliding_stats(stream(spark, X), 3, (), [1.5]).collect()
    late = Stream(spark.createDataFrame([(0, 1.0, 5), (1, 1.0, 4)], "seq long, x double, t long"), ["x"], "seq", time="t")
    with pytest.raises(Exception, match="strictly"):
        stats.sliding_stats(late, 10, "sum").collect()


def test_params(spark):
    d = det.SWKNN(10, 2)
    assert d.set_params(k=3).get_params()["k"] == 3 and d.k == 2
    assert scores(d.fit_predict(stream(spark, X))) == scores(d.transform(stream(spark, X))) and d.fit(stream(spark, X)) is None
    with pytest.raises(ValueError):
        d.set_params(q=1)


def test_empty_and_keys(spark):
    none = stream(spark, [])
    for d in (det.SWDBOR(4, 1), det.SWKNN(4, 2), det.RSHash(2, 8), det.HSTrees(4, 2, 2), det.XStream(4, 2, 2, 2), ker.SWLOF(4, 2), ker.LODA(4), ker.SWRRCT(4), ker.SDOstream(4, 4)):
        assert d.transform(none).count() == 0
    rows = [(i, "ab"[i % 2], X[i // 2]) for i in range(12)]
    keyed = Stream(spark.createDataFrame(rows, "seq long, k string, x double"), ["x"], "seq", key=["k"])
    for d in (det.SWDBOR(4, 1), det.SWKNN(4, 2), ker.LODA(4, n_bins=2), ker.SWLOF(4, 2, k_is_max=False)):
        one = scores(d.transform(stream(spark, X)))
        for k in "ab":
            close(scores(d.transform(keyed).filter(f"k = '{k}'")), one)


def test_window_view(spark):
    rows = det.SWDBOR(4, 1).window_rows(stream(spark, X)).orderBy("seq").collect()
    assert [r.x0 for r in rows] == X[2:] and [r.expire_time for r in rows] == [7.0, 8.0, 9.0, 10.0]
    got = det.SWDBOR(4, 1).neighbors(stream(spark, X)).orderBy("seq").collect()
    assert [r.neighbors for r in got] == [1, 0, 1, 0]
    assert len(ker.LODA(4, n_projections=3).projected_window(stream(spark, X)).columns) == 5


def test_array_column_and_float_type(spark):
    df = spark.createDataFrame([(i, [v, v + 0.1]) for i, v in enumerate(X)], "seq long, e array<double>")
    s = Stream(df, ["e"], "seq", dimension=2)
    close(scores(det.SWDBOR(4, 1.5).transform(s)), scores(det.SWDBOR(4, 1.5).transform(stream(spark, [(v, v + 0.1) for v in X], ("a", "b")))))
    f = ingest(Stream(df, ["e"], "seq", dimension=2, float_type="float")).orderBy("idx").first()
    assert f.x1 == float(np.float32(1.1))


def test_ieee(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (NAN, 1.0), (6.0, 3.0)], "a double, b double")
    close([r[0] for r in rows.select(vec.ieee_div(rows.a, rows.b)).collect()], [INF, -INF, NAN, NAN, 2])
    logs = spark.createDataFrame([(0.0,), (-1.0,), (NAN,), (100.0,)], "a double")
    close([r[0] for r in logs.select(vec.ieee_log(logs.a, 10)).collect()], [-INF, NAN, NAN, 2])
