"""Kernels row by row equal the batch operators."""

import math

import numpy as np
import pytest

from brooklet.operators import detectors as det
from brooklet.operators import kernels as ker
from brooklet.operators import stats
from brooklet.sources.stream import Stream

from .test_streams import close, random_rows, scores, stream  # noqa: F401


@pytest.mark.parametrize("detector", [det.RSHash(4, 50, seed=2), det.RSHash(3, 50, cms_w=2, cms_d=9, seed=2), det.HSTrees(70, 3, 3, seed=1), det.XStream(90, 3, 2, 3, seed=1), det.XStream(90, 3, 2, 3, cms_w=2, cms_d=5, seed=1), det.SWKNN(30, 2), det.SWDBOR(30, 0.4)])
def test_kernel_is_batch(spark, random_rows, detector):  # noqa: F811
    s = stream(spark, random_rows, ("u", "v"))
    close(scores(ker.sequential(s, detector)), scores(detector.transform(s)))


def test_chains_with_a_first_sample(spark, random_rows):  # noqa: F811
    x, s = det.XStream(90, 3, 2, 3, seed=1), stream(spark, random_rows, ("u", "v"))
    kernel = ker.ChainKernel(x, ["u", "v"], np.array(random_rows))
    close([kernel.step(np.array(r), 0) for r in random_rows], scores(x.transform(s, initial_sample=s.df.select("u", "v"))))


def test_statistics_and_scalers(spark, random_rows):  # noqa: F811
    s = stream(spark, random_rows[:200], ("u", "v"))
    got = scores(ker.SlidingStatistics(20, ("sum", "median"), (0.25,)).transform(s))
    want = stats.sliding_stats(s, 20, ["sum", "median"], [0.25]).orderBy("seq").collect()
    close(got, [[r["count"], r.u_sum, r.v_sum, r.u_median, r.v_median, r["u_q0.25"], r["v_q0.25"]] for r in want])
    for q, batch in ((None, stats.zscore_scale(s, 20)), (0.1, stats.quantile_scale(s, 20, 0.1))):
        close(scores(ker.SlidingScale(20, q).transform(s)), [[r.u, r.v] for r in batch.orderBy("seq").collect()])


def test_time_axis_with_ties_and_late_rows(spark):
    times = [1.0, 1.0, 2.0, 3.5, 3.0, 6.0]
    rows = stream(spark, [(0.5, t) for t in times], ("x", "t"))
    s = Stream(rows.df, ["x"], "seq", time="t")
    counts = [round(v[0]) for v in scores(ker.SlidingStatistics(2).transform(s))]
    assert counts == [1, 2, 3, 2, 3, 1]
    got = scores(det.RSHash(2, 4, s_param=4).transform(s))
    assert len(got) == 6 and got[0] == 0
    trees = scores(det.HSTrees(2, 2, 1, size_limit=0).transform(s))
    # blocks begin at 1, 3.5 and 6
    assert [math.isnan(v) for v in trees] == [True, True, True, False, False, False]


def test_forest_kernel_is_one_block_of_batch(spark, random_rows):  # noqa: F811
    f, s = ker.SWRRCT(40, 3, seed=5), stream(spark, random_rows[:300], ("u", "v"))
    close(scores(ker.sequential(s, f)), scores(f.transform(s)))


def test_chains_over_named_features(spark, random_rows):  # noqa: F811
    x, s = det.XStream(90, 3, 2, 3, seed=1), stream(spark, random_rows, ("u", "v"))
    named = s.df.selectExpr("seq", "map('u', u, 'v', v) AS m")
    mapped = Stream(named, ["m"], "seq")
    close(scores(x.transform(mapped)), scores(x.transform(s)))
    close(scores(x.transform(mapped, initial_sample=named)), scores(x.transform(s, initial_sample=s.df)))
    some = s.df.selectExpr("seq", "CASE WHEN seq < 300 THEN map('u', u) ELSE map('u', u, 'w', v) END AS m")
    assert len(scores(x.transform(Stream(some, ["m"], "seq")))) == len(random_rows)


def test_window_view_on_a_time_axis(spark):
    rows = [(i, k, float(t), t) for k in "ab" for i, t in enumerate((1, 2, 3, 5))]
    df = spark.createDataFrame(rows, "seq long, k string, x double, t long")
    d = det.SWKNN(2, 1)
    for s in (Stream(df.filter("k = 'a'"), ["x"], "seq", time="t"), Stream(df, ["x"], "seq", time="t", key=["k"])):
        n = max(1, 2 * len(s.key))
        assert sorted(r.x0 for r in d.window_rows(s).collect()) == [5.0] * n
        assert sorted(r.x0 for r in d.window_rows(s, at=2).collect()) == [2.0] * n + [3.0] * n
        assert {r.expire_time for r in d.window_rows(s).collect()} == {7} and d.window_size(s) == n


def _observers(rows, k, T, qv, x, draws):
    """The six steps, one row at a time, with one draw a row."""
    f, live, out, added_at, added_row = math.exp(-1 / T), [], [], 0, 0  # live: [vec, obs, touched, added, index]
    for row, v in enumerate(rows):
        now = row + 1
        faded = lambda o: o[1] * f ** (now - o[2])  # noqa: E731, B023
        live.sort(key=lambda o: (-faded(o), o[4]))
        if not live:
            live.append([v, 1.0, now, now, row])
            added_at, added_row = now, row
            out.append((0.0, 1))
            continue
        far = [math.dist(o[0], v) for o in live]
        score = float(np.median(sorted(far[: int((len(live) - 1) * (1 - qv)) + 1])[:x]))
        near = sorted(range(len(live)), key=lambda i: (far[i], i))[:x]
        worst = min(range(len(live)), key=lambda i: faded(live[i]) / (1 - f ** (now - live[i][3])))
        for i in near:
            live[i][1], live[i][2] = faded(live[i]) + 1, now
        total, of_near = sum(map(faded, live)), sum(faded(live[i]) for i in near)
        hit = draws[row - 1] * total * (row - added_row) < k * k / x / T * of_near * (now - added_at)
        if hit:
            new = [v, 1.0, now, now, row]
            if len(live) < k:
                live.append(new)
            else:
                live[worst] = new
            added_at, added_row = now, row
        out.append((score, int(hit)))
    return out


def test_observers_by_their_steps():
    rows = np.random.default_rng(0).random((700, 2)).tolist()
    for k, T, qv, x in ((10, 40, 0.3, 3), (12, 25, 0.0, 4), (25, 300, 0.5, 4)):
        kernel = ker.SDOstream(k, T, qv, x, seed=3).kernel()
        want = _observers([tuple(r) for r in rows], k, T, qv, x, np.random.default_rng(3).random(len(rows)))
        got = [kernel.step(np.array(r), i + 1) for i, r in enumerate(rows)]
        assert [g[1] for g in got] == [w[1] for w in want] and sum(g[1] for g in got) > k
        close([g[0] for g in got], [w[0] for w in want])


def _plain_lof(rows, w, k, simplified):
    out = []
    for n in range(len(rows)):
        p = np.array(rows[max(0, n - w + 1) : n + 1])
        d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
        np.fill_diagonal(d, np.inf)
        if len(p) == 1:
            out.append(0.0)
            continue
        kd = np.sort(d, 1)[:, min(k, len(p) - 1) - 1]
        near = [np.flatnonzero(d[i] <= kd[i]) for i in range(len(p))]
        with np.errstate(all="ignore"):
            lrd = np.array([len(near[i]) / (kd[near[i]] if simplified else np.maximum(d[i, near[i]], kd[near[i]])).sum() for i in range(len(p))])
            out.append(lrd[near[-1]].sum() / (len(near[-1]) * lrd[-1]))
    return out


@pytest.mark.parametrize("simplified", [False, True])
def test_lof_kernel_is_plain(random_rows, simplified):  # noqa: F811
    from pyspark import cloudpickle as pickle

    rows = random_rows[:250] + [random_rows[3]] * 9 + random_rows[250:300]
    kernel = ker.SWLOF(40, 4, simplified=simplified).kernel()
    got = kernel.many(np.array(rows[:100]), np.arange(100) + 1)
    kernel = pickle.loads(pickle.dumps(kernel))
    got += kernel.many(np.array(rows[100:]), np.arange(100, len(rows)) + 1)
    close(got, _plain_lof(rows, 40, 4, simplified))


def test_frames_in_parts(random_rows, monkeypatch):  # noqa: F811
    """Runs of any length, and parts of any size, give what one row at a time gives."""
    x, t = np.array(random_rows[:200]), np.cumsum(np.random.default_rng(1).integers(0, 3, 200))
    make = lambda: det.SWKNN(17, 3, k_is_max=True).kernel()
    want = [sorted([math.dist(x[j], x[i]) for j in range(i) if t[j] + 17 > t[i]] + [math.inf] * 3)[:3] for i in range(200)]
    monkeypatch.setattr(ker.FrameKernel, "PART", 64)
    for cuts in ([200], [1] * 200, [3, 90, 7, 100]):
        kernel, at, got = make(), 0, []
        for n in cuts:
            got += kernel.many(x[at : at + n], t[at : at + n])
            at += n
        close(got, want)


def test_rising_times_are_cut(spark, random_rows):  # noqa: F811
    rows = [(u, v, float(i // 2)) for i, (u, v) in enumerate(random_rows[:300])]
    s = stream(spark, rows, ("u", "v", "at"))
    plain, cut = (Stream(s.df, ["u", "v"], "seq", time="at", rising=r) for r in (False, True))
    for detector in (det.RSHash(3, 8, seed=2), ker.SWLOF(9, 3), ker.LODA(9, n_bins=4)):
        close(scores(detector.transform(cut)), scores(detector.transform(plain)))
    falls = Stream(s.df.selectExpr("seq", "u", "v", "-at AS at"), ["u", "v"], "seq", time="at", rising=True)
    for detector in (det.RSHash(3, 8, seed=2), det.SWKNN(8, 2)):
        with pytest.raises(Exception, match="falls"):
            detector.transform(falls).collect()


def test_dense_is_checked(spark):
    for bad in ([0, 1, 3], [1, 2, 3], [0, 1, 1], [0, 1, None]):
        df = spark.createDataFrame([(i, 1.0) for i in bad], "seq long, x double")
        with pytest.raises(ValueError, match="count"):
            stats.sliding_stats(Stream(df, ["x"], "seq", dense=True), 2, "sum").collect()
    two = spark.createDataFrame([(i, k, 1.0) for k in "ab" for i in range(3)], "seq long, k string, x double")
    assert det.SWKNN(2, 1).transform(Stream(two, ["x"], "seq", key=["k"], dense=True)).count() == 6
    empty = spark.createDataFrame([], "seq long, x double")
    assert det.SWKNN(2, 1).transform(Stream(empty, ["x"], "seq", dense=True)).count() == 0
