"""Online runs equal batch runs; table functions; the driver's contract."""

import pytest

from brooklet.functions import udtf
from brooklet.operators import detectors as det
from brooklet.operators import kernels as ker
from brooklet.operators import stats
from brooklet.sources.stream import Stream
from brooklet.streaming.online import online, online_stats


def _runs(spark, sf, tmp_path, detector, features=("value",), time=None):
    """A stream in three files through the online query, as rows by event."""
    rows = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id", "user_id % 5 AS user_id", "value", "value / 500 AS u", "(event_id * 7919 % 1009) / 1009D AS v", "event_id * 3 AS at").filter("event_id < 300")
    for i in range(3):
        rows.filter(f"event_id >= {i} * 100 AND event_id < {i + 1} * 100").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = online(source, detector, list(features), "event_id", key=["user_id"], time=time)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return rows, {r.event_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}


def _same(a, b) -> bool:
    if isinstance(a, (list, tuple)):
        return len(a) == len(b) and all(map(_same, a, b))
    return a == b or abs(a - b) < 1e-6 or (a != a and b != b)


EVERY = [
    det.SWDBOR(20, 50), det.SWKNN(20, 3), det.SWKNN(20, 3, k_is_max=True), ker.SWLOF(20, 3), ker.SDOstream(10, 50, return_sampling=True), det.RSHash(3, 20, seed=1), ker.LODA(20, 3),
    det.HSTrees(20, 3, 3), det.XStream(20, 2, 2, 3), det.XStream(20, 2, 2, 3, cms_w=2, cms_d=5), ker.SWRRCT(70, 3),
]


@pytest.mark.parametrize("detector", EVERY, ids=lambda d: type(d).__name__)
def test_online_is_batch(spark, sf, tmp_path, detector):
    rows, got = _runs(spark, sf, tmp_path, detector, ("u", "v"))
    # groups of one key draw from one seed, so observers and trees agree as well
    want = {r.event_id: r for r in detector.transform(Stream(rows, ["u", "v"], "event_id", key=["user_id"])).collect()}
    assert set(got) == set(want) and len(got) == 300
    assert all(_same(got[k].score, want[k].score) for k in want)
    if isinstance(detector, ker.SDOstream):
        assert all(got[k].sampled == want[k].sampled for k in want)


def test_statistics_and_scalers_online(spark, sf, tmp_path):
    s = lambda rows: Stream(rows, ["u", "v"], "event_id", key=["user_id"])
    what, quantiles = ("sum", "average", "squares_sum", "variance", "min", "max", "median"), (0.25, 1.0)
    for i, (detector, batch) in enumerate((
        (ker.SlidingStatistics(20, what, quantiles), lambda rows: stats.sliding_stats(s(rows), 20, what, quantiles)),
        (ker.SlidingScale(20), lambda rows: stats.zscore_scale(s(rows), 20)), (ker.SlidingScale(20, 0.1), lambda rows: stats.quantile_scale(s(rows), 20, 0.1)),
    )):
        (own := tmp_path / str(i)).mkdir()
        rows, got = _runs(spark, sf, own, detector, ("u", "v"))
        want = {r.event_id: r.asDict() for r in batch(rows).collect()}
        assert set(got) == set(want) and all(set(got[k].asDict()) == set(want[k]) for k in want)
        assert all(_same(got[k][c], v) for k in want for c, v in want[k].items()), detector


def test_online_on_a_time_axis(spark, sf, tmp_path):
    detector = det.SWKNN(90, 2)
    rows, got = _runs(spark, sf, tmp_path, detector, ("u", "v"), time="at")
    want = {r.event_id: r.score for r in detector.transform(Stream(rows, ["u", "v"], "event_id", time="at", key=["user_id"])).collect()}
    assert all(_same(got[k].score, want[k]) for k in want)


def test_online_stats(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/events.parquet").select("ts", "value")
    rows.write.parquet(str(tmp_path / "in"))
    out = online_stats(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts", "1 day", ["value"], "1 hour")
    q = out.writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(count) FROM daily").first()[0] == rows.count()


def test_table_function(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "value")
    rows.createOrReplaceTempView("ev")
    udtf.register(spark, "sw_knn", det.SWKNN(20, 3), ["value"], "event_id")
    got = {r.event_id: r.score for r in spark.sql("SELECT * FROM sw_knn(TABLE(ev) PARTITION BY user_id ORDER BY event_id)").collect()}
    want = {r.event_id: r.score for r in det.SWKNN(20, 3).transform(Stream(rows, ["value"], "event_id", key=["user_id"])).collect()}
    assert got == want
    udtf.register(spark, "sw_stats", ker.SlidingStatistics(20, ("sum", "median")), ["value"], "event_id")
    got = {r.event_id: (r["count"], r.value_sum, r.value_median) for r in spark.sql("SELECT * FROM sw_stats(TABLE(ev) PARTITION BY user_id ORDER BY event_id)").collect()}
    want = {r.event_id: (r["count"], r.value_sum, r.value_median) for r in stats.sliding_stats(Stream(rows, ["value"], "event_id", key=["user_id"]), 20, ["sum", "median"]).collect()}
    assert set(got) == set(want) and all(_same(got[k], want[k]) for k in want)


def test_contract(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert len(rows) == 10 and set(e.oracle_sql()) <= set(e.queries())


def test_oracles_on_the_smallest_tables(spark, sf):
    import duckdb

    from brooklet import queries

    con = duckdb.connect()
    for t in ("events", "lineitem", "embeddings", "part", "customer", "supplier", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        a, b = queries.QUERIES[name](spark, sf).toPandas(), con.execute(sql).df()
        assert sorted(a.columns) == sorted(b.columns), name
        plain = lambda df: sorted(tuple(map(str, r)) for r in df[sorted(df.columns)].itertuples(index=False))
        assert plain(a) == plain(b), name
