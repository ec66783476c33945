"""One query per operator over the whole test tables, and its DuckDB SQL.

Doubles are rounded on both sides, since engines add in different orders.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklet.functions import vec
from brooklet.operators import detectors as det
from brooklet.operators import kernels as ker
from brooklet.operators import projection, simjoin, stats
from brooklet.operators.pointset import PointSet
from brooklet.sources.stream import Stream

W = 100
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def events(spark: SparkSession, sf_dir: str, features=("cents",), **options) -> Stream:
    """events in order of event_id, which is dense; value in whole cents."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", F.round(F.col("value") * 100).cast("long").alias("cents"), (F.col("user_id") % 97).alias("group97"))
    return Stream(df, list(features), "event_id", **({"dense": True} | options))


def unit_events(spark: SparkSession, sf_dir: str) -> Stream:
    """Two features in [0, 1] or so, by fixed literals."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.round(F.col("value") * 100) / 50000).alias("u"), ((F.col("event_id") * 7919 % 1009) / 1009).alias("v"))
    return Stream(df, ["u", "v"], "event_id", dense=True)


def rounded(df: DataFrame, keep: list[str], digits: int = 6) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*keep, *((F.round(F.col(c) + 0.0, digits) if kinds[c] == "double" else F.col(c)).alias(c) for c in df.columns if c not in keep))


EV = "(SELECT event_id, user_id, ts, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"
UNIT = "(SELECT event_id, round(value * 100) / 50000 AS u, (event_id * 7919 % 1009) / 1009 AS v FROM events)"
FRAME = f"OVER (ORDER BY event_id ROWS {W - 1} PRECEDING)"


#: Variances of whole numbers often end in a 5; engines that differ in the last bit would round it both ways.
_OFF_TIES = 0.0012345


def _stats_sql(frame: str, keep: str = "event_id") -> str:
    return f"""SELECT {keep}, count(*) {frame} AS "count", CAST(sum(cents) {frame} AS DOUBLE) AS cents_sum, round(avg(cents) {frame}, 6) AS cents_average,
        CAST(sum(cents * cents) {frame} AS DOUBLE) AS cents_squares_sum, round(var_pop(cents) {frame} + {_OFF_TIES!r}, 2) AS cents_variance,
        CAST(min(cents) {frame} AS DOUBLE) AS cents_min, CAST(max(cents) {frame} AS DOUBLE) AS cents_max FROM {EV}"""


def _stats(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*keep, "count", "cents_sum", F.round("cents_average", 6).alias("cents_average"), "cents_squares_sum", F.round(F.col("cents_variance") + _OFF_TIES, 2).alias("cents_variance"), "cents_min", "cents_max")


PLAIN = ["sum", "average", "squares_sum", "variance", "min", "max"]


@query(_stats_sql(FRAME))
def sw_stats(spark, sf_dir):
    return _stats(stats.sliding_stats(events(spark, sf_dir), W, PLAIN), ["event_id"])


@query(_stats_sql(f"OVER (PARTITION BY user_id ORDER BY event_id ROWS {W - 1} PRECEDING)", "event_id, user_id"))
def sw_stats_by_user(spark, sf_dir):
    return _stats(stats.sliding_stats(events(spark, sf_dir, key=["user_id"], dense=False), W, PLAIN), ["event_id", "user_id"])


_LISTED = f"(SELECT event_id, list_sort(list(cents) {FRAME}) AS l FROM {EV})"


@query(f"SELECT event_id, len(l) AS \"count\", CAST(l[CAST(floor((len(l) - 1) * 0.5) AS BIGINT) + 1] AS DOUBLE) AS cents_median, CAST(l[CAST(floor((len(l) - 1) * 0.25) AS BIGINT) + 1] AS DOUBLE) AS \"cents_q0.25\", CAST(l[CAST(floor((len(l) - 1) * 0.75) AS BIGINT) + 1] AS DOUBLE) AS \"cents_q0.75\" FROM {_LISTED}")
def sw_quantiles(spark, sf_dir):
    return stats.sliding_stats(events(spark, sf_dir), W, "median", [0.25, 0.75])


@query(_stats_sql("OVER (ORDER BY ts RANGE INTERVAL 86399999999 MICROSECONDS PRECEDING)"))
def sw_stats_time(spark, sf_dir):
    return _stats(stats.sliding_stats(events(spark, sf_dir, time="ts"), 86_400_000_000, PLAIN), ["event_id"])


def marked(df: DataFrame, column: str = "score") -> DataFrame:
    """NaN as -1, infinity as -2 and minus infinity as -3, so that every engine prints them alike."""
    c = F.col(column)
    return df.withColumn(column, F.when(F.isnan(c), F.lit(-1.0)).when(c == vec.INF, F.lit(-2.0)).when(c == -vec.INF, F.lit(-3.0)).otherwise(c))


def _scaled(df: DataFrame) -> DataFrame:
    return rounded(marked(df, "cents"), ["event_id"])


@query(f"SELECT event_id, CASE WHEN a = b THEN -1.0 ELSE round((cents - m) / d, 6) + 0.0 END AS cents FROM (SELECT event_id, cents, avg(cents) {FRAME} AS m, stddev_pop(cents) {FRAME} AS d, min(cents) {FRAME} AS a, max(cents) {FRAME} AS b FROM {EV})")
def zscore_scale(spark, sf_dir):
    return _scaled(stats.zscore_scale(events(spark, sf_dir), W))


def _scale_sql(q: float) -> str:
    at = lambda q: f"l[CAST(floor((len(l) - 1) * CAST({q!r} AS DOUBLE)) AS BIGINT) + 1]"
    flat = "CASE WHEN cents = low THEN -1.0 WHEN cents > low THEN -2.0 ELSE -3.0 END"
    return f"SELECT event_id, CASE WHEN high = low THEN {flat} ELSE round((cents - low) / CAST(high - low AS DOUBLE), 6) + 0.0 END AS cents FROM (SELECT event_id, cents, {at(q)} AS low, {at(1 - q)} AS high FROM (SELECT event_id, cents, list_sort(list(cents) {FRAME}) AS l FROM {EV}))"


@query(_scale_sql(0.25))
def quantile_scale(spark, sf_dir):
    return _scaled(stats.quantile_scale(events(spark, sf_dir), W, 0.25))


@query(_scale_sql(0.0))
def minmax_scale(spark, sf_dir):
    return _scaled(stats.quantile_scale(events(spark, sf_dir), W, 0.0))


# --- projections -------------------------------------------------------------------

_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _projection_sql(weights) -> str:
    sums = [" + ".join(f"({float(w)!r} * {f})" for w, f in zip(row, _LINE) if w) or "0.0" for row in weights]
    outs = ", ".join(f"round({s}, 4) + 0.0 AS p{i}" for i, s in enumerate(sums))
    return f"SELECT l_orderkey, l_linenumber, {outs} FROM lineitem"


def _projected(df: DataFrame, n: int) -> DataFrame:
    return df.select("l_orderkey", "l_linenumber", *((F.round(f"p{i}", 4) + 0.0).alias(f"p{i}") for i in range(n)))


@query(_projection_sql(projection.sparse_weights(6, 4, 1)))
def loda_project(spark, sf_dir):
    return _projected(projection.sparse_projection(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), _LINE, 6, 1), 6)


@query(_projection_sql(projection.hashed_weights(8, _LINE)))
def streamhash_project(spark, sf_dir):
    return _projected(projection.stream_hash(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), _LINE, 8), 8)


@query(_projection_sql(projection.hashed_weights(8, _LINE)))
def streamhash_project_map(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    named = F.create_map(*(c for f in _LINE for c in (F.lit(f), F.col(f).cast("double"))))
    return _projected(projection.stream_hash_map(df.select("l_orderkey", "l_linenumber", named.alias("m")), "m", 8), 8)


# --- distances and joins ---------------------------------------------------------------


def points(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("vec"))


def searches(spark, sf_dir) -> DataFrame:
    return points(spark, sf_dir).filter("key % 100 = 0").select(F.col("key").alias("query_id"), "vec")


def _pairs_sql(distance: str, where: str = "true") -> str:
    """Distances by summing over unnested positions."""
    flat = "(SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings)"
    return f"(SELECT a.vec_id AS query_id, b.vec_id AS key, {distance} AS d FROM {flat} a JOIN {flat} b USING (i) WHERE {where} GROUP BY ALL)"


_L2, _L1, _LMAX, _L3 = "sqrt(sum((a.v - b.v) * (a.v - b.v)))", "sum(abs(a.v - b.v))", "max(abs(a.v - b.v))", "pow(sum(pow(abs(a.v - b.v), 3.0)), 1.0 / 3)"
_SEARCH = "a.vec_id % 100 = 0"


def _knn_sql(distance: str, k: int, where: str = "true", order: str = "d", rank: str | None = None) -> str:
    limit = rank or f"row_number() OVER (PARTITION BY query_id ORDER BY {order}, key)"
    return f"SELECT query_id, rank, key, round(d, 6) AS distance FROM (SELECT *, {limit} AS l, row_number() OVER (PARTITION BY query_id ORDER BY {order}, key) AS rank FROM {_pairs_sql(distance, _SEARCH)} WHERE {where}) WHERE l <= {k}"


def _found(df: DataFrame) -> DataFrame:
    return df.select("query_id", *(F.col(c).cast("long") for c in ("rank",) if c in df.columns), "key", F.round("distance", 6).alias("distance"))


@query(f"SELECT query_id, key, round(d, 6) AS distance FROM {_pairs_sql(_L2, _SEARCH)} WHERE d <= 1.2")
def range_join(spark, sf_dir):
    return _found(simjoin.range_join(searches(spark, sf_dir), points(spark, sf_dir), 1.2))


@query(f"SELECT query_id, count(*) FILTER (d <= 1.2) AS \"count\" FROM {_pairs_sql(_L2)} GROUP BY query_id")
def range_count(spark, sf_dir):
    """Neighbours of every row."""
    return simjoin.neighbor_counts(points(spark, sf_dir).withColumnRenamed("key", "query_id"), points(spark, sf_dir), 1.2)


@query(_knn_sql(_L2, 5))
def knn(spark, sf_dir):
    return _found(simjoin.knn_join(searches(spark, sf_dir), points(spark, sf_dir), 5))


@query(_knn_sql(_L2, 5, order="d DESC"))
def knn_reverse(spark, sf_dir):
    return _found(simjoin.knn_join(searches(spark, sf_dir), points(spark, sf_dir), 5, reverse=True))


@query(_knn_sql(_L2, 7, "d BETWEEN 0.8 AND 1.3"))
def knn_ring(spark, sf_dir):
    return _found(simjoin.knn_join(searches(spark, sf_dir), points(spark, sf_dir), 7, min_radius=0.8, max_radius=1.3))


@query(_knn_sql(_L1, 5))
def knn_cityblock(spark, sf_dir):
    return _found(simjoin.knn_join(searches(spark, sf_dir), points(spark, sf_dir), 5, metric="cityblock"))


@query(_knn_sql(_LMAX, 5))
def knn_chebyshev(spark, sf_dir):
    return _found(simjoin.knn_join(searches(spark, sf_dir), points(spark, sf_dir), 5, metric="chebyshev"))


@query(_knn_sql(_L3, 5))
def knn_minkowski3(spark, sf_dir):
    return _found(simjoin.knn_join(searches(spark, sf_dir), points(spark, sf_dir), 5, metric="minkowski", metric_params={"p": 3}))


_TIED = "(SELECT a.p_partkey AS query_id, b.p_partkey AS key, CAST(abs(a.p_size - b.p_size) AS DOUBLE) AS d FROM part a, part b WHERE a.p_partkey % 100 = 0)"


@query(f"SELECT query_id, rank, key, d AS distance FROM (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY d) AS l, row_number() OVER (PARTITION BY query_id ORDER BY d, key) AS rank FROM {_TIED}) WHERE l <= 3")
def knn_ties(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("key"), F.array(F.col("p_size").cast("double")).alias("vec"))
    return _found(simjoin.knn_join(part.filter("key % 100 = 0").select(F.col("key").alias("query_id"), "vec"), part, 3, extend_for_ties=True))


# --- point sets ----------------------------------------------------------------------------


def _customers(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("key"), F.array(F.col("c_acctbal").cast("double"), F.col("c_nationkey").cast("double")).alias("vec"))


def _suppliers(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("key"), F.array(F.col("s_acctbal").cast("double"), F.col("s_nationkey").cast("double")).alias("vec"))


def _xy(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.get("vec", 0).alias("x"), F.get("vec", 1).alias("y"))


_C = "(SELECT CAST(c_custkey AS BIGINT) AS key, CAST(c_acctbal AS DOUBLE) AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer)"
_S = "(SELECT CAST(s_suppkey AS BIGINT) AS key, CAST(s_acctbal AS DOUBLE) AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier)"


@query(f"SELECT row_number() OVER (ORDER BY key) - 1 AS key, x, y FROM {_C}")
def pointset_insert(spark, sf_dir):
    return _xy(PointSet.empty(spark).insert(_customers(spark, sf_dir), "key")[0].points, "key")


@query(f"SELECT * FROM {_S} UNION ALL SELECT * FROM {_C} WHERE key NOT IN (SELECT key FROM {_S})")
def pointset_upsert(spark, sf_dir):
    return _xy(PointSet(_customers(spark, sf_dir)).upsert(_suppliers(spark, sf_dir)).points, "key")


@query(f"SELECT * FROM {_C} WHERE key NOT IN (SELECT key FROM {_S} WHERE key IN (SELECT key FROM {_C}))")
def pointset_delete(spark, sf_dir):
    own = PointSet(_customers(spark, sf_dir))
    present = own.contains(_suppliers(spark, sf_dir)).filter("found")
    return _xy(own.delete(present).points, "key")


@query(f"SELECT s.key, c.key IS NOT NULL AS found FROM {_S} s LEFT JOIN {_C} c USING (key)")
def pointset_remove_found(spark, sf_dir):
    return PointSet(_customers(spark, sf_dir)).remove(_suppliers(spark, sf_dir))[1]


@query(f"SELECT k AS key, coalesce(x, 0.0) AS x, coalesce(y, 0.0) AS y, c.key IS NOT NULL AS found FROM (SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders) LEFT JOIN {_C} c ON c.key = k")
def pointset_get_missing(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("key"))
    return _xy(PointSet(_customers(spark, sf_dir)).get_points(orders, 2), "key", "found")


@query(f"SELECT row_number() OVER (ORDER BY key) - 1 AS ix, key FROM {_C}")
def itok(spark, sf_dir):
    return PointSet(_customers(spark, sf_dir)).itok()


@query(f"SELECT s.key, ix FROM {_S} s LEFT JOIN (SELECT key, row_number() OVER (ORDER BY key) - 1 AS ix FROM {_C}) USING (key)")
def ktoi(spark, sf_dir):
    return PointSet(_customers(spark, sf_dir)).ktoi(_suppliers(spark, sf_dir))


@query(f"SELECT ix, key, x, y FROM (SELECT *, row_number() OVER (ORDER BY key) - 1 AS ix FROM {_C}) WHERE ix >= 2 AND (ix - 2) % 3 = 0")
def ix_slice(spark, sf_dir):
    return _xy(PointSet(_customers(spark, sf_dir)).by_index(2, None, 3), "ix", "key")


_PICKS = [0, 5, -1, 7, 5, -10]
_PICKED = ", ".join(f"({i}, {ix})" for i, ix in enumerate(_PICKS))
_PLACED = f"(SELECT *, row_number() OVER (ORDER BY key) - 1 AS ix, count(*) OVER () AS n FROM {_C})"


@query(f"SELECT CAST(place AS BIGINT) AS place, ix, key, x, y FROM (VALUES {_PICKED}) AS v(place, pick) JOIN {_PLACED} ON ix = CASE WHEN pick < 0 THEN pick + n ELSE pick END")
def ix_list(spark, sf_dir):
    return _xy(PointSet(_customers(spark, sf_dir)).by_index(_PICKS), "place", "ix", "key")


@query(f"SELECT key, x, y FROM {_PLACED} WHERE ix NOT IN (SELECT CASE WHEN pick < 0 THEN pick + n ELSE pick END FROM (VALUES {_PICKED}) AS v(place, pick), (SELECT count(*) AS n FROM customer))")
def ix_delete(spark, sf_dir):
    return _xy(PointSet(_customers(spark, sf_dir)).delete_by_index(_PICKS).points, "key")


@query(f"SELECT key, CASE WHEN pick IS NULL THEN x ELSE 1.5 END AS x, CASE WHEN pick IS NULL THEN y ELSE -2.0 END AS y FROM {_PLACED} LEFT JOIN (SELECT DISTINCT CASE WHEN pick < 0 THEN pick + n ELSE pick END AS pick FROM (VALUES {_PICKED}) AS v(place, pick), (SELECT count(*) AS n FROM customer)) ON pick = ix")
def ix_update(spark, sf_dir):
    rows = spark.createDataFrame([(ix, [1.5, -2.0]) for ix in _PICKS], "ix long, vec array<double>")
    return _xy(PointSet(_customers(spark, sf_dir)).update_by_index(rows).points, "key")


@query(f"SELECT key, CASE WHEN key % 2 = 0 THEN x ELSE x + y END AS x, CASE WHEN key % 2 = 0 THEN y ELSE x - y END AS y FROM (SELECT key, x, y FROM {_C})")
def vector_algebra(spark, sf_dir):
    own = _customers(spark, sf_dir)
    turned = vec.add(F.array(F.get("vec", 0), F.get("vec", 0)), F.array(F.get("vec", 1), -F.get("vec", 1)))
    back = vec.subtract(vec.add(F.col("vec"), F.col("vec")), F.col("vec"))
    return _xy(own.select("key", F.when(F.col("key") % 2 == 0, back).otherwise(turned).alias("vec")), "key")


def _canberra(a, b):
    """A metric of one's own, as Columns."""
    terms = F.zip_with(a, b, lambda x, y: F.abs(x - y) / F.greatest(F.abs(x) + F.abs(y), F.lit(1e-12)))
    return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)


#: The same metric over arrays, for tiles.
_canberra.arrays = lambda a, b: (np.abs(a - b) / np.maximum(np.abs(a) + np.abs(b), 1e-12)).sum(-1)


@query(_knn_sql("sum(abs(a.v - b.v) / greatest(abs(a.v) + abs(b.v), 1e-12))", 5))
def knn_callable(spark, sf_dir):
    return _found(simjoin.knn_join(searches(spark, sf_dir), points(spark, sf_dir), 5, metric=_canberra))


# --- detectors --------------------------------------------------------------------------------

_NEAR = f"(SELECT a.event_id, b.event_id AS other, abs(a.cents - b.cents) AS d FROM {EV} a LEFT JOIN {EV} b ON b.event_id < a.event_id AND b.event_id > a.event_id - {W})"


@query(f"SELECT event_id, round(1.0 / (1 + count(*) FILTER (d <= 500)), 9) AS score FROM {_NEAR} GROUP BY event_id")
def dbor(spark, sf_dir):
    return rounded(det.SWDBOR(W, 500).transform(events(spark, sf_dir)), ["event_id"], 9)


@query(f"SELECT a.event_id, count(b.event_id) AS neighbors FROM {EV} a LEFT JOIN {EV} b ON a.event_id <> b.event_id AND abs(a.cents - b.cents) <= 500 AND b.event_id > (SELECT max(event_id) FROM events) - {W} WHERE a.event_id > (SELECT max(event_id) FROM events) - {W} GROUP BY a.event_id")
def dbor_window_neighbors(spark, sf_dir):
    return det.SWDBOR(W, 500).neighbors(events(spark, sf_dir)).select("event_id", "neighbors")


_FIFTH = f"SELECT event_id, CASE WHEN count(other) >= 5 THEN CAST(list_sort(list(d) FILTER (other IS NOT NULL))[5] AS DOUBLE) END AS score FROM {_NEAR} GROUP BY event_id"


@query(f"SELECT event_id, coalesce(score, -2.0) AS score FROM ({_FIFTH})")
def swknn(spark, sf_dir):
    return marked(det.SWKNN(W, 5).transform(events(spark, sf_dir)))


_NEAR_USER = "(SELECT a.event_id, a.user_id, b.event_id AS other, abs(a.cents - b.cents) AS d FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM {e}) a LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM {e}) b ON a.user_id = b.user_id AND b.i < a.i AND b.i > a.i - 20)".format(e=EV)


@query(f"SELECT event_id, user_id, CASE WHEN count(other) >= 2 THEN CAST(list_sort(list(d) FILTER (other IS NOT NULL))[2] AS DOUBLE) ELSE -2.0 END AS score FROM {_NEAR_USER} GROUP BY ALL")
def swknn_by_user(spark, sf_dir):
    return marked(det.SWKNN(20, 2).transform(events(spark, sf_dir, key=["user_id"], dense=False)))


@query(f"SELECT event_id, CASE WHEN count(other) >= 1 THEN list_sort(list(d) FILTER (other IS NOT NULL))[1] ELSE -1 END AS d1, CASE WHEN count(other) >= 2 THEN list_sort(list(d) FILTER (other IS NOT NULL))[2] ELSE -1 END AS d2, CASE WHEN count(other) >= 3 THEN list_sort(list(d) FILTER (other IS NOT NULL))[3] ELSE -1 END AS d3 FROM {_NEAR} GROUP BY event_id")
def swknn_kmax(spark, sf_dir):
    scored = det.SWKNN(W, 3, k_is_max=True).transform(events(spark, sf_dir))
    return scored.select("event_id", *(F.when(F.get("score", i) == vec.INF, F.lit(-1)).otherwise(F.get("score", i).cast("long")).alias(f"d{i + 1}") for i in range(3)))


@query(f"SELECT a.event_id, round(1.0 / (1 + count(b.event_id) FILTER (abs(a.cents - b.cents) <= 500)), 9) AS score FROM {EV} a LEFT JOIN {EV} b ON b.event_id < a.event_id AND b.ts > a.ts - INTERVAL 6 HOURS GROUP BY a.event_id")
def dbor_time(spark, sf_dir):
    return rounded(det.SWDBOR(21_600_000_000, 500).transform(events(spark, sf_dir, time="ts")), ["event_id"], 9)


_HASH = det.RSHash(8, 200, seed=3)
_SKETCH = det.RSHash(5, 200, cms_w=3, cms_d=50, seed=4)


def _cell(p: dict) -> list[str]:
    return [f"CAST(trunc(({'uv'[d]} + {a!r}) / {p['f']!r}) AS BIGINT)" for d, a in zip(p["dims"], p["alpha"])]


def _rshash_sql(h: det.RSHash) -> str:
    rows = []
    for e, p in enumerate(h.draw(2)):
        if h.cms_d is None:
            rows.append(f"SELECT event_id, {e} AS est, 0 AS i, concat_ws(':', {', '.join(_cell(p))}) AS cell FROM {UNIT}")
        else:
            for i in range(h.cms_w):
                total = " + ".join(f"({c}) * {w}" for c, w in zip(_cell(p), p["a"][i]))
                rows.append(f"SELECT event_id, {e} AS est, {i} AS i, CAST((({total} + {p['b'][i]}) % 1000003) % {h.cms_d} AS VARCHAR) AS cell FROM {UNIT}")
    counted = f"SELECT event_id, est, i, count(*) OVER (PARTITION BY est, i, cell ORDER BY event_id RANGE BETWEEN {int(h.window) - 1} PRECEDING AND 1 PRECEDING) AS c FROM ({' UNION ALL '.join(rows)})"
    return f"SELECT event_id, round(avg(-log2(1.0 + c)), 6) + 0.0 AS score FROM (SELECT event_id, est, min(c) AS c FROM ({counted}) GROUP BY ALL) GROUP BY event_id"


@query(_rshash_sql(_HASH))
def rshash_exact(spark, sf_dir):
    return rounded(_HASH.transform(unit_events(spark, sf_dir)), ["event_id"])


@query(_rshash_sql(_SKETCH))
def rshash_cms(spark, sf_dir):
    return rounded(_SKETCH.transform(unit_events(spark, sf_dir)), ["event_id"])


_TREES = det.HSTrees(250, 5, 4, seed=5)


def _hstrees_sql(h: det.HSTrees) -> str:
    values = ", ".join(f"({t}, {n}, {q}, {p!r})" for t, (dims, splits) in enumerate(h.draw(2)) for n, (q, p) in enumerate(zip(dims, splits)))
    ctes = [f"splits(tree, node, q, p) AS (VALUES {values})", f"p0 AS (SELECT event_id, event_id // {int(h.window)} AS blk, tree, u, v, CAST(0 AS BIGINT) AS node FROM {UNIT}, (SELECT DISTINCT tree FROM splits))"]
    for d in range(h.max_depth):
        ctes.append(f"p{d + 1} AS (SELECT event_id, blk, tree, u, v, node * 2 + 1 + CAST(CASE WHEN q = 0 THEN u ELSE v END >= p AS INT) AS node FROM p{d} JOIN splits USING (tree, node))")
    paths = " UNION ALL ".join(f"SELECT event_id, blk, tree, {d} AS depth, node FROM p{d}" for d in range(h.max_depth + 1))
    ctes += [f"paths AS ({paths})", "mass AS (SELECT blk + 1 AS blk, tree, node, count(*) AS r FROM paths GROUP BY ALL)"]
    ctes.append("met AS (SELECT event_id, paths.tree, depth, coalesce(r, 0) AS r FROM paths LEFT JOIN mass USING (blk, tree, node) WHERE blk > 0)")
    return f"WITH {', '.join(ctes)} SELECT event_id, round(avg(s), 6) + 0.0 AS score FROM (SELECT event_id, tree, arg_min(-r * pow(2, depth), depth) AS s FROM met WHERE depth = {h.max_depth} OR r <= {h.limit} GROUP BY ALL) GROUP BY event_id UNION ALL SELECT event_id, -1.0 FROM {UNIT} WHERE event_id < {int(h.window)}"


@query(_hstrees_sql(_TREES))
def hstrees(spark, sf_dir):
    return rounded(marked(_TREES.transform(unit_events(spark, sf_dir))), ["event_id"])


_CHAINS = det.XStream(250, 4, 3, 3, seed=6)


def _xstream_sql(x: det.XStream) -> str:
    k, weights = x.n_projections, projection.hashed_weights(x.n_projections, ["u", "v"])
    outs = ", ".join((" + ".join(f"({float(w)!r} * {f})" for w, f in zip(row, "uv") if w) or "0.0") + f" AS p{i}" for i, row in enumerate(weights))
    ctes = [f"proj AS (SELECT event_id, event_id // {x.window} AS blk, {outs} FROM {UNIT})"]
    bounds = ", ".join(f"min(p{i}) AS a{i}, max(p{i}) AS b{i}" for i in range(k))
    ctes.append(f"own AS (SELECT blk, {bounds} FROM proj GROUP BY blk)")
    every = ", ".join(f"a{i}, b{i}" for i in range(k))
    ctes.append(f"used AS (SELECT blk + 1 AS blk, {every} FROM own UNION ALL SELECT blk, {every} FROM own WHERE blk = 0)")
    norms = ", ".join(f"CASE WHEN b{i} > a{i} THEN (p{i} - a{i}) / (b{i} - a{i}) ELSE 0.0 END AS n{i}" for i in range(k))
    ctes.append(f"norm AS (SELECT event_id, blk, {norms} FROM proj JOIN used USING (blk))")
    cells = []
    for c, p in enumerate(x.draw()):
        times, bins = [0] * k, ["0"] * k
        for level, d in enumerate(p["dims"]):
            times[d] += 1
            wide = float(2 ** times[d])
            bins[d] = f"CAST(trunc(least(greatest(n{d} * {wide!r} + {p['offset'][d]!r}, 0.0), {wide - 1!r})) AS INT)"
            named = [f"concat_ws(':', {', '.join(bins)})"]
            if x.cms_d is not None:
                named = [f"'{i}:' || (({' + '.join(f'{b} * {w}' for b, w in zip(bins, a))} + {shift}) % 1000003) % {x.cms_d}" for i, (a, shift) in enumerate(x.hashes())]
            cells += [f"SELECT event_id, blk, {c} AS chain, {level} AS level, {cell} AS cell FROM norm" for cell in named]
    ctes += [f"cells AS ({' UNION ALL '.join(cells)})", "counts AS (SELECT blk + 1 AS blk, chain, level, cell, count(*) AS n FROM cells GROUP BY ALL)"]
    return f"WITH {', '.join(ctes)} SELECT event_id, CAST(-sum(s) AS DOUBLE) + 0.0 AS score FROM (SELECT event_id, chain, min(coalesce(n, 0) * pow(2, level + 1)) AS s FROM cells LEFT JOIN counts USING (blk, chain, level, cell) WHERE blk > 0 GROUP BY ALL) GROUP BY event_id UNION ALL SELECT event_id, -1.0 FROM proj WHERE blk = 0"


@query(_xstream_sql(_CHAINS))
def xstream(spark, sf_dir):
    return rounded(marked(_CHAINS.transform(unit_events(spark, sf_dir))), ["event_id"])


_CHAIN_SKETCH = det.XStream(250, 3, 3, 3, cms_w=2, cms_d=7, seed=6)


@query(_xstream_sql(_CHAIN_SKETCH))
def xstream_cms(spark, sf_dir):
    return rounded(marked(_CHAIN_SKETCH.transform(unit_events(spark, sf_dir))), ["event_id"])


def _lof_sql(w: int, k: int, simplified: bool) -> str:
    reach = "q.kd" if simplified else "greatest(d.d, q.kd)"
    return f"""WITH w AS (SELECT a.event_id AS n, b.event_id AS o, b.cents AS x FROM {EV} a JOIN {EV} b ON b.event_id BETWEEN a.event_id - {w - 1} AND a.event_id),
    d AS (SELECT a.n, a.o, b.o AS p, abs(a.x - b.x) AS d FROM w a JOIN w b USING (n) WHERE a.o <> b.o),
    kd AS (SELECT n, o, list_sort(list(d))[least({k}, count(*))] AS kd FROM d GROUP BY n, o),
    sums AS (SELECT d.n, d.o, count(*) AS c, sum({reach}) AS s FROM d JOIN kd USING (n, o) JOIN kd q ON q.n = d.n AND q.o = d.p WHERE d.d <= kd.kd GROUP BY d.n, d.o),
    lrd AS (SELECT n, o, CASE WHEN s = 0 THEN CAST('inf' AS DOUBLE) ELSE c / CAST(s AS DOUBLE) END AS lrd FROM sums),
    lof AS (SELECT d.n, count(*) AS c, sum(isinf(q.lrd)::INT) AS i, sum(q.lrd) AS s FROM d JOIN kd USING (n, o) JOIN lrd q ON q.n = d.n AND q.o = d.p WHERE d.o = d.n AND d.d <= kd.kd GROUP BY d.n)
    SELECT e.event_id, CASE WHEN lof.n IS NULL THEN 0.0 WHEN isinf(lrd.lrd) THEN CASE WHEN i > 0 THEN -1.0 ELSE 0.0 END WHEN i > 0 THEN -2.0 ELSE round(lof.s / (lof.c * lrd.lrd), 6) END AS score
    FROM events e LEFT JOIN lof ON lof.n = e.event_id LEFT JOIN lrd ON lrd.n = e.event_id AND lrd.o = e.event_id"""


@query(_lof_sql(50, 5, False))
def swlof(spark, sf_dir):
    return rounded(marked(ker.SWLOF(50, 5).transform(events(spark, sf_dir))), ["event_id"])


@query(_lof_sql(50, 5, True))
def swlof_simplified(spark, sf_dir):
    return rounded(marked(ker.SWLOF(50, 5, simplified=True).transform(events(spark, sf_dir))), ["event_id"])


def _hbos_sql(source: str, dims: list[str], w: int, n_bins: int) -> str:
    """Bins by recursion over the sorted window of each row and dimension."""
    lists = " UNION ALL ".join(f"SELECT event_id AS n, {i} AS dim, CAST({d} AS DOUBLE) AS x, list_sort(list(CAST({d} AS DOUBLE)) OVER (ORDER BY event_id ROWS {w - 1} PRECEDING)) AS l FROM {source}" for i, d in enumerate(dims))
    return f"""WITH RECURSIVE lists AS ({lists}),
    wide AS (SELECT *, len(l) AS size, greatest(1, len(l) // {n_bins}) AS depth FROM lists WHERE l[1] <> l[len(l)]),
    bins AS (
        SELECT n, dim, x, l, size, depth, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS stop, l[1] AS low, l[1] AS high FROM wide
        UNION ALL
        SELECT n, dim, x, l, size, depth, stop, least(e, size), high, CASE WHEN e < size THEN (l[e] + l[e + 1]) / 2 ELSE l[size] END
        FROM (SELECT *, CASE WHEN stop + depth < size AND l[stop + depth + 1] = l[stop + depth] THEN CAST(len(list_filter(l, lambda y: y <= l[stop + depth + 1])) AS BIGINT) ELSE stop + depth END AS e FROM bins WHERE stop < size)
    ),
    heights AS (SELECT n, dim, x, start, low, high, (stop - start) / (high - low) AS h FROM bins WHERE stop > start),
    scores AS (SELECT n, dim, -log10(arg_max(h, start) FILTER (low <= x AND x <= high) / max(h)) AS s FROM heights GROUP BY n, dim)
    SELECT e.event_id, round(coalesce(t, 0.0) + 0.0, 6) + 0.0 AS score FROM events e LEFT JOIN (SELECT n, sum(s) AS t FROM scores GROUP BY n) ON n = e.event_id"""


@query(_hbos_sql(UNIT, ["u", "v"], W, 10))
def hbos(spark, sf_dir):
    return rounded(ker.LODA(W).transform(unit_events(spark, sf_dir)), ["event_id"])


_SPARSE = projection.sparse_weights(4, 2, 1)
_LINES = [" + ".join(f"({float(v)!r} * {f})" for v, f in zip(row, "uv") if v) for row in _SPARSE]


@query(_hbos_sql(UNIT, _LINES, W, 10))
def loda(spark, sf_dir):
    return rounded(ker.LODA(W, n_projections=4, seed=1).transform(unit_events(spark, sf_dir)), ["event_id"])


@query()
def rrcf(spark, sf_dir):
    return rounded(ker.SWRRCT(W, 4, seed=2).transform(unit_events(spark, sf_dir)), ["event_id"])


_OBSERVERS = ker.SDOstream(12, 60, qv=0.3, x=4, seed=1, return_sampling=True)


def _sdostream_sql(o: ker.SDOstream, draws: int = 4096) -> str:
    """Row by row for all groups at once; observers are a list, draws are literals by row."""
    fading, rate = math.exp(-1.0 / o.T), o.k * o.k / o.x / o.T
    u = ", ".join(map(repr, np.random.default_rng(o.seed).random(draws).tolist()))
    shape = lambda e, obs, touched: f"{{'x': {e}.x, 'obs': {obs}, 'touched': {touched}, 'added': {e}.added, 'idx': {e}.idx}}"
    return f"""WITH RECURSIVE draws AS (SELECT [{u}] AS u),
    ev AS (SELECT event_id, user_id % 97 AS g, CAST(cents AS DOUBLE) AS x, row_number() OVER (PARTITION BY user_id % 97 ORDER BY event_id) - 1 AS r FROM {EV}),
    rec AS (
        SELECT event_id, g, r, CAST(0 AS DOUBLE) AS score, 1 AS sampled, [{{'x': x, 'obs': 1.0::DOUBLE, 'touched': r + 1, 'added': r + 1, 'idx': r}}] AS state, r AS last FROM ev WHERE r = 0
        UNION ALL
        SELECT event_id, g, r, CASE WHEN len(act) % 2 = 1 THEN act[len(act) // 2 + 1] ELSE (act[len(act) // 2] + act[len(act) // 2 + 1]) / 2 END, CAST(hit AS INT),
            CASE WHEN NOT hit THEN seen ELSE list_append(CASE WHEN len(seen) < {o.k} THEN seen ELSE list_filter(seen, lambda e: e.idx <> worst) END, {{'x': px, 'obs': 1.0::DOUBLE, 'touched': r + 1, 'added': r + 1, 'idx': r}}) END,
            CASE WHEN hit THEN r ELSE last END
        FROM (
            SELECT *, u[r] * (list_sum(list_transform(o, lambda e: -e.nf)) + len(near)) * (r - last) < {rate!r} * (list_sum(list_transform(near, lambda i: -o[i].nf)) + len(near)) * (r - last) AS hit,
                list_transform(range(1, len(o) + 1), lambda i: CASE WHEN list_contains(near, i) THEN {shape('o[i]', '-o[i].nf + 1', 'r + 1')} ELSE {shape('o[i]', 'o[i].obs', 'o[i].touched')} END) AS seen
            FROM (
                SELECT *, list_transform(list_sort(dist)[1:{o.x}], lambda e: e.i) AS near, list_sort(list_transform(dist[1:CAST(floor((len(o) - 1) * {1 - o.qv!r}) AS INT) + 1], lambda e: e.d))[1:{o.x}] AS act,
                    list_sort(list_transform(o, lambda e: {{'w': -e.nf / (1 - pow({fading!r}, r + 1 - e.added)), 'idx': e.idx}}))[1].idx AS worst
                FROM (
                    SELECT *, list_transform(range(1, len(o) + 1), lambda i: {{'d': abs(o[i].x - px), 'i': i}}) AS dist
                    FROM (
                        SELECT ev.event_id, ev.g, ev.r, ev.x AS px, last, list_sort(list_transform(state, lambda e: {{'nf': -(e.obs * pow({fading!r}, ev.r + 1 - e.touched)), 'idx': e.idx, 'x': e.x, 'obs': e.obs, 'touched': e.touched, 'added': e.added}})) AS o
                        FROM rec JOIN ev ON ev.g = rec.g AND ev.r = rec.r + 1
                    )
                )
            ), draws
        )
    ) SELECT event_id, g AS group97, round(score, 6) AS score, sampled FROM rec"""


@query(_sdostream_sql(_OBSERVERS))
def sdostream(spark, sf_dir):
    return rounded(_OBSERVERS.transform(events(spark, sf_dir, key=["group97"], dense=False)), ["event_id", "group97"])


@query(f"SELECT event_id, coalesce(f.score, -2.0) AS score FROM ({_FIFTH}) f ORDER BY f.score DESC NULLS FIRST, event_id LIMIT 10")
def top10_outliers(spark, sf_dir):
    return marked(simjoin.top_outliers(det.SWKNN(W, 5).transform(events(spark, sf_dir)), "event_id", 10))


def flagship(spark, sf_dir):
    """Z-scores in a sliding window, then the k-nearest-neighbour score of them, then the top 10."""
    scaled = stats.zscore_scale(events(spark, sf_dir), W).withColumn("cents", F.when(F.isnan("cents"), F.lit(0.0)).otherwise(F.col("cents")))
    return simjoin.top_outliers(det.SWKNN(W, 5).transform(Stream(scaled, ["cents"], "event_id", dense=True)), "event_id", 10)
