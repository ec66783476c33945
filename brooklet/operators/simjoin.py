"""Exact similarity joins between a query set and a point set: by radius, and k nearest.

Points are (key, vec) and queries (query_id, vec), vec an array<double>.

A radius buckets both sides on distances to a few pivots: within radius r the
distances to a pivot differ by at most r, so a query meets its own and the two
neighbouring buckets per pivot, and the metric decides the rest. This
holds for every metric; a callable that is none (no triangle inequality) must say so by
metric_params={"metric": False}, and every query then meets every point. Without a radius
there are no buckets.

Within a bucket (or without any) all pairs are the job. They are met by tiles of bounded size
(`operators.tiles`), where a tile sends on no more than its answers: pairs, counts, or the k best of a query.
A callable that builds Columns and no arrays goes pair by pair through an equi-join, block by block.

Ties without bound (extend_for_ties) are found among distinct vectors, of which each is as many points as
equal it, and only answers are dealt out to rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brooklet.functions.vec import metric_of
from brooklet.operators.tiles import CountTile, NearestTile, RangeTile, meet, measure_of
from brooklet.plans.lineage import written

INF = float("inf")
#: Bytes of queries in one block, which is broadcast; a fixed bound.
BLOCK_BYTES = 8_000_000
#: Rows of answers that one slice of a class is dealt out to.
SLICE_ROWS = 2_000_000


def _is_metric(metric, metric_params: dict | None) -> bool:
    """Whether the triangle inequality holds: for metrics by name, and callables unless they deny it."""
    return not callable(metric) or bool((metric_params or {}).get("metric", True))


def _all_pairs(queries: DataFrame, points: DataFrame, measure, block_bytes: int) -> DataFrame:
    """query_id, key, distance of every query with every point; queries in blocks of bounded size."""
    q, p = queries.select("query_id", _vector("vec").alias("q_vec")), points.select("key", _vector("vec").alias("p_vec"))
    n, size = q.agg(F.count("*"), F.max(F.size("q_vec"))).first()
    blocks = max(1, -(-n * (8 * max(size or 0, 1) + 24) // block_bytes))
    if blocks == 1:
        pairs = p.crossJoin(F.broadcast(q))  # n rows of a size just checked
    else:
        q = q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
        p = p.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        pairs = p.hint("shuffle_hash").join(q, "block")
    return pairs.select("query_id", "key", measure(F.col("q_vec"), F.col("p_vec")).alias("distance"))


def _pivots(points: DataFrame, n: int, measure) -> list[list[float]]:
    """A few points far from each other: n rows to the driver."""
    rows = [r[0] for r in points.orderBy("key").select("vec").limit(1).collect()]
    while rows and len(rows) < n:
        to = [measure(F.col("vec"), F.lit(p).cast("array<double>")) for p in rows]
        near = F.least(*to) if len(to) > 1 else to[0]
        rows.append(points.orderBy(near.desc(), "key").select("vec").limit(1).collect()[0][0])
    return rows


def _vector(column: str):
    return F.col(column).cast("array<double>")


def _bucketed(queries: DataFrame, points: DataFrame, radius: float, metric, metric_params, n_pivots: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the buckets that a query and a point within the radius share, and their names."""
    q, p = queries.select("query_id", _vector("vec").alias("q_vec")), points.select("key", _vector("vec").alias("p_vec"))
    if radius == INF or not _is_metric(metric, metric_params):
        return q, p, []
    measure = metric_of(metric, metric_params)
    pivots = _pivots(points, n_pivots, measure)
    width = radius if radius > 0 else 1.0
    names = [f"b{i}" for i in range(len(pivots))]
    for name, pivot in zip(names, pivots):
        at = F.floor(measure(F.col("p_vec"), F.lit(pivot).cast("array<double>")) / width).cast("long")
        p = p.withColumn(name, at)
        mine = measure(F.col("q_vec"), F.lit(pivot).cast("array<double>"))
        # a little wider than the radius: rounding of the two distances must not lose a pair
        slack = width * 1.000001
        low, high = F.floor((mine - slack) / width).cast("long"), F.floor((mine + slack) / width).cast("long")
        q = q.withColumn(name, F.explode(F.sequence(low, high)))
    return q, p, names


def range_join(queries: DataFrame, points: DataFrame, radius: float, metric="euclidean", metric_params=None, n_pivots: int = 2, min_radius: float = 0.0) -> DataFrame:
    """query_id, key, distance for all pairs with min_radius <= distance <= radius."""
    if radius < 0:
        raise ValueError("radius must not be negative")
    measure, tiles = metric_of(metric, metric_params), measure_of(metric, metric_params)
    if tiles is None and not _is_metric(metric, metric_params):
        pairs = _all_pairs(queries, points, measure, BLOCK_BYTES)
        return pairs.filter(F.col("distance").between(min_radius, radius))
    q, p, names = _bucketed(queries, points, radius, metric, metric_params, n_pivots)
    if tiles is not None:
        return meet(q, p, names, lambda: RangeTile(tiles, min_radius, radius), BLOCK_BYTES)
    joined = q.join(p, names) if names else q.join(p, F.lit(False))
    return joined.select("query_id", "key", measure(F.col("q_vec"), F.col("p_vec")).alias("distance")).filter(F.col("distance").between(min_radius, radius))


def neighbor_counts(queries: DataFrame, points: DataFrame, radius: float, metric="euclidean", metric_params=None, n_pivots: int = 2, min_radius: float = 0.0) -> DataFrame:
    """query_id and the number of points within the radius; 0 included."""
    tiles = measure_of(metric, metric_params)
    if tiles is None:
        parts = range_join(queries, points, radius, metric, metric_params, n_pivots, min_radius).select("query_id", F.lit(1).alias("n"))
    else:
        if radius < 0:
            raise ValueError("radius must not be negative")
        q, p, names = _bucketed(queries, points, radius, metric, metric_params, n_pivots)
        parts = meet(q, p, names, lambda: CountTile(tiles, min_radius, radius), BLOCK_BYTES)
    found = parts.groupBy(F.col("query_id").alias("q")).agg(F.sum("n").alias("n"))
    return queries.select("query_id").join(found, F.col("query_id") == F.col("q"), "left").select("query_id", F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def knn_join(
    queries: DataFrame,
    points: DataFrame,
    k: int = 1,
    sort: bool = True,
    min_radius: float = 0.0,
    max_radius: float = INF,
    reverse: bool = False,
    extend_for_ties: bool = False,
    metric="euclidean",
    metric_params=None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """query_id, rank (from 1), key, distance of the k nearest (reverse: furthest) points.

    Equal distances go by key; extend_for_ties keeps all that equal the k-th distance.
    sort=False leaves the order of ranks out of the contract (they are given all the same).
    """
    if k < 1:
        raise ValueError("k must be positive")
    measure = metric_of(metric, metric_params)
    tiles = measure_of(metric, metric_params)
    order = F.col("distance").desc() if reverse else F.col("distance").asc()
    by = Window.partitionBy("query_id")
    if tiles is not None:
        radius = INF if reverse else max_radius

        def nearest(queries: DataFrame, points: DataFrame) -> DataFrame:
            q, p, names = _bucketed(queries, points, radius, metric, metric_params, 2)
            return meet(q, p, names, lambda: NearestTile(tiles, min_radius, max_radius, k, reverse, extend_for_ties), block_bytes)

        if extend_for_ties:
            return _with_ties(queries, points, k, nearest, order)
        pairs = nearest(queries, points)
    elif max_radius != INF and not reverse:
        pairs = range_join(queries, points, max_radius, metric, metric_params, min_radius=min_radius)
    else:
        pairs = _all_pairs(queries, points, measure, block_bytes).filter(F.col("distance").between(min_radius, max_radius))
    rank = F.rank().over(by.orderBy(order)) if extend_for_ties else F.row_number().over(by.orderBy(order, "key"))
    kept = pairs.withColumn("limit_rank", rank).filter(F.col("limit_rank") <= k)
    if extend_for_ties:
        kept = kept.withColumn("rank", F.row_number().over(by.orderBy(order, "key")))
    else:
        kept = kept.withColumn("rank", F.col("limit_rank"))
    return kept.select("query_id", "rank", "key", "distance")


def _with_ties(queries: DataFrame, points: DataFrame, k: int, nearest, order) -> DataFrame:
    """The k nearest and all that equal the k-th: among distinct vectors first, then dealt out to rows."""

    def classes(rows: DataFrame, name: str) -> DataFrame:
        return written(rows.groupBy(_vector("vec").alias("vec")).agg(F.count("*").alias("n")).withColumn("class", F.monotonically_increasing_id()), name)

    q, p = queries.select("query_id", _vector("vec").alias("vec")), points.select("key", _vector("vec").alias("vec"))
    qs, ps = classes(q, "queries"), classes(p, "points")
    met = nearest(qs.select(F.col("class").alias("query_id"), "vec"), ps.select(F.col("class").alias("key"), "vec"))
    met = met.join(ps.select(F.col("class").alias("key"), F.col("n").alias("points")), "key")
    # a class is in, as a whole, if fewer than k points are nearer
    up_to = F.sum("points").over(Window.partitionBy("query_id").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    equal = F.sum("points").over(Window.partitionBy("query_id", "distance"))
    kept = met.withColumn("nearer", up_to - equal).filter(F.col("nearer") < k).select(F.col("query_id").alias("class"), F.col("key").alias("p_class"), "distance")
    keys = p.join(ps.select("vec", F.col("class").alias("p_class")), "vec").select("p_class", "key")
    ranked = kept.join(keys, "p_class").withColumn("rank", F.row_number().over(Window.partitionBy("class").orderBy(order, "key")))
    answers = written(ranked.select("class", "rank", "key", "distance"), "answers")
    # the answers of a class go to each query of it, in slices of bounded size
    sizes = answers.groupBy("class").agg(F.count("*").alias("rows")).join(qs.select("class", "n"), "class")
    rows = sizes.agg(F.sum(F.col("rows").cast("double") * F.col("n"))).first()[0] or 0.0
    slices = sizes.select("class", F.least(F.col("rows"), F.ceil(F.col("rows").cast("double") * F.col("n") / SLICE_ROWS)).cast("long").alias("slices"))
    parts = int(min(max(q.sparkSession.sparkContext.defaultParallelism, rows // SLICE_ROWS), 50_000))
    answers = answers.join(slices, "class").withColumn("slice", F.pmod(F.col("rank").cast("long"), F.col("slices"))).drop("slices")
    own = q.join(qs.select("vec", "class"), "vec").select("query_id", "class").join(slices, "class")
    own = own.select("query_id", "class", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"))
    out = answers.repartition(parts, "class", "slice").join(own.repartition(parts, "class", "slice").hint("shuffle_hash"), ["class", "slice"])
    return out.select("query_id", "rank", "key", "distance")


def top_outliers(scored: DataFrame, order: str, n: int = 10, score: str = "score") -> DataFrame:
    """The n rows of highest score; equal scores by order."""
    return scored.orderBy(F.col(score).desc(), order).limit(n)
