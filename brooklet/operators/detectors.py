"""Outlier detectors that DataFrame operators can express.

Scores follow a sliding window (SWDBOR, SWKNN, RSHash) or the tumbling block before
(HSTrees, xStream). All take a `Stream` and append `score`. Draws are made on the driver
by seed and stand in the plan as literals or as a table of fixed size.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, fields, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brooklet.functions.vec import INF, NAN, metric_of, numpy_metric
from brooklet.operators.projection import hashed_weights, project, stream_hash, stream_hash_map
from brooklet.plans.blocks import overlap, rows_of
from brooklet.sources.stream import Stream, ingest


class Detector:
    """Parameters as a frozen dataclass: get_params, set_params (a new detector)."""

    def get_params(self) -> dict:
        return asdict(self)

    def set_params(self, **params) -> "Detector":
        unknown = set(params) - {f.name for f in fields(self)}
        if unknown:
            raise ValueError(f"unknown parameters {sorted(unknown)}")
        return replace(self, **params)

    def transform(self, s: Stream) -> DataFrame:
        raise NotImplementedError

    def fit_predict(self, s: Stream) -> DataFrame:
        return self.transform(s)

    def fit(self, s: Stream, sink: str = "noop") -> None:
        """Run over the stream for its effects on state alone; scores go nowhere."""
        self.transform(s).write.format(sink).mode("overwrite").save()

    def window_rows(self, s: Stream, at: int | None = None) -> DataFrame:
        """The live rows after row `at` (the last by default), with expire_time."""
        df = ingest(s)
        last = df.groupBy(*s.key).agg(F.max("idx").alias("__last")) if at is None else df.groupBy(*s.key).agg(F.lit(at).cast("long").alias("__last"))
        if s.key:
            joined = df.join(last, s.key)
        else:
            joined = df.crossJoin(last)  # one row
        if s.time is None:
            live = joined.filter((F.col("idx") <= F.col("__last")) & (F.col("idx") > F.col("__last") - rows_of(self.window)))
        else:
            now = df.join(last, [*s.key] if s.key else F.lit(True)).filter("idx = __last").select(*s.key, F.col("t").alias("__now"))
            joined = joined.join(now, s.key) if s.key else joined.crossJoin(now)
            live = joined.filter((F.col("idx") <= F.col("__last")) & (F.col("t") + F.lit(self.window) > F.col("__now"))).drop("__now")
        return live.withColumn("expire_time", F.col("t") + F.lit(self.window)).drop("__last")

    def window_size(self, s: Stream) -> int:
        return self.window_rows(s).count()


def _positive(**values) -> None:
    for name, v in values.items():
        if not v > 0:
            raise ValueError(f"{name} must be positive")


def _features(s: Stream) -> list[str]:
    return [f"x{i}" for i in range(s.n_features)]


def window_pairs(s: Stream, window) -> DataFrame:
    """Each row a with each live earlier row b of its stream (nulls where there is none):
    an equi-join on overlap blocks of about one window."""
    df, x = ingest(s), _features(s)
    if s.time is None:
        n = rows_of(window)
        later, size = overlap(df, F.col("idx"), n, max(n, 64)), max(n, 64)
        own = F.floor(F.col("a_idx") / size)
        alive = (F.col("b_idx") < F.col("a_idx")) & (F.col("b_idx") > F.col("a_idx") - n)
    else:
        later = overlap(df, F.col("t"), window, window)
        own = F.floor(F.col("a_t") / F.lit(window))
        alive = (F.col("b_idx") < F.col("a_idx")) & (F.col("b_t") + F.lit(window) > F.col("a_t"))
    a = df.select(F.col(s.order), *s.key, *(F.col(c).alias(f"a_{c}") for c in ("idx", "t", *x)))
    a = a.withColumn("blk", own.cast("long"))
    b = later.select("blk", *(F.col(k).alias(f"b_key{i}") for i, k in enumerate(s.key)), *(F.col(c).alias(f"b_{c}") for c in ("idx", "t", *x))).withColumnRenamed("blk", "b_blk")
    on = (F.col("blk") == F.col("b_blk")) & alive
    for i, k in enumerate(s.key):
        on &= F.col(k).eqNullSafe(F.col(f"b_key{i}"))
    return a.hint("shuffle_hash").join(b.hint("shuffle_hash"), on, "left")


def _distance(s: Stream, metric, metric_params) -> Column:
    x = _features(s)
    return metric_of(metric, metric_params)([F.col(f"a_{c}") for c in x], [F.col(f"b_{c}") for c in x])


@dataclass(frozen=True)
class SWDBOR(Detector):
    """1 / (1 + m), m the live earlier rows within the radius (inclusive).

    A time axis must not fall within a key: late rows raise here and go through
    `kernels.ArrivalOrder`. A metric that is a callable builds Columns, and takes the plan
    over pairs of rows in place of the kernel.
    """

    window: float
    radius: float
    metric: object = "euclidean"
    metric_params: dict | None = None

    def __post_init__(self):
        _positive(window=self.window, radius=self.radius)

    def kernel(self, group=(), features=None):
        from brooklet.operators.kernels import LINE, NeighborKernel

        return NeighborKernel(self.window, numpy_metric(self.metric, self.metric_params), radius=self.radius, line=self.metric in LINE)

    def transform(self, s: Stream) -> DataFrame:
        if not callable(self.metric):
            from brooklet.operators.kernels import framed_run

            # windows of one feature may hold any number of rows, so blocks are short and runs long
            long = {"factor": 2, "gather": 262_144} if s.time is not None and s.n_features == 1 else {}
            return framed_run(s, self.window, self.kernel, "score double", rising=True, **long)
        pairs = window_pairs(s, self.window)
        near = F.count(F.when(_distance(s, self.metric, self.metric_params) <= self.radius, F.lit(1)))
        return pairs.groupBy("blk", *s.key, s.order).agg(near.alias("m")).select(s.order, *s.key, (F.lit(1.0) / (F.col("m") + 1)).alias("score"))

    def neighbors(self, s: Stream) -> DataFrame:
        """The live rows at the end with their current number of neighbours in the window."""
        x = _features(s)
        live = self.window_rows(s)
        a = live.select(F.col(s.order), *s.key, "expire_time", *(F.col(c).alias(f"a_{c}") for c in ("idx", *x)))
        b = live.select(*(F.col(k).alias(f"b_key{i}") for i, k in enumerate(s.key)), *(F.col(c).alias(f"b_{c}") for c in ("idx", *x)))
        on = (F.col("a_idx") != F.col("b_idx")) & (_distance(s, self.metric, self.metric_params) <= self.radius)
        for i, k in enumerate(s.key):
            on &= F.col(k).eqNullSafe(F.col(f"b_key{i}"))
        # both sides are one window
        return a.join(b, on, "left").groupBy(s.order, *s.key, "expire_time").agg(F.count("b_idx").alias("neighbors"))


@dataclass(frozen=True)
class SWKNN(Detector):
    """Distance to the k-th nearest live earlier row, infinite when there are fewer; with
    k_is_max the array of all k distances."""

    window: float
    k: int
    k_is_max: bool = False
    metric: object = "euclidean"
    metric_params: dict | None = None

    def __post_init__(self):
        _positive(window=self.window, k=self.k)

    def kernel(self, group=(), features=None):
        from brooklet.operators.kernels import NeighborKernel

        return NeighborKernel(self.window, numpy_metric(self.metric, self.metric_params), k=self.k, k_is_max=self.k_is_max)

    def transform(self, s: Stream) -> DataFrame:
        if not callable(self.metric):
            from brooklet.operators.kernels import framed_run

            return framed_run(s, self.window, self.kernel, "score array<double>" if self.k_is_max else "score double", rising=True)
        pairs = window_pairs(s, self.window)
        d = F.when(F.col("b_idx").isNotNull(), _distance(s, self.metric, self.metric_params))
        near = F.sort_array(F.collect_list(d))  # collect_list skips nulls; at most a window of values
        ranked = pairs.groupBy("blk", *s.key, s.order).agg(near.alias("d"))
        kth = F.coalesce(F.get("d", self.k - 1), F.lit(INF))
        if self.k_is_max:
            kth = F.slice(F.concat("d", F.array_repeat(F.lit(INF), self.k)), 1, self.k)
        return ranked.select(s.order, *s.key, kth.alias("score"))


@dataclass(frozen=True)
class RSHash(Detector):
    """Mean of -log2(1 + live earlier rows in the row's cell) over randomised grids.

    Features are expected in [0, 1]. cms_d = None counts cells exactly; else cms_w hash
    functions of cms_d bins each, of which the least count holds.
    """

    n_estimators: int
    window: float
    cms_w: int = 1
    cms_d: int | None = None
    s_param: float | None = None
    seed: int = 0

    def __post_init__(self):
        _positive(n_estimators=self.n_estimators, window=self.window, cms_w=self.cms_w)
        if (self.s_param or self.window) < 4:
            raise ValueError("the sample size parameter must be 4 at least")

    def draw(self, dimension: int) -> list[dict]:
        """f, and the chosen dimensions with their shifts alpha, of each estimator."""
        rng, s, out = np.random.default_rng(self.seed), float(self.s_param or self.window), []
        hashes = np.random.default_rng([self.seed, 1])  # of its own, so that grids do not depend on the sketch
        for _ in range(self.n_estimators):
            f = rng.uniform(1 / math.sqrt(s), 1 - 1 / math.sqrt(s))
            most = math.log(s) / math.log(max(2.0, 1 / f))
            low, high = round(1 + most / 2), round(most)
            r = min(dimension, max(1, int(rng.integers(low, max(low, high) + 1))))
            dims = sorted(rng.choice(dimension, r, replace=False).tolist())
            out.append({"f": float(f), "dims": dims, "alpha": rng.uniform(0, f, r).tolist(), "a": hashes.integers(1, 1_000_003, (self.cms_w, r)).tolist(), "b": hashes.integers(0, 1_000_003, self.cms_w).tolist()})
        return out

    def kernel(self, group=(), features=None):
        from brooklet.operators.kernels import HashKernel

        return HashKernel(self, len(features))

    def transform(self, s: Stream) -> DataFrame:
        from brooklet.operators.cells import CellKernel
        from brooklet.operators.kernels import framed_run, sequential

        if s.time is not None and not s.rising:
            return sequential(s, self)
        s_features = s.n_features
        return framed_run(s, self.window, lambda group: CellKernel(self, s_features), "score double", gather=65_536 if s.time is not None and s_features <= 64 else 0)


@dataclass(frozen=True)
class HSTrees(Detector):
    """Half-space trees: -mass * 2^depth of the row's node in the tumbling block before,
    at the first node of its path that is deep or light enough; NaN in the first block."""

    window: float
    n_estimators: int
    max_depth: int
    size_limit: float | None = None
    seed: int = 0

    def __post_init__(self):
        _positive(window=self.window, n_estimators=self.n_estimators, max_depth=self.max_depth)
        if self.size_limit is not None and self.size_limit < 0:
            raise ValueError("size_limit must not be negative")

    @property
    def limit(self) -> float:
        return self.window // 10 if self.size_limit is None else self.size_limit

    def draw(self, dimension: int) -> list[tuple[list[int], list[float]]]:
        """Dimension and split of each inner node of each complete tree, in heap order."""
        rng, out = np.random.default_rng(self.seed), []
        for _ in range(self.n_estimators):
            s = rng.uniform(0, 1, dimension)
            reach = 2 * np.maximum(s, 1 - s)
            ranges = {0: (s - reach, s + reach)}
            dims, splits = [], []
            for node in range(2**self.max_depth - 1):
                low, high = ranges.pop(node)
                q = int(rng.integers(dimension))
                p = float(rng.uniform(low[q], high[q]))
                dims.append(q)
                splits.append(p)
                for child, (a, b) in ((2 * node + 1, (low.copy(), high.copy())), (2 * node + 2, (low.copy(), high.copy()))):
                    (b if child % 2 else a)[q] = p
                    ranges[child] = (a, b)
            out.append((dims, splits))
        return out

    def kernel(self, group=(), features=None):
        from brooklet.operators.kernels import HalfSpaceKernel

        return HalfSpaceKernel(self, len(features))

    def transform(self, s: Stream, trees: list | None = None) -> DataFrame:
        if s.time is not None:
            from brooklet.operators.kernels import sequential

            return sequential(s, self)
        spark, depth = s.df.sparkSession, self.max_depth
        trees = trees or self.draw(s.n_features)
        schema = T.StructType([T.StructField("tree", T.IntegerType()), T.StructField("dims", T.ArrayType(T.IntegerType())), T.StructField("splits", T.ArrayType(T.DoubleType()))])
        table = spark.createDataFrame([(i, [int(q) for q in d], [float(x) for x in p]) for i, (d, p) in enumerate(trees)], schema)
        df = ingest(s).withColumn("vec", F.array(*_features(s))).withColumn("blk", F.floor(F.col("idx") / rows_of(self.window)).cast("long"))
        # the table has n_estimators rows of 2^max_depth numbers, whatever the input
        leaf: Column = F.lit(0)
        rows = df.select(s.order, *s.key, "blk", "vec").crossJoin(F.broadcast(table)).withColumn("node", leaf)
        for _ in range(depth):
            right = (F.get("vec", F.get("dims", F.col("node"))) >= F.get("splits", F.col("node"))).cast("int")
            rows = rows.withColumn("node", F.col("node") * 2 + 1 + right)
        rows = rows.select(s.order, *s.key, "blk", "tree", F.col("node").alias("leaf"))
        # mass of leaves first, then of their ancestors: few rows
        leaves = rows.groupBy("blk", *s.key, "tree", "leaf").agg(F.count("*").alias("n"))
        # in heap order from 1, the ancestor j levels up is the number shifted right by j
        up = F.explode(F.sequence(F.lit(0), F.lit(depth)))
        masses = leaves.withColumn("j", up).withColumn("at", F.expr("shiftright(leaf + 1, j)")).groupBy("blk", *s.key, "tree", "at").agg(F.sum("n").alias("n"))
        maps = masses.groupBy("blk", *s.key, "tree").agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("mass"))
        before = maps.select((F.col("blk") + 1).alias("b_blk"), F.col("tree").alias("b_tree"), *(F.col(k).alias(f"b_key{i}") for i, k in enumerate(s.key)), "mass")
        on = (F.col("blk") == F.col("b_blk")) & (F.col("tree") == F.col("b_tree"))
        for i, k in enumerate(s.key):
            on &= F.col(k).eqNullSafe(F.col(f"b_key{i}"))
        joined = rows.join(before, on, "left")
        score: Column = F.lit(None).cast("double")
        for d in range(depth, -1, -1):
            r = F.coalesce(F.try_element_at("mass", F.expr(f"shiftright(leaf + 1, {depth - d})")), F.lit(0)).cast("double")
            value = -r * float(2**d)
            score = value if d == depth else F.when(r <= self.limit, value).otherwise(score)
        one = F.when(F.col("mass").isNull(), F.lit(NAN)).otherwise(score)
        return joined.select(s.order, *s.key, one.alias("one")).groupBy(s.order, *s.key).agg(F.avg("one").alias("score"))


@dataclass(frozen=True)
class XStream(Detector):
    """Half-space chains over a hashed projection: minus the sum over chains of the least
    count * 2^level of the row's cells in the block before; NaN in the first block.

    A block's rows are binned with the ranges of the block before (the first one with its
    own), and its counts keep those bins. A dimension without range has place 0.
    cms_d = None counts cells exactly.
    """

    window: int
    n_estimators: int
    n_projections: int
    depth: int
    cms_w: int = 1
    cms_d: int | None = None
    seed: int = 0

    def __post_init__(self):
        _positive(window=self.window, n_estimators=self.n_estimators, n_projections=self.n_projections, depth=self.depth)

    def draw(self) -> list[dict]:
        rng, k = np.random.default_rng(self.seed), self.n_projections
        return [{"dims": rng.integers(0, k, self.depth).tolist(), "offset": rng.uniform(0, 0.5, k).tolist()} for _ in range(self.n_estimators)]

    def hashes(self) -> list[tuple[list[int], int]]:
        """Multipliers and shift of each hash function of the sketch."""
        rng = np.random.default_rng([self.seed, 1])
        return [(rng.integers(1, 1_000_003, self.n_projections).tolist(), int(rng.integers(0, 1_000_003))) for _ in range(self.cms_w)]

    def kernel(self, group=(), features=None):
        from brooklet.operators.kernels import ChainKernel

        return ChainKernel(self, list(features))

    def projected(self, s: Stream) -> DataFrame:
        """The stream's rows, projected, with their place. One map<string, double> column in
        place of features may name other features in every row."""
        k = self.n_projections
        if len(s.features) == 1 and isinstance(s.df.schema[s.features[0]].dataType, T.MapType):
            named = stream_hash_map(s.df.select(s.order, *s.key, s.features[0]), s.features[0], k)
            df, outs = ingest(replace(s, df=named, features=[f"p{i}" for i in range(k)])), [F.col(f"x{i}") for i in range(k)]
        else:
            df, outs = ingest(s), project([F.col(c) for c in _features(s)], hashed_weights(k, s.features))
        return df.select(s.order, *s.key, "idx", *(c.alias(f"p{i}") for i, c in enumerate(outs)))

    def transform(self, s: Stream, initial_sample: DataFrame | None = None) -> DataFrame:
        """initial_sample: feature rows whose ranges serve the first block instead of its own."""
        from brooklet.operators.cells import chains

        k, first = self.n_projections, None
        if initial_sample is not None:
            mapped = len(s.features) == 1 and isinstance(initial_sample.schema[s.features[0]].dataType, T.MapType)
            sample = stream_hash_map(initial_sample, s.features[0], k) if mapped else stream_hash(initial_sample, s.features, k)
            ends = sample.agg(*(f(f"p{i}") for f in (F.min, F.max) for i in range(k))).first()
            first = np.array(ends[:k], np.float64), np.array(ends[k:], np.float64)
        return chains(self.projected(s), self, s.order, list(s.key), first)
