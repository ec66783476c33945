"""Ingestion of ordered streams.

A `Stream` names a DataFrame's order column, its features (double columns or one array
column), an optional time column and an optional stream key. `ingest` brings it to one
form: `idx` (dense from 0 within a key), `x0..xn` doubles, `t` (time, or idx + 1), and
the key columns. Null or NaN features raise; infinities pass.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brooklet.plans.lineage import written


@dataclass(frozen=True)
class Stream:
    df: DataFrame
    features: list[str]
    order: str
    time: str | None = None
    key: list[str] = field(default_factory=list)
    #: Whether `order` already counts 0, 1, 2, ... within each key; one that does not raises.
    dense: bool = False
    #: Whether time never falls within a key, so that a key can be cut on its time axis; one that falls raises.
    rising: bool = False
    #: "double" or "float": features are rounded to that type on the way in.
    float_type: str = "double"
    #: Length of the array, where the one feature is an array column.
    dimension: int | None = None

    def __post_init__(self):
        if self.float_type not in ("double", "float"):
            raise ValueError("float_type is double or float")

    @property
    def n_features(self) -> int:
        return self.dimension or len(self.features)


def guarded(c: Column, name: str, float_type: str = "double") -> Column:
    """The value as a double; null and NaN raise."""
    value = c.cast(float_type).cast("double")
    return F.when(value.isNull() | F.isnan(value), F.raise_error(F.lit(f"feature {name} is null or NaN")).cast("double")).otherwise(value)


def numeric_time(df: DataFrame, time: str) -> Column:
    """Timestamps as microseconds, so that windows are exact; numbers as doubles."""
    kind = df.schema[time].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(time).cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_micros(F.col(time).cast("timestamp"))
    return F.col(time).cast("double") if not isinstance(kind, T.IntegralType) else F.col(time).cast("long")


def numbered(df: DataFrame, order: str, key: list[str]) -> DataFrame:
    """df with `idx`, dense from 0 by order within each key, without one task per key:
    rows are dealt by range, numbered inside their range and shifted by the counts of the
    ranges before. Ties of the order are told apart by a row number."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.withColumn("__row", F.monotonically_increasing_id())
    dealt = written(rows.repartitionByRange(parts, *key, order, "__row").withColumn("__part", F.spark_partition_id()), "dealt")
    inside = F.row_number().over(Window.partitionBy("__part", *key).orderBy(order, "__row"))
    sizes = dealt.groupBy("__part", *key).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*key, F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select(F.col("__part").alias("__p"), *(F.col(k).alias(f"__k{i}") for i, k in enumerate(key)), before.alias("__before"))
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(key):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = dealt.withColumn("__i", inside).join(shifts, same)
    return joined.withColumn("idx", (F.col("__i") + F.col("__before") - 1).cast("long")).drop("__row", "__part", "__i", "__before", "__p", *(f"__k{i}" for i in range(len(key))))


def check_dense(s: Stream) -> None:
    """Whether the order counts 0, 1, 2, ... within each key: one aggregate of two columns,
    once for each stream."""
    if not s.dense or getattr(s, "_checked", False):
        return
    n = F.col(s.order)
    each = s.df.groupBy(*s.key).agg(F.count("*").alias("rows"), F.count(n).alias("n"), F.min(n).alias("low"), F.max(n).alias("high"), F.sum(n.cast("decimal(38,0)")).alias("total"))
    # with these ends and this sum, a place that is missing and one that is doubled can only hide each other if they balance
    whole = (F.col("n") == F.col("rows")) & (F.col("low") == 0) & (F.col("high") == F.col("rows") - 1) & (F.col("total") * 2 == F.col("rows").cast("decimal(38,0)") * F.col("high"))
    if each.filter((F.col("rows") > 0) & ~F.coalesce(whole, F.lit(False))).limit(1).count():
        raise ValueError(f"{s.order} does not count 0, 1, 2, ... within each key: leave out dense")
    object.__setattr__(s, "_checked", True)


def ingest(s: Stream) -> DataFrame:
    """order, key columns, idx, t, x0.. of the stream."""
    check_dense(s)
    if s.dimension:
        raw = [(F.get(F.col(s.features[0]), i), f"{s.features[0]}[{i}]") for i in range(s.dimension)]
    else:
        raw = [(F.col(f), f) for f in s.features]
    t = numeric_time(s.df, s.time) if s.time else F.lit(None)
    df = s.df.select(F.col(s.order), *(F.col(k) for k in s.key), t.alias("t"), *(guarded(c, name, s.float_type).alias(f"x{i}") for i, (c, name) in enumerate(raw)))
    df = df.withColumn("idx", F.col(s.order).cast("long")) if s.dense else numbered(df, s.order, s.key)
    return df if s.time else df.withColumn("t", F.col("idx") + 1)


def read_stream_table(spark, path: str, **options) -> Stream:
    """A Parquet table as a stream."""
    return Stream(spark.read.parquet(path), **options)


def save(df: DataFrame, path: str) -> None:
    """A point set or scores as Parquet, the persistent form of both."""
    df.write.mode("overwrite").parquet(path)
