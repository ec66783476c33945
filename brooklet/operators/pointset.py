"""A keyed point set: what an index offers by key, by ordinal and by distance.

A PointSet is a value: a DataFrame of (key, vec), unique by key, with the counter for new
keys. Changes give a new PointSet. The ordinal of a key is its rank by key, from 0.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brooklet.operators import simjoin
from brooklet.sources.stream import numbered, save

SCHEMA = T.StructType([T.StructField("key", T.LongType()), T.StructField("vec", T.ArrayType(T.DoubleType()))])


@dataclass(frozen=True)
class PointSet:
    points: DataFrame
    counter: int = 0
    metric: str = "euclidean"
    metric_params: dict | None = None

    @staticmethod
    def empty(spark: SparkSession, **options) -> "PointSet":
        return PointSet(spark.createDataFrame([], SCHEMA), **options)

    @staticmethod
    def of(df: DataFrame, key: str, vec: str, **options) -> "PointSet":
        return PointSet(df.select(F.col(key).cast("long").alias("key"), F.col(vec).cast("array<double>").alias("vec")), **options)

    @staticmethod
    def load(spark: SparkSession, path: str, **options) -> "PointSet":
        return PointSet(spark.read.schema(SCHEMA).parquet(path), **options)

    def save(self, path: str) -> None:
        save(self.points, path)

    # --- changes ---------------------------------------------------------------

    def insert(self, rows: DataFrame, order: str, vec: str = "vec") -> tuple["PointSet", DataFrame]:
        """Add rows under the smallest keys from the counter on that are not in use, in
        order. Returns the new set and (row, key), row being the row's order."""
        new = numbered(rows.select(F.col(order).alias("row"), F.col(vec).cast("array<double>").alias("vec")), "row", [])
        n = new.count()
        taken = self.points.filter(F.col("key") >= self.counter).select("key")
        spare = rows.sparkSession.range(self.counter, self.counter + n + taken.count()).withColumnRenamed("id", "key").join(taken, "key", "left_anti")
        keys = numbered(spare, "key", []).filter(F.col("idx") < n)
        placed = new.join(keys, "idx").select("row", "key", "vec")
        last = keys.agg(F.max("key")).first()[0]
        after = replace(self, points=self.points.unionByName(placed.select("key", "vec")), counter=self.counter if last is None else last + 1)
        return after, placed.select("row", "key")

    def upsert(self, rows: DataFrame) -> "PointSet":
        """Set points by key, new or not. Of rows with one key the greatest counts."""
        rows = rows.select(F.col("key").cast("long").alias("key"), F.col("vec").cast("array<double>").alias("vec")).groupBy("key").agg(F.max("vec").alias("vec"))
        return replace(self, points=self.points.join(rows.select("key"), "key", "left_anti").unionByName(rows))

    def update_by_index(self, rows: DataFrame) -> "PointSet":
        """Set points by ordinal (ix, vec; negative ones count from the end); an ordinal that does
        not exist raises."""
        ix = F.col("ix").cast("long")
        keyed = rows.withColumn("ix", F.when(ix < 0, ix + self.count()).otherwise(ix)).join(self.itok(), "ix", "left")
        known = F.when(F.col("key").isNull(), F.raise_error(F.lit("no such ordinal")).cast("long")).otherwise(F.col("key"))
        return self.upsert(keyed.select(known.alias("key"), "vec"))

    def delete(self, keys: DataFrame) -> "PointSet":
        """Remove keys; one that does not exist raises (when the result is read)."""
        self_keys = self.points.select(F.col("key").alias("own"))
        found = keys.select("key").distinct().join(self_keys, F.col("key") == F.col("own"), "left")
        sure = found.select(F.when(F.col("own").isNull(), F.raise_error(F.lit("no such key")).cast("long")).otherwise(F.col("key")).alias("key"))
        return replace(self, points=self.points.join(sure, "key", "left_anti"))

    def remove(self, keys: DataFrame) -> tuple["PointSet", DataFrame]:
        """Remove keys that exist. Returns the new set and (key, found)."""
        return replace(self, points=self.points.join(keys.select("key"), "key", "left_anti")), self.contains(keys)

    def delete_by_index(self, start=None, stop=None, step=None) -> "PointSet":
        """Remove a slice of the ordinals, or a list of them; negative ones count from the end."""
        return replace(self, points=self.points.join(self.by_index(start, stop, step).select("key").distinct(), "key", "left_anti"))

    def clear(self) -> "PointSet":
        return replace(self, points=self.points.limit(0))

    # --- lookups ---------------------------------------------------------------

    def count(self) -> int:
        return self.points.count()

    __len__ = count

    def dimension(self) -> int | None:
        row = self.points.select(F.size("vec")).first()
        return row[0] if row else None

    def contains(self, keys: DataFrame) -> DataFrame:
        own = self.points.select(F.col("key").alias("own"))
        return keys.select("key").distinct().join(own, F.col("key") == F.col("own"), "left").select("key", F.col("own").isNotNull().alias("found"))

    def get_points(self, keys: DataFrame, dimension: int | None = None) -> DataFrame:
        """key, vec, found; vec is all 0 where the key does not exist."""
        own = self.points.select(F.col("key").alias("own"), "vec")
        zeros = F.array_repeat(F.lit(0.0), dimension or self.dimension() or 0)
        return keys.select("key").join(own, F.col("key") == F.col("own"), "left").select("key", F.coalesce("vec", zeros).alias("vec"), F.col("own").isNotNull().alias("found"))

    def get(self, keys: DataFrame) -> DataFrame:
        """key, vec; a key that does not exist raises."""
        found = self.get_points(keys)
        return found.select(F.when(F.col("found"), F.col("key")).otherwise(F.raise_error(F.lit("no such key")).cast("long")).alias("key"), "vec")

    def itok(self) -> DataFrame:
        """ix, key: the ordinal of every key."""
        return numbered(self.points.select("key"), "key", []).select(F.col("idx").alias("ix"), "key")

    def ktoi(self, keys: DataFrame) -> DataFrame:
        """key, ix; a key that does not exist has a null ordinal."""
        own = self.itok().select(F.col("key").alias("own"), "ix")
        return keys.select("key").join(own, F.col("key") == F.col("own"), "left").select("key", "ix")

    def ordinals(self, picks) -> DataFrame:
        """place, ix of a list of ordinals (or a DataFrame of ix); negative ones count from the
        end, one that does not exist raises. place is the position in the list, from 0."""
        n = self.count()
        if isinstance(picks, DataFrame):
            at = numbered(picks.select(F.col("ix").cast("long").alias("ix")).withColumn("__at", F.monotonically_increasing_id()), "__at", []).select(F.col("idx").alias("place"), "ix")
        else:
            at = self.points.sparkSession.createDataFrame(list(enumerate(map(int, picks))), "place long, ix long")
        own = F.when(F.col("ix") < 0, F.col("ix") + n).otherwise(F.col("ix"))
        sure = F.when(own.between(0, n - 1), own).otherwise(F.raise_error(F.lit("no such ordinal")).cast("long"))
        return at.select("place", sure.alias("ix"))

    def by_index(self, start=None, stop=None, step=None) -> DataFrame:
        """ix, key, vec of a Python slice of the ordinals (negative ends count from the end). With
        a list or a DataFrame of ordinals (ix) in place of start: place, ix, key, vec of each."""
        if isinstance(start, (list, tuple, DataFrame)):
            return self.ordinals(start).join(self.itok(), "ix").join(self.points, "key").select("place", "ix", "key", "vec")
        low, high, stride = slice(start, stop, step).indices(self.count())
        if stride < 0:
            low, high, stride = low + (len(range(low, high, stride)) - 1) * stride, low + 1, -stride
        picked = self.itok().filter((F.col("ix") >= low) & (F.col("ix") < high) & ((F.col("ix") - low) % stride == 0))
        return picked.join(self.points, "key").select("ix", "key", "vec")

    # --- by distance -------------------------------------------------------------

    def neighbors(self, queries: DataFrame, radius: float, **options) -> DataFrame:
        return simjoin.range_join(queries, self.points, radius, self.metric, self.metric_params, **options)

    def knn(self, queries: DataFrame, k: int = 1, **options) -> DataFrame:
        return simjoin.knn_join(queries, self.points, k, metric=self.metric, metric_params=self.metric_params, **options)

    @staticmethod
    def ragged(found: DataFrame, order: str = "distance") -> DataFrame:
        """query_id, keys, distances, length: the long result as one row a query."""
        items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("by"), "key", "distance")))
        return found.groupBy("query_id").agg(items.alias("items")).select("query_id", F.col("items.key").alias("keys"), F.col("items.distance").alias("distances"), F.size("items").alias("length"))
