"""The same kernels online: Structured Streaming with explicit state per stream key.

State is one value per key, the kernel itself (what is live in it). Rows of a micro-batch are put in order
before the kernel sees them; rows that arrive in a later batch are late and count from
their arrival on, as in batch. A query needs the RocksDB state store provider.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from brooklet.functions.vec import NAN

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def outputs_of(detector, features: list[str]) -> list[tuple[str, str]]:
    """Names and types of what a detector's kernel gives for a row: its own `outputs`, or a score."""
    if hasattr(detector, "outputs"):
        return detector.outputs(features)
    return [("score", "array<double>" if getattr(detector, "k_is_max", False) else "double")]


class KernelProcessor(StatefulProcessor):
    def __init__(self, make: Callable, key: list[str], order: str, features: list[str], time: str | None, outs: list[tuple[str, str]]):
        self.make, self.key, self.order, self.features, self.time, self.outs = make, key, order, features, time, outs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("kernel", "blob binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        held = self.state.get() if self.state.exists() else None
        kernel, clock = cloudpickle.loads(bytes(held[0])) if held else (self.make(key), 0)
        data = pdf[self.features].to_numpy(np.float64)
        if np.isnan(data).any():
            raise ValueError("a feature is null or NaN")
        times = pdf[self.time].to_numpy(np.float64) if self.time else np.arange(clock + 1, clock + len(pdf) + 1)
        scores = kernel.many(data, times)
        self.state.update((cloudpickle.dumps((kernel, clock + len(pdf))),))
        out = {k: [v] * len(pdf) for k, v in zip(self.key, key)} | {self.order: pdf[self.order].tolist()}
        if len(self.outs) == 1 and self.outs[0][1].startswith("array"):
            out[self.outs[0][0]] = scores
        else:
            rows_ = [s if isinstance(s, (list, tuple)) else (s,) for s in scores]
            for i, (name, kind) in enumerate(self.outs):
                out[name] = [r[i] if kind == "double" else int(r[i]) for r in rows_]
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def online(df: DataFrame, detector, features: list[str], order: str, key: list[str] | None = None, time: str | None = None) -> DataFrame:
    """A streaming DataFrame of key, order and what the detector gives (`outputs_of`): a score, or
    the named columns of sliding statistics and scalers. detector: anything with kernel(group).

    Without a key the stream is one group, which is serial by nature.
    """
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    names = key or ["stream"]
    if not key:
        df = df.withColumn("stream", F.lit(0))
    outs = [(f"{n}_scaled" if n in (*names, order) else n, kind) for n, kind in outputs_of(detector, features)]
    known = {"double": T.DoubleType(), "array<double>": T.ArrayType(T.DoubleType()), "int": T.IntegerType(), "bigint": T.LongType()}
    fields = [df.schema[k] for k in names] + [df.schema[order]] + [T.StructField(n, known[kind]) for n, kind in outs]
    processor = KernelProcessor(lambda group: detector.kernel(group, features), names, order, features, time, outs)
    picked = df.select(*dict.fromkeys([*names, order, *features, *([time] if time else [])]))
    scored = picked.groupBy(*names).transformWithStateInPandas(processor, T.StructType(fields), "append", "None")
    # pandas hands NaN over as null; a score is never null
    sure = {"double": lambda c: F.coalesce(c, F.lit(NAN)), "array<double>": lambda c: F.transform(c, lambda v: F.coalesce(v, F.lit(NAN)))}
    return scored.select(*names, order, *(sure[kind](F.col(f"`{n}`")).alias(n) if kind in sure else F.col(f"`{n}`") for n, kind in outs))


def online_stats(df: DataFrame, time: str, window: str, features: list[str], watermark: str | None = None) -> DataFrame:
    """Tumbling statistics of a stream in event time; a watermark drops late rows."""
    df = df.withColumn(time, F.col(time).cast("timestamp"))
    df = df.withWatermark(time, watermark) if watermark else df
    outs = [f(c).alias(f"{c}_{n}") for c in features for n, f in (("sum", F.sum), ("average", F.avg), ("min", F.min), ("max", F.max))]
    return df.groupBy(F.window(time, window)).agg(F.count("*").alias("count"), *outs)
