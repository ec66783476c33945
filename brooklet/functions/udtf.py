"""Detectors for SQL users, as Python table functions over a TABLE argument:

    SELECT * FROM sw_knn(TABLE(events) PARTITION BY user_id ORDER BY event_id)
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from brooklet.streaming.online import outputs_of


def register(spark: SparkSession, name: str, detector, features: list[str], order: str, order_type: str = "bigint", time: str | None = None) -> None:
    """Register `name` for a detector with a kernel; rows of a partition come in its order."""
    make = lambda: detector.kernel((), features)
    outs = outputs_of(detector, features)
    listed = len(outs) == 1 and outs[0][1].startswith("array")

    class Run:
        def __init__(self):
            self.kernel, self.seen = make(), 0

        def eval(self, row):
            import numpy as np

            self.seen += 1
            x = np.array([row[f] for f in features], np.float64)
            if np.isnan(x).any():
                raise ValueError("a feature is null or NaN")
            score = self.kernel.step(x, float(row[time]) if time else self.seen)
            if listed or not isinstance(score, (list, tuple)):
                yield row[order], score
            else:
                yield (row[order], *(int(v) if kind in ("int", "bigint") else v for v, (_, kind) in zip(score, outs)))

    spark.udtf.register(name, udtf(Run, returnType=", ".join([f"{order} {order_type}", *(f"`{n}` {kind}" for n, kind in outs)])))
