"""Random projections: sparse Gaussian, and hashed for named features.

Weights are drawn on the driver and stand in the plan as literals, so results depend on
the seed alone.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brooklet.functions.vec import weighted


def sparse_weights(n_projections: int, dimension: int, seed: int = 0) -> np.ndarray:
    """(n_projections, dimension): round(sqrt(dimension)) standard normal entries a row."""
    rng = np.random.default_rng(seed)
    out = np.zeros((n_projections, dimension))
    for row in out:
        chosen = rng.choice(dimension, max(1, round(dimension**0.5)), replace=False)
        row[chosen] = rng.standard_normal(len(chosen))
    return out


def hashed_weights(n_projections: int, features: list[str]) -> np.ndarray:
    """(n_projections, features): -1, 0 or 1 times sqrt(3 / n), by a checksum of the whole name.

    A third of the entries is not zero, half of them negative.
    """
    scale = (3.0 / n_projections) ** 0.5
    out = np.zeros((n_projections, len(features)))
    for j, name in enumerate(features):
        for i in range(n_projections):
            h = zlib.crc32(f"{i}:{name}".encode()) / 2**32
            out[i, j] = -scale if h < 1 / 6 else scale if h >= 5 / 6 else 0.0
    return out


def project(columns: list[Column], weights: np.ndarray) -> list[Column]:
    return [weighted(columns, row.tolist()) for row in weights]


def sparse_projection(df: DataFrame, features: list[str], n_projections: int, seed: int = 0, prefix: str = "p") -> DataFrame:
    """df with columns p0.. of the sparse Gaussian projection of its features."""
    outs = project([F.col(f).cast("double") for f in features], sparse_weights(n_projections, len(features), seed))
    return df.select("*", *(c.alias(f"{prefix}{i}") for i, c in enumerate(outs)))


def stream_hash(df: DataFrame, features: list[str], n_projections: int, prefix: str = "p") -> DataFrame:
    """df with the hashed projection of named feature columns."""
    outs = project([F.col(f).cast("double") for f in features], hashed_weights(n_projections, features))
    return df.select("*", *(c.alias(f"{prefix}{i}") for i, c in enumerate(outs)))


#: Names whose weights a worker keeps.
MOST_NAMES = 100_000


def hashed_entries(maps: pa.MapArray, n_projections: int, known: dict[str, np.ndarray]) -> pa.ListArray:
    """The hashed projection of each map as a list; null for a null map, nulls where a value is null.

    known: weights by name, which is filled as names are met."""
    offsets = maps.offsets.to_numpy()
    begin, lengths = int(offsets[0]), np.diff(offsets)
    names = maps.keys.slice(begin, int(offsets[-1]) - begin).dictionary_encode()
    items = maps.items.slice(begin, int(offsets[-1]) - begin)
    if len(known) > MOST_NAMES:
        known.clear()
    distinct = names.dictionary.to_pylist()
    for name in distinct:
        if name not in known:
            known[name] = hashed_weights(n_projections, [name])[:, 0]
    weights = np.array([known[name] for name in distinct]).reshape(len(distinct), n_projections)
    codes, values = names.indices.to_numpy(), items.to_numpy(zero_copy_only=False)
    out = np.zeros((len(maps), n_projections))
    with np.errstate(all="ignore"):
        for j in range(int(lengths.max(initial=0))):  # entry after entry, so that sums are those of the columns
            at = np.flatnonzero(lengths > j) if (lengths <= j).any() else slice(None)
            entry = offsets[:-1][at] - begin + j
            out[at] += values[entry, None] * weights[codes[entry]]
    missing = np.zeros(out.shape, bool)
    if items.null_count:
        gone = np.flatnonzero(items.is_null().to_numpy(zero_copy_only=False))
        missing[np.searchsorted(offsets - begin, gone, side="right") - 1] = True
    flat = pa.array(out.ravel(), mask=missing.ravel() if items.null_count else None)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, n_projections, dtype=np.int32)), flat, mask=maps.is_null() if maps.null_count else None)


def stream_hash_map(df: DataFrame, column: str, n_projections: int, prefix: str = "p") -> DataFrame:
    """The hashed projection of a map<string, double> whose names may change from row to
    row. The weights of a name are worked out once a worker, and maps are projected by arrays."""
    known: dict[str, np.ndarray] = {}

    @F.arrow_udf("array<double>")
    def hashed(maps: pa.Array) -> pa.Array:
        return hashed_entries(maps, n_projections, known)

    out = df.withColumn("__hashed", hashed(F.col(column).cast("map<string,double>")))
    return out.select(*(F.col(f"`{c}`") for c in df.columns), *(F.get("__hashed", i).alias(f"{prefix}{i}") for i in range(n_projections)))
