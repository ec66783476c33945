"""Vector columns: metrics as Column builders, IEEE division and logarithms, products.

A vector is a list of double columns (unrolled, stays inside code generation) or one
array<double> column (higher-order functions).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = "list[Column] | Column"
INF = float("inf")
NAN = float("nan")


def _terms(a, b, term: Callable[[Column, Column], Column]) -> Column | list[Column]:
    if isinstance(a, list):
        if len(a) != len(b):
            raise ValueError(f"vectors of {len(a)} and {len(b)} dimensions")
        return [term(x, y) for x, y in zip(a, b)]
    return F.zip_with(a, b, term)


def total(terms: Column | list[Column]) -> Column:
    if isinstance(terms, list):
        return reduce(lambda x, y: x + y, terms) if terms else F.lit(0.0)
    return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)


def euclidean(a, b) -> Column:
    return F.sqrt(total(_terms(a, b, lambda x, y: (x - y) * (x - y))))


def cityblock(a, b) -> Column:
    return total(_terms(a, b, lambda x, y: F.abs(x - y)))


def chebyshev(a, b) -> Column:
    terms = _terms(a, b, lambda x, y: F.abs(x - y))
    if isinstance(terms, list):
        return F.greatest(*terms) if len(terms) > 1 else terms[0]
    return F.array_max(terms)


def minkowski(p: int) -> Callable:
    if int(p) != p or p < 1:
        raise ValueError("minkowski needs a positive whole p")
    return lambda a, b: F.pow(total(_terms(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p))))), F.lit(1.0 / p))


def metric_of(metric="euclidean", metric_params: dict | None = None) -> Callable:
    """A metric by name, or a callable (vector, vector) -> Column as it is."""
    if callable(metric):
        return metric
    params = dict(metric_params or {})
    plain = {"euclidean": euclidean, "cityblock": cityblock, "manhattan": cityblock, "chebyshev": chebyshev}
    if metric in plain and not params:
        return plain[metric]
    if metric in ("minkowski", "minkowsi") and set(params) == {"p"}:
        return minkowski(params["p"])
    raise TypeError(f"unknown metric {metric!r} with parameters {sorted(params)}")


def numpy_metric(metric="euclidean", metric_params: dict | None = None) -> Callable:
    """The same metrics for kernels: (rows, one row) -> distances."""
    import numpy as np

    params = dict(metric_params or {})
    if metric == "euclidean":
        return lambda a, x: np.sqrt(((a - x) ** 2).sum(-1))
    if metric in ("cityblock", "manhattan"):
        return lambda a, x: np.abs(a - x).sum(-1)
    if metric == "chebyshev":
        return lambda a, x: np.abs(a - x).max(-1)
    if metric in ("minkowski", "minkowsi") and "p" in params:
        p = params["p"]
        return lambda a, x: (np.abs(a - x) ** p).sum(-1) ** (1.0 / p)
    raise TypeError(f"unknown metric {metric!r} with parameters {sorted(params)}")


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def ieee_div(a: Column, b: Column) -> Column:
    """a / b as IEEE 754 has it; ANSI mode would raise."""
    zero = F.when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF)).otherwise(F.lit(NAN))
    # NaN compares above everything here, so it must be told apart first
    return F.when(F.isnan(a) | F.isnan(b), F.lit(NAN)).when(b != 0, a / b).otherwise(zero)


def ieee_log(a: Column, base: float) -> Column:
    """Logarithm with log(0) = -inf and NaN below 0, where SQL has null."""
    logs = {2: F.log2, 10: F.log10}[base]
    return F.when(F.isnan(a) | (a < 0), F.lit(NAN)).when(a == 0, F.lit(-INF)).otherwise(logs(a))


def weighted(columns: list[Column], weights: list[float]) -> Column:
    """Sum of weights * columns over the non-zero weights."""
    return total([F.lit(float(w)) * c for w, c in zip(weights, columns) if w]) if any(weights) else F.lit(0.0)
