"""Counts of cells for runs of rows at once: RSHash's grids and xStream's chains, over arrays.

A row stands once in the shuffle whatever the number of estimators, and a task holds a run of rows
(`CellKernel`) or one block (`chains`), so that its memory does not grow with the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brooklet.operators.kernels import FrameKernel
from brooklet.operators.timed import whole_groups
from brooklet.plans.blocks import overlap

PRIME = 1_000_003


def _classes(columns: list[np.ndarray]) -> np.ndarray:
    """A number for each distinct row of the columns."""
    out = np.unique(columns[0], return_inverse=True)[1]
    for c in columns[1:]:
        at = np.unique(c, return_inverse=True)[1]
        out = np.unique(out * (int(at.max()) + 1) + at, return_inverse=True)[1]
    return out


class CellKernel(FrameKernel):
    """RSHash over runs of rows: mean of -log2(1 + earlier live rows in the row's cell)."""

    def __init__(self, detector, dimension: int):
        super().__init__(detector.window)
        self.d, self.draws = detector, detector.draw(dimension)

    def cells(self, x: np.ndarray, p: dict) -> list[np.ndarray]:
        """The cell of each row, or its bin by each hash function of the sketch."""
        # whole numbers as doubles, of any size; infinities are cells of their own
        parts = [np.trunc((x[:, d] + a) / p["f"]) + 0.0 for d, a in zip(p["dims"], p["alpha"])]
        if self.d.cms_d is None:
            return [_classes(parts)]
        rest = [np.mod(np.where(np.isinf(c), np.copysign(2.0**62, c), c), float(PRIME)).astype(np.int64) for c in parts]
        return [(sum((c * w for c, w in zip(rest, a)), np.full(len(x), b)) % PRIME) % self.d.cms_d for a, b in zip(p["a"], p["b"])]

    def framed(self, x, low, at):
        if not len(at):
            return []
        begin = int(low[0])
        x, low, at = x[begin:], low - begin, at - begin
        n, total = len(x), np.zeros(len(at))
        for p in self.draws:
            least = None
            for cell in self.cells(x, p):
                places = np.sort(cell * n + np.arange(n))
                own = cell[at] * n
                count = np.searchsorted(places, own + at) - np.searchsorted(places, own + low)
                least = count if least is None else np.minimum(least, count)
            total -= np.log2(1.0 + least)
        return (total / len(self.draws)).tolist()


def ranges(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of each column; NaN is greatest, as for Spark."""
    return np.fmin.reduce(p), p.max(0)


class Chains:
    """xStream block after block: counts of the block before, and ranges for the next one."""

    def __init__(self, detector, first: tuple[np.ndarray, np.ndarray] | None):
        self.d, self.draws, self.hashes, self.first = detector, detector.draw(), detector.hashes(), first
        self.last: int | None = None
        self.used = self.before = None
        width = detector.n_estimators * detector.depth * (1 if detector.cms_d is None else detector.cms_w)
        #: Cells of deep chains outgrow machine numbers.
        self.kind = np.int64 if detector.depth <= 40 and width < 2**20 else object

    def codes(self, p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """(rows, chains, levels, hash functions): the cell of each row as a number."""
        k, out = p.shape[1], []
        with np.errstate(all="ignore"):
            wide = (high > low) | (np.isnan(high) & ~np.isnan(low))
            norm = np.where(wide, (p - low) / np.where(wide, high - low, 1.0), 0.0)
        for chain in self.draws:
            times, bins = [0] * k, [np.zeros(len(p), self.kind)] * k
            for d in chain["dims"]:
                times[d] += 1
                size = 2.0 ** times[d]
                at = norm[:, d] * size + chain["offset"][d]
                bins[d] = np.where(np.isnan(at), size - 1, np.minimum(np.maximum(at, 0.0), size - 1)).astype(np.int64).astype(self.kind)
                if self.d.cms_d is None:
                    cell = np.zeros(len(p), self.kind)
                    for b, n in zip(bins, times):
                        cell = cell * 2**n + b
                    out.append(cell)
                else:
                    out += [(sum((b * w for b, w in zip(bins, a)), np.full(len(p), shift, self.kind)) % PRIME) % self.d.cms_d for a, shift in self.hashes]
        return np.stack(out, 1).reshape(len(p), len(self.draws), self.d.depth, -1)

    def block(self, number: int, p: np.ndarray) -> np.ndarray:
        """Scores of the rows of a block; NaN where the block before is not known."""
        own = ranges(p)
        if self.last != number - 1:
            self.used = self.before = None
        if number == 0:
            self.used = self.first or own
        score = np.full(len(p), np.nan)
        if self.used is None:
            self.before = None
        else:
            codes = self.codes(p, *self.used)
            shape, columns = codes.shape, codes[0].size
            flat = codes.reshape(len(p), columns) * columns + np.arange(columns)
            if self.before is not None:
                cells, counts = self.before
                at = np.minimum(np.searchsorted(cells, flat.ravel()), len(cells) - 1)
                n = np.where(cells[at] == flat.ravel(), counts[at], 0).reshape(shape).min(3)
                score = -(n * 2.0 ** np.arange(1, self.d.depth + 1)).min(2).sum(1)
            self.before = np.unique(flat, return_counts=True)
        self.used, self.last = own, number
        return score


def chains(df: DataFrame, detector, order: str, key: list[str], first: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """order, key, score of projected rows (order, key, idx, p0, ...), where blocks follow each other from 0 within a key.

    A row's score needs its block, the one before, and the ranges of the one before that: blocks are dealt in runs,
    each with the two blocks before it.
    """
    window, k = int(detector.window), detector.n_projections
    size = window * max(8, -(-4096 // window))
    rows = overlap(df, F.col("idx"), 2 * window, size).withColumnRenamed("blk", "run").withColumn("blk", F.floor(F.col("idx") / window).cast("long"))
    rows = rows.select(*(F.col(c).alias(f"g_{c}") for c in key), "run", "blk", order, "idx", "home", *(f"p{i}" for i in range(k)))
    groups = [*(f"g_{c}" for c in key), "run"]
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(parts, *groups).sortWithinPartitions(*groups, "idx")
    g, keep = len(groups), [order, *key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for table in whole_groups(batches, g + 1):
            group = tuple(table.column(i)[0].as_py() for i in range(g))
            if state is None or group != now:
                now, state = group, Chains(detector, first)
            p = np.column_stack([c.to_numpy() for c in table.columns[g + 4 :]])
            scores, home = state.block(table.column(g)[0].as_py(), p), table.column(g + 3)
            out = pa.Table.from_arrays([table.column(g + 1), *table.columns[: g - 1], pa.array(scores)], [*keep, "score"])
            yield from out.filter(home).combine_chunks().to_batches(max_chunksize=10_000)

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return dealt.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "score double"]))
