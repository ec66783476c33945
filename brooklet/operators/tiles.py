"""Pairs of queries and points by tiles: matrices of distances in place of rows.

Both sides are dealt into tiles of bounded size, and every pair of tiles is a group of one
task: the queries of the group are held, its points stream past them in parts. A part is
screened by a matrix (a product in single precision for the Euclidean metric), and only what
the screen cannot rule out gets its distance, summed by position as the Columns of
`functions.vec` sum it. Work is that of all pairs of a cell; memory is that of a tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs in one part of a tile.
PART = 500_000
#: Pairs in one group: below the first more tasks do not pay, above the second one task takes long.
LEAST_WORK, MOST_WORK = 2_000_000, 400_000_000
#: Candidates of a tile that are held before they are cut to the best of each query.
HELD = 1_000_000


class Measure:
    """A metric over tiles. `screen` is a rising function of the distance, which is off by `slack` at most."""

    def __init__(self, exact: Callable, power: int = 1, screen: Callable | None = None, product: bool = False):
        #: (n, d) and (n, d) -> n distances
        self.exact, self.power, self.own, self.product = exact, power, screen, product

    def screened(self, q: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, float]:
        """Screen values of all rows of q with all of p, and their slack."""
        if not q.shape[1]:
            return np.full((len(q), len(p)), self.exact(np.zeros((1, 0)), np.zeros((1, 0)))[0]), 0.0
        if self.product:
            center = q.mean(0)
            with np.errstate(all="ignore"):
                a, b = q - center, p - center
                one, two = (a * a).sum(1), (b * b).sum(1)
                scale = float(one.max() + two.max())
            if scale < 1e30:
                left = np.column_stack([-2 * a, one, np.ones(len(q))]).astype(np.float32)
                right = np.column_stack([b, np.ones(len(p)), two]).astype(np.float32)
                return left @ right.T, (q.shape[1] + 16) * 2.4e-7 * scale  # twice what single precision can be off by
        out = np.empty((len(q), len(p)))
        if self.own is None:
            rows, cols = 8, max(1, 8192 // q.shape[1])
            for i in range(0, len(q), rows):
                for j in range(0, len(p), cols):
                    out[i : i + rows, j : j + cols] = self.exact(q[i : i + rows, None, :], p[None, j : j + cols, :])
            return out, 0.0
        columns = np.ascontiguousarray(p.T)
        with np.errstate(all="ignore"):
            for i in range(0, len(q), 64):
                for j in range(0, len(p), 1024):
                    out[i : i + 64, j : j + 1024] = self.own(q[i : i + 64], columns[:, j : j + 1024])
        return out, 0.0

    def limits(self, distance, slack: float) -> tuple:
        """Screen values that the distance lies between for sure."""
        with np.errstate(over="ignore"):
            at = np.asarray(distance, np.float64) ** self.power
        low, high = at * (1 - 1e-9) - slack, at * (1 + 1e-9) + slack
        return (low, high) if at.ndim else (float(low), float(high))  # a plain number leaves a matrix in its precision


def _by_position(term: Callable, join: Callable = np.add) -> Callable:
    """(n, d) and (d, m) -> (n, m), position after position."""

    def screen(q: np.ndarray, columns: np.ndarray) -> np.ndarray:
        out, held = np.zeros((len(q), columns.shape[1])), np.empty((len(q), columns.shape[1]))
        for j in range(q.shape[1]):
            np.subtract(q[:, j, None], columns[j], out=held)
            join(out, term(held), out=out)
        return out

    return screen


def _summed(term: Callable, finish: Callable = lambda v: v) -> Callable:
    def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            out = np.zeros(np.broadcast_shapes(a.shape, b.shape)[:-1])
            for j in range(a.shape[-1]):
                out += term(a[..., j] - b[..., j])
            return finish(out)

    return exact


def _greatest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.abs(a - b).max(-1) if a.shape[-1] else np.full(np.broadcast_shapes(a.shape, b.shape)[:-1], np.nan)


def _magnitude(v: np.ndarray) -> np.ndarray:
    return np.abs(v, out=v)


def _square(v: np.ndarray) -> np.ndarray:
    return np.multiply(v, v, out=v)


def measure_of(metric, metric_params: dict | None = None) -> Measure | None:
    """The metric over tiles; None for a callable that builds Columns and no more. One with an
    attribute `arrays` gives distances of arrays too, whose vectors lie along the last axis."""
    params = dict(metric_params or {})
    if callable(metric):
        return Measure(metric.arrays) if hasattr(metric, "arrays") else None
    if metric == "euclidean":
        return Measure(_summed(lambda v: v * v, np.sqrt), 2, _by_position(_square), product=True)
    if metric in ("cityblock", "manhattan"):
        return Measure(_summed(np.abs), 1, _by_position(_magnitude))
    if metric == "chebyshev":
        return Measure(_greatest, 1, _by_position(_magnitude, np.maximum))
    p = int(params["p"])

    def term(v: np.ndarray) -> np.ndarray:
        held = np.abs(v)
        v[:] = held
        for _ in range(p - 1):
            v *= held
        return v

    if p > 16:  # products of many factors overflow where powers do too, but cost more
        return Measure(_summed(lambda v: np.abs(v) ** float(p), lambda s: s ** (1.0 / p)))
    return Measure(_summed(lambda v: np.abs(v) ** float(p), lambda s: s ** (1.0 / p)), p, _by_position(term))


def matrices(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each length; vectors that are null or hold a null are left out."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    ends = np.cumsum(np.maximum(lengths, 0))
    whole = lengths >= 0
    if flat.null_count:
        missing = np.flatnonzero(flat.is_null().to_numpy(zero_copy_only=False))
        whole[np.searchsorted(ends, missing, side="right")] = False
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    for length in np.unique(lengths[whole]).tolist():
        at = np.flatnonzero(whole & (lengths == length))
        if len(at) == len(lengths):
            yield at, values.reshape(len(at), length)
        else:
            yield at, values[(ends[at] - length)[:, None] + np.arange(length)]


def sortable(keys: pa.Array) -> np.ndarray:
    """Numbers in the order of the keys, nulls first."""
    if pa.types.is_integer(keys.type) and not keys.null_count:
        return keys.to_numpy(zero_copy_only=False)
    return pc.rank(keys, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()


class Tile:
    """Queries of one length, and what their points have come to so far."""

    names = ["query_id", "key", "distance"]

    def __init__(self, measure: Measure, low: float, high: float):
        self.measure, self.low, self.high = measure, low, high
        self.ids: list[pa.Array] = []
        self.parts: list[np.ndarray] = []
        self.q: np.ndarray | None = None

    def hold(self, ids: pa.Array, q: np.ndarray) -> None:
        self.ids.append(ids)
        self.parts.append(q)

    def start(self) -> None:
        if self.q is None:
            self.q, self.parts = np.concatenate(self.parts), []
            self.ids = pa.concat_arrays(self.ids)
            self.begin()

    def begin(self) -> None:
        """The queries are whole."""

    def inside(self, screen: np.ndarray, slack: float) -> np.ndarray:
        """What may lie within the radii."""
        near = ~np.isnan(screen) if self.high == np.inf else screen <= self.measure.limits(self.high, slack)[1]
        return near & (screen >= self.measure.limits(self.low, slack)[0]) if self.low > 0 else near

    def pairs(self, near: np.ndarray, p: np.ndarray, start: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, place in p, distance) of the marked pairs that lie within the radii, in bounded parts."""
        rows, cols = np.nonzero(near)
        for i in range(0, len(rows), 65_536):
            r, c = rows[i : i + 65_536] + start, cols[i : i + 65_536]
            d = self.measure.exact(self.q[r], p[c])
            good = (d >= self.low) & (d <= self.high)
            yield r[good], c[good], d[good]

    def meet(self, keys: pa.Array, p: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Points go past all queries."""
        self.start()
        step = max(1, min(len(p), 1024))
        rows = max(1, PART // step)
        for j in range(0, len(p), step):
            for i in range(0, len(self.q), rows):
                own = p[j : j + step]
                yield from self.part(i, self.q[i : i + rows], keys.slice(j, step), own, *self.measure.screened(self.q[i : i + rows], own))

    def part(self, i: int, q: np.ndarray, keys: pa.Array, p: np.ndarray, screen: np.ndarray, slack: float) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def close(self) -> Iterator[pa.RecordBatch]:
        return iter(())

    def batch(self, rows: np.ndarray, keys: pa.Array, d: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([self.ids.take(pa.array(rows)), keys, pa.array(d)], self.names)


class RangeTile(Tile):
    """All pairs within the radii."""

    def part(self, i, q, keys, p, screen, slack):
        for r, c, d in self.pairs(self.inside(screen, slack), p, i):
            if len(r):
                yield self.batch(r, keys.take(pa.array(c)), d)


class CountTile(Tile):
    """For each query the number of points within the radii."""

    names = ["query_id", "n"]

    def begin(self):
        self.n = np.zeros(len(self.q), np.int64)

    def part(self, i, q, keys, p, screen, slack):
        may, sure = self.inside(screen, slack), screen <= self.measure.limits(self.high, slack)[0]
        if self.low > 0:
            sure &= screen >= self.measure.limits(self.low, slack)[1]
        # bits are counted, since sums over a mask widen it first
        self.n[i : i + len(q)] += np.bitwise_count(np.packbits(sure, axis=1)).sum(1, dtype=np.int64)
        if np.count_nonzero(may) > np.count_nonzero(sure):
            for r, _, _ in self.pairs(may & ~sure, p, i):
                np.add.at(self.n, r, 1)
        return iter(())

    def close(self):
        self.start()
        at = np.flatnonzero(self.n)
        yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(at)), pa.array(self.n[at])], self.names)


class NearestTile(Tile):
    """For each query the k nearest points (reverse: furthest), equal distances by key; with ties
    all that equal the k-th distance."""

    def __init__(self, measure, low, high, k: int, reverse: bool, ties: bool):
        super().__init__(measure, low, high)
        self.k, self.reverse, self.ties = k, reverse, ties

    def begin(self):
        #: The k-th distance so far, which can only get better.
        self.kth = np.full(len(self.q), -np.inf if self.reverse else np.inf)
        self.rows, self.keys, self.d, self.fresh = np.zeros(0, np.int64), None, np.zeros(0), []
        self.waiting = 0

    def part(self, i, q, keys, p, screen, slack):
        near, kth = self.inside(screen, slack), self.kth[i : i + len(q)]
        found = np.isfinite(kth)
        low, high = self.measure.limits(np.where(found, kth, 0.0), slack)
        if self.reverse:
            near &= screen >= np.where(found, low, -np.inf)[:, None].astype(screen.dtype)
        else:
            near &= screen <= np.where(found, high, np.inf)[:, None].astype(screen.dtype)
        if self.k < len(p) and not found.all():
            # nothing worse than the k-th of those that surely lie within the radii
            sure = near & (screen <= self.measure.limits(self.high, slack)[0]) if self.high != np.inf else near
            if self.low > 0:
                sure = sure & (screen >= self.measure.limits(self.low, slack)[1])
            worth = np.where(sure, -screen if self.reverse else screen, np.inf).astype(np.float64, copy=False)
            last = np.partition(worth, self.k - 1, axis=1)[:, self.k - 1, None]
            far = last + 2 * slack + np.abs(np.where(np.isfinite(last), last, 0.0)) * 1e-8
            near &= (-screen if self.reverse else screen) <= far
        for r, c, d in self.pairs(near, p, i):
            if len(r):
                self.fresh.append((r, keys.take(pa.array(c)), d))
                self.waiting += len(r)
            if self.waiting > HELD:
                yield from self.cut()
        if self.waiting > max(4096, len(self.q) * self.k // 4):
            yield from self.cut()

    def cut(self) -> Iterator[pa.RecordBatch]:
        """Keep the best of each query."""
        if not self.fresh:
            return
        rows = np.concatenate([self.rows, *(f[0] for f in self.fresh)])
        d = np.concatenate([self.d, *(f[2] for f in self.fresh)])
        keys = pa.concat_arrays([*([] if self.keys is None else [self.keys]), *(f[1] for f in self.fresh)])
        worth = -d if self.reverse else d
        order = np.lexsort((sortable(keys), worth, rows))
        ordered = rows[order]
        first = np.searchsorted(ordered, ordered)
        place = np.arange(len(order)) - first
        last = order[place == self.k - 1]
        self.kth[rows[last]] = np.maximum(self.kth[rows[last]], d[last]) if self.reverse else np.minimum(self.kth[rows[last]], d[last])
        kept = order[(d[order] >= self.kth[ordered]) if self.reverse else (d[order] <= self.kth[ordered])] if self.ties else order[place < self.k]
        self.rows, self.d, self.keys = rows[kept], d[kept], keys.take(pa.array(kept))
        self.fresh, self.waiting = [], 0
        if len(kept) > HELD and self.ties:  # more equal distances than are held: the last step sorts them out
            yield self.batch(self.rows, self.keys, self.d)
            self.rows, self.d, self.keys = self.rows[:0], self.d[:0], None

    def close(self):
        self.start()
        yield from self.cut()
        for i in range(0, len(self.rows), 100_000):
            yield self.batch(self.rows[i : i + 100_000], self.keys.slice(i, 100_000), self.d[i : i + 100_000])


def meet(queries: DataFrame, points: DataFrame, cells: list[str], make: Callable[[], Tile], block_bytes: int) -> DataFrame:
    """Run tiles over all pairs of rows with equal cells (none: over all pairs).

    queries: query_id, q_vec and cells; points: key, p_vec and cells. make() gives an empty tile.
    block_bytes: bytes of queries in one tile.
    """
    spark = queries.sparkSession
    q, p = queries.groupBy(*cells).agg(F.count("*").alias("nq"), F.max(F.size("q_vec")).alias("d")), points.groupBy(*cells).agg(F.count("*").alias("np"))
    sizes = q.join(p, cells) if cells else q.crossJoin(p)  # one row each
    nq, n, total, d = sizes.agg(F.max("nq"), F.max("np"), F.sum(F.col("nq").cast("double") * F.col("np")), F.max("d")).first()
    total, parallel = total or 0.0, spark.sparkContext.defaultParallelism
    work = min(max(LEAST_WORK, total / (8 * parallel)), MOST_WORK)
    parts = int(min(max(parallel, -(-total // work)), 50_000))
    held = max(1, block_bytes // (8 * max(d or 0, 1) + 24))
    nq, n = (F.col("nq"), F.col("np")) if cells else (F.lit(nq), F.lit(n))
    qi = F.greatest(F.lit(1), F.ceil(nq / F.lit(held))).cast("long")
    pj = F.greatest(F.lit(1), F.least(F.ceil(n / 1024), F.ceil(nq.cast("double") * n / (F.lit(float(work)) * qi)))).cast("long")

    def dealt(df: DataFrame, side: int, own: str, other: str, id_col: str, vector: str) -> DataFrame:
        df = df.join(sizes.select(*cells, qi.alias("qi"), pj.alias("pj")), cells) if cells else df.withColumns({"qi": qi, "pj": pj})
        n_own, n_other = ("qi", "pj") if own == "i" else ("pj", "qi")
        df = df.withColumn(own, F.pmod(F.xxhash64(id_col, vector), F.col(n_own))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n_other) - 1)))
        ids = [F.col(c) if c == id_col else F.lit(None).cast(kinds[c]).alias(c) for c in ("query_id", "key")]
        return df.select(*cells, "i", "j", F.lit(side).alias("side"), *ids, F.col(vector).alias("vec"))

    kinds = {"query_id": queries.schema["query_id"].dataType, "key": points.schema["key"].dataType}
    both = dealt(queries, 0, "i", "j", "query_id", "q_vec").unionAll(dealt(points, 1, "j", "i", "key", "p_vec"))
    both = both.repartition(parts, *cells, "i", "j").sortWithinPartitions(*cells, "i", "j", "side")
    g, names = len(cells) + 2, make().names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tiles = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[: g + 1]])
            edges = np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1
            for low, high in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                group, side = tuple(marks[low, :g].tolist()), marks[low, g]
                if group != now:
                    for tile in tiles.values():
                        yield from tile.close()
                    now, tiles = group, {}
                if side and not tiles:
                    continue
                own = batch.slice(low, high - low)
                for at, vectors in matrices(own.column(g + 3)):
                    ids = own.column(g + 2 if side else g + 1).take(pa.array(at))
                    length = vectors.shape[1]
                    if not side:
                        tiles.setdefault(length, make()).hold(ids, vectors)
                    elif length in tiles:
                        yield from tiles[length].meet(ids, vectors)
        for tile in tiles.values():
            yield from tile.close()

    schema = ", ".join(f"{c} {'double' if c == 'distance' else 'long' if c == 'n' else kinds[c].simpleString()}" for c in names)
    return both.mapInArrow(run, schema)
