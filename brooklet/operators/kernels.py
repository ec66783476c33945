"""Row-sequential kernels: explicit state, one row in, one score out.

A kernel has `step(x, t) -> score`, and `many` for a run of rows, and may be pickled between
rows, so the same class serves batch groups (`grouped`), overlap blocks and streaming state. Batch runs cut a
long stream into overlap blocks where the score depends on the window alone; the robust
random cut forest is cut so too, since its trees have the same distribution whatever
they held before.

Live rows follow arrival: before a row, rows leave from the front while their expiry
(t + window) is not after now. Late rows count from their arrival on.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brooklet.functions.vec import numpy_metric
from brooklet.operators.detectors import Detector, _positive
from brooklet.operators.projection import hashed_weights, project, sparse_weights
from brooklet.plans.blocks import by_rows, by_time, rows_of
from brooklet.sources.stream import Stream, ingest

# --- sliding windows -----------------------------------------------------------


class WindowKernel:
    """Live rows in order of arrival, as (t, x)."""

    def __init__(self, window: float):
        self.window = window
        self.rows: deque = deque()

    def left(self, t: float, x: np.ndarray) -> None:
        """Called for each row that leaves."""

    def prune(self, now: float) -> None:
        while self.rows and self.rows[0][0] + self.window <= now:
            self.left(*self.rows.popleft())

    def many(self, x: np.ndarray, t: np.ndarray) -> list:
        """Scores of consecutive rows."""
        return [self.step(row, at) for row, at in zip(x, t.tolist())]


#: Metrics that are the absolute difference of one feature.
LINE = ("euclidean", "cityblock", "manhattan", "chebyshev")


class FrameKernel:
    """Live rows as arrays: a run of rows is scored at once, each against its own frame.

    A frame is a stretch of rows in order of arrival, so a run of rows costs one gather of
    (rows, longest frame), cut into parts of bounded size.
    """

    #: Numbers in one gathered part.
    PART = 2_000_000

    def __init__(self, window: float):
        self.window = window
        self.x: np.ndarray | None = None
        self.t: np.ndarray | None = None

    def scored(self, x: np.ndarray, frame: np.ndarray, live: np.ndarray) -> list:
        """Scores of rows x (n, d), given their frames (n, length, d) and which places are live."""
        raise NotImplementedError

    #: Whether the row itself belongs to its frame.
    own = False

    def frames(self, t: np.ndarray, held: int) -> np.ndarray:
        """The first row of the frame of each row from `held` on. Rows leave from the front only."""
        low, out = 0, np.empty(len(t) - held, np.int64)
        ends = (t + self.window).tolist()
        for i, now in enumerate(t[held:].tolist(), held):
            while low < i and ends[low] <= now:
                low += 1
            out[i - held] = low
        return out

    def many(self, x: np.ndarray, t: np.ndarray) -> list:
        held = 0 if self.x is None else len(self.x)
        x = np.asarray(x, np.float64).reshape(len(t), -1)
        if held:
            x, t = np.concatenate([self.x, x]), np.concatenate([self.t, t])
        low = self.frames(t, held)
        at = np.arange(held, len(t))
        out = self.framed(x, low, at)
        # what a later row may still see: nothing before the frame of the last row
        keep = int(low[-1]) if len(low) else 0
        self.x, self.t = x[keep:], t[keep:]
        return out

    def framed(self, x: np.ndarray, low: np.ndarray, at: np.ndarray) -> list:
        """Scores of the rows at those places, whose frames begin at low."""
        sizes = at - low + int(self.own)
        out, i = [], 0
        while i < len(at):
            rows = max(1, self.PART // max(1, int(sizes[i : i + 4096].max()) * x.shape[1]))
            part = slice(i, i + min(rows, 4096))
            length = int(sizes[part].max())
            places = at[part, None] + int(self.own) - 1 - np.arange(length)
            out += self.scored(x[at[part]], x[np.maximum(places, 0)], places >= low[part, None])
            i = part.stop
        return out

    def step(self, x: np.ndarray, t: float):
        return self.many(np.asarray(x)[None], np.asarray([t]))[0]


def counted_below(ranks: np.ndarray, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """For each (low, high, bound) the number of ranks below bound among ranks[low:high], by a wavelet matrix
    whose levels come and go: work is rows times bits, whatever the length of a stretch."""
    out = np.zeros(len(low), np.int64)
    for bit in range(max(1, int(max(ranks.max(initial=0), bound.max(initial=0))).bit_length()) - 1, -1, -1):
        ones = (ranks >> bit) & 1
        zeros = np.zeros(len(ranks) + 1, np.int32)
        np.cumsum(1 - ones, out=zeros[1:])
        a, b, up, n = zeros[low], zeros[high], ((bound >> bit) & 1).astype(bool), zeros[-1]
        out += np.where(up, b - a, 0)
        low, high = np.where(up, n + low - a, a), np.where(up, n + high - b, b)
        ranks = np.concatenate([ranks[ones == 0], ranks[ones == 1]])
    return out


class NeighborKernel(FrameKernel):
    """SWDBOR (radius) or SWKNN (k) in arrival order, for any time axis.

    line: the metric of one feature is the absolute difference. Neighbours within a radius are then
    counted by rank, and long frames cost no more than short ones.
    """

    #: Rows up to which a frame is looked through.
    SHORT = 256

    def __init__(self, window: float, metric, radius: float | None = None, k: int | None = None, k_is_max: bool = False, line: bool = False):
        super().__init__(window)
        self.metric, self.radius, self.k, self.k_is_max, self.line = metric, radius, k, k_is_max, line

    def framed(self, x, low, at):
        if self.radius is None or not self.line or x.shape[1] != 1 or not len(at) or int((at - low).max()) <= self.SHORT or not np.isfinite(x).all():
            return super().framed(x, low, at)
        begin = int(low[0])
        values, ranks = np.unique(x[begin:, 0], return_inverse=True)
        own = x[at, 0]

        def edge(places: np.ndarray, inside) -> np.ndarray:
            # the sum that found the place is rounded otherwise than the difference that counts
            while True:
                down = (places > 0) & ~inside(values[np.maximum(places - 1, 0)])
                up = ~down & (places < len(values)) & inside(values[np.minimum(places, len(values) - 1)])
                if not (down | up).any():
                    return places
                places = places - down + up

        first = edge(np.searchsorted(values, own - self.radius), lambda v: own - v > self.radius)
        last = edge(np.searchsorted(values, own + self.radius, side="right"), lambda v: v - own <= self.radius)
        ranks, a, b = ranks.astype(np.int32), low - begin, at - begin
        n = counted_below(ranks, a, b, last) - counted_below(ranks, a, b, first)
        return (1.0 / (1.0 + n)).tolist()

    def scored(self, x, frame, live):
        d = self.metric(frame, x[:, None, :]) if frame.shape[1] else np.zeros(frame.shape[:2])
        if self.radius is not None:
            return (1.0 / (1.0 + ((d <= self.radius) & live).sum(1))).tolist()
        d = np.where(live, d, math.inf)
        if d.shape[1] < self.k:
            d = np.hstack([d, np.full((len(d), self.k - d.shape[1]), math.inf)])
        near = np.partition(d, self.k - 1, axis=1)[:, : self.k]
        return np.sort(near, axis=1).tolist() if self.k_is_max else near.max(1).tolist()


class LOFKernel(WindowKernel):
    """Local outlier factor of the row within its window, for neighbourhoods of 1..k.

    Neighbourhoods include ties. Distances between live rows stand in one matrix with room to
    spare, which moves once it is full; a row writes one row and column of it, and needs the
    k-th distances of its neighbours and of theirs only.
    """

    def __init__(self, window: float, k: int, metric, simplified: bool = False, k_is_max: bool = False):
        super().__init__(window)
        self.k, self.metric, self.simplified, self.k_is_max = k, metric, simplified, k_is_max
        self.points: np.ndarray | None = None
        self.d = np.zeros((0, 0))
        self.low = self.high = 0

    def left(self, t, x):
        self.low += 1

    def room(self, x: np.ndarray) -> None:
        if self.points is not None and self.high < len(self.points):
            return
        live, size = slice(self.low, self.high), max(32, 2 * (self.high - self.low) + 2)
        n, d, points = self.high - self.low, np.empty((size, size)), np.empty((size, len(x)))
        if n:
            d[:n, :n], points[:n] = self.d[live, live], self.points[live]
        self.d, self.points, self.low, self.high = d, points, 0, n

    def __getstate__(self):
        """Only what is live is kept between batches."""
        live = slice(self.low, self.high)
        return self.__dict__ | {"d": self.d[live, live].copy(), "points": None if self.points is None else self.points[live].copy(), "low": 0, "high": self.high - self.low}

    def step(self, x: np.ndarray, t: float):
        self.prune(t)
        self.room(x)
        low, n = self.low, self.high - self.low
        own = low + n
        row = self.metric(self.points[low:own], x) if n else np.zeros(0)
        self.d[own, low:own] = self.d[low:own, own] = row
        self.d[own, own] = math.inf  # a row is no neighbour of itself
        self.points[own] = x
        self.rows.append((t, None))
        self.high = own + 1
        if not n:
            return [0.0] * self.k if self.k_is_max else 0.0
        d, out = self.d[low : own + 1, low : own + 1], []
        for k in range(1, self.k + 1) if self.k_is_max else (self.k,):
            rank = min(k, n) - 1
            near = np.flatnonzero(row <= np.partition(row, rank)[rank])
            some = np.r_[n, near]
            to = d[some]
            inside = to <= np.partition(to, rank, axis=1)[:, rank : rank + 1]
            met = np.flatnonzero(inside.any(0))
            kd = np.partition(d[met], rank, axis=1)[:, rank]
            inside, to = inside[:, met], to[:, met]
            reach = np.where(inside, kd[None, :] if self.simplified else np.maximum(to, kd[None, :]), 0.0)
            count, total = inside.sum(1), reach.sum(1)
            with np.errstate(divide="ignore", invalid="ignore"):
                lrd = count / total
                out.append(float(lrd[1:].sum() / (len(near) * lrd[0])))
        return out if self.k_is_max else out[-1]


class SortedKernel(WindowKernel):
    """Live rows, and the values of each feature in order: a row costs a place found by halving."""

    def __init__(self, window: float):
        super().__init__(window)
        self.sorted: list[list[float]] | None = None

    def left(self, t, x):
        for values, v in zip(self.sorted, x):
            del values[bisect_left(values, v)]

    def enter(self, x: np.ndarray, t: float) -> list[float]:
        x = [float(v) for v in x]
        if self.sorted is None:
            self.sorted = [[] for _ in x]
        self.prune(t)
        for values, v in zip(self.sorted, x):
            insort(values, v)
        self.rows.append((t, x))
        return x


class HBOSKernel(SortedKernel):
    """Sum over dimensions of -log10(height of the row's bin / greatest height), with
    equi-depth bins over the window, the row included. Runs of ties stay in one bin."""

    def __init__(self, window: float, n_bins: int, weights: np.ndarray | None = None):
        super().__init__(window)
        self.n_bins, self.weights = n_bins, weights

    def height(self, values: list[float], x: float) -> float:
        n, depth = len(values), max(1, len(values) // self.n_bins)
        if values[0] == values[-1]:
            return 1.0
        ends = [0]
        while ends[-1] < n:  # a bin ends with the run of ties that its last value stands in
            last = min(ends[-1] + depth, n) - 1
            ends.append(bisect_right(values, values[last], last))
        edges = [values[0], *((values[e - 1] + values[e]) / 2 for e in ends[1:-1]), values[-1]]
        counts = [b - a for a, b in zip(ends, ends[1:])]
        heights = [c / (b - a) if b > a else math.inf for c, a, b in zip(counts, edges, edges[1:])]
        own, most = heights[bisect_right(edges, x, 0, len(heights)) - 1], max(heights)
        return own / most if math.isfinite(most) else float(own == most)

    def step(self, x: np.ndarray, t: float) -> float:
        total = 0.0
        x = self.enter(x if self.weights is None else self.weights @ x, t)
        for values, v in zip(self.sorted, x):
            h = self.height(values, v)
            total -= math.log10(h) if h > 0 else -math.inf
        return total + 0.0


class CutTree:
    """A robust random cut tree under insertion and deletion."""

    __slots__ = ("rng", "root", "drawn")
    #: Draws that are taken from the generator at once; they are those of single calls.
    DRAWS = 64

    def __init__(self, rng: np.random.Generator):
        self.rng, self.root, self.drawn = rng, None, []

    # a node is [parent, mass, low, high, cut dimension, cut, left, right]; a leaf has cut dimension -1

    def insert(self, x: tuple) -> list:
        if self.root is None:
            self.root = [None, 1, list(x), list(x), -1, 0.0, None, None]
            return self.root
        node, d, drawn = self.root, len(x), self.drawn
        while True:
            low, high = list(node[2]), list(node[3])
            total = 0.0
            for q in range(d):
                v = x[q]
                if v < low[q]:
                    low[q] = v
                elif v > high[q]:
                    high[q] = v
                total += high[q] - low[q]
            if total <= 0:  # a copy of a leaf's point
                node[1] += 1
                return node
            if not drawn:
                drawn.extend(self.rng.random(self.DRAWS)[::-1].tolist())
            r, q = drawn.pop() * total, 0
            span = high[0] - low[0]
            while q < d - 1 and r > span:
                r -= span
                q += 1
                span = high[q] - low[q]
            cut = low[q] + (r if r < span else span)
            first, begin = x[q] <= cut, node[2][q]
            if first != (begin <= cut) and not (begin <= cut < node[3][q]):
                break
            if node[4] < 0:  # a cut at the very end of a span parts nothing: draw again
                continue
            # the row goes below this node, which holds it from here on
            node[1] += 1
            node[2], node[3] = low, high
            node = node[6] if x[node[4]] <= node[5] else node[7]
        parent, leaf = node[0], [None, 1, list(x), list(x), -1, 0.0, None, None]
        branch = [parent, node[1] + 1, low, high, q, cut, leaf if first else node, node if first else leaf]
        if parent is None:
            self.root = branch
        elif parent[6] is node:
            parent[6] = branch
        else:
            parent[7] = branch
        node[0] = leaf[0] = branch
        return leaf

    def delete(self, leaf: list) -> None:
        leaf[1] -= 1
        at = leaf[0]
        changed = leaf[1] == 0
        if changed:
            if at is None:
                self.root = None
                return
            sibling, above = at[7] if at[6] is leaf else at[6], at[0]
            sibling[0] = above
            if above is None:
                self.root = sibling
            elif above[6] is at:
                above[6] = sibling
            else:
                above[7] = sibling
            at = above
        while at is not None:
            at[1] -= 1
            if changed:  # above a box that stays, all stay
                one, two = at[6], at[7]
                low = [a if a <= b else b for a, b in zip(one[2], two[2])]
                high = [a if a >= b else b for a, b in zip(one[3], two[3])]
                changed = low != at[2] or high != at[3]
                at[2], at[3] = low, high
            at = at[0]

    def codisp(self, leaf: list) -> float:
        most, node = 0.0, leaf
        while (parent := node[0]) is not None:
            sibling = parent[7] if parent[6] is node else parent[6]
            most = max(most, sibling[1] / node[1])
            node = parent
        return most


class CutTreeKernel(WindowKernel):
    """Collusive displacement of the new row in one tree."""

    def __init__(self, window: float, seed):
        super().__init__(window)
        self.tree = CutTree(np.random.default_rng(seed))

    def left(self, t, leaf):
        self.tree.delete(leaf)

    def step(self, x: np.ndarray, t: float) -> float:
        self.prune(t)
        leaf = self.tree.insert(tuple(map(float, x)))
        self.rows.append((t, leaf))
        return self.tree.codisp(leaf)


class ObserverKernel:
    """Sparse data observers with exponential fading."""

    def __init__(self, k: int, T: float, qv: float, x: int, metric, seed: int = 0):
        self.k, self.qv, self.x, self.metric = k, qv, x, metric
        self.fading, self.rate = math.exp(-1.0 / T), k * k / x / T
        self.rng = np.random.default_rng(seed)
        self.points: np.ndarray | None = None
        self.obs, self.touched, self.added, self.index = np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0, np.int64)
        self.n, self.last_added, self.last_index = 0, 0.0, 0

    def many(self, x: np.ndarray, t: np.ndarray) -> list:
        return [self.step(row, at) for row, at in zip(x, t.tolist())]

    def step(self, x: np.ndarray, t: float) -> tuple[float, int]:
        """(score, whether the row became an observer)."""
        n, f = len(self.obs), self.fading
        if not n:
            self.points = np.array([x])
            self._fill(np.array([1.0]), t)
            return 0.0, 1
        faded = self.obs * f ** (t - self.touched)
        order = np.lexsort((self.index, -faded))
        d = self.metric(self.points, x)
        active = order[: int((n - 1) * (1 - self.qv)) + 1]
        score = float(np.median(np.sort(d[active])[: self.x]))
        near = order[np.argsort(d[order], kind="stable")][: self.x]  # equal distances: the more observed first
        age = 1.0 - f ** (t - self.added)
        with np.errstate(divide="ignore", invalid="ignore"):
            worth = np.where(age > 0, faded / age, np.inf)
        worst = int(np.lexsort((self.index, worth))[0])
        # sums of the observations as they are once the nearest have seen this row
        total, near_total = float(faded.sum()) + len(near), float(faded[near].sum()) + len(near)
        self.obs[near] = faded[near] + 1.0
        self.touched[near] = t
        sampled = self.rng.random() * total * (self.n - self.last_index) < self.rate * near_total * (t - self.last_added)
        if sampled:
            if n < self.k:
                self.points = np.vstack([self.points, x])
                self._fill(np.r_[self.obs, 1.0], t)
            else:
                self.points[worst] = x
                self.obs[worst], self.touched[worst], self.added[worst], self.index[worst] = 1.0, t, t, self.n
                self.last_added, self.last_index = t, self.n
                self.n += 1
                return score, 1
            return score, 1
        self.n += 1
        return score, 0

    def _fill(self, obs: np.ndarray, t: float) -> None:
        self.obs = obs
        self.touched, self.added, self.index = np.r_[self.touched, t], np.r_[self.added, t], np.r_[self.index, self.n]
        self.last_added, self.last_index = t, self.n
        self.n += 1

    def observers(self, now: float) -> list[tuple[list[float], float, float]]:
        """(vec, observations, average observations) at a time, most observed first."""
        f = self.fading
        obs = self.obs * f ** (now - self.touched)
        age = 1.0 - f ** (now - self.added)
        with np.errstate(divide="ignore", invalid="ignore"):
            average = np.where(age > 0, (1 - f) * obs / age, obs)
        order = np.lexsort((self.index, -obs))
        return [(self.points[i].tolist(), float(obs[i]), float(average[i])) for i in order]


# --- row by row, what DataFrame operators do in batch ----------------------------------


class StatsKernel:
    """Statistics of the window that ends with the row: count, then each statistic and
    each quantile of each feature."""

    def __init__(self, window: float, what=(), quantiles=()):
        self.what, self.quantiles = ([what] if isinstance(what, str) else list(what)), list(quantiles)
        unknown = set(self.what) - {"sum", "average", "squares_sum", "variance", "min", "max", "median"}
        if unknown or not all(0 <= q <= 1 for q in self.quantiles):
            raise ValueError(f"unknown statistics {sorted(unknown)} or quantiles out of [0, 1]")
        ranked = self.quantiles or {"min", "max", "median"} & set(self.what)
        self.frame = _Sums(window) if set(self.what) - {"min", "max", "median"} or not ranked else None
        self.ranks = SortedKernel(window) if ranked else None

    def many(self, x: np.ndarray, t: np.ndarray) -> list[list[float]]:
        plain = [None] * len(t) if self.frame is None else self.frame.many(x, t)
        return [self.one(row, at, p) for row, at, p in zip(x, t.tolist(), plain)]

    def step(self, x: np.ndarray, t: float) -> list[float]:
        return self.many(np.asarray(x)[None], np.asarray([t]))[0]

    def one(self, x: np.ndarray, t: float, plain: tuple | None) -> list[float]:
        if self.ranks is not None:
            self.ranks.enter(x, t)
            lists = self.ranks.sorted
            n = len(lists[0]) if lists else len(self.ranks.rows)
        else:
            n = plain[0]
        at = lambda q: [values[math.floor((n - 1) * q)] for values in lists]
        ranks = {"min": 0.0, "max": 1.0, "median": 0.5}
        out = [float(n)]
        for name in self.what:
            out += at(ranks[name]) if name in ranks else plain[1][name].tolist()
        for q in self.quantiles:
            out += at(q)
        return out


class _Sums(FrameKernel):
    """Count, sums and moments of each row's window, the row included."""

    own = True

    def scored(self, x, frame, live):
        n, held = live.sum(1), np.where(live[..., None], frame, 0.0)
        total, squares = held.sum(1), (held * held).sum(1)
        mean = total / n[:, None]
        variance = np.where(live[..., None], (frame - mean[:, None]) ** 2, 0.0).sum(1) / n[:, None]
        return [(int(n[i]), {"sum": total[i], "average": mean[i], "squares_sum": squares[i], "variance": variance[i]}) for i in range(len(n))]


class ScaleKernel:
    """The z-score of the row (quantile None) or its place between two quantiles."""

    def __init__(self, window: float, quantile: float | None = None):
        self.quantile, self.ranks = quantile, SortedKernel(window)
        self.frame = _Sums(window) if quantile is None else None

    def many(self, x: np.ndarray, t: np.ndarray) -> list[list[float]]:
        plain = [None] * len(t) if self.frame is None else self.frame.many(x, t)
        return [self.one(row, at, p) for row, at, p in zip(x, t.tolist(), plain)]

    def step(self, x: np.ndarray, t: float) -> list[float]:
        return self.many(np.asarray(x)[None], np.asarray([t]))[0]

    def one(self, x: np.ndarray, t: float, plain: tuple | None) -> list[float]:
        self.ranks.enter(x, t)
        data, n = self.ranks.sorted, len(self.ranks.rows)
        out = []
        for i, v in enumerate(map(float, x)):
            if self.quantile is None:
                if data[i][0] == data[i][-1]:  # a constant window has deviation 0 exactly
                    out.append(math.nan)
                    continue
                low, wide = float(plain[1]["average"][i]), math.sqrt(float(plain[1]["variance"][i]))
            else:
                low, high = (data[i][math.floor((n - 1) * q)] for q in (self.quantile, 1 - self.quantile))
                wide = high - low
            up = v - low
            out.append(up / wide if wide else math.nan if not up or up != up else math.copysign(math.inf, up))
        return out


class HashKernel(WindowKernel):
    """RSHash, row by row: for any time axis. Counts are of cells, or of sketch bins."""

    def __init__(self, detector, dimension: int):
        super().__init__(detector.window)
        self.draws, self.d, self.counts = detector.draw(dimension), detector, {}

    def keys(self, x: np.ndarray) -> list[list[tuple]]:
        out, big = [], 2**62
        for e, p in enumerate(self.draws):
            cell = tuple((big if v > 0 else -big) if math.isinf(v) else math.trunc((v + a) / p["f"]) for v, a in zip((float(x[d]) for d in p["dims"]), p["alpha"]))
            if self.d.cms_d is None:
                out.append([(e, 0, cell)])
            else:
                out.append([(e, i, (sum(c % 1_000_003 * w for c, w in zip(cell, a)) + b) % 1_000_003 % self.d.cms_d) for i, (a, b) in enumerate(zip(p["a"], p["b"]))])
        return out

    def left(self, t, keys):
        for own in keys:
            for k in own:
                self.counts[k] -= 1
                if not self.counts[k]:
                    del self.counts[k]

    def step(self, x: np.ndarray, t: float) -> float:
        self.prune(t)
        keys = self.keys(x)
        score = sum(-math.log2(1.0 + min(self.counts.get(k, 0) for k in own)) for own in keys) / len(keys)
        for own in keys:
            for k in own:
                self.counts[k] = self.counts.get(k, 0) + 1
        self.rows.append((t, keys))
        return score


class RowKernel:
    """A kernel that takes rows one by one."""

    def many(self, x: np.ndarray, t: np.ndarray) -> list:
        return [self.step(row, at) for row, at in zip(x, t.tolist())]


class HalfSpaceKernel(RowKernel):
    """Half-space trees, row by row. A block begins with the first row, and anew with a row
    at or after the block's begin plus the window; empty stretches make no blocks."""

    def __init__(self, detector, dimension: int):
        self.d, self.trees = detector, detector.draw(dimension)
        self.begin: float | None = None
        self.now, self.before = {}, None

    def step(self, x: np.ndarray, t: float) -> float:
        if self.begin is None:
            self.begin = t
        elif t >= self.begin + self.d.window:
            self.begin, self.before, self.now = t, self.now, {}
        total = 0.0
        for tree, (dims, splits) in enumerate(self.trees):
            node, score = 0, None
            for depth in range(self.d.max_depth + 1):
                k = (tree, node)
                self.now[k] = self.now.get(k, 0) + 1
                if self.before is not None and score is None:
                    r = self.before.get(k, 0)
                    if depth == self.d.max_depth or r <= self.d.limit:
                        score = -r * 2.0**depth
                if depth < self.d.max_depth:
                    node = 2 * node + 1 + int(x[dims[node]] >= splits[node])
            total += math.nan if score is None else score
        return total / len(self.trees)


class ChainKernel(RowKernel):
    """Half-space chains, row by row, over exact cells or sketch bins. The first block waits for
    its own ranges, unless an initial sample gives them."""

    def __init__(self, detector, features: list[str], initial_sample: np.ndarray | None = None):
        self.d, self.weights, self.chains = detector, hashed_weights(detector.n_projections, features), detector.draw()
        self.block: list[np.ndarray] = []
        self.used = None if initial_sample is None else self.range_of(np.asarray(initial_sample, np.float64) @ self.weights.T)
        self.before: dict | None = None
        self.now: dict = {}
        self.hashes = detector.hashes()

    @staticmethod
    def range_of(rows: np.ndarray):
        return rows.min(0), rows.max(0)

    def cells(self, p: np.ndarray) -> list[list[tuple]]:
        """For each chain and level, the keys (chain, level, hash number, cell) that count the row."""
        low, high = self.used
        norm = np.where(high > low, (p - low) / np.where(high > low, high - low, 1.0), 0.0)
        out = []
        for c, chain in enumerate(self.chains):
            times, bins = [0] * len(p), [0] * len(p)
            for level, d in enumerate(chain["dims"]):
                times[d] += 1
                wide = 2.0 ** times[d]
                bins[d] = int(min(max(norm[d] * wide + chain["offset"][d], 0.0), wide - 1))
                cells = [tuple(bins)] if self.d.cms_d is None else [(sum(b * w for b, w in zip(bins, a)) + shift) % 1_000_003 % self.d.cms_d for a, shift in self.hashes]
                out.append([(c, level, i, cell) for i, cell in enumerate(cells)])
        return out

    def count(self, p: np.ndarray) -> list[list[tuple]]:
        cells = self.cells(p)
        for keys in cells:
            for k in keys:
                self.now[k] = self.now.get(k, 0) + 1
        return cells

    def step(self, x: np.ndarray, t: float) -> float:
        p = self.weights @ x
        score = math.nan
        self.block.append(p)
        if self.used is not None:
            cells = self.count(p)
            if self.before is not None:
                least = [math.inf] * len(self.chains)
                for keys in cells:
                    c, level = keys[0][:2]
                    least[c] = min(least[c], min(self.before.get(k, 0) for k in keys) * 2 ** (level + 1))
                score = -float(sum(least))
        if len(self.block) == int(self.d.window):
            ranges = self.range_of(np.array(self.block))
            if self.used is None:
                self.used = ranges
                for row in self.block:
                    self.count(row)
            self.used, self.before, self.now, self.block = ranges, self.now, {}, []
        return score


class ForestKernel(RowKernel):
    """All trees of a robust random cut forest, for online runs."""

    def __init__(self, window: float, n: int, seed: int):
        self.trees = [CutTreeKernel(window, [seed, i, 0]) for i in range(n)]

    def step(self, x: np.ndarray, t: float) -> float:
        return sum(tree.step(x, t) for tree in self.trees) / len(self.trees)


# --- batch runs ------------------------------------------------------------------


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of that many rows or more."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def grouped(df: DataFrame, group: list[str], order: str, keep: list[str], x: list[str], make: Callable, out: str, home: bool = True, rising: bool = False, gather: int = 0) -> DataFrame:
    """Run a kernel over each group's rows in order; rows with `home` give a row.

    make(group key) -> kernel. A group arrives as sorted Arrow batches of one task, so it
    is never held whole: only the kernel's state is. rising: times that fall raise.
    gather: rows that a kernel is given at once, for one whose runs cost what it holds.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = [*group, *keep, "t", *(["home"] if home else []), *x]
    # without a group the stream is one, and serial by nature
    dealt = (df.repartition(parts, *group) if group else df.repartition(1)).sortWithinPartitions(*group, order).select(*names)
    kinds = [df.schema[c].dataType.simpleString() for c in keep]
    g, k = len(group), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kernel, last = None, None, None
        for batch in gathered(batches, gather) if gather else batches:
            if not batch.num_rows:
                continue
            t = batch.column(g + k).to_numpy(zero_copy_only=False)
            own = batch.column(g + k + 1).to_numpy(zero_copy_only=False).astype(bool) if home else np.ones(batch.num_rows, bool)
            columns = batch.columns[g + k + 1 + home :]
            data = np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns]).astype(np.float64) if columns else np.zeros((len(t), 0))
            rows = zip(*(batch.column(i).to_pylist() for i in range(g))) if g else iter([()] * len(t))
            scores, low = [], 0
            for now, part in groupby(rows):
                high = low + sum(1 for _ in part)
                if kernel is None or now != key:
                    key, kernel, last = now, make(now), None
                if rising and ((last is not None and t[low] < last) or (np.diff(t[low:high]) < 0).any()):
                    raise ValueError("a time axis that falls: late rows go through kernels.sequential")
                scores += kernel.many(data[low:high], t[low:high])
                last, low = t[high - 1], high
            at = np.flatnonzero(own)
            scores = [scores[i] for i in at]
            kept = [batch.column(g + j).take(pa.array(at, pa.int64())) for j in range(k)]
            values = [list(c) for c in zip(*scores)] if scores and isinstance(scores[0], tuple) else [scores] if n_out == 1 else [[] for _ in range(n_out)]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, kind) for c, kind in zip(values, out_kinds))], [*keep, *out_names])

    fields = [f.strip().rsplit(" ", 1) for f in out.split(",")]
    out_names, n_out = [f[0] for f in fields], len(fields)
    known = {"double": pa.float64(), "int": pa.int32(), "array<double>": pa.list_(pa.float64())}
    out_kinds = [known[f[1]] for f in fields]
    schema = ", ".join([*(f"`{c}` {kind}" for c, kind in zip(keep, kinds)), out])
    return dealt.mapInArrow(run, schema)


def _blocked(s: Stream, window: float, rising: bool = False, factor: int = 8) -> tuple[DataFrame, list[str]]:
    """Overlap blocks on the default clock, and on a time axis that never falls (rising); else
    whole keys, where late rows may shield others however far back."""
    df = ingest(s)
    if s.time is None:
        return by_rows(df, rows_of(window)), [*s.key, "blk"]
    if rising or s.rising:
        return by_time(df, window, factor), [*s.key, "blk"]
    return df.withColumn("home", F.lit(True)), s.key


def framed_run(s: Stream, window: float, make: Callable, out: str, rising: bool = False, factor: int = 8, gather: int = 0) -> DataFrame:
    """Order, key and scores of a kernel whose scores depend on the window alone. factor: windows of
    a block of a time axis."""
    df, group = _blocked(s, window, rising, factor)
    x = [f"x{i}" for i in range(s.n_features)]
    key = [k for k in s.key]
    renamed = df.select(*(F.col(k).alias(f"g_{k}") for k in key), *(["blk"] if "blk" in group else []), *df.columns[: 1 + len(key)], "idx", "t", "home", *x)
    groups = [*(f"g_{k}" for k in key), *(["blk"] if "blk" in group else [])]
    return grouped(renamed, groups, "idx", [s.order, *key], x, make, out, rising=(rising or s.rising) and s.time is not None, gather=gather)


def names_of(s: Stream) -> list[str]:
    return [f"{s.features[0]}_{i}" for i in range(s.dimension)] if s.dimension else list(s.features)


def sequential(s: Stream, detector, out: str | None = None) -> DataFrame:
    """A detector's kernel over each key as a whole: for time axes with ties or late rows."""
    names = [f"x{i}" for i in range(s.n_features)] if s.dimension else list(s.features)
    out = out or ("score array<double>" if getattr(detector, "k_is_max", False) else "score double")
    timed = ingest(s).withColumn("home", F.lit(True))
    x, key = [f"x{i}" for i in range(s.n_features)], list(s.key)
    renamed = timed.select(*(F.col(k).alias(f"g_{k}") for k in key), s.order, *key, "idx", "t", "home", *x)
    return grouped(renamed, [f"g_{k}" for k in key], "idx", [s.order, *key], x, lambda group: detector.kernel(group, names), out)


@dataclass(frozen=True)
class SlidingStatistics:
    """`sliding_stats` in order of arrival, as one array per row: count, then values."""

    window: float
    what: tuple = ()
    quantiles: tuple = ()
    k_is_max: bool = True  # the score is an array

    def kernel(self, group=(), features=None) -> StatsKernel:
        return StatsKernel(self.window, self.what, self.quantiles)

    def outputs(self, features: list[str]) -> list[tuple[str, str]]:
        """Names and types of what the kernel's array holds."""
        what = [self.what] if isinstance(self.what, str) else self.what
        return [("count", "bigint"), *((f"{f}_{name}", "double") for name in (*what, *(f"q{q:g}" for q in self.quantiles)) for f in features)]

    def transform(self, s: Stream) -> DataFrame:
        return sequential(s, self, "score array<double>")


@dataclass(frozen=True)
class SlidingScale:
    """The scalers in order of arrival: z-scores, or quantile scaling if a quantile is given."""

    window: float
    quantile: float | None = None
    k_is_max: bool = True

    def kernel(self, group=(), features=None) -> ScaleKernel:
        return ScaleKernel(self.window, self.quantile)

    def outputs(self, features: list[str]) -> list[tuple[str, str]]:
        return [(f, "double") for f in features]

    def transform(self, s: Stream) -> DataFrame:
        return sequential(s, self, "score array<double>")


@dataclass(frozen=True)
class SWLOF(Detector):
    window: float
    k: int
    simplified: bool = False
    k_is_max: bool = False
    metric: str = "euclidean"
    metric_params: dict | None = None

    def __post_init__(self):
        _positive(window=self.window, k=self.k)

    def kernel(self, group=(), features=None) -> LOFKernel:
        return LOFKernel(self.window, self.k, numpy_metric(self.metric, self.metric_params), self.simplified, self.k_is_max)

    def transform(self, s: Stream) -> DataFrame:
        return framed_run(s, self.window, self.kernel, "score array<double>" if self.k_is_max else "score double")


@dataclass(frozen=True)
class LODA(Detector):
    """Sliding histograms, over sparse random projections if n_projections is given."""

    window: float
    n_projections: int | None = None
    n_bins: int = 10
    seed: int = 0

    def __post_init__(self):
        _positive(window=self.window, n_bins=self.n_bins)
        if self.n_projections is not None:
            _positive(n_projections=self.n_projections)

    def kernel(self, group=(), features=None) -> HBOSKernel:
        if self.n_projections is not None and not features:
            raise ValueError("projections need the names of the features")
        return HBOSKernel(self.window, self.n_bins, None if self.n_projections is None else sparse_weights(self.n_projections, len(features), self.seed))

    def transform(self, s: Stream) -> DataFrame:
        names = [f"x{i}" for i in range(s.n_features)]
        return framed_run(s, self.window, lambda group: self.kernel(group, names), "score double")

    def projected_window(self, s: Stream) -> DataFrame:
        """The live rows as the detector sees them: projected, if it projects."""
        live = self.window_rows(s)
        if self.n_projections is None:
            return live
        outs = project([F.col(f"x{i}") for i in range(s.n_features)], sparse_weights(self.n_projections, s.n_features, self.seed))
        return live.select(s.order, *s.key, "expire_time", *(c.alias(f"p{i}") for i, c in enumerate(outs)))


@dataclass(frozen=True)
class SWRRCT(Detector):
    """Robust random cut forest: trees are groups of their own, and scores their mean."""

    window: float
    n_estimators: int = 10
    seed: int = 0

    def __post_init__(self):
        _positive(window=self.window, n_estimators=self.n_estimators)

    def kernel(self, group=(), features=None) -> ForestKernel:
        return ForestKernel(self.window, self.n_estimators, self.seed)

    def transform(self, s: Stream) -> DataFrame:
        df, group = _blocked(s, self.window)
        x, key = [f"x{i}" for i in range(s.n_features)], list(s.key)
        blk = ["blk"] if "blk" in group else []
        trees = df.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(self.n_estimators - 1))))
        trees = trees.select("tree", *(F.col(k).alias(f"g_{k}") for k in key), *blk, s.order, *key, "idx", "t", "home", *x)
        seed, window = self.seed, self.window

        def make(group):
            # by tree and block alone, so that results do not depend on partitions
            return CutTreeKernel(window, [seed, int(group[0]), int(group[-1]) if blk else 0])

        scored = grouped(trees, ["tree", *(f"g_{k}" for k in key), *blk], "idx", [s.order, *key], x, make, "one double")
        return scored.groupBy(s.order, *key).agg(F.avg("one").alias("score"))


@dataclass(frozen=True)
class SDOstream(Detector):
    """Sparse data observers; a stream's history is unbounded, so each key is one group."""

    k: int
    T: float
    qv: float = 0.3
    x: int = 6
    metric: str = "euclidean"
    metric_params: dict | None = None
    seed: int = 0
    return_sampling: bool = False

    def __post_init__(self):
        _positive(k=self.k, T=self.T, x=self.x)
        if not 0 <= self.qv < 1:
            raise ValueError("qv lies in [0, 1)")

    def outputs(self, features: list[str]) -> list[tuple[str, str]]:
        return [("score", "double"), *([("sampled", "int")] if self.return_sampling else [])]

    def kernel(self, group=(), features=None) -> ObserverKernel:
        return ObserverKernel(self.k, self.T, self.qv, self.x, numpy_metric(self.metric, self.metric_params), self.seed)

    def transform(self, s: Stream) -> DataFrame:
        key, x = list(s.key), [f"x{i}" for i in range(s.n_features)]
        df = ingest(s).select(*(F.col(k).alias(f"g_{k}") for k in key), s.order, *key, "idx", "t", *x)
        groups = [f"g_{k}" for k in key] or ["g"]
        df = df if key else df.withColumn("g", F.lit(0))
        out = grouped(df, groups, "idx", [s.order, *key], x, self.kernel, "score double, sampled int", home=False)
        return out if self.return_sampling else out.drop("sampled")

    def observers(self, s: Stream, time: float | None = None) -> DataFrame:
        """key, vec, observations, av_observations after the whole stream."""
        key, x, make = list(s.key), [f"x{i}" for i in range(s.n_features)], self.kernel
        df = ingest(s).select(*key, "idx", "t", *x)
        df = df if key else df.withColumn("g", F.lit(0))
        groups = key or ["g"]
        kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in groups)
        dealt = df.repartition(*groups).sortWithinPartitions(*groups, "idx").select(*groups, "t", *x)

        def run(batches):
            key_, kernel, last, kinds_of = None, None, None, []

            def close():
                rows = kernel.observers(last if time is None else time)
                arrays = [pa.array([k] * len(rows), kind) for k, kind in zip(key_, kinds_of)]
                columns = list(zip(*rows)) or [[], [], []]
                return pa.RecordBatch.from_arrays([*arrays, pa.array(columns[0], pa.list_(pa.float64())), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.float64())], [*groups, "vec", "observations", "av_observations"])

            for batch in batches:
                kinds_of = batch.schema.types[: len(groups)]
                for *row_key, t, point in zip(*(batch.column(i).to_pylist() for i in range(len(groups) + 1)), np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[len(groups) + 1 :]])):
                    if kernel is None or row_key != key_:
                        if kernel is not None:
                            yield close()
                        key_, kernel = row_key, make()
                    kernel.step(point, t)
                    last = t
            if kernel is not None:
                yield close()

        out = dealt.mapInArrow(run, f"{kinds}, vec array<double>, observations double, av_observations double")
        return out if key else out.drop("g")


@dataclass(frozen=True)
class ArrivalOrder(Detector):
    """SWDBOR (radius) or SWKNN (k) on any time axis: ties, late rows, fractional times."""

    window: float
    radius: float | None = None
    k: int | None = None
    k_is_max: bool = False
    metric: str = "euclidean"
    metric_params: dict | None = None

    def kernel(self, group=(), features=None) -> NeighborKernel:
        return NeighborKernel(self.window, numpy_metric(self.metric, self.metric_params), self.radius, self.k, self.k_is_max, self.metric in LINE)

    def transform(self, s: Stream) -> DataFrame:
        return framed_run(s, self.window, self.kernel, "score array<double>" if self.k_is_max else "score double")
