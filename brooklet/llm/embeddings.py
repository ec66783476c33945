"""Embedding near-duplicates: a subspace pigeonhole join.

Unit vectors with cosine >= t are within squared distance 2 - 2t. They are turned by a
fixed random rotation and split into blocks of few dimensions; of the blocks of a near
pair one at least holds no more than its proportional share of that budget. So each
block is range-joined under its share, and the union of candidates is verified by
cosine in double precision: no pair is lost, none below t is linked.

At the thresholds in use cells prune little: at t = 0.9 a block of 16 dimensions has radius
0.22, its pairs a median distance of 0.69 to 0.70 and a 1 % quantile of 0.43 (sf0.1), and of
256 cells around pivots a block still has to visit 37 %. So tiles of classes meet in tasks
and the range join of a block is one small matrix product, which leaves about one pair in
10^5 to verify. Work is quadratic in rows: a tile grows with the input up to a fixed size,
and a task takes many pairs of tiles once there are more than MAX_TASKS of them.

Equal vectors form a class first and count by weight. A task reports counts of links
and a spanning forest of its links, never the pairs, so a hot group costs rows in
proportion to its members. Null, zero or non-finite vectors and null or NaN components
link with nothing; only vectors of equal length are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brooklet.llm.common import kept_by_worker, runs, written
from brooklet.llm.graph import LocalForest, class_table

BLOCK_DIMENSIONS = 16
#: Tiles that a small input is cut into at most, so that its work spreads over tasks.
SPREAD = 8
#: Rows of a tile: few in small inputs, more in large ones, so that fewer copies of each are dealt.
TILE_ROWS, MOST_TILE_ROWS = 8192, 32_768
#: Tiles up to which a tile keeps TILE_ROWS, and tasks that pairs of tiles are dealt to at most.
MANY_TILES, MAX_TASKS = 64, 20_000


def rotation(d: int, seed: int = 3) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def units(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def block_operands(x: np.ndarray, budget: float) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Per block: left and right operands and the bound c such that left @ right.T >= c
    holds for all pairs within the block's share (single precision, with slack)."""
    y, out = x @ rotation(x.shape[1]), []
    for block in np.array_split(y, max(1, x.shape[1] // BLOCK_DIMENSIONS), axis=1):
        half, one = (block * block).sum(1, keepdims=True) / 2, np.ones((len(block), 1))
        share = budget * block.shape[1] / x.shape[1] + 1e-5
        out.append((np.hstack([block, -half, one]).astype(np.float32), np.hstack([block, one, -half]).astype(np.float32), -share / 2))
    return out


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float, same: bool, step: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (row of a, row of b) in bounded parts; with `same`, all but each row with itself."""
    budget = 2 - 2 * threshold
    left, right = block_operands(a, budget), block_operands(b, budget)
    for i in range(0, len(a), step):
        for j in range(0, len(b), step):
            near = None
            for (l, _, c), (_, r, _) in zip(left, right):
                hit = l[i : i + step] @ r[j : j + step].T >= c
                near = hit if near is None else near | hit
            rows, cols = np.nonzero(near)
            for k in range(0, len(rows), 65_536):
                p, q = rows[k : k + 65_536] + i, cols[k : k + 65_536] + j
                good = (a[p] * b[q]).sum(1) >= threshold
                if same:
                    good &= p != q
                if good.any():
                    yield p[good], q[good]


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, tile_rows: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    id_type = vectors.schema[id_col].dataType.simpleString()

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, raws, dims = [], [], []
            for v in batch.column(1).to_pylist():
                x = np.array(v, np.float64) if v and None not in v else np.zeros(0)
                ok = len(x) > 0 and bool(np.isfinite(x).all()) and bool(x.any())
                raws.append((x + 0.0).tobytes() if ok else None)
                keys.append(hashlib.blake2b(raws[-1], digest_size=16).digest() if ok else None)
                dims.append(len(x) if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(raws, pa.binary()), pa.array(dims, pa.int32())], ["id", "key", "raw", "dim"])

    rows = written(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>")).mapInArrow(prepare, f"id {id_type}, key binary, raw binary, dim int"), "vectors")
    classes = written(rows.filter("key is not null").groupBy("key").agg(F.min("id").alias("first_id"), F.count("*").alias("n"), F.max("raw").alias("raw"), F.max("dim").alias("dim")), "classes")
    n = classes.count()
    tile_rows = tile_rows or min(max(TILE_ROWS, -(-n // MANY_TILES)), MOST_TILE_ROWS)
    # tiles of tile_rows; of fewer, down to an eighth, as long as there are no more than SPREAD tiles
    tiles = max(1, -(-n // tile_rows), min(-(-8 * n // tile_rows), SPREAD))

    # each class goes to the tasks of all pairs that hold its tile
    tile = F.pmod(F.xxhash64("key"), F.lit(tiles)).cast("int")
    pairs = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    dealt = classes.select("dim", "key", "n", "raw", tile.alias("tile")).withColumn("other", pairs)
    dealt = dealt.select("dim", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "key", "n", "raw")
    dealt = dealt.repartition(min(max(1, tiles * (tiles + 1) // 2), MAX_TASKS), "dim", "low", "high").sortWithinPartitions("dim", "low", "high")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("embeddings")
        for (_, low, high), group in runs(batches, 3):
            first, second = [r for r in group if r[0] == low], [r for r in group if r[0] == high]
            a = units([r[3] for r in first])
            b = a if low == high else units([r[3] for r in second]) if second else a[:0]
            weight_a, weight_b = np.array([r[2] for r in first]), np.array([r[2] for r in second])
            count_a, count_b = np.zeros(len(first), np.int64), np.zeros(len(second), np.int64)
            forest, shift, edges = LocalForest(len(first) + len(second)), 0 if low == high else len(first), []
            for p, q in tile_links(a, b, threshold, low == high) if len(a) and len(b) else ():
                np.add.at(count_a, p, weight_b[q])
                if low != high:
                    np.add.at(count_b, q, weight_a[p])
                roots = np.array(forest.parent)
                for x, y in np.unique(np.stack([roots[p], roots[q + shift]], 1), axis=0).tolist():
                    if forest.union(x, y):
                        edges.append((x, y))
            keys = [r[1] for r in first] + ([] if low == high else [r[1] for r in second])
            counts = np.concatenate([count_a] if low == high else [count_a, count_b])
            out = [(keys[i], int(counts[i]), None) for i in np.flatnonzero(counts)] + [(keys[i], 0, keys[j]) for i, j in edges]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.binary())], ["key", "linked", "b"])

    found = written(dealt.mapInArrow(join, "key binary, linked long, b binary"), "links")
    table = class_table(classes, found.filter("b is null").select("key", "linked"), found.filter("b is not null").select(F.col("key").alias("a"), "b"))
    table = written(table, "table")  # so that a class with many rows can be split
    joined = rows.filter("key is not null").select("id", "key").join(table.drop("first_id"), "key").select("id", "n_links", "component_id")
    alone = rows.filter("key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return joined.union(alone).select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
