"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

1. Every whole text becomes its set of word shingles (five words; a text of fewer words
   is one shingle; hashes of 64 bits). Texts with equal sets form a class.
2. A class's MinHash signature is cut into TREES parts of DEPTH hashes; the parts of a tree,
   in order, are a prefix trie. Rows below one node of the shortest prefix that may be needed
   (`prefix_length`) meet in a task, sorted, so that nodes of longer prefixes are runs of rows.
   Pairs meet at the deepest node that they share, deepest nodes first, in tiles of bounded
   size. A pair passes if its whole signatures agree nearly as often as the threshold asks; a
   tile reports a spanning forest of what passes, with the depth of each edge, never the pairs.
3. Prefixes are then shortened from the whole depth on, until the recall of links that the
   pairs met tell of reaches the target (`shortened`); edges of shorter prefixes are dropped.
   Components of the edges that stay are candidate groups.
4. Within a candidate group, tiles of classes are verified on their whole shingle sets:
   intersections of all pairs of two tiles are one matrix product. A tile pair reports
   counts of links and a spanning forest of links.
5. Components of the verified links name the groups.

There is no cap on a prefix or a group: what is large is cut into more tiles. No pair of
rows is ever emitted.

Null and empty texts have no shingles and form one class. Ids may repeat or be null; a
group is named by its smallest id. Similarity ties count as links (>= threshold).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brooklet.llm.common import WORD_RE, kept_by_worker, runs, text_or_empty, written
from brooklet.llm.graph import LocalForest, class_table, components

WORDS = 5
TREES = 24
DEPTH = 8
HASHES = TREES * DEPTH
#: Recall of every link at the shortest prefix, and the expected recall of all links of the
#: input at which prefixes are not shortened any further.
LEAST, TARGET = 0.9998, 0.99999
#: Standard deviations of a signature's estimate below the threshold at which a pair still passes.
SLACK = 4.0
#: Rows of a tile of a large node; rows and shingles of a tile of a large candidate group; and the
#: number of tiles that a group of medium size is cut into at most, so that its verification
#: spreads over tasks. (A node has one in each tree.)
TILE, GROUP_TILE, TILE_SHINGLES, SMALL_TILE, SPREAD = 256, 768, 500_000, 64, 12


def prefix_length(threshold: float, trees: int = TREES, depth: int = DEPTH, target: float = LEAST) -> int:
    """The longest prefix at which a pair of that similarity shares it in some tree with the target recall:
    no input needs a shorter one."""
    for k in range(depth, 1, -1):
        if 1 - (1 - threshold**k) ** trees >= target:
            return k
    return 1


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 250_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        return h


_ODD = np.random.default_rng(11).integers(0, 2**63, (HASHES, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, known: _WordHashes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of n words."""
    words = WORD_RE.findall(text)
    h = np.fromiter((known[w] for w in words), np.uint64, len(words))
    if not len(h):
        return h
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = (out ^ h[i : len(h) - width + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """Minimum of each hash function over the set; all ones for the empty set."""
    out = np.full(HASHES, 2**32 - 1, np.uint32)
    for low in range(0, len(s), 1024):
        mixed = (s[None, low : low + 1024] * _ODD[:, :1] + _ODD[:, 1:]) >> np.uint64(32)
        np.minimum(out, mixed.min(1).astype(np.uint32), out=out)
    return out


def key_of(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def keyed(docs: DataFrame, id_col: str, text_col: str, whole: bool = False) -> DataFrame:
    """id, key of the shingle set, its size and the signature, for every row; with `whole`, all
    columns of docs too, as c0, c1 and so on, and a number of the row."""
    fields = docs.schema.fields if whole else []
    own = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("key", T.BinaryType()), T.StructField("shingles", T.LongType()), T.StructField("sig", T.BinaryType())])
    for i, f in enumerate(fields):
        own = own.add(f"c{i}", f.dataType, True)
    own = own.add("row", T.LongType()) if whole else own
    # a column may stand twice: names do not matter here
    narrow = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), *(F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(fields)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept_by_worker("ngrams").setdefault("words", _WordHashes())
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            keys, sizes, signatures = [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), known)
                keys.append(key_of(s))
                sizes.append(len(s))
                signatures.append(signature(s).astype("<u4").tobytes())
            arrays = [batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signatures, pa.binary()), *batch.columns[2:]]
            if whole:
                arrays.append(pa.array(range(at, at + len(keys)), pa.int64()))
                at += len(keys)
            yield pa.RecordBatch.from_arrays(arrays, own.names)

    return narrow.mapInArrow(run, own)


def _dealt(df: DataFrame, group: str, key: str, tiles, parts: int, keep: list[str], order: list[str]) -> DataFrame:
    """Deal rows of groups to the tasks of all pairs of the group's tiles."""
    dealt = df.withColumn("tiles", tiles.cast("int")).withColumn("tile", F.pmod(F.xxhash64(key), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select(group, F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", *keep)
    return dealt.repartition(parts, group, "low", "high").sortWithinPartitions(group, "low", "high", *order)


def nodes(rest: np.ndarray) -> np.ndarray:
    """For sorted rows (n, hashes) of a subtree: number of the node that each row stands in, by
    depth below the subtree's root, from the root down (a run of rows is a node)."""
    n, depth = rest.shape
    same = np.ones((n, depth + 1), bool)
    same[1:, 1:] = np.logical_and.accumulate(rest[1:] == rest[:-1], axis=1)
    same[0] = False
    return np.cumsum(~same, axis=0).T - 1


def met_pairs(rest: np.ndarray, tile: np.ndarray, two: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    """(depth, row, later rows) of the pairs whose deepest shared node has that depth below the
    subtree's root, deepest nodes first; with `two`, pairs of different tiles only."""
    n, depth = rest.shape
    of = nodes(rest)
    ends = [np.searchsorted(of[d], of[d], "right") for d in range(depth + 1)]
    for d in range(depth, -1, -1):
        starts = ends[d + 1] if d < depth else np.arange(n) + 1
        for i in np.flatnonzero(starts < ends[d]).tolist():
            later = np.arange(starts[i], ends[d][i])
            if two:
                later = later[tile[later] != tile[i]]
            if len(later):
                yield d, i, later


def shortened(stats: dict[int, tuple[float, float]], least: int, depth: int = DEPTH, target: float = TARGET) -> int:
    """The prefix at which shortening stops: the longest that misses no more than the target allows.
    stats: for each prefix, links and links missed by it, as the pairs met tell of them."""
    for k in range(depth, least, -1):
        links, missed = stats.get(k, (0.0, 0.0))
        if missed <= (1 - target) * links:
            return k
    return least


def forest_edges(classes: DataFrame, threshold: float, parts: int) -> DataFrame:
    """classes (key, sig) -> edges (a, b, prefix), and per prefix the sums for shortened() (a null)."""
    k = prefix_length(threshold)
    width = DEPTH * 4
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    rows = classes.select("key", "sig", tree).select("key", F.expr(f"xxhash64(tree, substring(sig, tree * {width} + 1, {4 * k}))").alias("node"), F.expr(f"substring(sig, tree * {width} + {4 * k + 1}, {4 * (DEPTH - k)})").alias("rest"))
    shared = written(rows.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1").select(F.col("node").alias("p"), "size"), "nodes")
    members = written(rows.join(shared, F.col("node") == F.col("p")).select("node", "size", "key", "rest"), "members")
    # one byte of each hash is enough to tell whether it agrees
    thin = F.expr(f"unhex(array_join(transform(sequence(0, {HASHES - 1}), i -> hex(substring(sig, i * 4 + 1, 1))), ''))")
    members = members.join(classes.select(F.col("key").alias("k"), thin.alias("thin")), F.col("key") == F.col("k")).select("node", "size", "key", "rest", "thin")
    least = threshold - SLACK * float(np.sqrt(threshold * (1 - threshold) / HASHES))
    depths = np.arange(k, DEPTH + 1)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[bytes, bytes, int]] = []
        links, missed = 0.0, np.zeros(len(depths))
        for (_, low, high), group in runs(batches, 3):
            keys = [r[1] for r in group]
            tile = np.array([r[0] for r in group])
            sig = np.frombuffer(b"".join(r[3] for r in group), np.uint8).reshape(len(group), HASHES)
            rest = np.frombuffer(b"".join(r[2] for r in group), "<u4").reshape(len(group), DEPTH - k)
            forest = LocalForest(len(group))
            for d, i, later in met_pairs(rest, tile, low != high):
                share = (sig[later] == sig[i]).mean(1)
                good = share >= least
                if not good.any():
                    continue
                # a link of similarity s shares a prefix of j hashes in TREES * s^j trees on average, and in
                # none with probability (1 - s^j)^TREES; at the shortest prefix nearly every link is met
                p = np.maximum(share[good], threshold)[:, None] ** depths
                each = 1 / (TREES * p[:, 0])
                links += each.sum()
                missed += each @ (1 - p) ** TREES
                for j in later[good].tolist():
                    if forest.union(i, j):
                        out.append((keys[i], keys[j], k + d))
            if len(out) > 5000:
                yield _rows(out, [])
                out = []
        yield _rows(out, [(d, links, m) for d, m in zip(depths.tolist(), missed.tolist())])

    def _rows(edges: list, stats: list) -> pa.RecordBatch:
        rows = [(a, b, d, None, None) for a, b, d in edges] + [(None, None, d, x, y) for d, x, y in stats]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.binary(), pa.int32(), pa.float64(), pa.float64()))], ["a", "b", "prefix", "links", "missed"])

    size = F.greatest(F.ceil(F.col("size") / TILE), F.lit(1))
    dealt = _dealt(members, "node", "key", size, parts, ["key", "rest", "thin"], ["rest", "key"])
    return written(dealt.mapInArrow(meet, "a binary, b binary, prefix int, links double, missed double"), "forest")


def candidate_groups(classes: DataFrame, threshold: float, parts: int, target: float = TARGET) -> DataFrame:
    """classes (key, sig) -> (node, root) of groups of candidates."""
    found = forest_edges(classes, threshold, parts)
    # one row for each prefix
    stats = {r.prefix: (r.links or 0.0, r.missed or 0.0) for r in found.filter("a is null").groupBy("prefix").agg(F.sum("links").alias("links"), F.sum("missed").alias("missed")).collect()}
    prefix = shortened(stats, prefix_length(threshold), target=target)
    return components(found.filter(F.col("a").isNotNull() & (F.col("prefix") >= prefix)).select("a", "b"))


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs, over bounded parts of the shingles."""
    n = len(sets)
    out = np.zeros((n, n), np.float32)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    every = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    fresh = np.r_[True, every[1:] != every[:-1]] if len(every) else np.zeros(0, bool)
    column = np.cumsum(fresh) - 1
    shared = np.bincount(column)[column] > 1 if len(every) else fresh
    column, owner = column[shared], owner[shared]
    if len(column):
        column = np.cumsum(np.r_[True, column[1:] != column[:-1]]) - 1
        for low in range(0, int(column[-1]) + 1, 8192):
            a, b = np.searchsorted(column, [low, low + 8192])
            part = np.zeros((n, min(8192, int(column[-1]) + 1 - low)), np.float32)
            part[owner[a:b], column[a:b] - low] = 1
            out += part @ part.T
    return out


def verified(docs: DataFrame, classes: DataFrame, groups: DataFrame, threshold: float, parts: int, id_col: str, text_col: str) -> DataFrame:
    """(key, linked, b): counts of links (b null) and a spanning forest of links."""
    whole = groups.union(groups.select("root", "root").distinct())
    placed = written(whole.join(classes.select("key", "first_id", "n", "shingles"), F.col("node") == F.col("key")).select("key", "first_id", "n", "root", "shingles"), "placed")
    sizes = written(placed.groupBy(F.col("root").alias("r")).agg(F.count("*").alias("size"), F.sum("shingles").alias("shingles")), "sizes")
    # rows and shingles of a tile are bounded; groups of medium size are cut into small tiles, to spread
    tiles = F.greatest(F.ceil(F.col("size") / GROUP_TILE), F.ceil(F.col("shingles") / TILE_SHINGLES), F.least(F.ceil(F.col("size") / SMALL_TILE), F.lit(SPREAD)))
    placed = placed.drop("shingles").join(sizes.select("r", tiles.cast("long").alias("size")), F.col("root") == F.col("r")).select("key", "first_id", "n", "root", "size")
    # the text of a class is that of any row with its first id and its key
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(placed, F.col("id").eqNullSafe(F.col("first_id"))).select("key", "n", "root", "size", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept_by_worker("ngrams").setdefault("words", _WordHashes())
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                own = [shingles(t, known) for t in part.column(4).to_pylist()]
                right = pa.array([key_of(s) == k for s, k in zip(own, part.column(0).to_pylist())])
                raw = pa.array([s.tobytes() for s in own], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:4], raw], ["key", "n", "root", "size", "raw"]).filter(right)

    found = texts.mapInArrow(sets, "key binary, n long, root binary, size long, raw binary")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, low, high), rows in runs(batches, 3):
            group = list({r[1]: r for r in rows}.values())  # rows of one id may repeat
            tile, keys, weight = np.array([r[0] for r in group]), [r[1] for r in group], np.array([r[2] for r in group])
            own = [np.frombuffer(r[3], np.uint64) for r in group]
            size = np.array([len(s) for s in own], np.float64)
            both = intersections(own).astype(np.float64)
            link = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
            link &= both > 0
            np.fill_diagonal(link, False)
            if low != high:
                link &= tile[:, None] != tile[None, :]
            counts = link @ weight
            forest, edges = LocalForest(len(group)), []
            for i in range(len(group)):
                for j in np.flatnonzero(link[i, i + 1 :]) + i + 1:
                    if forest.union(i, int(j)):
                        edges.append((i, int(j)))
            out = [(keys[i], int(counts[i]), None) for i in np.flatnonzero(counts)] + [(keys[i], 0, keys[j]) for i, j in edges]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.binary())], ["key", "linked", "b"])

    dealt = _dealt(found, "root", "key", F.col("size"), parts, ["key", "n", "raw"], [])
    return dealt.mapInArrow(verify, "key binary, linked long, b binary")


def jaccard_classes(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, key) of every row, and per class key, first_id, n_links, component_id."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    rows = written(keyed(docs, id_col, text_col), "rows") if rows is None else rows
    classes = written(rows.groupBy("key").agg(F.min("id").alias("first_id"), F.count("*").alias("n"), F.max("shingles").alias("shingles"), F.max("sig").alias("sig")), "classes")
    groups = candidate_groups(classes, threshold, parts)
    found = written(verified(docs, classes, groups, threshold, parts, id_col, text_col), "links")
    table = class_table(classes, found.filter("b is null").select("key", "linked"), found.filter("b is not null").select(F.col("key").alias("a"), "b"))
    return rows.select("id", "key"), table


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_links (other documents at or above the threshold),
    component_id (smallest id reachable by links), kept (doc_id = component_id)."""
    rows, table = jaccard_classes(docs, threshold, id_col, text_col)
    table = written(table, "table")
    return rows.join(table.drop("first_id"), "key").select(F.col("id").alias("doc_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group: one with its smallest id. Rows that repeat that id
    within a group count as one (the least of their whole rows as JSON, so reruns agree);
    columns may be of any type. Whole rows are written once, with their keys and numbers, and
    shuffled once, by number."""
    tagged = written(keyed(docs, id_col, text_col, whole=True), "tagged")
    _, table = jaccard_classes(docs, threshold, id_col, text_col, tagged.select("id", "key", "shingles", "sig"))
    keepers = written(table.filter(F.col("first_id").eqNullSafe(F.col("component_id"))).select(F.col("key").alias("keep_key"), F.col("component_id").alias("keep_id")), "keepers")
    same = (F.col("key") == F.col("keep_key")) & F.col("id").eqNullSafe(F.col("keep_id"))
    each = written(tagged.groupBy("key", "id").agg(F.count("*").alias("n"), F.min("row").alias("row")).join(keepers, same).select("key", "id", "n", "row"), "each")
    columns = [f"c{i}" for i in range(len(docs.columns))]
    twice = each.filter("n > 1").select(F.col("key").alias("keep_key"), F.col("id").alias("keep_id"))
    ordered = tagged.join(twice, same).select("key", "id", "row", F.to_json(F.struct(*columns)).alias("json"))
    chosen = ordered.groupBy("key", "id").agg(F.min(F.struct("json", "row")).alias("least")).select(F.col("least.row").alias("row"))
    rows = each.filter("n = 1").select("row").union(chosen)
    return tagged.join(rows, "row", "left_semi").select(*(F.col(c).alias(name) for c, name in zip(columns, docs.columns)))
