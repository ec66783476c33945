import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from brooklet.llm import embeddings, graph, ngram_join

from . import edge

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def groups(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_jaccard(rows, threshold=0.8):
    """n_links and group (a position) of each row, by an inverted index."""
    sets = [shingles(t) for _, t in rows]
    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s or [None]:
            by[x].append(i)
    both = Counter()
    for owners in by.values():
        for a, i in enumerate(owners):
            for j in owners[a + 1 :]:
                both[i, j] += 1
    links = [(i, j) for (i, j), n in both.items() if not sets[i] or n >= threshold * (len(sets[i]) + len(sets[j]) - n) - 1e-9]
    count = Counter(i for link in links for i in link)
    return [count[i] for i in range(len(rows))], groups(range(len(rows)), links)


def expect(rows, ids):
    count, root = plain_jaccard(rows)
    least = {}
    for i, r in root.items():
        if ids[i] is not None:
            least[r] = min(least.get(r, ids[i]), ids[i])
    return Counter((ids[i], count[i], least.get(root[i]), ids[i] == least.get(root[i])) for i in range(len(rows)))


@pytest.mark.parametrize("which", ["edge", "documents"])
def test_jaccard_join_is_whole(spark, which):
    docs = edge.frame(spark) if which == "edge" else spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = expect(rows, [r[0] for r in rows])
    got = ngram_join.near_duplicates(docs)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_links", "component_id", "kept").collect()) == want
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(plain_jaccard(rows)[1].values()))


def test_jaccard_hot_group(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(400)]
    base = list(rng.choice(words, 120))
    rows = []
    for i in range(700):  # more than two tiles of near copies, none equal
        own = list(base)
        own[int(rng.integers(120))] = f"x{i}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, rows[0][1]) for i in range(300)] + [(2000 + i, " ".join(rng.choice(words, 60))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = ngram_join.near_duplicates(docs)
    assert Counter(tuple(r) for r in got.collect()) == expect(rows, [r[0] for r in rows])


def test_prefix_reaches_the_target():
    for t in (0.5, 0.8, 0.95):
        k = ngram_join.prefix_length(t)
        assert k == 1 or 1 - (1 - t**k) ** ngram_join.TREES >= ngram_join.LEAST
    assert ngram_join.prefix_length(0.8) > ngram_join.prefix_length(0.5)


def test_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 20000, n).astype(np.uint64)) for n in (0, 1, 5000, 9000, 15000, 15000)]
    got = ngram_join.intersections(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            shared = len(np.intersect1d(a, b))
            assert got[i, j] == shared or i == j


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(i, i + 1) for i in range(200, 260)] + [(0, i) for i in range(1, 100)] + rng.integers(300, 400, (60, 2)).tolist() + [(5, 5)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame([tuple(map(int, x)) for x in links], "a long, b long")).collect()}
    want = groups({n for x in links for n in x}, links)
    assert got == {n: r for n, r in want.items() if n != r}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_cosine(rows, threshold=0.9):
    good = [i for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    x = {i: np.array(rows[i][1], np.float64) for i in good}
    x = {i: v / np.linalg.norm(v) for i, v in x.items()}
    links = [(i, j) for a, i in enumerate(good) for j in good[a + 1 :] if len(x[i]) == len(x[j]) and x[i] @ x[j] >= threshold]
    count, root = Counter(i for link in links for i in link), groups(range(len(rows)), links)
    least = {}
    for i, r in root.items():
        least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    return Counter((rows[i][0], count[i], least[root[i]], rows[i][0] == least[root[i]]) for i in range(len(rows)))


@pytest.mark.parametrize("tile", [8192, 100])
def test_embedding_join_is_whole(spark, tile):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    got = embeddings.near_duplicates(vectors, tile_rows=tile)
    assert Counter(tuple(r) for r in got.collect()) == plain_cosine(rows)


def test_embedding_edges(spark):
    near = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, near), (2, near), (2, near), (3, [2.0, 4.0, 6.0, 8.0]), (4, None), (5, []), (6, [0.0] * 4), (7, [1.0, None, 1.0, 1.0]), (8, [float("nan")] * 4), (9, [float("inf"), 1.0, 1.0, 1.0]), (10, [1.0, 2.0, 3.0]), (11, [1e-200, 2e-200, 3e-200, 4e-200]), (12, [-1.0, -2.0, -3.0, -4.0]), (13, [1.0, 2.0, 3.0])]
    got = embeddings.near_duplicates(spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<double>, label int, n_links int"))
    want = plain_cosine([(i, v) if i != 11 else (i, near) for i, v in rows])
    assert Counter(tuple(r) for r in got.collect()) == want
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_pigeonhole_loses_nothing():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(300, 50))
    a = np.vstack([a, a[:100] + rng.normal(size=(100, 50)) * 0.35, a[:100]])
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    got = {(int(i), int(j)) for p, q in embeddings.tile_links(a, a, 0.9, True, step=128) for i, j in zip(p, q)}
    s = a @ a.T
    assert got == {(i, j) for i, j in np.argwhere(s >= 0.9).tolist() if i != j}


def test_pairs_meet_at_their_deepest_node():
    rng = np.random.default_rng(3)
    rest = rng.integers(0, 3, (200, 3)).astype(np.uint32)
    rest = rest[np.lexsort(rest.T[::-1])]
    tile = rng.integers(0, 2, 200)
    for two in (False, True):
        got = [(d, i, int(j)) for d, i, later in ngram_join.met_pairs(rest, tile, two) for j in later]
        depth = lambda i, j: next((d for d in range(3) if rest[i, d] != rest[j, d]), 3)
        want = {(depth(i, j), i, j) for i in range(200) for j in range(i + 1, 200) if not two or tile[i] != tile[j]}
        assert len(got) == len(want) and set(got) == want and [d for d, _, _ in got] == sorted((d for d, _, _ in got), reverse=True)


def test_prefixes_shorten_until_the_target():
    least, trees = ngram_join.prefix_length(0.8), ngram_join.TREES
    stats = lambda s: {k: (100.0, 100 * (1 - s**k) ** trees) for k in range(least, ngram_join.DEPTH + 1)}
    stops = [ngram_join.shortened(stats(s), least) for s in (0.8, 0.83, 0.85, 0.86, 0.87, 0.88, 0.9, 1.0)]
    assert stops == sorted(stops) and stops[0] == least and stops[-1] == ngram_join.DEPTH and len(set(stops)) > 2
    assert ngram_join.shortened({}, least) == ngram_join.DEPTH


def test_prefixes_follow_the_data(spark):
    """Copies with one word changed need no short prefix; texts near the threshold do."""
    rng, least = np.random.default_rng(5), ngram_join.prefix_length(0.8)

    def stop(changes: int) -> int:
        rows = []
        for i in range(60):
            words = [f"w{w}" for w in rng.integers(0, 10**6, 300)]
            rows.append((2 * i, " ".join(words)))
            for at in np.linspace(10, 290, changes).astype(int):
                words[at] = "new"
            rows.append((2 * i + 1, " ".join(words)))
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        classes = ngram_join.keyed(docs, "doc_id", "text")
        found = ngram_join.forest_edges(classes, 0.8, 4)
        stats = {r.prefix: (r.links, r.missed) for r in found.filter("a is null").groupBy("prefix").agg(F.sum("links").alias("links"), F.sum("missed").alias("missed")).collect()}
        assert abs(stats[least][0] - 60) < 15  # the links there are
        return ngram_join.shortened(stats, least)

    assert stop(1) > stop(6) >= least


def test_keep_one_bears_columns_of_any_type(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, {"a": 2}, [1.5], b"x"), (1, text, {"a": 1}, None, b"y"), (2, text, None, [], None), (None, None, {}, [], b""), (3, "", None, None, None), (4, "other words", {"b": None}, [2.0], b"z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, l array<double>, b binary")
    got = ngram_join.keep_one(docs)
    assert got.schema.simpleString() == docs.schema.simpleString()
    kept = {(r.doc_id, None if r.m is None else tuple(r.m.items())) for r in got.collect()}
    assert kept == {(1, (("a", 1),)), (3, None), (4, (("b", None),))}
    twice = docs.select("doc_id", "text", *(["m"] * 2))
    assert ngram_join.keep_one(twice.toDF("doc_id", "text", "m", "m2")).count() == 3
