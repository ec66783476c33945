import pathlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from brooklet.llm import lm, queries
from brooklet.plans import lineage

from . import edge


def plain(rows):
    """The contract's counts and base score."""
    tokens = {}
    for n, (_, text) in enumerate(rows):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        tokens[n] = [*re.findall(r"[^\x20\x09-\x0D]+", low), None]
    train = [zlib.crc32((str(i) if i is not None else "").encode()) % 5 != 1 for i, _ in rows]
    count = Counter(t for n, own in tokens.items() if train[n] for t in own)
    total, kinds = sum(count.values()), len(count)
    out = Counter()
    for n, (i, _) in enumerate(rows):
        base = sum(np.log10((count[t] + 0.5) / (total + 0.5 * (kinds + 1))) for t in tokens[n])
        out[i, not train[n], len(tokens[n]), sum(count[t] > 0 for t in tokens[n]), total, round(base, 4)] += 1
    return out


@pytest.mark.parametrize("which", ["edge", "documents"])
def test_counts_and_base(spark, sf, which):
    docs = edge.frame(spark) if which == "edge" else spark.read.parquet(f"{sf}/documents.parquet")
    got = lm.scores(docs, queries.crc_mod("doc_id", 5) != 1, chunk_bytes=50_000).collect()
    assert Counter((r.doc_id, not r.train, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == plain([(r.doc_id, r.text) for r in docs.collect()])
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)


def test_beats_the_base_on_held_out_texts(spark):
    got = queries.op6_lm(spark, "/root/testdata/sf0.01").filter("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_reruns_agree(spark, sf):
    key = lambda: {r.doc_id: r.score for r in queries.op6_lm(spark, sf).collect()}
    assert key() == key()


def test_stirling_numbers():
    s = np.exp(lm.stirling(0.5, 6))
    assert s[3, 1] == pytest.approx(0.5 * 1.5) and s[3, 2] == pytest.approx(1.5) and s[3, 3] == pytest.approx(1)


def test_seating_has_the_conditional_distribution():
    rng, d, a = np.random.default_rng(0), 0.7, 0.8
    log_s = lm.stirling(d)
    draws = lm.seat(rng, np.full(200_000, 5), np.full(200_000, a), d, log_s)
    want = np.exp(log_s[5, 1:6] + np.log(a) * np.arange(1, 6))
    assert np.allclose(np.bincount(draws, minlength=6)[1:] / 200_000, want / want.sum(), atol=5e-3)
    assert lm.seat(rng, np.array([0, 1, 2, 100_000]), np.ones(4), d, log_s)[:2].tolist() == [0, 1]


def _buckets(n):
    rng = np.random.default_rng(1)
    words = [f"w{int(x)}" for x in rng.zipf(1.3, 40_000) % 3000]
    texts = [" ".join(words[i : i + 100]) for i in range(0, len(words), 100)]
    chunks = [lm.Chunk(part, n) for part in (texts[:150], texts[150:])]
    blocks = [dict(c.blocks(np.ones(len(c.lengths)))) for c in chunks]
    return [lm.Bucket([b[i] for b in blocks if i in b]) for i in range(n)]


def _totals(buckets):
    """Totals of all buckets as they stand, and for each bucket those of its own contexts."""
    out = {"v": sum(b.n_words for b in buckets)}
    for b in buckets:
        for k, v in b.sums().items():
            if k != "t3":
                out[k] = out.get(k, 0) + v
    tables, customers = Counter(), Counter()
    for b in buckets:
        for key, c, t in zip(b.keys.tolist(), *b.own_totals([b.c3, b.t3]).tolist()):
            customers[key] += c
            tables[key] += t
    each = [{"c3": np.array([customers[k] for k in b.keys.tolist()]), "t3": np.array([tables[k] for k in b.keys.tolist()])} for b in buckets]
    return out, each


def test_probabilities_sum_to_one_in_every_context():
    """Several buckets, several sweeps between exchanges, and totals of the last seating."""
    buckets, log_s = _buckets(3), [lm.stirling(d) for d in lm.DISCOUNT]
    for pass_ in range(3):
        total, each = _totals(buckets)
        for b, own in zip(buckets, each):
            b.sweeps(total | own, log_s, [pass_ << 8 | i for i in range(3)])
            assert all((t >= (c > 0)).all() and (t <= c).all() for t, c in ((b.t3, b.c3), (b.t2, b.c2), (b.t1, b.c1), (b.t0, b.c0)))
    total, each = _totals(buckets)
    (s0, s1, s2, s3), (d0, d1, d2, d3) = lm.STRENGTH, lm.DISCOUNT
    levels = [b.probabilities(total) for b in buckets]
    unknown = (s0 + d0 * total["t0"]) / (total["v"] + 1) / (s0 + total["c0"])
    assert sum(p0.sum() for _, _, p0 in levels) + unknown == pytest.approx(1, abs=1e-9)
    p1_all = {g: unknown for g in range(lm.PARENTS)}  # mass of every word that a parent has not served, by its root
    back1 = (s1 + d1 * total["t1"]) / (s1 + total["c1"])
    for g in range(lm.PARENTS):
        own = [(b.context1 == g, b, p) for b, p in zip(buckets, levels)]
        rest = 1 - sum(p[2][b.word1[m]].sum() for m, b, p in own)
        p1_all[g] = sum(p[1][m].sum() for m, b, p in own) + back1[g] * rest
        assert p1_all[g] == pytest.approx(1, abs=1e-9)
    back2 = (s2 + d2 * total["t2"]) / (s2 + total["c2"])
    # leaf contexts: what they have served, and through their class, its parent and the root, all else
    p2_of, p1_of, p0_of, leaf = {}, {}, {}, {}
    for n, (b, own, (p2, p1, p0)) in enumerate(zip(buckets, each, levels)):
        p2_of |= {(n, w, g): p for w, g, p in zip(b.word2.tolist(), b.context2.tolist(), p2)}
        p1_of |= {(n, w, g): p for w, g, p in zip(b.word1.tolist(), b.context1.tolist(), p1)}
        p0_of |= {(n, w): p for w, p in enumerate(p0)}
        for key, w, p in zip(b.keys[b.context3].tolist(), b.word3.tolist(), b.leaves(total | own)):
            leaf.setdefault(key, {})[n, w] = p
    counts = {k: (c, t) for b, own in zip(buckets, each) for k, c, t in zip(b.keys.tolist(), own["c3"].tolist(), own["t3"].tolist())}
    for key in list(leaf)[:: max(1, len(leaf) // 200)]:
        g = int(key) >> lm.HASH_BITS
        h = g // lm.CHILDREN
        c, t = counts[key]
        back3, mass = (s3 + d3 * t) / (s3 + c), 0.0
        for word, p0 in p0_of.items():
            p1 = p1_of.get((*word, h), back1[h] * p0)
            p2 = p2_of.get((*word, g), back2[g] * p1)
            mass += leaf[key].get(word, back3 * p2)
        assert mass + back3 * back2[g] * back1[h] * unknown == pytest.approx(1, abs=1e-6)


def test_a_draw_leaves_its_own_tables_out():
    """One pair alone: its own seats must not tell it where to sit."""
    chunk = lm.Chunk(["a b"] * 30, 1)
    log_s = [lm.stirling(d) for d in lm.DISCOUNT]
    seen = Counter()
    for i in range(2000):
        bucket = lm.Bucket([dict(chunk.blocks(np.ones(30)))[0]])
        total, (own,) = _totals([bucket])
        at = int(np.flatnonzero(bucket.c3 == 30)[0])
        for start in (1, 20):
            bucket.t3[at] = start
            bucket.refeed()
            total, (own,) = _totals([bucket])
            bucket.sweep(i, total | own, log_s)
            seen[start, int(bucket.t3[at])] += 1
    means = [sum(t * n for (s, t), n in seen.items() if s == start) / 2000 for start in (1, 20)]
    assert means[0] == pytest.approx(means[1], rel=0.15)


def test_gaps_round_trip():
    keys = np.unique(np.random.default_rng(2).integers(0, 2**48, 1000).astype(np.uint64))
    assert (lm._of_gaps(lm._gaps(keys)) == keys).all() and len(lm._of_gaps(lm._gaps(keys[:0]))) == 0


def test_empty_table(spark):
    assert lm.scores(edge.empty(spark), queries.crc_mod("doc_id", 5) != 1).count() == 0


def test_contexts_are_preceding_words():
    # bat and cat share their ending, and so their class; only the words themselves tell what follows
    texts = ["bat one"] * 50 + ["cat two"] * 50
    chunk = lm.Chunk(texts, 1)
    bucket = lm.Bucket([dict(chunk.blocks(np.ones(len(texts))))[0]])
    assert len(bucket.keys) == 5 and lm.class_of(b"bat") == lm.class_of(b"cat")


def test_the_word_before_tells_what_follows(spark):
    rows = [(i, "bat one" if i % 2 else "cat two") for i in range(400)] + [(1000, "bat one"), (1001, "bat two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in lm.scores(docs, queries.F.col("doc_id") < 1000, chunk_bytes=500).filter("doc_id >= 1000").collect()}
    assert got[1000] > got[1001] + 1


def test_scores_do_not_depend_on_buckets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(200)
    few, many = ({r.doc_id: r.score for r in lm.scores(docs.repartition(n, "doc_id"), queries.crc_mod("doc_id", 5) != 1).collect()} for n in (2, 7))
    assert few == pytest.approx(many, rel=1e-5)


def test_keyed_numbers_have_their_distributions():
    keys = lm.mixed(np.arange(100_000, dtype=np.uint64))
    got = lm.normal(keys)
    assert abs(got.mean()) < 0.02 and got.var() == pytest.approx(1, rel=0.03) and np.mean(got < 1) == pytest.approx(0.8413, abs=0.01)
    log_s = lm.stirling(0.7)
    draws = lm.seat(None, np.full(len(keys), 5), np.full(len(keys), 0.8), 0.7, log_s, keys)
    want = np.exp(log_s[5, 1:6] + np.log(0.8) * np.arange(1, 6))
    assert np.allclose(np.bincount(draws, minlength=6)[1:] / len(keys), want / want.sum(), atol=8e-3)


def test_totals_settle_only_when_no_level_moves():
    start = {k: np.full(2, 1e6) for k in ("c2", "t2", "c1", "t1", "c0", "t0")}
    assert lm.settled(start, start, 0.01) and not lm.settled(start, start | {"c1": np.full(2, 1.05e6)}, 0.01)


def test_words_are_those_of_bytes():
    rng = random.Random(4)
    texts = ["", "  ", "a", "A b\t\x0bC\x0c\n", "é É x y Z\x1fq\x1c", *("".join(rng.choice("aB éİ\n\t\x00\u3000😀\x85") for _ in range(rng.randrange(40))) for _ in range(500))]
    words, tokens, lengths = lm.numbered(pa.array(texts))
    split = [t.encode().lower().split() for t in texts]
    assert [words[i] for i in tokens.tolist()] == [w for own in split for w in (*own, lm.END)]
    assert lengths.tolist() == [len(own) + 1 for own in split]
    assert (lm.keys_of(words) >> np.uint64(lm.HASH_BITS)).tolist() == [lm.class_of(w) for w in words]


@pytest.mark.parametrize("d", [0.6, 0.8])
@pytest.mark.parametrize("c", [100, 400])
def test_many_customers_are_seated_as_by_the_exact_conditional(c, d):
    n, whole = 4000, lm.stirling(d, 400)
    keys = np.arange(n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for theta, later, total in ((1, 0.05, 1e4), (50, 30, 1e3), (1000, 200, 5e3), (5000, 2000, 1e4)):
        cost = lm.Cost(d, *(np.full(n, float(x)) for x in (theta, later, later, total)))
        w = whole[c, 1 : c + 1] + cost.logs(np.array([0]), c)[0].cumsum()
        w = np.exp(w - w.max()) / np.exp(w - w.max()).sum()
        t = np.arange(1, c + 1)
        mean = (w * t).sum()
        spread = ((w * t * t).sum() - mean * mean) ** 0.5
        got = lm.seat(None, np.full(n, c), cost, d, lm.stirling(d), keys)
        assert abs(got.mean() - mean) < 0.04 * mean + 0.25, (theta, later, got.mean(), mean)
        assert abs(got.std() - spread) < 0.15 * spread + 0.1, (theta, later, got.std(), spread)


def test_texts_round_trip():
    chunk = lm.Chunk(["b a b a", "", "a", " ".join(f"w{i * 7 % 300}" for i in range(5000))], 4)
    got = lm._texts_unpacked(lm._texts_packed(chunk.pair_of, chunk.lengths), chunk.lengths)
    cuts = np.cumsum(chunk.lengths)[:-1]
    assert all(sorted(a.tolist()) == b.tolist() for a, b in zip(np.split(chunk.pair_of, cuts), np.split(got, cuts)))


def test_passes_leave_nothing_behind(spark, sf):
    """Before the scores are taken, disk holds the chunks and their answers only."""
    place = pathlib.Path(lineage.shared_dir(spark).removeprefix("file:"))
    before = set(place.iterdir())
    got = lm.scores(spark.read.parquet(f"{sf}/documents.parquet"), queries.crc_mod("doc_id", 5) != 1)
    assert {p.name.split("-")[1] for p in set(place.iterdir()) - before if not p.name.startswith(".")} == {"chunks", "answers"}
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
