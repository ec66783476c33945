"""LM scoring: a hierarchical Pitman-Yor model over preceding words, sampled by Gibbs.

The next word is drawn in the restaurant of the word before it. Its parent is the class
of that word (its ending: two letters, hashed to CLASSES), whose parent is a coarser class
(PARENTS of them share the root), whose parent serves all words; the root's base is uniform
over the training vocabulary and one unknown word. A context's table counts are its
parent's customers. There is a restaurant for every distinct preceding word, so contexts
grow with the corpus; they are told apart by class and hashes of 38 bits.

All pairs of a word sit in one bucket, so seating is sampled bucket by bucket:

1. `cut` reads documents in chunks of bounded size and sends each bucket one block:
   the chunk's words of that bucket and their counts per preceding word.
2. Buckets add up the blocks to a state. A Gibbs sweep takes the tables of every (context,
   word) out of its own context and of its parent, and draws their number anew given all
   others, level by level. A bucket sweeps several times between exchanges of the contexts'
   totals. Totals of a preceding word are summed over buckets by a shuffle; those of the
   classes, a fixed number of them, come to the driver. Passes go on until the totals of
   every level settle; random numbers are keyed by word, context and sweep, so results do
   not depend on buckets.
   One customer always has one table, so the state has pairs of two customers or more,
   and of the others only how many customers they send to each class.
3. A last pass takes samples, and predictive probabilities are averaged over them, each
   with the totals of all buckets for that very sample; so those of a context sum to 1.
   Every block is answered, in ANSWERED parts one after the other, and chunks meet their answers and
   score their documents. What is not read again is deleted before the next step.

The number of tables t for c customers has conditional weight S_d(c, t), generalised
Stirling numbers, times the rising products of what each further table costs in its context
and in the parent. It is drawn from that exactly for up to EXACT customers, beyond them from
its saddle point form (laplace), whose mean was 0 to 9 % below the exact one (3.65 for 4.01 at worst).

The model and all counts come from every training document, and every text is scored
whole. Null and empty texts are one end token. Ids may repeat or be null.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from brooklet.llm.common import kept_by_worker, runs, text_or_empty, written
from brooklet.plans.lineage import dropped, released

PARENTS, CHILDREN = 32, 32
CLASSES = PARENTS * CHILDREN
END = b""
EXACT = 96
#: Customers up to which counts are drawn together, in arrays of that width.
WIDTHS = (2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 28, 40, 64, EXACT)
HASH_BITS = 38
CHUNK_BYTES = 12_000_000
#: Parts in which blocks are answered, one after the other, so that their second shuffle is on disk in parts only.
ANSWERED = 3
#: Share by which totals may still move from pass to pass when they count as settled.
SETTLED = 0.02
#: Discount, strength and start (see Bucket.open) from the root down.
DISCOUNT = (0.6, 0.7, 0.8, 0.8)
STRENGTH = (5.0, 2.0, 1.0, 1.0)
START = (0.45, 0.57, 0.66, 0.4)


def _packed(x) -> bytes:
    return zstandard.compress(pickle.dumps(x, 5), 3)


def _unpacked(raw: bytes):
    return pickle.loads(zstandard.decompress(raw))


def numbered(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words (the end first), the number of each token with an end after every text, tokens of each text.
    Words are those of bytes: A-Z in lower case, cut at ASCII white space."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, text_of = pc.list_flatten(split), pc.list_parent_indices(split)
    full = pc.not_equal(flat, "")  # white space at an end of a text leaves an empty piece there
    flat, text_of = flat.filter(full).dictionary_encode(), text_of.filter(full).to_numpy()
    tokens = np.zeros(len(flat) + len(texts), np.int32)
    tokens[np.arange(len(flat)) + text_of] = flat.indices.to_numpy() + 1
    words = [END, *flat.dictionary.cast(pa.binary()).to_pylist()]
    return words, tokens, np.bincount(text_of, minlength=len(texts)).astype(np.int64) + 1


def class_of(word: bytes) -> int:
    return zlib.crc32(word[-1:]) % PARENTS * CHILDREN + zlib.crc32(word[-2:]) % CHILDREN


@cache
def _classes() -> np.ndarray:
    """Classes by the last byte, then by the last two (65,536 numbers from 256 on)."""
    return np.array([class_of(bytes([i])) for i in range(256)] + [class_of(bytes(divmod(i, 256))) for i in range(65536)], np.uint64)


def keys_of(words: list[bytes]) -> np.ndarray:
    """What tells words apart as contexts: their class, then 38 bits of a hash. Of 10^7 words, about one pair shares a key."""
    raw = np.frombuffer(b"\0\0" + b"".join(words), np.uint8).astype(np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size) + 1
    classes = _classes()[np.where(size > 1, 256 + raw[ends - 1] * 256 + raw[ends], raw[ends])]
    classes[size == 0] = class_of(END)
    return (classes << np.uint64(HASH_BITS)) | (np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) >> np.uint64(64 - HASH_BITS))


def _gaps(keys: np.ndarray) -> bytes:
    """Ascending keys as bytes of their gaps, by place value, which pack well."""
    gaps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return gaps.view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()


def _of_gaps(raw: bytes) -> np.ndarray:
    gaps = np.zeros((len(raw) // 6, 8), np.uint8)
    gaps[:, :6] = np.frombuffer(raw, np.uint8).reshape(6, -1).T
    return np.cumsum(gaps.view("<u8")[:, 0], dtype=np.uint64)


def _texts_packed(pair_of: np.ndarray, lengths: np.ndarray) -> bytes:
    """Pairs of each text as bytes of the gaps between them, by place value. They stand in ascending order, as sums over a text need no other."""
    own = np.sort(np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths) << np.uint64(32) | pair_of) & np.uint64(2**32 - 1)
    starts = np.r_[0, np.cumsum(lengths, dtype=np.int64)[:-1]]
    gaps = np.diff(own, prepend=np.uint64(0))
    gaps[starts] = own[starts]
    return gaps.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _texts_unpacked(raw: bytes, lengths: np.ndarray) -> np.ndarray:
    gaps = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4")[:, 0]
    sums = np.cumsum(gaps, dtype=np.int64)
    starts = np.r_[0, np.cumsum(lengths, dtype=np.int64)[:-1]]
    return sums - np.repeat(sums[starts] - gaps[starts], lengths)


class Chunk:
    """Tokens of some documents as distinct (word, word before) pairs. Words are numbered by
    bucket, and pairs by word, so what belongs to a bucket is a stretch of either."""

    def __init__(self, texts: list[str] | pa.Array, buckets: int):
        words, tokens, self.lengths = numbered(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        keys = keys_of(words)
        bucket = (keys % np.uint64(2**HASH_BITS) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        self.words, self.keys = [words[i] for i in order.tolist()], keys[order]
        tokens = rank[tokens]
        before = np.r_[rank[:1], tokens[:-1]]  # what stands before a text is the end of another
        self.pairs, pair_of = np.unique(tokens * len(words) + before, return_inverse=True)
        self.pair_of = pair_of.astype(np.uint32)
        self.of_word = np.bincount(self.pairs // len(words), minlength=len(words)).astype(np.uint32)  # pairs of each word
        self.word_cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        self.pair_cuts = np.r_[0, np.cumsum(self.of_word, dtype=np.int64)][self.word_cuts]

    def blocks(self, train: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(bucket, block): words, contexts, and for each pair its word, context and training count."""
        counts = np.bincount(self.pair_of, np.repeat(train, self.lengths), len(self.pairs)).astype(np.int64)
        place = np.empty(len(self.words), np.int64)
        by_key = np.argsort(self.keys, kind="stable")
        place[by_key] = np.arange(len(by_key))  # contexts stand by key
        for b in np.flatnonzero(np.diff(self.word_cuts)).tolist():
            words, pairs = (slice(*cuts[b : b + 2]) for cuts in (self.word_cuts, self.pair_cuts))
            own, context = np.unique(place[self.pairs[pairs] % len(self.words)], return_inverse=True)
            own = by_key[own]
            yield b, _packed((b"\n".join(self.words[words]), _gaps(self.keys[own]), self.of_word[words], context.astype(np.uint16 if len(own) < 65536 else np.uint32), counts[pairs].astype(np.uint32)))


def stirling(d: float, most: int = EXACT) -> np.ndarray:
    """log S_d(c, t) for c, t up to most; -inf outside."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(most + 1)
    for c in range(1, most + 1):
        stay = np.where(c - 1 - t * d > 0, np.log(np.maximum(c - 1 - t * d, 1e-300)), -np.inf) + out[c - 1]
        out[c] = np.logaddexp(stay, np.r_[-np.inf, out[c - 1][:-1]])
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that scatters (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(keys: np.ndarray, step: int) -> np.ndarray:
    """A number between 0 and 1 for each key and the step."""
    salt = np.uint64((step + 1) * 0x9E3779B97F4A7C15 % 2**64)
    return ((mixed(keys + salt) >> np.uint64(11)) + 0.5) * 2.0**-53


def normal(keys: np.ndarray) -> np.ndarray:
    """A standard normal number for each key."""
    return np.sqrt(-2 * np.log(uniform(keys, 1))) * np.cos(2 * np.pi * uniform(keys, 2))


def laplace(c: np.ndarray, d: float, cost, z: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Table counts for many customers, by the saddle point of their exact conditional.

    S_d(c, k + 1) is (c - 1)! / (k! d^k) times the coefficient of x^(c-1) in (1-x)^(d-1) (1 - (1-x)^d)^k. Its saddle
    point v = 1 - x belongs to k = ((c-1) / x - (1-d) / v) (1 - v^d) / (d v^(d-1)), and a step from k - 1/2 to k + 1/2
    multiplies it by (1 - v^d) / (d (k + 1/2)); with the cost of a table that is 1 at the mode. Around it k is normal (z), or
    Poisson (by inversion of u) if small. cost: of one more table, for an array of t."""

    def at(w):  # w = log(v / (1 - v))
        x, log_v = 1 / (1 + np.exp(w)), -np.logaddexp(0, -w)
        below = -np.expm1(d * log_v)
        k = np.clip(((c - 1) / x - (1 - d) * np.exp(-log_v)) * below / (d * np.exp((d - 1) * log_v)), -0.4999999, c - 1)
        return k, np.log(cost(np.maximum(k + 0.5, 1)) * below / (d * (k + 0.5)))

    low, high = np.full(len(c), -100.0), np.full(len(c), 30.0)
    for _ in range(44):
        middle = (low + high) / 2
        more = at(middle)[1] > 0
        low, high = np.where(more, middle, low), np.where(more, high, middle)
    k = at(high)[0]
    (k0, g0), (k1, g1) = at(high - 0.01), at(high + 0.01)
    spread2 = np.minimum(np.maximum(k1 - k0, 0) / np.maximum(g0 - g1, 1e-9), 2 * k + 1)
    mean = k + 0.5 * np.minimum(1, spread2 / np.maximum(k, 0.5))
    out = np.round(mean + np.sqrt(spread2) * z)
    few = np.flatnonzero(k < 16)
    rate = k[few, None] + 0.5
    mass = np.cumprod(np.c_[np.exp(-rate), rate / np.arange(1, 64)], 1).cumsum(1)
    out[few] = (u[few, None] > mass).sum(1)
    return 1 + np.clip(out, 0, c - 1).astype(np.int64)


class Cost:
    """What a further table costs, for each pair: the i-th one has weight (theta + d i) times the
    parent's predictive probability once i customers more sit there."""

    def __init__(self, d: float, theta: np.ndarray, base: np.ndarray, later: np.ndarray | None = None, total: np.ndarray | None = None):
        self.d, self.theta, self.base, self.later, self.total = d, theta, base, later, total

    def logs(self, part: np.ndarray, k: int) -> np.ndarray:
        i = np.arange(k)
        out = self.theta[part][:, None] + self.d * i
        if self.total is None:  # the base of all is fixed
            return np.log(out * self.base[part][:, None])
        up = self.later[part][:, None] + i
        up[:, 0] = self.base[part]
        return np.log(out * up / (self.total[part][:, None] + i))

    def more(self, part: np.ndarray):
        """What a table costs once t sit there."""
        theta, base = self.theta[part], self.base[part]
        if self.total is None:
            return lambda t: (theta + self.d * t) * base
        later, total = self.later[part], self.total[part]
        return lambda t: (theta + self.d * t) * (later + t) / (total + t)


def seat(rng: np.random.Generator | None, c: np.ndarray, a: "np.ndarray | Cost", d: float, log_s: np.ndarray, keys: np.ndarray | None = None) -> np.ndarray:
    """Table counts for c customers each, given the weight a of a new table (or what each costs).
    Random numbers are those of the keys, if there are any."""
    t = np.minimum(c, 1).astype(np.int64)
    some = np.flatnonzero(c >= 2)
    order = some[np.argsort(c[some], kind="stable")]
    first = np.minimum(c[order], EXACT)
    cuts = np.r_[0, np.searchsorted(first, WIDTHS, side="right")]
    for low, high, k in zip(cuts, cuts[1:], WIDTHS):  # counts of like size are drawn at once; log S_d(c, t) is -inf for t > c
        own = order[low:high]
        if not len(own):
            continue
        for part in np.array_split(own, max(1, len(own) * k // 4_000_000 + 1)):
            cost = a.logs(part, k).cumsum(1) if isinstance(a, Cost) else np.log(a[part])[:, None] * np.arange(1, k + 1)
            w = log_s[np.minimum(c[part], EXACT), 1 : k + 1] + cost
            w = np.exp(w - w.max(1, keepdims=True)).cumsum(1)
            u = rng.random(len(part)) if keys is None else uniform(keys[part], 0)
            t[part] = 1 + (w < u[:, None] * w[:, -1:]).sum(1)
    many = np.flatnonzero(c > EXACT)
    if len(many):
        more = a.more(many) if isinstance(a, Cost) else lambda _: a[many]
        draws = (rng.standard_normal(len(many)), rng.random(len(many))) if keys is None else (normal(keys[many]), uniform(keys[many], 0))
        t[many] = laplace(c[many], d, more, *draws)
    return t


class Bucket:
    """The restaurants of the words of one bucket; level 3 has the contexts by preceding word."""

    def __init__(self, blocks: list[bytes]):
        number: dict[bytes, int] = {}
        read = [_unpacked(raw) for raw in blocks]
        blocks.clear()  # the caller has no more use for them
        every = [_of_gaps(r[1]) for r in read]
        # contexts stand by key, and so by class, so that pairs do
        sizes = [len(x) for x in every]
        every = np.concatenate(every)
        self.keys, place_of = np.unique(every, return_inverse=True)
        del every
        self.classes = (self.keys >> np.uint64(HASH_BITS)).astype(np.int64)
        own, counts, self.parts, at = [], [], [], 0
        for n_keys, (words, _, each, context, count) in zip(sizes, read):
            place = np.array([number.setdefault(w, len(number)) for w in words.split(b"\n")], np.int64)
            known = place_of[at : at + n_keys]
            at += n_keys
            own.append(np.repeat(place, each) * len(self.keys) + known[context])
            counts.append(count)
            self.parts.append((len(context), place))
        del read, place_of
        own, counts = np.concatenate(own), np.concatenate(counts)
        pairs, self.inverse = np.unique(own, return_inverse=True)
        del own
        self.word3, self.context3 = np.divmod(pairs, len(self.keys))
        self.c3 = np.bincount(self.inverse, counts, len(pairs)).astype(np.int64)
        self.inverse = self.inverse.astype(np.uint32)
        self.word_keys = keys_of(list(number))
        code = self.word3 * CLASSES + self.classes[self.context3]  # ascending
        fresh = np.r_[True, code[1:] != code[:-1]]
        self.up3 = np.cumsum(fresh) - 1
        self.word2, self.context2 = np.divmod(code[fresh], CLASSES)
        self.fixed2 = np.zeros(len(self.word2), np.int64)  # customers from pairs that are not listed
        self.single = np.zeros(len(self.keys), np.int64)  # tables of each context, in all buckets, from pairs that are not listed
        self.count = np.bincount(self.word3, self.c3, len(number)).astype(np.int64)  # of each word
        self.samples: list[tuple[np.ndarray, ...]] = []
        self.link()
        self.open()

    def link(self) -> None:
        """The parents of the classes."""
        self.n_words = len(self.word_keys)
        code = self.word2 * PARENTS + self.context2 // CHILDREN
        fresh = np.r_[True, code[1:] != code[:-1]][: len(code)]
        self.up2 = np.cumsum(fresh) - 1
        self.word1, self.context1 = np.divmod(code[fresh], PARENTS)

    def fed(self, level: int) -> np.ndarray:
        """Customers of a level, from the tables below it."""
        if level == 2:
            return self.fixed2 + np.bincount(self.up3, self.t3, len(self.word2)).astype(np.int64)
        return np.bincount(self.up2, self.t2, len(self.word1)).astype(np.int64) if level else np.bincount(self.word1, self.t1, self.n_words).astype(np.int64)

    def open(self) -> None:
        """A start not far from where sweeps lead: of c customers, c^START tables."""
        begin = lambda c, e: np.clip(np.round(np.maximum(c, 1) ** e).astype(np.int64), c > 0, c)
        self.t3 = begin(self.c3, START[3])
        self.c2 = self.fed(2)
        self.t2 = begin(self.c2, START[2])
        self.c1 = self.fed(1)
        self.t1 = begin(self.c1, START[1])
        self.c0 = self.fed(0)
        self.t0 = begin(self.c0, START[0])

    def tables(self) -> tuple[np.ndarray, ...]:
        return tuple(t.astype(np.uint32) for t in (self.t3, self.t2, self.t1, self.t0))

    def seated(self, tables: tuple[np.ndarray, ...]) -> None:
        self.t3, self.t2, self.t1, self.t0 = (t.astype(np.int64) for t in tables)
        self.c2, self.c1, self.c0 = self.fed(2), self.fed(1), self.fed(0)

    def whole(self, tables: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        """Tables of a thin() bucket as those of this one, from which it came."""
        out = [np.minimum(self.c3, 1), np.zeros_like(self.t2), np.zeros_like(self.t1)]
        for own, listed, few in zip(out, (self.c3 > 1, self.c2 > 0, self.c1 > 0), tables):
            own[listed] = few
        return (*out, tables[3])

    def thin(self) -> "Bucket":
        """This bucket as it opens with the pairs of two customers or more, and the classes that are served."""
        own = Bucket.__new__(Bucket)
        listed, served = self.c3 > 1, self.c2 > 0
        own.word_keys, own.count, own.samples = self.word_keys, self.count, []
        own.word2, own.context2 = self.word2[served], self.context2[served]
        own.fixed2 = np.bincount(self.up3, self.c3 == 1, len(self.word2)).astype(np.int64)[served]
        own.up3, own.c3 = (np.cumsum(served) - 1)[self.up3[listed]], self.c3[listed]
        used, own.context3 = np.unique(self.context3[listed], return_inverse=True)
        own.keys = self.keys[used]
        own.single = np.zeros(len(used), np.int64)
        own.link()
        own.open()
        return own

    def state(self) -> bytes:
        each2, each3 = np.bincount(self.word2, minlength=self.n_words), np.bincount(self.up3, minlength=len(self.word2))
        small = (x.astype(np.uint32) for x in (self.count, each2, self.fixed2, each3, self.context3, self.c3, self.single))
        return _packed((self.word_keys, self.keys, self.context2.astype(np.uint16), *small, self.tables(), self.samples))

    @classmethod
    def of(cls, state: bytes) -> "Bucket":
        own = cls.__new__(cls)
        own.word_keys, own.keys, context2, *small, tables, own.samples = _unpacked(state)
        own.context2 = context2.astype(np.int64)
        own.count, each2, own.fixed2, each3, own.context3, own.c3, own.single = (x.astype(np.int64) for x in small)
        own.word2, own.up3 = np.repeat(np.arange(len(each2)), each2), np.repeat(np.arange(len(each3)), each3)
        own.link()
        own.seated(tables)
        return own

    def refeed(self) -> None:
        """Customers from the tables below them; where there are too few for the tables, fewer tables."""
        fit = lambda t, c: np.clip(t, c > 0, c)
        self.c2 = self.fed(2)
        self.t2 = fit(self.t2, self.c2)
        self.c1 = self.fed(1)
        self.t1 = fit(self.t1, self.c1)
        self.c0 = self.fed(0)
        self.t0 = fit(self.t0, self.c0)

    def sums(self) -> dict:
        """What this bucket has of each total."""
        by = lambda at, x, n: np.bincount(at, x, n)
        return {"t3": by(self.context3, self.t3, len(self.keys)), "c2": by(self.context2, self.c2, CLASSES), "t2": by(self.context2, self.t2, CLASSES), "c1": by(self.context1, self.c1, PARENTS), "t1": by(self.context1, self.t1, PARENTS), "c0": float(self.c0.sum()), "t0": float(self.t0.sum())}

    def totals(self) -> list[tuple[int, int, int]]:
        """(number of the total, customers, tables): classes, then their parents, then the root, then words and tokens."""
        out = []
        for shift, context, size, c, t in ((0, self.context2, CLASSES, self.c2, self.t2), (CLASSES, self.context1, PARENTS, self.c1, self.t1)):
            cs, ts = np.bincount(context, c, size).astype(np.int64), np.bincount(context, t, size).astype(np.int64)
            out += [(shift + int(i), int(cs[i]), int(ts[i])) for i in np.flatnonzero(cs)]
        return [*out, (CLASSES + PARENTS, int(self.c0.sum()), int(self.t0.sum())), (CLASSES + PARENTS + 1, int(self.count.sum()), int((self.count > 0).sum()))]

    def own_totals(self, each: list[np.ndarray]) -> np.ndarray:
        """For each context, sums over its pairs in this bucket."""
        return np.stack([np.bincount(self.context3, x, len(self.keys)) for x in each]).astype(np.int64)

    def asked(self, shards: int, each: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
        """(shard, contexts and what this bucket has of them), for summed()."""
        order, cuts = self._by_shard(shards)
        own = self.own_totals(each)[:, order]
        for g in np.flatnonzero(np.diff(cuts)).tolist():
            yield g, _packed((_gaps(self.keys[order[cuts[g] : cuts[g + 1]]]), own[:, cuts[g] : cuts[g + 1]].astype(np.uint32)))

    def met(self, shards: int, replies: list[bytes]) -> np.ndarray:
        """What all buckets have of each context; replies stand by shard."""
        order, _ = self._by_shard(shards)
        if not len(order):
            return np.zeros((2, 0), np.int64)
        sums = np.concatenate([_unpacked(r) for r in replies], 1)
        out = np.empty(sums.shape, np.int64)
        out[:, order] = sums
        return out

    def _by_shard(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        shard = (self.keys % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((self.keys, shard))
        return order, np.searchsorted(shard[order], np.arange(shards + 1))

    def probabilities(self, total: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Predictive probability of each (word, class), of each (word, parent), of each word."""
        (d0, d1, d2, _), (s0, s1, s2, _) = DISCOUNT, STRENGTH
        p0 = (self.c0 - d0 * self.t0 + (s0 + d0 * total["t0"]) / (total["v"] + 1)) / (s0 + total["c0"])
        p1 = (self.c1 - d1 * self.t1 + (s1 + d1 * total["t1"][self.context1]) * p0[self.word1]) / (s1 + total["c1"][self.context1])
        p2 = (self.c2 - d2 * self.t2 + (s2 + d2 * total["t2"][self.context2]) * p1[self.up2]) / (s2 + total["c2"][self.context2])
        return p2, p1, p0

    def by_context(self, total: dict) -> tuple[np.ndarray | None, np.ndarray]:
        """Customers and tables of each pair's context: the totals met, else (of a sole bucket) its own."""
        c, t = (total["c3"], total["t3"]) if "t3" in total else self.own_totals([self.c3, self.t3])
        return None if c is None else c[self.context3], t[self.context3]

    def leaves(self, total: dict) -> np.ndarray:
        """Predictive probability of each pair."""
        d, s = DISCOUNT[3], STRENGTH[3]
        c, t = self.by_context(total)
        return (self.c3 - d * self.t3 + (s + d * t) * self.probabilities(total)[0][self.up3]) / (s + c)

    def sweep(self, rng: np.random.Generator | int, total: dict, log_s: list[np.ndarray], at: tuple[np.ndarray, ...] | None = None) -> None:
        """One draw of every table count, each without its own tables in what it is given.
        rng: a generator, or the number from which keyed random numbers start; at: tables as
        they stood when the totals were taken (if not now)."""
        at3, at2, at1, at0 = at or (self.t3, self.t2, self.t1, self.t0)
        p1, p0 = self.probabilities(total)[1:]

        def drawn(level: int, c, t, had, tables, word, context, parent=None) -> np.ndarray:
            """had: tables of each pair in the totals; tables: of its context; parent: customers, tables, tables
            in the totals, the two totals, and what its parent predicts, of each pair."""
            d, s, some = DISCOUNT[level], STRENGTH[level], np.flatnonzero(c > 1)  # one customer has one table
            out = np.minimum(c, 1)
            c, t, had, tables, word, context = c[some], t[some], had[some], tables[some], word[some], context[some]
            theta = s + d * (tables - had)
            if parent is None:
                cost = Cost(d, theta, np.full(len(c), 1 / (total["v"] + 1)))
            else:
                (pc, pt, up_had, all_c, all_t, back), d_up, s_up = (x[some] for x in parent), DISCOUNT[level - 1], STRENGTH[level - 1]
                pc, all_c = pc - t, all_c - had
                kept = np.minimum(pt, pc)
                all_t = all_t - up_had + kept
                later = pc - d_up * np.maximum(kept, 1) + (s_up + d_up * (all_t + (kept == 0))) * back
                cost = Cost(d, theta, pc - d_up * kept + (s_up + d_up * all_t) * back, later, s_up + all_c)
            if not isinstance(rng, int):
                out[some] = seat(rng, c, cost, d, log_s[level])
            else:
                start = np.uint64((rng * 4 + level) * 0xD1B54A32D192ED03 % 2**64)
                out[some] = seat(None, c, cost, d, log_s[level], mixed(self.word_keys[word] + mixed(context.astype(np.uint64) ^ start)))
            return out

        up, of = self.up3, self.context2[self.up3]
        self.t3 = drawn(3, self.c3, self.t3, at3, self.by_context(total)[1], self.word2[up], self.keys[self.context3], (self.c2[up], self.t2[up], at2[up], total["c2"][of], total["t2"][of], p1[self.up2][up]))
        self.refeed()
        up, of = self.up2, self.context1[self.up2]
        self.t2 = drawn(2, self.c2, self.t2, at2, total["t2"][self.context2], self.word2, self.context2, (self.c1[up], self.t1[up], at1[up], total["c1"][of], total["t1"][of], p0[self.word1[up]]))
        self.refeed()
        up, n = self.word1, len(self.word1)
        self.t1 = drawn(1, self.c1, self.t1, at1, total["t1"][self.context1], up, self.context1, (self.c0[up], self.t0[up], at0[up], np.full(n, total["c0"]), np.full(n, total["t0"]), np.full(n, 1 / (total["v"] + 1))))
        self.refeed()
        words = np.arange(self.n_words)
        self.t0 = drawn(0, self.c0, self.t0, at0, np.full(self.n_words, total["t0"]), words, words * 0)

    def sweeps(self, total: dict, log_s: list[np.ndarray], steps: list[int], burn_in: int | None = None) -> None:
        """Sweeps with the totals of all buckets at the last exchange; after burn_in of them (if
        that is given) each is a sample."""
        at = (self.t3, self.t2, self.t1, self.t0)
        for i, step in enumerate(steps):
            self.sweep(step, total, log_s, at)
            if burn_in is not None and i >= burn_in:
                self.samples.append(self.tables())


def settled(old: dict, new: dict, share: float) -> bool:
    """Whether no level's customers or tables moved by more than the share (or chance, where they are few)."""
    now = {k: (float(np.sum(old[k])), float(np.sum(new[k]))) for k in ("c2", "t2", "c1", "t1", "c0", "t0")}
    return all(abs(y - x) <= max(share * x, 3 * x**0.5) for x, y in now.values())


def summed(every: list[bytes], listed: list[bytes], to_all: bool, n: int) -> list[bytes]:
    """Sums over the buckets of what they have of the contexts of a shard. every: customers and
    single tables of all contexts (or nothing, if these are known); listed: tables of listed pairs in n seatings.
    Answers every (customers, then all tables of each seating) or listed (single tables, then others)."""
    every, listed = ([(_of_gaps(keys), sums) for keys, sums in map(_unpacked, rows)] for rows in (every, listed))
    keys, place = np.unique(np.concatenate([r[0] for r in every + listed]), return_inverse=True)
    cut = sum(len(r[0]) for r in every)
    of_every, of_listed = place[:cut], place[cut:]
    add = lambda at, read, i: np.bincount(at, np.concatenate([r[1][i] for r in read]), len(keys)) if read else np.zeros(len(keys))
    single, tables = add(of_every, every, 1), [add(of_listed, listed, i) for i in range(n)]
    sums = np.stack([add(of_every, every, 0), *(single + t for t in tables)] if to_all else [single, *tables]).astype(np.int64)
    at, read = (of_every, every) if to_all else (of_listed, listed)
    return [_packed(sums[:, own].astype(np.uint64)) for own in np.split(at, np.cumsum([len(r[0]) for r in read])[:-1])] if read else []


def _collected(totals: DataFrame) -> list[dict]:
    """Totals of all buckets for each seating: a fixed number of rows."""
    blank = lambda: {k: np.zeros(n, np.float64) for k, n in (("c2", CLASSES), ("t2", CLASSES), ("c1", PARENTS), ("t1", PARENTS))} | {"c0": 0.0, "t0": 0.0, "n": 0, "v": 0}
    found: dict[int, dict] = {}
    for sample, number, c, t in totals.groupBy("sample", "number").agg(F.sum("c"), F.sum("t")).collect():
        out = found.setdefault(sample, blank())
        if number < CLASSES:
            out["c2"][number], out["t2"][number] = c, t
        elif number < CLASSES + PARENTS:
            out["c1"][number - CLASSES], out["t1"][number - CLASSES] = c, t
        elif number == CLASSES + PARENTS:
            out["c0"], out["t0"] = float(c), float(t)
        else:
            out["n"], out["v"] = int(c), int(t)
    return [found[i] for i in sorted(found)] or [blank()]  # no rows, no totals


def scores(docs: DataFrame, train, sweeps: int = 2, burn_in: int = 1, samples: int = 3, seed: int = 23, chunk_bytes: int = CHUNK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row.

    train: a condition (column) that says which rows the model learns from.
    sweeps: Gibbs sweeps between two exchanges of totals; burn_in: those of the last pass before
    its samples.
    """
    id_type = docs.schema[id_col].dataType
    narrow = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    parts = max(2, docs.rdd.getNumPartitions())
    buckets = 3 * parts

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("lm")
        held: list[pa.RecordBatch] = []
        size, chunk = 0, TaskContext.get().partitionId() << 32

        def send() -> Iterator[pa.RecordBatch]:
            nonlocal chunk
            table = pa.Table.from_batches(held)
            own = Chunk(table["text"].combine_chunks(), buckets)
            train = table["train"].to_numpy(zero_copy_only=False)
            rows = [(-1, _packed((table["id"].to_pylist(), train, own.lengths.astype(np.uint32), own.of_word, _texts_packed(own.pair_of, own.lengths)))), *own.blocks(train.astype(np.float64))]
            for low in range(0, len(rows), 16):
                part = rows[low : low + 16]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(part), pa.int64()), pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.binary()), pa.array([r[0] % ANSWERED if r[0] >= 0 else -1 for r in part], pa.int32())], ["chunk", "bucket", "data", "part"])
            chunk += 1

        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                held.append(part)
                size += part.column(1).nbytes if low == 0 and batch.num_rows <= 200 else sum(map(len, part.column(1).to_pylist()))
                if size >= chunk_bytes:
                    yield from send()
                    held, size = [], 0
        if held:
            yield from send()

    # part -1: chunks; others: blocks
    sent = written(narrow.mapInArrow(cut, "chunk long, bucket int, data binary, part int"), "chunks", ("part",))

    def blocks(which: str) -> DataFrame:
        return sent.filter(which).select("bucket", F.lit(2).alias("kind"), F.col("chunk").alias("source"), "data")

    # rows of the passes. kind 0: a bucket's state; 1: what it has of the contexts of a shard, or an answer; 2: blocks; 3: totals of
    # classes; 4: what it has of all contexts of a shard, once
    row = "bucket int, kind int, source long, data binary"

    def sent_on(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["bucket", "kind", "source", "data"])

    def left(b: int, own: Bucket, tables: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        """The state, and for each seating its totals and its tables of contexts."""
        every = []
        for sample, seating in enumerate(tables):
            own.seated(seating)
            every += [(sample, *row_) for row_ in own.totals()]
        yield sent_on([(b, 0, -1, own.state()), (b, 3, b, _packed(every))])
        for g, data in own.asked(buckets, [seating[0] for seating in tables]):
            yield sent_on([(g, 1, b, data)])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (b,), rows in runs(batches, 1):
            raws = [r[2] for r in rows]
            rows.clear()
            own = Bucket(raws)
            for g, data in own.asked(buckets, [own.c3, own.c3 == 1]):
                yield sent_on([(g, 4, b, data)])
            own = own.thin()
            yield from left(b, own, [own.tables()])

    def reply(to_all: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (g,), rows in runs(batches, 1):
                every, listed = ([r for r in rows if r[0] == kind] for kind in (4, 1))
                for (_, b, _), data in zip(every if to_all else listed, summed([r[2] for r in every], [r[2] for r in listed], to_all, samples if to_all else 1)):
                    yield sent_on([(b, 1, g, data)])

        return run

    def swept(total: dict, k: int, sampled: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            log_s = [stirling(d) for d in DISCOUNT]
            for (b,), rows in runs(batches, 1):
                own = Bucket.of(rows[0][2])
                single, tables = own.met(buckets, [r[2] for r in rows[1:]])
                own.single += single  # comes with the first answer only
                steps = [seed << 20 | k << 8 | i for i in range(burn_in + samples if sampled else sweeps)]
                own.sweeps(total | {"c3": None, "t3": own.single + tables}, log_s, steps, burn_in if sampled else None)
                yield from left(b, own, own.samples if sampled else [own.tables()])

        return run

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind", "source")

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                sample, n, c, t = zip(*_unpacked(raw))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (sample, n, c, t)], ["sample", "number", "c", "t"])

    def kept(rows: DataFrame) -> tuple[DataFrame, list[dict]]:
        """The written pass, and its totals of classes for each seating."""
        table = written(rows, "seats", ("kind",)).select("bucket", "kind", "source", "data")
        return table, _collected(table.filter("kind = 3").select("data").mapInArrow(numbers, "sample long, number long, c long, t long"))

    first, (total,) = kept(dealt(blocks("part >= 0")).mapInArrow(opened, row))
    released(docs.sparkSession)  # of the blocks' shuffle
    table, asks = first, first.filter("kind in (1, 4)")
    k, sampled = 0, False
    while True:
        state = table.filter("kind = 0").unionByName(dealt(asks).mapInArrow(reply(False), row))
        old, before = table, total
        table, of_samples = kept(dealt(state).mapInArrow(swept(total, k, sampled), row))
        if old is not first:
            dropped(old)
        asks = table.filter("kind = 1")
        if sampled:
            break
        total, k = of_samples[0], k + 1
        sampled = settled(before, total, SETTLED)
    state = written(table.filter("kind = 0").unionByName(dealt(asks.unionByName(first.filter("kind = 4"))).mapInArrow(reply(True), row)), "replies")
    dropped(table)
    dropped(first)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (b,), rows in runs(batches, 1):
            seatings = Bucket.of(rows[0][2]).samples
            replies, raws = ([raw for kind, _, raw in rows if kind == own_kind] for own_kind in (1, 2))
            chunks = [source for kind, source, _ in rows if kind == 2]
            rows.clear()
            own = Bucket(raws)
            c, *each = own.met(buckets, replies)
            mean = np.zeros(len(own.c3))
            for tables, t, of in zip(seatings, each, of_samples):
                own.seated(own.whole(tables))
                mean += own.leaves(of | {"c3": c, "t3": t}) / samples
            logs = np.log10(mean).astype(np.float32)
            at = 0
            for chunk, (n, place) in zip(chunks, own.parts):
                data = _packed((own.count[place], logs[own.inverse[at : at + n]]))
                at += n
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([b], pa.int32()), pa.array([data], pa.binary())], ["chunk", "bucket", "data"])

    answers = []
    for part in range(ANSWERED):
        own = dealt(state.filter(F.col("bucket") % ANSWERED == part).unionByName(blocks(f"part = {part}")))
        answers.append(written(own.mapInArrow(answer, "chunk long, bucket int, data binary"), "answers"))
        del own
        released(docs.sparkSession)  # of their shuffle
    dropped(state)
    meet = reduce(DataFrame.unionByName, answers).unionByName(sent.filter("part = -1").select("chunk", "bucket", "data")).repartition(4 * parts, "chunk").sortWithinPartitions("chunk", "bucket")
    n_train, v, id_arrow = total["n"], total["v"], to_arrow_type(id_type)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("lm")
        for _, rows in runs(batches, 1):
            (first, state), rest = rows[0], rows[1:]
            assert first == -1
            ids, train_, lengths, of_word, texts = _unpacked(state)
            pair_of = _texts_unpacked(texts, lengths)
            answers = [_unpacked(data) for _, data in rest]  # by bucket, as words and pairs are numbered
            count, log_p = (np.concatenate(x) for x in zip(*answers))
            base = np.log10((count + 0.5) / (n_train + 0.5 * (v + 1)))
            word_of = np.repeat(np.arange(len(of_word)), of_word)[pair_of]
            starts = np.r_[0, np.cumsum(lengths, dtype=np.int64)[:-1]]
            add = lambda x: np.add.reduceat(x, starts)
            total_p = add(log_p.astype(np.float64)[pair_of])
            arrays = [pa.array(ids, id_arrow), pa.array(train_), pa.array(lengths.astype(np.int64)), pa.array(add((count > 0)[word_of].astype(np.int64))), pa.array(np.full(len(starts), n_train, np.int64)), pa.array(add(base[word_of])), pa.array(total_p), pa.array(10.0 ** np.minimum(-total_p / lengths, 300))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return meet.mapInArrow(score, f"doc_id {id_type.simpleString()}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
