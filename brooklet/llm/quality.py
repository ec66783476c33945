"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the whole text alone. Trees grow level by level from binned
histograms of gradients, and are flattened into arrays (feature, threshold, children,
value) so that numpy walks all rows of a batch down a tree at once.

The model is fitted on at most `max_rows` labelled documents, the bound documented
here; they are the labelled ids of lowest hash among those that may be learned from.
A label is the mean of an id's labels, 1 from a half up; null ids and labels are not
learned from. Without any label every score is 1; with labels of one kind it is their
rate. Null and empty texts get a score like any other.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brooklet.llm.common import WORD_RE, crc_mod, kept_by_worker, text_or_empty

THRESHOLD = 0.7
FEATURES = (
    "log_chars", "log_words", "word_length", "word_length_dev", "long_words", "distinct_words", "top_word", "repeated_trigrams",
    "lines", "repeated_lines", "line_length", "letters", "upper", "digits", "spaces", "symbols", "marks", "punctuation", "high_bytes",
    "byte_entropy", "upper_words", "symbol_words", "ends_sentence", "single_chars", "sentence_words",
)
_CLASS = np.zeros((7, 256))
for _i, _s in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\n\r\v\f", "#$%&*|<>{}[]\\^~=+@_/", "!?", ".,;:'\"()-")):
    _CLASS[_i, list(_s.encode())] = 1
SYMBOL_RE = re.compile(r"[#$%&*|<>{}\[\]\\^~=!]")


def statistics(text: str) -> list[float]:
    words, raw = WORD_RE.findall(text), text.encode("utf-8", "replace")
    n, size = max(1, len(words)), max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digits, spaces, symbols, marks, punctuation = (_CLASS @ counts / size).tolist()
    p = counts[counts > 0] / size
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    tally = Counter(words)
    trigrams = len(set(zip(words, words[1:], words[2:])))
    lines = [x for x in text.split("\n") if x]
    return [
        np.log1p(len(text)), np.log1p(len(words)), lengths.mean(), lengths.std(), float((lengths > 12).mean()), len(tally) / n, max(tally.values(), default=0) / n,
        1 - trigrams / max(1, len(words) - 2) if len(words) > 2 else 0.0, np.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)), np.log1p(len(text) / max(1, len(lines))),
        upper + lower, upper, digits, spaces, symbols, marks, punctuation, float(counts[128:].sum()) / size,
        float(-(p * np.log2(p)).sum()) if raw else 0.0, sum(map(str.isupper, tally)) / max(1, len(tally)), sum(1 for w in tally if SYMBOL_RE.search(w)) / max(1, len(tally)),
        float(text.rstrip()[-1:] in (".", "!", "?")), sum(1 for w in words if len(w) == 1) / n, len(words) / (1 + raw.count(b".")),
    ]


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t or "") for t in texts], np.float64).reshape(len(texts), len(FEATURES))


@dataclass
class Trees:
    """Flat trees: a node is a leaf where feature < 0; rows go left where x <= threshold."""

    base: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    threshold: list[np.ndarray] = field(default_factory=list)
    left: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, left, value in zip(self.feature, self.threshold, self.left, self.value):
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go = left[at] + (x[rows, np.maximum(f, 0)] > threshold[at])
                at = np.where(inner, go, at)
            out += value[at]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 90, depth: int = 4, rate: float = 0.12, bins: int = 64, l2: float = 2.0, least: float = 4.0) -> Trees:
    """Logistic boosting; splits come from histograms of at most `bins` bins a feature."""
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 1.0, 0, 1))
        return Trees(base=30.0 if p >= 1 else -30.0)
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)  # bin b: x <= edges[b]
    trees = Trees(base=float(np.log(y.mean() / (1 - y.mean()))))
    score = np.full(n, trees.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        feature, threshold, left, value = [-1], [0.0], [0], [0.0]
        at, open_ = np.zeros(n, np.int64), [0]
        for level in range(depth + 1):
            slot = np.full(len(feature), -1)
            slot[open_] = np.arange(len(open_))
            live = slot[at] >= 0
            s, k = slot[at[live]], len(open_)
            sum_g, sum_h = np.bincount(s, g[live], k), np.bincount(s, h[live], k)
            for i, node in enumerate(open_):
                value[node] = -rate * sum_g[i] / (sum_h[i] + l2)
            if level == depth:
                break
            best = [(1e-6, -1, 0)] * k
            for j in range(d):
                width = len(edges[j]) + 1
                if width < 2:
                    continue
                key = s * width + binned[live, j]
                gl = np.bincount(key, g[live], k * width).reshape(k, width).cumsum(1)[:, :-1]
                hl = np.bincount(key, h[live], k * width).reshape(k, width).cumsum(1)[:, :-1]
                gr, hr = sum_g[:, None] - gl, sum_h[:, None] - hl
                gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - (sum_g**2 / (sum_h + l2))[:, None]
                gain[(hl < least) | (hr < least)] = -1
                where = gain.argmax(1)
                for i in range(k):
                    if gain[i, where[i]] > best[i][0]:
                        best[i] = (float(gain[i, where[i]]), j, int(where[i]))
            fresh = []
            for i, node in enumerate(open_):
                if best[i][1] < 0:
                    continue
                _, j, b = best[i]
                feature[node], threshold[node], left[node] = j, float(edges[j][b]), len(feature)
                rows = at == node
                at[rows] = len(feature) + (binned[rows, j] > b)
                fresh += [len(feature), len(feature) + 1]
                for column, blank in ((feature, -1), (threshold, 0.0), (left, 0), (value, 0.0)):
                    column += [blank, blank]
            open_ = fresh
            if not open_:
                break
        arrays = np.array(feature), np.array(threshold), np.array(left), np.array(value)
        trees.feature.append(arrays[0])
        trees.threshold.append(arrays[1])
        trees.left.append(arrays[2])
        trees.value.append(arrays[3])
        score += arrays[3][at]
    return trees


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", may_learn=None) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most max_rows documents, the same ones on every run.

    The chosen ids are broadcast: max_rows bounds them. Copies of an id count once.
    """
    keyed = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).dropna()
    if may_learn is not None:
        keyed = keyed.filter(may_learn(F.col("id")))
    chosen = keyed.groupBy("id").agg((F.avg("label") >= 0.5).cast("int").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("quality")
        for batch in batches:
            stats = pa.array(matrix(batch.column(1).to_pylist()).tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), stats], ["id", "label", "stats"])

    kind = texts.schema["id"].dataType.simpleString()
    rows = texts.mapInArrow(run, f"id {kind}, label int, stats array<double>").groupBy("id").agg(F.min(F.struct("stats", "label")).alias("row")).orderBy("id").select("row.label", "row.stats").toArrow()
    y = np.array(rows["label"].to_pylist(), np.float64)
    return np.array(rows["stats"].to_pylist(), np.float64).reshape(len(y), len(FEATURES)), y


def train(docs: DataFrame, labels: DataFrame, **options) -> Trees:
    return fit(*labelled_sample(docs, labels, **options))


def score(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row, in one pass without a shuffle."""
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("quality")
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                part = batch.slice(low, 2000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(trees.predict(matrix(part.column(1).to_pylist())), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type.simpleString()}, score double")


def keep_good(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs that score at least the threshold, with all their columns."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("quality")
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                part = batch.slice(low, 2000)
                yield part.filter(pa.array(trees.predict(matrix(part.column(place).to_pylist())) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def learnable(modulus: int = 4, held: int = 2):
    """Condition on an id: whether labels may be learned from it."""
    return lambda c: F.crc32(c.cast("string").cast("binary")) % modulus != held


def held_out(id_col: str = "doc_id", modulus: int = 4, held: int = 2):
    return crc_mod(id_col, modulus) == held
