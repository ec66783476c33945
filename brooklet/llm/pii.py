"""Personal data in whole texts: fixed patterns, and spans added by a character model.

The model is a bidirectional LSTM over characters with CRF transitions, trained here
in numpy from synthetic windows with labelled spans (`training_windows`). At scan
time overlapping windows are decoded by Viterbi and reconciled over the text: each
position takes its label from the window in which it lies most centrally, so a span
may run over several windows.

A span must hold a digit or an @ (all four kinds do), so decoding starts from the windows
that give those characters their labels, and goes on to the next window wherever a label
other than O stands at the border of one that is not decoded. Every span that holds a digit
or an @ is so the span that decoding all windows finds. Spans that the model adds must fit
their kind (`fits`) and may not meet a base span.

Null and empty texts have no spans. Places are code points, ends exclusive.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brooklet.llm.common import kept_by_worker, text_or_empty

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN_RE = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP_RE = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD_RE = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE_RE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT_RE = re.compile("[0-9]")
TRIGGER_RE = re.compile("[0-9@]")

Span = tuple[int, int, int]  # start, number of the kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of the email pattern in linear time: what comes
    before an @ is the run of its characters back to the last match."""
    after, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > after and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < at and (m := DOMAIN_RE.match(text, at + 1)):
            yield begin, m.end()
            after = m.end()
        else:
            after = at + 1  # no match can cross this @
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    out = [(a, 0, b) for a, b in emails(text)]
    if DIGIT_RE.search(text):
        out += [(m.start(), 1, m.end()) for m in IP_RE.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split("."))]
        for m in CARD_RE.finditer(text):
            if 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        for m in PHONE_RE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def fits(kind: int, s: str) -> bool:
    """What a span of the model must look like to count."""
    digits = sum("0" <= c <= "9" for c in s)
    if kind == 0:
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+\x20?@\x20?[A-Za-z0-9-]+(?:\x20?\.\x20?[A-Za-z0-9-]+)+", s))
    if kind == 1:
        parts = re.split(r"[.:\x20-]+", s)
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 13 <= digits <= 19 and bool(re.fullmatch(r"[0-9][0-9.\x20-]+[0-9]", s)) and luhn(re.sub("[^0-9]", "", s))
    return 9 <= digits <= 15 and bool(re.fullmatch(r"[(+]?[0-9][0-9().\x20-]+[0-9]", s)) and len(re.findall("[0-9]+", s)) >= 3 and not re.fullmatch(r"[0-9.]+", s)


# --- the model ---------------------------------------------------------------

N_CODES = 100
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
K = len(LABELS)
#: A label I-x only follows B-x or I-x.
FORBIDDEN = np.array([[b.startswith("I-") and a[2:] != b[2:] for b in LABELS] for a in LABELS])


def codes(text: str) -> np.ndarray:
    """0: before and after the text; ASCII 32-126: 1-95; white space 96; letters 97; else 98."""
    a = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    out = np.where((a >= 32) & (a < 127), a - 31, np.where(a < 32, 96, np.where(a < 0x2000, 97, 98)))
    return out.astype(np.int16)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """BiLSTM-CRF; inputs are one-hot, so the input matrix is a table of rows per code."""

    def __init__(self, hidden: int = 20, seed: int = 5):
        rng, h = np.random.default_rng(seed), hidden
        self.h = h
        self.p = {f"in{d}": rng.normal(0, 0.3, (N_CODES, 4 * h)) for d in "fb"}
        self.p |= {f"re{d}": rng.normal(0, 1 / np.sqrt(h), (h, 4 * h)) for d in "fb"}
        for d in "fb":
            self.p[f"in{d}"][:, h : 2 * h] += 1.0  # forget gates begin open
        self.p |= {"out": rng.normal(0, 0.3, (2 * h, K)), "bias": np.zeros(K), "trans": np.zeros((K, K)), "first": np.zeros(K)}

    def emissions(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict]:
        """x: (batch, time). Scores (time, batch, labels), states, and what _back needs.

        Both directions run in one loop; the second sees time reversed.
        """
        n, steps = x.shape
        h = self.h
        both = np.stack([x.T, x.T[::-1]])
        g = np.stack([self.p[f"in{d}"][own] for d, own in zip("fb", both)], 1)  # (time, direction, batch, gates)
        rec = np.stack([self.p["ref"], self.p["reb"]])
        hs, cs = np.zeros((steps + 1, 2, n, h)), np.zeros((steps + 1, 2, n, h))
        for t in range(steps):
            own = g[t]
            own += hs[t] @ rec
            own[..., : 3 * h] = _sigmoid(own[..., : 3 * h])
            own[..., 3 * h :] = np.tanh(own[..., 3 * h :])
            cs[t + 1] = own[..., h : 2 * h] * cs[t] + own[..., :h] * own[..., 3 * h :]
            hs[t + 1] = own[..., 2 * h : 3 * h] * np.tanh(cs[t + 1])
        states = np.concatenate([hs[1:, 0], hs[1:, 1][::-1]], 2)
        return states @ self.p["out"] + self.p["bias"], states, {"h": hs, "c": cs, "g": g, "x": both, "rec": rec}

    def _back(self, s: dict, ds: np.ndarray, out: dict) -> None:
        """Gradients of both directions from those of the states (time, batch, 2 h)."""
        h = self.h
        grad = np.stack([ds[:, :, :h], ds[::-1, :, h:]], 1)
        back = s["rec"].transpose(0, 2, 1)
        das = np.empty_like(s["g"])
        dh, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
        for t in range(len(grad) - 1, -1, -1):
            g, tc, da = s["g"][t], np.tanh(s["c"][t + 1]), das[t]
            i, f, o, z = g[..., :h], g[..., h : 2 * h], g[..., 2 * h : 3 * h], g[..., 3 * h :]
            dh = dh + grad[t]
            dc = dc + dh * o * (1 - tc * tc)
            da[..., :h] = dc * z * i * (1 - i)
            da[..., h : 2 * h] = dc * s["c"][t] * f * (1 - f)
            da[..., 2 * h : 3 * h] = dh * tc * o * (1 - o)
            da[..., 3 * h :] = dc * i * (1 - z * z)
            dh, dc = da @ back, dc * f
        for k, d in enumerate("fb"):
            flat = das[:, k].reshape(-1, 4 * h)
            out[f"in{d}"] = (np.arange(N_CODES)[:, None] == s["x"][k].ravel()).astype(np.float64) @ flat
            out[f"re{d}"] = s["h"][:-1, k].reshape(-1, h).T @ flat

    def loss_gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        e, states, seen = self.emissions(x)
        steps, n, _ = e.shape
        trans = np.where(FORBIDDEN, -1e4, self.p["trans"])
        first = np.where([s.startswith("I-") for s in LABELS], -1e4, self.p["first"])

        def lse(a, axis):
            m = a.max(axis, keepdims=True)
            return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis))

        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = first + e[0]
        for t in range(1, steps):
            alpha[t] = lse(alpha[t - 1][:, :, None] + trans, 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = lse(trans[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        de = np.exp(alpha + beta - z[None, :, None])
        d_trans = np.zeros((K, K))
        for t in range(1, steps):
            d_trans += np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t] - z[:, None])[:, None, :]).sum(0)
        yt, rows = y.T, np.arange(n)
        gold = first[yt[0]] + sum(e[t, rows, yt[t]] for t in range(steps)) + sum(trans[yt[t - 1], yt[t]] for t in range(1, steps))
        loss = float((z - gold).mean())
        d_first = de[0].sum(0)
        np.subtract.at(d_first, yt[0], 1)
        for t in range(steps):
            de[t, rows, yt[t]] -= 1
        np.subtract.at(d_trans, (yt[:-1].ravel(), yt[1:].ravel()), 1)
        g = {"trans": np.where(FORBIDDEN, 0, d_trans), "first": d_first, "bias": de.sum((0, 1)), "out": np.einsum("tnh,tnk->hk", states, de, optimize=True)}
        self._back(seen, de @ self.p["out"].T, g)
        return loss, {k: v / n for k, v in g.items()}

    def train(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int = 96, rate: float = 0.02, seed: int = 6) -> "Tagger":
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in "mv")
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(x), batch)
            _, g = self.loss_gradient(x[pick], y[pick])
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            for k, a in g.items():
                a = a * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                self.p[k] -= rate * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Viterbi labels (batch, time)."""
        e = self.emissions(x)[0]
        trans = np.where(FORBIDDEN, -1e4, self.p["trans"])
        score = np.where([s.startswith("I-") for s in LABELS], -1e4, self.p["first"]) + e[0]
        back = np.zeros(e.shape, np.int8)
        for t in range(1, len(e)):
            s = score[:, :, None] + trans
            back[t] = s.argmax(1)
            score = s.max(1) + e[t]
        path = np.empty((x.shape[1], x.shape[0]), np.int8)
        path[-1] = score.argmax(1)
        rows = np.arange(x.shape[0])
        for t in range(len(e) - 1, 0, -1):
            path[t - 1] = back[t, rows, path[t]]
        return path.T


def training_windows(n: int = 1600, width: int = 64, seed: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Synthetic windows with labelled spans, and look-alikes that are none."""
    rng = random.Random(seed)
    pick = lambda *xs: rng.choice(xs)
    number = lambda k: "".join(rng.choices("0123456789", k=k))
    letters = lambda a, b: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(a, b)))
    hexes = lambda k: "".join(rng.choices("0123456789abcdef", k=k))

    def card() -> str:
        d = pick("4", "5", "37", "6011") + number(11)
        d = d.ljust(15, "0")[:15]
        d += next(str(c) for c in range(10) if luhn(d + str(c)))
        return pick("", "", " ", "-", ".").join(d[i : i + 4] for i in range(0, 16, 4))

    def spans() -> tuple[str, int]:
        kind = rng.randrange(4)
        if kind == 0:
            return letters(2, 9) + pick("", ".", "_", "+") + pick("", number(2), letters(2, 6)) + pick("@", "@", " @ ") + letters(3, 8) + pick("", number(1)) + "." + pick("", "example.") + pick("com", "org", "net", "de"), 0
        if kind == 1:
            return ".".join(str(rng.randrange(256)) for _ in range(4)), 1
        if kind == 2:
            return card(), 2
        return pick(f"+1 ({number(3)}) {number(3)}-{number(4)}", f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}", f"+{number(2)} {number(2)} {number(4)} {number(4)}", f"+{number(11)}", f"{number(3)} {number(3)} {number(4)}"), 3

    def other() -> str:
        return pick(
            letters(1, 10), letters(2, 7), letters(3, 12).capitalize() + ".", letters(2, 6) + ",", "ö" + letters(1, 5) + "é", letters(2, 9),
            pick(f"{number(1)}.0.", f"{number(1)}.{number(1)}", f"v{number(1)}.{number(1)}.{number(2)}", number(rng.randrange(1, 7)), f"20{number(2)}-0{number(1)}-1{number(1)}", "AKIA" + number(4) + letters(6, 12).upper(),
                 "password=" + hexes(18), hexes(40), "@" + letters(3, 8), number(9) + letters(1, 3), f"${number(3)},{number(3)}.{number(2)}", f"{number(2)}:{number(2)}"),
        )

    x, y = np.zeros((n, width), np.int16), np.zeros((n, width), np.int64)
    for i in range(n):
        text, labels = "", []
        while len(text) < width + 20:
            if rng.random() < 0.22:
                s, kind = spans()
                own = [1 + 2 * kind] + [2 + 2 * kind] * (len(s) - 1)
            else:
                s = other()
                own = [0] * len(s)
            gap = pick(" ", " ", " ", "\n", " (", ": ")
            text, labels = text + s + gap, labels + own + [0] * len(gap)
        at = rng.randrange(20)
        cut = labels[at : at + width]
        if cut[0] and cut[0] % 2 == 0:  # a span that began before the window
            cut[0] -= 1
        x[i], y[i] = codes(text[at : at + width]), cut
    return x, y


@lru_cache(maxsize=4)
def trained(steps: int = 260, hidden: int = 20, seed: int = 5) -> Tagger:
    x, y = training_windows()
    return Tagger(hidden, seed).train(x, y, steps)


def model_spans(tagger: Tagger, texts: list[str], width: int = 128) -> list[list[Span]]:
    """Spans of the model before any check against base spans; the windows of all
    texts that may share a span with a digit or @ are decoded in batches."""
    stride, margin = width // 2, width // 4
    labels: dict[int, np.ndarray] = {}
    lasts: dict[int, int] = {}
    todo: set[tuple[int, int]] = set()
    for n, text in enumerate(texts):
        if not TRIGGER_RE.search(text):
            continue
        labels[n] = np.zeros(len(text), np.int8)
        last = lasts[n] = max(0, -(-(len(text) - width) // stride))
        todo |= {(n, min(w, last)) for m in TRIGGER_RE.finditer(text) for w in ((m.start() // stride) - 1, m.start() // stride) if w >= 0}
    done: set[tuple[int, int]] = set()
    while todo:
        where, todo = sorted(todo), set()
        done.update(where)
        for low in range(0, len(where), 512):
            part = where[low : low + 512]
            x = np.zeros((len(part), width), np.int16)
            for row, (n, w) in zip(x, part):
                own = codes(texts[n][w * stride : w * stride + width])
                row[: len(own)] = own
            for (n, w), path in zip(part, tagger.decode(x)):
                a = 0 if w == 0 else margin
                b = width if w == lasts[n] else margin + stride
                own = labels[n][w * stride + a : w * stride + b]
                own[:] = path[a : a + len(own)]
                if w > 0 and own[:1].any():
                    todo.add((n, w - 1))
                if w < lasts[n] and own[-1:].any():
                    todo.add((n, w + 1))
        todo -= done
    out: list[list[Span]] = [[] for _ in texts]
    for n, path in labels.items():
        kind = (path + 1) // 2  # 0: none, else the kind plus 1
        begins = (kind > 0) & ((path % 2 == 1) | (np.r_[0, kind[:-1]] != kind))
        for a in np.flatnonzero(begins):
            b = a + 1
            while b < len(path) and kind[b] == kind[a] and not begins[b]:
                b += 1
            out[n].append((int(a), int(kind[a]) - 1, int(b)))
    return out


def find(tagger: Tagger, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) per text, by start, then kind."""
    out = []
    for text, added in zip(texts, model_spans(tagger, texts)):
        base = base_spans(text)
        keep = []
        for a, kind, b in added:
            while a < b and text[b - 1] in ".,;: ":
                b -= 1
            if fits(kind, text[a:b]) and not any(s < b and a < e for s, _, e in base):
                keep.append((a, kind, b))
        out.append((base, sorted(base + keep)))
    return out


def detect(docs: DataFrame, tagger: Tagger | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (array of structs start, kind, end, text, base) for every row."""
    tagger = tagger or trained()
    id_type = docs.schema[id_col].dataType
    narrow = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("text", pa.string()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("pii")
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                texts = batch.column(1).slice(low, 1000).to_pylist()
                rows = [[{"start": a, "kind": KINDS[k], "end": b, "text": t[a:b], "base": (a, k, b) in base} for a, k, b in spans] for t, (base, spans) in zip(texts, find(tagger, texts))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, 1000), pa.array(rows, kind)], ["doc_id", "spans"])

    return narrow.mapInArrow(run, f"doc_id {id_type.simpleString()}, spans array<struct<start:bigint,kind:string,end:bigint,text:string,base:boolean>>")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of spans that meet, replaced by its first kind's mark."""
    out, at = [], 0
    for a, kind, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, tagger: Tagger | None = None, text_col: str = "text") -> DataFrame:
    """docs with its own columns, the text redacted; a null text stays null."""
    tagger = tagger or trained()
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("pii")
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                texts = part.column(place).to_pylist()
                found = find(tagger, [t or "" for t in texts])
                new = pa.array([t and redacted(t, spans) for t, (_, spans) in zip(texts, found)], part.schema.field(place).type)
                yield pa.RecordBatch.from_arrays([new if i == place else c for i, c in enumerate(part.columns)], schema=part.schema)

    return docs.mapInArrow(run, docs.schema)


def span_digests(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, their digest, and all spans as text."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    base = joined(F.filter("spans", lambda s: s["base"]))
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
