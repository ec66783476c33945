"""Packing of token sequences into fixed windows by Karmarkar-Karp differencing.

A document's ids (with an end id) are cut into whole windows of `capacity` plus
pieces of at most `piece_tokens`; the pieces are gathered into shards of bounded
size as they are scanned, and each shard is split into near-equal windows by
multiway differencing: the two partial partitions with the widest spread are
merged, the fullest windows of one meeting the emptiest of the other, until one
partition is left. If its fullest window exceeds the capacity, the number of
windows rises and the shard is split again.

There is no shuffle: a task packs what it scans. Null and empty texts give one
piece, the end id alone. Repeated rows and null ids are packed like any others. A special
token that a text spells out, in its own case, is that token, as for the tokenizer; in
another case it is plain text.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brooklet.llm.common import kept_by_worker, text_or_empty

CACHED_CHARS = 10_000_000
#: Characters of fresh units that are encoded as one text, and bytes of texts (one at least) and texts that are encoded together.
LEARNT_CHARS, ENCODED_BYTES, ENCODED_TEXTS = 500_000, 4_000_000, 256
#: What every special token of the tokenizers in use begins with.
SPECIAL = "<|"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Item numbers of k near-equal windows, by multiway Karmarkar-Karp differencing.

    A partial partition holds k sums, ascending and less their smallest; equal
    spreads merge in order of creation, so the result depends on the sizes alone.
    """
    if k <= 1:
        return [list(range(len(sizes)))]
    zero = np.zeros(k, np.int64)
    heap: list[tuple[int, int, np.ndarray, list]] = []
    for i, s in enumerate(sizes):
        sums = zero.copy()
        sums[-1] = s
        heap.append((-s, i, sums, [None] * (k - 1) + [(i,)]))
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        _, _, a, own_a = heapq.heappop(heap)
        _, _, b, own_b = heapq.heappop(heap)
        sums = a + b[::-1]
        order = np.argsort(sums, kind="stable")
        # a window is a tree of pairs, so that a merge does not copy its items
        joined = [x if y is None else y if x is None else (x, y) for x, y in zip(own_a, reversed(own_b))]
        sums = sums[order]
        sums -= sums[0]
        heapq.heappush(heap, (-int(sums[-1]), made, sums, [joined[j] for j in order]))
        made += 1
    out = []
    for tree in heap[0][3] if heap else []:
        items, stack = [], [tree] if tree is not None else []
        while stack:
            node = stack.pop()
            if len(node) == 1:
                items.append(node[0])
            else:
                stack += [node[1], node[0]]
        out.append(items)
    return out


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most `capacity`; their number rises until every window fits."""
    total = sum(sizes)
    if not sizes:
        return []
    k = max(1, -(-total // capacity))
    while True:
        parts = [p for p in differencing(sizes, k) if p]
        if all(sum(sizes[i] for i in p) <= capacity for p in parts):
            return parts
        k += max(1, k // 200)


#: Units that the tokenizer never joins: words, less the plain punctuation that ends a word of plain letters.
UNIT_RE = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+(?=[.,!?*#%&$]*(?:[\x20\x09-\x0D]|\Z))|[^\x20\x09-\x0D]+")


WHITE_RE = re.compile(r"[\x20\x09-\x0D]")


def units(text: str) -> list[str]:
    """The tokenizer lower-cases anyway; doing so before leaves fewer distinct units. Only
    Latin-1 texts are lowered here: there, the order of lowering and NFC cannot matter. Texts
    with a mark that begins a special token are not: the tokenizer looks for special tokens, in
    their own case, before it lowers."""
    if SPECIAL in text:
        return UNIT_RE.findall(text)
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return UNIT_RE.findall(text)
    return UNIT_RE.findall(text.lower())


class _Numbers(dict):
    """Numbers of units in order of appearance; `fresh` lists those not learned yet."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        self.fresh.append(unit)
        return n


class WordEncoder:
    """Ids of whole texts from a lower-casing tokenizer whose pre-tokenizer splits at white
    space and between letters and punctuation. Units not seen before are encoded
    together, as texts of bounded size, and told apart by the places of their tokens; ids stand
    in one flat array. What is remembered is bounded and then dropped as a whole."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        odd = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not t.content.startswith(SPECIAL) or t.normalized or WHITE_RE.search(t.content)]
        if odd:
            raise ValueError(f"special tokens that this encoder cannot keep apart: {odd}")
        self.forget()

    @classmethod
    def of_process(cls, tokenizer_json: str) -> "WordEncoder":
        """The encoder that this Python worker already has, from an earlier task."""
        held = kept_by_worker(f"encoder {hash(tokenizer_json)}")
        if not held:
            held["encoder"] = cls(tokenizer_json)
        return held["encoder"]

    def forget(self) -> None:
        self.number = _Numbers()
        self.chars = 0
        self.flat = np.zeros(0, np.uint32)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self, words: list[str]) -> None:
        """In parts: what the tokenizer says of a text takes some hundred bytes a token."""
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        part_of = (ends - 1) // LEARNT_CHARS  # a unit that is longer begins a part
        all_sizes, all_ids = [self.sizes], [self.flat]
        for part in np.split(np.arange(len(words)), np.flatnonzero(np.diff(part_of)) + 1):
            low, high = int(part[0]), int(part[-1]) + 1
            got = self.tokenizer.encode(" ".join(words[low:high]), add_special_tokens=False)
            places = np.array([o[0] for o in got.offsets], np.int64)
            own_ends = ends[low:high] - (ends[low - 1] if low else 0)
            all_sizes.append(np.bincount(np.searchsorted(own_ends, places, "right"), minlength=high - low).astype(np.int32))
            all_ids.append(np.array(got.ids, np.uint32))
        sizes = np.concatenate(all_sizes[1:]).astype(np.int64)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes, self.flat = np.concatenate(all_sizes), np.concatenate(all_ids)
        self.chars += int(ends[-1])

    def encode(self, texts: list[str], end_id: int) -> list[np.ndarray]:
        split = [units(t) for t in texts]
        if self.chars > CACHED_CHARS:
            self.forget()
        find = self.number.__getitem__
        numbers = [np.fromiter(map(find, words), np.int64, len(words)) for words in split]
        if self.number.fresh:
            try:
                self._learn(self.number.fresh)
            except BaseException:
                self.forget()  # numbers without ids must not outlive this task
                raise
            self.number.fresh = []
        out = []
        for w in numbers:
            sizes = self.sizes[w].astype(np.int64)
            ends = np.cumsum(sizes)
            n = int(ends[-1]) if len(w) else 0
            ids = np.empty(n + 1, np.uint32)
            ids[:n] = self.flat[np.arange(n) + np.repeat(self.starts[w] - ends + sizes, sizes)]
            ids[n] = end_id
            out.append(ids)
        return out


def together(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Stretches (from, to) of texts of these sizes in bytes that are encoded together."""
    low, held = 0, 0
    for i, n in enumerate(sizes):
        if i > low and (i - low == ENCODED_TEXTS or held + n > ENCODED_BYTES):
            yield low, i
            low, held = i, 0
        held += n
    if low < len(sizes):
        yield low, len(sizes)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 4096,
    end_id: int = 2,
    piece_tokens: int = 1024,
    shard_pieces: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit, as
    bytes), doc_tokens, sequence_id (unique), offset (in its sequence, gapless from 0)."""
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = json.dumps(json.load(f), ensure_ascii=False)
    id_type = docs.schema[id_col].dataType
    narrow = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = pa.schema([("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of_process(tokenizer_json)
        sequence = TaskContext.get().partitionId() << 33
        id_arrow = None
        held: list[tuple] = []  # pieces that wait for their shard

        def rows(parts: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            out: list[tuple] = []
            for part in parts:
                at = 0
                for doc_id, start, ids, total in part:
                    out.append((doc_id, start, len(ids), ids.astype("<u4").tobytes(), total, sequence, at))
                    at += len(ids)
                sequence += 1
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], id_arrow), *(pa.array(c, f.type) for c, f in zip(columns[1:], kind))], ["doc_id", *kind.names])

        def shard() -> Iterator[pa.RecordBatch]:
            parts = windows_of([len(p[2]) for p in held], capacity)
            yield from rows([[held[i] for i in part] for part in parts])
            held.clear()

        for batch in batches:
            id_arrow = batch.schema.field(0).type
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1)
            for low, high in together(pc.binary_length(texts).to_pylist()):
                whole: list[list[tuple]] = []
                for doc_id, ids in zip(ids_of[low:high], encoder.encode(texts[low:high].to_pylist(), end_id)):
                    full = len(ids) // capacity * capacity
                    whole += [[(doc_id, s, ids[s : s + capacity], len(ids))] for s in range(0, full, capacity)]
                    rest = len(ids) - full
                    if rest:
                        n = -(-rest // piece_tokens)
                        cuts = [full + rest * i // n for i in range(n + 1)]
                        # copies: a view would keep the ids of the whole document
                        held += [(doc_id, a, ids[a:b].copy(), len(ids)) for a, b in zip(cuts, cuts[1:])]
                yield from rows(whole)
                if len(held) >= shard_pieces:
                    yield from shard()
        if held:
            yield from shard()

    return narrow.mapInArrow(run, f"doc_id {id_type.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def packed_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
