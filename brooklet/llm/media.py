"""Interleaved document sequences with media.

`interleave` parses HTML into the ordered elements of a page: texts and media
references, each with its position, and a caption with the media it belongs to
(the figcaption of its figure, else its alt text). References are digests, so a join
by digest resolves them against a store of payloads; positions and captions ride
along with the reference and stay aligned.

Payloads are stored without loss as 8-bit grey images (PGM, 64 samples a row) in a table
in the shared folder. Features are computed from the table read back. Reads are checked: a
stored form that does not parse raises.

Null html has no elements. References without a payload resolve to nulls. Equal
payloads share a digest; the store keeps one row of each. Only payloads that may occur
twice are shuffled, for that; the others are written where they are read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brooklet.llm.common import kept_by_worker, text_or_empty, written

ROW = 64
#: Slots by which refs that occur twice are told from others; refs that share a slot are shuffled too.
SLOTS = 1 << 22
BLOCKS = frozenset("address article aside blockquote br div dl dt dd figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul figcaption title body".split())
HIDDEN = frozenset(("script", "style", "template", "noscript"))
MEDIA = frozenset(("img", "video", "audio", "source", "embed"))
ELEMENT = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])
SPACE_RE = re.compile(r"[\x20\x09-\x0D]+")


class _Parser(HTMLParser):
    """Ordered elements as lists [kind, text, ref, caption]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[list] = []
        self.words: list[str] = []
        self.hidden = 0
        self.figures: list[list[list]] = []
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = SPACE_RE.sub(" ", "".join(self.words)).strip(" ")
        self.words = []
        if text:
            self.found.append(["text", text, None, None])

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        elif tag in MEDIA:
            named = dict(attrs)
            if named.get("src"):
                self.flush()
                self.found.append(["media", None, named["src"], named.get("alt")])
                if self.figures:
                    self.figures[-1].append(self.found[-1])
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure":
                self.figures.append([])
            elif tag == "figcaption" and self.figures:
                self.caption = []

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = SPACE_RE.sub(" ", "".join(self.caption)).strip(" ")
            for media in self.figures[-1] if self.figures else []:
                media[3] = text
            self.caption = None
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure" and self.figures:
                self.figures.pop()

    def handle_data(self, data):
        if not self.hidden:
            (self.words if self.caption is None else self.caption).append(data)


def elements(html: str | None) -> list[dict]:
    parser = _Parser()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return [{"position": i, "kind": k, "text": t, "ref": r, "caption": c} for i, (k, t, r, c) in enumerate(parser.found)]


def interleave(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page id and its elements, in order."""
    id_type = pages.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("media")
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([elements(h) for h in part.column(1).to_pylist()], pa.list_(ELEMENT))], [id_col, "elements"])

    return pages.select(id_col, html_col).mapInArrow(run, f"`{id_col}` {id_type.simpleString()}, elements array<struct<position:int,kind:string,text:string,ref:string,caption:string>>")


def padded(data: bytes) -> bytes:
    """data with bytes 0 up to a positive multiple of the row."""
    return data + b"\0" * ((-len(data)) % ROW or (0 if data else ROW))


def stored(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (ROW, len(payload) // ROW) + payload


def read_back(media: bytes) -> bytes:
    m = re.match(rb"P5\n(\d+) (\d+)\n255\n", media)
    if not m or len(media) - m.end() != int(m[1]) * int(m[2]):
        raise ValueError("not a whole 8-bit grey image")
    return media[m.end() :]


def feature(samples: bytes) -> str:
    """Width, height, sum and sum of squares of the samples, distinct values, and how often
    the commonest occurs; all whole numbers, so that every engine agrees."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    value = np.arange(256)
    return f"{ROW}x{len(samples) // ROW}:{counts @ value}:{counts @ value**2}:{(counts > 0).sum()}:{counts.max()}"


def reference(payload: bytes, n_bytes: int) -> str:
    """The digest by which a payload is stored; texts that differ by their padding differ."""
    return f"sha256-{hashlib.sha256(payload).hexdigest()}-{n_bytes}"


def store(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """ref, n_bytes and the stored media of each distinct text (null: empty), as a written table."""
    spark = docs.sparkSession
    texts = docs.select(text_or_empty(text_col).alias("text"))

    def payloads(batch: pa.RecordBatch) -> Iterator[tuple[str, int, bytes]]:
        for text in batch.column(0):
            raw = text.as_py().encode("utf-8", "replace")
            whole = padded(raw)
            yield reference(whole, len(raw)), len(raw), whole

    def refs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("media")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _, _ in payloads(batch)], pa.string())], ["ref"])

    twice = texts.mapInArrow(refs, "ref string").groupBy("ref").agg(F.count("*").alias("n")).filter("n > 1").select((F.crc32(F.col("ref").cast("binary")) % SLOTS).alias("slot"))
    taken = np.zeros(SLOTS // 32, np.uint32)
    for word, bits in twice.groupBy((F.col("slot") / 32).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 32 as int)))")).collect():
        taken[word] = bits
    marks = spark.sparkContext.broadcast(taken)

    def rows(shared: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept_by_worker("media")
            seen: set[str] = set()
            for batch in batches:
                for low in range(0, batch.num_rows, 500):
                    out = []
                    for ref, n, whole in payloads(batch.slice(low, 500)):
                        slot = zlib.crc32(ref.encode()) % SLOTS
                        if bool(int(marks.value[slot // 32]) >> slot % 32 & 1) == shared and ref not in seen:
                            if shared:
                                seen.add(ref)
                            out.append((ref, n, stored(whole)))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int64(), pa.binary()))], ["ref", "n_bytes", "media"])

        return run

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            new = [r not in seen and not seen.add(r) for r in batch.column(0).to_pylist()]
            yield batch.filter(pa.array(new, pa.bool_()))

    form = "ref string, n_bytes long, media binary"
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    return written(texts.mapInArrow(rows(False), form).unionByName(texts.mapInArrow(rows(True), form).repartition(parts, "ref").mapInArrow(once, form)), "media")


def features(media: DataFrame) -> DataFrame:
    """One row per ref, from the stored bytes read back. Rows of a ref are equal, and
    meet as small rows after a partial aggregate; the media bytes are never shuffled."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("media")
        for batch in batches:
            rows = []
            for form in batch.column(2).to_pylist():
                back = read_back(form)
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(form), hashlib.sha256(form).hexdigest(), feature(back)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["ref", "n_bytes", *names])

    per_row = media.mapInArrow(run, "ref string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return per_row.groupBy("ref").agg(*(F.max(c).alias(c) for c in ("n_bytes", *names)))


def resolve(sequences: DataFrame, payloads: DataFrame, id_col: str = "page_id") -> DataFrame:
    """One row per media element with what the payload table has for its ref. The payload
    side is unique by ref, so a hot ref splits on the sequence side."""
    media = sequences.select(F.col(id_col), F.explode("elements").alias("e")).filter("e.kind = 'media'")
    flat = media.select(F.col(id_col), F.col("e.position").alias("position"), F.col("e.caption").alias("caption"), F.col("e.ref").alias("element_ref"))
    return flat.join(payloads, flat["element_ref"] == payloads["ref"], "left")


def as_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document as a page: its text, then a figure that refers to its payload."""
    id_type = docs.schema[id_col].dataType

    def page(text: str) -> str:
        raw = text.encode("utf-8", "replace")
        return f'<article><p>{escape(text)}</p><figure><img src="{reference(padded(raw), len(raw))}"><figcaption>{len(raw)} bytes</figcaption></figure></article>'

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("media")
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([page(t) for t in part.column(1).to_pylist()], pa.string())], ["doc_id", "html"])

    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type.simpleString()}, html string")
