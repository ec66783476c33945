"""Secret scans with DataFrame functions only.

Base spans come from three fixed patterns. The scan adds `entropy` spans: candidate
strings (runs of key characters with a digit and a letter) in which some window of
fixed width has a high Shannon entropy for its character class. The entropy of the
sliding window is carried by incremental counts: a step takes one character out and
one in, and changes the sum of c*log2(c) by those two counts only. An allow-list
suppresses candidates (placeholders, identifiers of known form). A window whose entropy
equals the least counts.

Spark gives matched strings but no places, so places come from splitting the text by
the same pattern: a match starts after the pieces and matches before it. Lengths are
in code points. Work is linear in a text and its matches. Null and empty texts have no spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brooklet.llm.common import text_or_empty

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # as [0-9a-f]+ with 24 characters or more: such a run is always taken whole
#: Candidate strings are runs of these, 20 characters or more.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
WIDTH = 20
#: (class, what the candidate looks like, least entropy in bits of some window), first that fits.
CLASSES = (
    ("hex", r"^[0-9a-fA-F-]+$", 3.0),
    ("alnum", r"^[A-Za-z0-9]+$", 3.4),
    ("base64", r"^[A-Za-z0-9+/_-]+$", 3.6),
)
#: Candidates that are never secrets.
ALLOWED = (
    r"(?i)example|placeholder|xxxx|0000",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9_-]+$",
    r"^[a-z]+(?:[-_/][a-z]+)*[-_/]?[0-9]{0,4}$",
    r"^[A-Za-z]+(?:[-_/][A-Za-z]+)*[-_/]?[0-9]{0,4}$",
)
KINDS = ("assign", "access", "hex", "entropy")
SPAN = "struct<start:int,rank:int,kind:string,end:int,text:string>"


#: Values that a running total is taken over at once.
CHUNK = 64


def bound(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, join, first: Column) -> Column:
    """Running totals of an array of ints, each value included; join is associative, `first`
    leaves everything as it is. Totals are taken inside chunks, and chunks are then shifted by
    the totals before them, so that no array grows value by value."""
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), first)
    grown = lambda a, step: F.aggregate(a, F.array().cast("array<int>"), lambda acc, v: F.concat(acc, F.array(join(last(acc), step(v)).cast("int"))))

    def chunked(all_: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(all_) / CHUNK).cast("int") - 1, F.lit(0)))
        return F.transform(at, lambda i: grown(F.slice(all_, i * CHUNK + 1, F.lit(CHUNK)), lambda v: v))

    def shifted(chunks: Column) -> Column:
        before = F.concat(F.array(first), grown(F.slice(chunks, F.lit(1), F.size(chunks) - 1), last))
        return F.flatten(F.zip_with(chunks, before, lambda c, k: F.transform(c, lambda v: join(k, v).cast("int"))))

    return bound(values, lambda v: bound(chunked(v), shifted))


def located(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Spans of a pattern's leftmost matches; keep: a condition on (match, group 2)."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    second = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if keep else F.array().cast("array<string>")
    found = F.struct(matches.alias("hits"), F.split(text, pattern, -1).alias("gaps"), second.alias("second"))

    def spans(found: Column) -> Column:
        hits = found["hits"]
        steps = F.zip_with(F.slice(found["gaps"], F.lit(1), F.size(hits)), hits, lambda gap, hit: F.length(gap) + F.length(hit))
        ends = running(steps, lambda a, b: a + b, F.lit(0))
        rows = F.zip_with(ends, F.arrays_zip(hits.alias("hit"), found["second"].alias("second")), lambda end, x: F.struct((end - F.length(x["hit"])).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), x["hit"].alias("text"), x["second"].alias("second")))
        if keep:
            rows = F.filter(rows, lambda s: keep(s["text"], s["second"]))
        return F.transform(rows, lambda s: F.struct(*(s[c].alias(c) for c in ("start", "rank", "kind", "end", "text")))).cast(f"array<{SPAN}>")

    return F.when(text.rlike(pattern), bound(found, spans)).otherwise(F.array().cast(f"array<{SPAN}>"))


def window_entropy(string: Column, width: int = WIDTH) -> Column:
    """The highest Shannon entropy in bits of any window of `width` characters (of the whole
    string if it is shorter). A step takes one character out and one in; only the counts of
    those two change, and the sum of c * log2(c) with them."""
    table = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(width + 1)))
    value = lambda c: F.get(table, c)

    def best(codes: Column) -> Column:
        wide = F.least(F.size(codes), F.lit(width))

        def step(acc, i):
            came, went = F.get(codes, i), F.when(i >= width, F.get(codes, i - width)).otherwise(F.lit(-1))
            seen = F.slice(codes, F.greatest(i - width, F.lit(0)) + 1, F.least(i, F.lit(width)))
            count = lambda code: F.size(F.filter(seen, lambda c: c == code))
            change = bound(count(came), lambda n: value(n + 1) - value(n)) + F.when(went >= 0, bound(count(went), lambda n: value(n - 1) - value(n))).otherwise(F.lit(0.0))
            total = acc["sum"] + F.when(came == went, F.lit(0.0)).otherwise(change)
            return bound(total, lambda t: F.struct(t.alias("sum"), F.when(i + 1 >= wide, F.greatest(F.log2(wide.cast("double")) - t / wide, acc["best"])).otherwise(acc["best"]).alias("best")))

        begin = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), begin, step, lambda acc: acc["best"])

    return bound(F.transform(F.split(string, ""), lambda c: F.ascii(c) % 128), best)


def apart(known: Column, found: Column) -> Column:
    """known and those of found that meet none of them, in order: among spans in order of their
    start, one that meets a known span begins before a known end so far, or ends after the next known start."""
    far = F.lit(2**31 - 1)

    def kept(spans: Column) -> Column:
        is_known = lambda s: s["rank"] < KINDS.index("entropy")
        ends = running(F.transform(spans, lambda s: F.when(is_known(s), s["end"]).otherwise(F.lit(-1))), F.greatest, F.lit(-1))
        starts = F.reverse(running(F.reverse(F.transform(spans, lambda s: F.when(is_known(s), s["start"]).otherwise(far))), F.least, far))
        rows = F.arrays_zip(spans.alias("s"), ends.alias("end"), starts.alias("start"))
        free = F.filter(rows, lambda r: is_known(r["s"]) | ((r["end"] <= r["s"]["start"]) & (r["start"] >= r["s"]["end"])))
        return F.transform(free, lambda r: r["s"])

    both = F.array_sort(F.concat(known, found))
    return F.when(F.size(found) > 0, bound(both, kept)).otherwise(both)


def suspicious(string: Column, allowed=ALLOWED, classes=CLASSES) -> Column:
    """Whether a candidate string is a secret by entropy. Cheap tests come first."""
    floor = F.lit(None).cast("double")
    for _, shape, least in reversed(classes):
        floor = F.when(string.rlike(shape), F.lit(least)).otherwise(floor)
    mixed = string.rlike("[0-9]") & string.rlike("[A-Za-z]")
    for pattern in allowed:
        mixed = mixed & ~string.rlike(pattern)
    return F.when(mixed, window_entropy(string) >= floor).otherwise(F.lit(False))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed=ALLOWED, classes=CLASSES) -> DataFrame:
    """doc_id and spans: an array of structs (start, rank, kind, end, text), by start, then kind.

    An entropy span that meets a base span is left out: the base one stays as it is.
    """
    text = F.col("text")
    narrow = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    base = narrow.select(
        "doc_id", "text",
        located(text, ASSIGN, "assign", lambda _, second: F.length(second) >= 6).alias("assign"),
        F.filter(located(text, ACCESS, "access"), lambda s: F.length(s["text"]) >= 20).alias("access"),
        located(text, HEX, "hex").alias("hex"),
    )
    # a candidate needs a digit somewhere: most texts are done after one look
    candidates = F.when(text.rlike("[0-9]"), F.filter(located(text, CANDIDATE, "entropy"), lambda s: suspicious(s["text"], allowed, classes))).otherwise(F.array().cast(f"array<{SPAN}>"))
    known = base.select("doc_id", F.concat("assign", "access", "hex").alias("known"), candidates.alias("found"))
    return known.select("doc_id", apart(F.col("known"), F.col("found")).alias("spans"))


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_digests(scanned: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans, and all spans as text."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = joined_spans(F.filter("spans", lambda s: s["kind"] != "entropy"))
    return scanned.select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))
