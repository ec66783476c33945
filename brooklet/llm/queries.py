"""The thin queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklet.llm import embeddings, lm, media, mixing, ngram_join, packing, pii, quality, secrets, tokens
from brooklet.llm.common import crc_mod, read, written


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    trees = quality.train(docs, read(spark, sf_dir, "labels"), may_learn=quality.learnable())
    scored = quality.score(docs, trees)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digests(packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(pii.detect(read(spark, sf_dir, "documents")))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.scores(read(spark, sf_dir, "documents"), crc_mod("doc_id", 5) != 1)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    sequences = media.interleave(media.as_pages(docs), "doc_id")
    # written, so that the join can split a hot ref
    found = media.resolve(sequences, written(media.features(media.store(docs)), "features"), "doc_id")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix(read(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_digests(secrets.scan(read(spark, sf_dir, "documents")))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_token_counts, op3_packing, op4_embeddings, op5_pii, op6_lm, op7_media, op8_mixing, op9_secrets, op10_ngram_join)}

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

#: Rounds of the targets as the operator takes them, so that doubles agree to the last bit.
OP8_SQL = f"""
WITH RECURSIVE sized AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w FROM sized GROUP BY source),
rounds AS (
    SELECT 0 AS i, source, n, w, true AS open, CAST(NULL AS DOUBLE) AS target, CAST(sum(n) OVER () AS DOUBLE) AS rest, true AS more FROM sources
    UNION ALL
    SELECT i + 1, source, n, w, open AND NOT over, CASE WHEN over THEN 3.0 * n ELSE target END, rest - coalesce(sum(CASE WHEN over THEN 3.0 * n END) OVER (), 0.0), bool_or(over) OVER ()
    FROM (SELECT *, open AND rest * w / sum(CASE WHEN open THEN w END) OVER () > 3.0 * n AS over FROM rounds) WHERE more
),
done AS (SELECT source, n, CASE WHEN open THEN rest * w / sum(CASE WHEN open THEN w END) OVER () ELSE target END AS target FROM rounds WHERE i = (SELECT max(i) FROM rounds)),
placed AS (
    SELECT doc_id, size, n AS source_size, target, s.source, CASE WHEN n > 0 THEN target / n ELSE 0.0 END AS rate,
        row_number() OVER (PARTITION BY s.source ORDER BY size, md5(concat_ws(':', '17', CAST(doc_id AS VARCHAR)))) AS r
    FROM sized s JOIN done d ON s.source IS NOT DISTINCT FROM d.source
)
SELECT doc_id, size, source_size, target, (CAST(floor(rate * r + {mixing.offset(17)!r}) AS BIGINT) - CAST(floor(rate * (r - 1) + {mixing.offset(17)!r}) AS BIGINT)) * size AS taken, source,
    CAST(floor(rate * r + {mixing.offset(17)!r}) AS BIGINT) - CAST(floor(rate * (r - 1) + {mixing.offset(17)!r}) AS BIGINT) AS copies
FROM placed"""

_GROUPS = """reach AS (SELECT id, id AS other FROM items UNION SELECT reach.id, b FROM reach JOIN links ON reach.other = a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)"""

OP4_SQL = f"""
WITH RECURSIVE items AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
links AS (SELECT x.id AS a, y.id AS b FROM items x, items y WHERE x.id <> y.id AND list_cosine_similarity(x.v, y.v) >= 0.9),
{_GROUPS}
SELECT id AS vec_id, CAST(coalesce(max(n), 0) AS BIGINT) AS n_links, min(other) AS component_id, id = min(other) AS kept FROM reach LEFT JOIN counted ON id = a GROUP BY id"""

OP10_SQL = f"""
WITH RECURSIVE items AS (SELECT doc_id AS id, {_WORDS} AS w FROM documents),
shingles AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM items),
sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
shared AS (SELECT x.id AS a, y.id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.id <> y.id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON a = x.id JOIN sizes y ON b = y.id WHERE shared.n >= 0.8 * (x.n + y.n - shared.n)),
{_GROUPS}
SELECT id AS doc_id, CAST(coalesce(max(n), 0) AS BIGINT) AS n_links, min(other) AS component_id, id = min(other) AS kept FROM reach LEFT JOIN counted ON id = a GROUP BY id"""



#: The checksum steps through a table of 256 entries, built by its rule.
OP7_SQL = """
WITH docs AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
payloads AS (SELECT doc_id, rid, t, n, encode(t) || from_hex(repeat('00', CAST(CASE WHEN n = 0 THEN 64 ELSE (64 - n % 64) % 64 END AS BIGINT))) AS b FROM docs),
listed AS (SELECT *, octet_length(b) AS size, list_transform(regexp_extract_all(hex(b), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS v FROM payloads),
counts AS (SELECT rid, v, count(*) AS c FROM (SELECT rid, unnest(v) AS v FROM listed) GROUP BY ALL),
features AS (SELECT rid, CAST(sum(v * c) AS BIGINT) AS s, CAST(sum(v * v * c) AS BIGINT) AS q, count(*) AS d, max(c) AS m FROM counts GROUP BY rid),
steps AS (SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k) ORDER BY k) AS steps FROM (SELECT unnest(range(256)) AS k))
SELECT doc_id, n AS n_bytes, size AS payload_bytes, sha256(b) AS payload_sha256,
    xor(list_reduce(v[size - 63 : size], lambda c, x: xor(c >> 8, steps[xor(c, x) % 256 + 1]), 4294967295), 4294967295) AS tail_crc32,
    size + octet_length(encode('P5' || chr(10) || '64 ' || (size // 64) || chr(10) || '255' || chr(10))) AS media_bytes,
    sha256(encode('P5' || chr(10) || '64 ' || (size // 64) || chr(10) || '255' || chr(10)) || b) AS media_sha256,
    '64x' || (size // 64) || ':' || s || ':' || q || ':' || d || ':' || m AS feature,
    CASE WHEN regexp_matches(t, '[^\\x20\\x09-\\x0D]') THEN 1 ELSE 0 END AS position, n || ' bytes' AS caption
FROM listed JOIN features USING (rid), steps"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _op9_sql() -> str:
    """Matches and the gaps between them give places; windows of candidates are unnested."""
    patterns = dict(zip(secrets.KINDS, (secrets.ASSIGN, secrets.ACCESS, secrets.HEX, secrets.CANDIDATE)))
    lists = " UNION ALL ".join(f"SELECT rid, '{k}' AS kind, {i} AS rank, regexp_extract_all(t, {_quoted(p)}) AS m, string_split_regex(t, {_quoted(p)}) AS g FROM docs WHERE regexp_matches(t, {_quoted(p)})" for i, (k, p) in enumerate(patterns.items()))
    refused = " AND ".join(f"NOT regexp_matches(s, {_quoted(p)})" for p in ("^[^0-9]*$", "^[^A-Za-z]*$", *secrets.ALLOWED))
    least = " ".join(f"WHEN regexp_matches(s, {_quoted(shape)}) THEN {bits}" for _, shape, bits in secrets.CLASSES)
    w = secrets.WIDTH
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secrets.KINDS[:3])
    span = "kind || ':' || start || ':' || stop, ',' ORDER BY start, rank"
    return f"""WITH docs AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
    lists AS ({lists}),
    hits AS (SELECT rid, kind, rank, i, m[i] AS s, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM lists)),
    base AS (SELECT rid, kind, rank, s, start, start + length(s) AS stop FROM hits WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(s, {_quoted(secrets.ASSIGN)}, 2)) >= 6 WHEN 'access' THEN length(s) >= 20 ELSE kind = 'hex' END),
    candidates AS (SELECT rid, i, s, start, CASE {least} END AS least FROM hits WHERE kind = 'entropy' AND {refused}),
    letters AS (SELECT rid, i, least, o, substr(s, o + p, 1) AS c FROM (SELECT *, unnest(range(1, {w + 1})) AS p FROM (SELECT *, unnest(range(0, length(s) - {w - 1})) AS o FROM candidates))),
    bits AS (SELECT rid, i, least, o, -sum(n / {w}.0 * log2(n / {w}.0)) AS h FROM (SELECT rid, i, least, o, c, count(*) AS n FROM letters GROUP BY ALL) GROUP BY ALL),
    found AS (SELECT DISTINCT rid, i FROM bits WHERE h >= least - 1e-12),
    spans AS (SELECT rid, kind, rank, start, stop FROM base UNION ALL SELECT c.rid, 'entropy', 3, c.start, c.start + length(c.s) FROM candidates c JOIN found USING (rid, i) WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = c.rid AND b.start < c.start + length(c.s) AND c.start < b.stop)),
    joined AS (SELECT rid, {counts}, coalesce(string_agg({span}) FILTER (kind <> 'entropy'), '') AS base, string_agg({span}) AS spans FROM spans GROUP BY rid)
    SELECT doc_id, {', '.join(f'CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}' for k in secrets.KINDS[:3])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN joined USING (rid)"""


ORACLE_SQL = {"op4_embeddings": OP4_SQL, "op7_media": OP7_SQL, "op9_secrets": _op9_sql(), "op8_mixing": OP8_SQL, "op10_ngram_join": OP10_SQL}
