"""Mixing sources to target weights by systematic sampling.

Each source has a target in words. A document's expected copies are its source's
target over its source's size; the prefix sum of expected copies within the
source, plus one random offset for all, gives a copy per integer boundary that a
document's stretch crosses. Documents stand in order of size within their source,
so that what is taken comes near the target for every size of document.

The prefix sum needs no task that holds a source: rows are dealt by range over
(source, size, ...), ranked inside their range, and shifted by the counts of the
ranges before. Ties and repeated rows are told apart by a row number.

Null texts have size 0; a null source is a source of its own, last in order;
sources of size 0 have target 0, and expected copies of 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brooklet.llm.common import WORD, text_or_empty, written


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> dict[str | None, float]:
    """Words wanted per source: shares of the total by weight, none above `most` times its
    size; what is above goes to the others by weight, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))  # Python orders text by code point
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    out: dict[str | None, float] = {}
    left, open_ = float(sum(sizes.values())), list(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
        open_ = [s for s in open_ if s not in out]
        left -= sum(out[s] for s in over)
    return out


def offset(seed: int) -> float:
    """The one random offset, in (0, 1)."""
    return ((seed * 2654435761) % 2**32 + 0.5) / 2**32


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (1, 2, 3),
    most: float = 3.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    row_col: str | None = None,
) -> DataFrame:
    """Every row with row, doc_id, source, size, source_size, target and copies (0 to ceil(most)).

    `row_col` names a column that numbers the rows; without it they are numbered here.
    Sources are collected to the driver: a row of two numbers for each source name that
    the caller mixes.
    """
    spark = docs.sparkSession
    size = F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    sized = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), row.alias("row")), "sized")
    found = {r[0]: (r[1], r[2]) for r in sized.groupBy("source").agg(F.sum("size"), F.count("*")).collect()}
    want = targets({s: n for s, (n, _) in found.items()}, weights, most)
    schema = T.StructType([T.StructField("m_source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
    per_source = spark.createDataFrame([(s, n, want[s]) for s, (n, _) in found.items()], schema)

    parts = max(1, sized.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the hash spreads equal sizes; the row number tells repeated rows apart
    keyed = sized.withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary")))
    order = [F.col("source").asc_nulls_last(), "size", "h", "row"]
    dealt = written(keyed.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "dealt")
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("part", "source").orderBy("size", "h", "row")))
    before = (
        dealt.groupBy("part", "source").agg(F.count("*").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select(F.col("part").alias("b_part"), F.col("source").alias("b_source"), "before")
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = F.lit(offset(seed))
    at = F.col("rank") + F.col("before")
    joined = ranked.join(before, (F.col("part") == F.col("b_part")) & F.col("source").eqNullSafe(F.col("b_source")), "left")
    joined = joined.join(per_source, F.col("source").eqNullSafe(F.col("m_source")), "left")
    copies = (F.floor(rate * at + u) - F.floor(rate * (at - 1) + u)).cast("long")
    return joined.select("row", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with its own columns. The
    texts are moved once, to meet the copies of their row."""
    names = docs.columns
    own = written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(c) for c in names)).alias("own")), "numbered")
    narrow = own.select("row", F.col("own")[id_col].alias("id"), F.col("own")[text_col].alias("text"), F.col("own")[source_col].alias("source"))
    taken = mix(narrow, id_col="id", row_col="row", **options).filter("copies > 0").select(F.col("row").alias("taken_row"), "copies")
    repeated = own.join(taken, F.col("row") == F.col("taken_row")).select("own", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*(F.col("own")[n].alias(n) for n in names))
