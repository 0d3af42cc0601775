"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

WEIGHTS = (5, 2, 1)
#: The digits of the seeded hash that make one level of buckets: 256 of them.
LEVEL = 2


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in text: each word's start, with the white
    space before it, is taken out, and the loss in length is counted."""
    padded = F.concat(F.lit(" "), F.coalesce(text, F.lit("")))
    return ((F.length(padded) - F.length(F.regexp_replace(padded, r"[\x20\x09-\x0D][^\x20\x09-\x0D]", ""))) / 2).cast("long")


def ranked(sources: DataFrame, key: str) -> DataFrame:
    """sources with _rank, their place by code point from 0, null last. Rows are
    dealt by range, ranked inside a range, and moved by the number of rows in the
    ranges before; only that last step, a row a range, is one task's."""
    dealt = materialize(
        sources.repartitionByRange(F.col(key).asc_nulls_last()).withColumn("_range", F.spark_partition_id()), "ranges"
    )
    before = (
        dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))
        .select("_range", F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(F.col(key).asc_nulls_last()))
    return dealt.withColumn("_in", inside - 1).join(before, "_range").withColumn("_rank", F.col("_in") + F.col("_before")).drop("_range", "_in", "_before")


def water_fill(sources: DataFrame, share: float, epochs: float, weights: tuple = WEIGHTS) -> DataFrame:
    """sources (source, source_size) with target: share of all sizes, dealt by
    weight; a source above epochs times its size is clamped to that, and the
    excess goes to the others by weight, until none is above.

    A round is one aggregate over the sources; the driver holds two numbers.
    """
    by = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    src = materialize(
        ranked(sources, "source").withColumn("_w", by.cast("double")).withColumn("_cap", F.col("source_size") * F.lit(float(epochs))), "sources"
    )
    total = share * (src.agg(F.sum("source_size")).first()[0] or 0)
    level, clamped = 0.0, -1
    while True:
        over = F.col("_w") * F.lit(level) > F.col("_cap")
        n, fixed, free = src.agg(
            F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, F.col("_cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("_w"))), F.lit(0.0))
        ).first()
        if n == clamped or not free:
            break
        clamped, level = n, max(0.0, total - fixed) / free
    return src.withColumn("target", F.round(F.least(F.col("_cap"), F.col("_w") * F.lit(level)), 6)).drop("_rank", "_w", "_cap")


def mix(docs: DataFrame, share: float = 1.5, epochs: float = 2.0, weights: tuple = WEIGHTS, seed: str = "mix") -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target,
    copies, taken.

    Every document of a source is taken floor(target / source_size) times. What
    is then missing comes from the source's documents in the order of a seeded
    hash of doc_id: whole documents, and of the one where the sum is reached, a
    part. So each source's taken words equal its rounded target, and no document
    passes one repetition more than the whole ones. copies is taken in whole
    documents, the part rounded; rows without words follow their place in that
    order.

    The place where the sum is reached is found by a histogram over the first two
    hex digits of the hash, then over the next two inside that bucket; only the
    documents left (one in 65,536 of a source) are put in order, so no task needs
    a source's documents together.

    Null text: size 0. Null sources are one source, ranked last. Null doc_ids
    share one place in the order; rows that repeat a doc_id are dealt one after
    the other. Other columns are ignored. An empty table gives no rows.
    """
    slim = materialize(
        docs.select(
            "doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
            F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_u"),
        ), "sizes",
    )
    src = water_fill(slim.groupBy("source").agg(F.sum("size").alias("source_size")), share, epochs, weights)
    words = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(words / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(F.lit(0)).cast("long")
    src = materialize(src.withColumn("_whole", whole).withColumn("_left", words - F.col("_whole") * F.col("source_size")), "targets")

    def joined(rows: DataFrame, by: DataFrame) -> DataFrame:
        by = by.withColumnRenamed("source", "_source")
        return rows.join(by, rows["source"].eqNullSafe(by["_source"])).drop("_source")

    def level(rows: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """rows before, after and inside the bucket where _left is reached; the
        last with _left less what comes before that bucket."""
        digit = F.substring("_u", LEVEL * n + 1, LEVEL)
        totals = rows.groupBy("source", digit.alias("_b")).agg(F.sum("size").alias("_words"))
        upto = F.sum("_words").over(Window.partitionBy("source").orderBy("_b"))
        left = rows.groupBy("source").agg(F.first("_left").alias("_goal"))
        crossing = (
            joined(totals.withColumn("_upto", upto), left)
            .filter((F.col("_upto") >= F.col("_goal")) & (F.col("_upto") - F.col("_words") < F.col("_goal")))
            .select("source", F.col("_b").alias("_at"), (F.col("_upto") - F.col("_words")).alias("_base"))
        )
        by = crossing.withColumnRenamed("source", "_source")
        placed = materialize(rows.join(by, rows["source"].eqNullSafe(by["_source"]), "left").drop("_source").withColumn("_b", digit), f"level{n}")
        done = placed.drop("_at", "_base", "_b")
        first = done.filter(placed["_at"].isNotNull() & (placed["_b"] < placed["_at"]))
        last = done.filter(placed["_at"].isNull() | (placed["_b"] > placed["_at"]))
        return first, last, placed.filter("_b = _at").withColumn("_left", F.col("_left") - F.col("_base")).drop("_at", "_base", "_b")

    first, last, inside = level(joined(slim, src), 0)
    first1, last1, inside = level(inside, 1)
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("_u", F.col("doc_id"), "size").rowsBetween(Window.unboundedPreceding, 0))
    before = F.col("_upto") - F.col("size")
    inside = (
        inside.withColumn("_upto", upto)
        .withColumn("_extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_left") - before)))
        .withColumn("_more", F.when(F.col("size") > 0, F.col("_extra") * 2 >= F.col("size")).otherwise(before < F.col("_left")))
        .drop("_upto")
    )
    taken = lambda df, yes: df.withColumn("_extra", F.col("size") if yes else F.lit(0).cast("long")).withColumn("_more", F.lit(yes))
    every = inside
    for df, yes in ((first, True), (first1, True), (last, False), (last1, False)):
        every = every.unionByName(taken(df, yes))
    return every.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("_whole") + F.col("_more").cast("long")).alias("copies"),
        (F.col("_whole") * F.col("size") + F.col("_extra")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of docs, each as often as mix() says, whole. Rows
    that repeat doc_id, source and size are dealt the sum of their copies: each
    the same, the first ones by the text's hash one more. For these, rows are
    placed by 256 slots of that hash, so that a key's rows aren't one task's."""
    key = lambda size, source: F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), size.cast("string"), F.coalesce(source, F.lit("null"))))
    copies = materialize(
        mix(docs, **options).groupBy(key(F.col("size"), F.col("source")).alias("key")).agg(F.sum("copies").alias("sum"), F.count(F.lit(1)).alias("n"))
        .filter("sum > 0").select("key", F.floor(F.col("sum") / F.col("n")).cast("int").alias("copies"), (F.col("sum") % F.col("n")).alias("more")),
        "copies",
    )
    rows = docs.select(F.struct(*docs.columns).alias("row"), key(word_count(F.col("text")), F.col("source").cast("string")).alias("key"), F.xxhash64(text_or_empty()).alias("h"))
    # Where a source's target is reached: one key a source at most.
    odd = rows.join(F.broadcast(copies.filter("more > 0")), "key").withColumn("slot", F.pmod("h", F.lit(256)))
    slots = odd.groupBy("key", "slot").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("key").orderBy("slot")) - F.col("n")
    place = F.row_number().over(Window.partitionBy("key", "slot").orderBy("h")) + F.col("before")
    dealt = odd.join(slots.select("key", "slot", before.alias("before")), ["key", "slot"]).withColumn("copies", F.col("copies") + (place <= F.col("more")).cast("int"))
    every = rows.join(copies.filter("more = 0"), "key").select("row", "copies").unionByName(dealt.select("row", "copies"))
    return every.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*(F.col("row")[c].alias(c) for c in docs.columns))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix|' || coalesce(doc_id::VARCHAR, '')) AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM d GROUP BY source
), c AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total,
         row_number() OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST) AS k
  FROM s
), l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam
  FROM c
), f AS (SELECT coalesce(arg_min(lam, k) FILTER (lam * w <= cap), max(lam)) AS lam FROM l
), t AS (
  SELECT c.source, c.source_size, round(least(c.cap, c.w * f.lam), 6) AS target FROM c, f
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(round(target) / source_size)::BIGINT ELSE 0 END AS whole FROM t
), r AS (
  SELECT d.*, q.source_size, q.target, q.whole, round(q.target)::BIGINT - q.whole * q.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, rest - before)))::BIGINT AS taken
FROM r
"""
