"""Document fingerprints: one-permutation MinHash, optimally densified, with
packed low-order bits. DataFrame operations only."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, let, materialize

SHINGLE, BINS, BITS = 5, 256, 4
#: Bins in one packed long.
PACKED = 64 // BITS


def shingle_hashes(text: Column) -> Column:
    """Hashes of the runs of five lower-cased words (of all, where they are
    fewer; none of a text without words)."""
    plain = F.trim(F.regexp_replace(F.lower(text), SPACES, " "))
    runs = lambda w: F.when(
        F.size(w) > SHINGLE, F.transform(F.sequence(F.lit(1), F.size(w) - SHINGLE + 1), lambda i: F.xxhash64(F.slice(w, i, SHINGLE)))
    ).otherwise(F.array(F.xxhash64(w)))
    return F.when(plain == "", F.array().cast("array<bigint>")).otherwise(let(F.split(plain, " "), runs))


def _walks() -> tuple[Column, Column]:
    """For each bin, the start and the odd step of its own walk over all bins."""
    rng = random.Random(BINS)
    numbers = lambda odd: F.array(*(F.lit(rng.randrange(BINS) | odd) for _ in range(BINS)))
    return numbers(0), numbers(1)


def packed_fingerprint(text: Column) -> Column:
    """The fingerprint as longs of 16 bins each, no longs for a text without words.

    A hash's highest eight bits are its bin. One sort brings each bin's least hash
    to the bin's front; a greatest hash put into each bin beforehand marks the bin
    as empty where it comes first. An empty bin takes the value of the first
    filled one on its own walk over the bins; the walks are the same for all
    texts. The lowest four bits of each bin's value are kept.
    """
    low = 64 - (BINS - 1).bit_length()
    marker = lambda p: F.shiftleft(p.cast("long") - BINS // 2, low) + F.lit((1 << low) - 1)
    bin_of = lambda x: F.shiftright(x, low)
    markers = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), marker)
    firsts = lambda s: F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1))))
    start, step = _walks()

    def densified(v: Column) -> Column:
        visit = lambda i, j: F.get(v, (F.get(start, i) + F.get(step, i) * j).bitwiseAND(BINS - 1))
        return F.transform(v, lambda x, i: F.coalesce(x, *(visit(i, j) for j in range(BINS))))

    def packed(d: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(BINS // PACKED - 1)),
            lambda g: F.aggregate(F.slice(d, g * PACKED + 1, PACKED), F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, BITS).bitwiseOR(x)),
        )

    def whole(h: Column) -> Column:
        ordered = F.sort_array(F.concat(h, markers))
        values = F.transform(let(ordered, firsts), lambda x, p: F.when(x != marker(p), x.bitwiseAND((1 << BITS) - 1)))
        return F.when(F.size(h) == 0, h).otherwise(let(let(values, densified), packed))

    return let(shingle_hashes(text), whole)


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard similarity that two packed fingerprints estimate: the share of
    equal bins, less what bins of unlike values share by chance. Two empty
    fingerprints are alike, an empty one is unlike any other."""
    apart = lambda z: F.bit_count((lambda t: t.bitwiseOR(F.shiftrightunsigned(t, 2)))(z.bitwiseOR(F.shiftrightunsigned(z, 1))).bitwiseAND(0x1111111111111111))
    unlike = F.aggregate(F.zip_with(a, b, lambda x, y: apart(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    chance = 1 / (1 << BITS)
    share = (F.lit(1.0) - unlike / BINS - chance) / (1 - chance)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.greatest(F.lit(0.0), share))


def as_hex(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (packed) for each row of docs; null texts count as
    empty. The operator's general form."""
    return docs.select("doc_id", packed_fingerprint(F.coalesce("text", F.lit(""))).alias("fingerprint"))


def following(rows: DataFrame) -> DataFrame:
    """rows (_id, _h, _n), distinct, with _next_id and _next_h: those of the row
    that follows by _id, nulls first, then _h; the first follows the last. Rows
    are dealt by range; the last of a range takes the head of the next one, and
    only the heads, one a range, are in one task."""
    dealt = materialize(rows.repartitionByRange(F.col("_id").asc_nulls_first(), "_h").withColumn("_range", F.spark_partition_id()), "ranges")
    by = [F.col("_id").asc_nulls_first(), F.col("_h")]
    window = Window.partitionBy("_range").orderBy(*by)
    placed = dealt.withColumn("_at", F.row_number().over(window)).withColumn("_follow", F.lead(F.struct("_id", "_h")).over(window))
    heads = placed.filter("_at = 1").select("_range", F.struct("_id", "_h").alias("_head"))
    order = Window.orderBy("_range")
    ends = heads.select("_range", F.coalesce(F.lead("_head").over(order), F.first("_head").over(order)).alias("_wrap"))
    both = placed.join(ends, "_range").withColumn("_to", F.coalesce("_follow", "_wrap"))
    return both.select("_id", "_h", "_n", F.col("_to._id").alias("_next_id"), F.col("_to._h").alias("_next_h"))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """For each row of docs: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) code points
    replaced by the first as many (or all) of the next document, by ascending
    doc_id, after the last the first. Null texts count as empty. A null doc_id
    comes first; rows of one doc_id follow each other by their text's hash, and
    rows that repeat doc_id and text count as one document there and are each
    returned. Other columns are ignored, an empty table gives no rows.

    A text is dealt by (doc_id, hash) once: the exchange serves both the join
    that cuts what the document before needs of it and the join that brings it
    what it needs itself.
    """
    rows = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_text")).withColumn("_h", F.xxhash64("_text"))
    links = materialize(following(rows.select("_id", "_h", F.length("_text").alias("_n")).distinct()), "following")
    same = lambda a, b, x, y, u, v: a[x].eqNullSafe(b[u]) & (a[y] == b[v])
    before = links.select(F.col("_next_id").alias("_to_id"), F.col("_next_h").alias("_to_h"), F.col("_id").alias("_for_id"), F.col("_h").alias("_for_h"), F.floor(F.col("_n") / 2).cast("int").alias("_half"))
    cut = rows.join(before, same(rows, before, "_id", "_h", "_to_id", "_to_h")).select("_for_id", "_for_h", F.substring("_text", F.lit(1), F.col("_half")).alias("_tail"))
    cut = cut.dropDuplicates(["_for_id", "_for_h"])
    n = F.length("_text")
    edited = F.concat(F.substring("_text", F.lit(1), (n - F.floor(n / 2)).cast("int")), "_tail")
    both = rows.join(cut, same(rows, cut, "_id", "_h", "_for_id", "_for_h")).select("_id", "_h", "_text", edited.alias("_edited"))
    prints = materialize(
        both.select("_id", "_h", n.cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"), packed_fingerprint(F.col("_text")).alias("_print"), packed_fingerprint(F.col("_edited")).alias("_edited_print")),
        "fingerprints",
    )
    nexts = prints.select(F.col("_id").alias("_to_id"), F.col("_h").alias("_to_h"), F.col("_print").alias("_next_print")).distinct()
    to = links.join(nexts, same(links, nexts, "_next_id", "_next_h", "_to_id", "_to_h")).select(F.col("_id").alias("_from_id"), F.col("_h").alias("_from_h"), "_next_print")
    return prints.join(to, same(prints, to, "_id", "_h", "_from_id", "_from_h")).select(
        F.col("_id").alias("doc_id"), "n_chars", "edited_sha256", as_hex(F.col("_print")).alias("fingerprint"), as_hex(F.col("_edited_print")).alias("edited_fingerprint"),
        likeness(F.col("_print"), F.col("_edited_print")).alias("near_edited"), likeness(F.col("_print"), F.col("_next_print")).alias("near_next"),
    )
