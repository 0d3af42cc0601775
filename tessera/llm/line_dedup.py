"""Line dedup by a segment-partition edit join. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialize, text_or_empty

#: Lines within this edit distance are alike.
EDITS = 2
#: Lines of LEAST characters and more are deduped, those under NEAR only exactly
#: (two edits are over a tenth of them) and only where they aren't blank.
LEAST, NEAR = 1, 20
#: Lengths of one class share their segments.
CLASS = 16
#: Candidate lines are looked up by broadcast up to this many ids of 8 bytes, by
#: a shuffle of the lines beyond it.
BROADCAST_IDS = 1_000_000
#: Frequent letters, whose counts two lines within EDITS nearly share.
LETTERS = "entarisohldcumgb"
BITS = 64 // len(LETTERS)


def _segments() -> list[tuple[int, int, bool]]:
    """(segment, shift, whether it also is the indexed one) of all probes. Where
    segment i of EDITS + 1 is the only whole one, each other has one edit, so it
    has moved by i at most from the left, or by EDITS - i from the right."""
    out = []
    for i in range(EDITS + 1):
        reach = min(i, EDITS - i)
        out += [(i, s, s == 0) for s in range(-reach, reach + 1)]
    return out


def _keys(line: Column, size: Column, length_class: Column) -> list[Column]:
    """A hash for each probe: the class, the segment's number and its text. The
    first half of the segments is counted from the line's left end, the others
    from its right end."""
    m = F.floor((length_class * CLASS + NEAR) / (EDITS + 1)).cast("int")
    out = []
    for i, shift, _ in _segments():
        begin = m * i + 1 + shift if 2 * i <= EDITS else size - m * (EDITS - i + 1) + 1 + shift
        out.append(F.xxhash64(length_class, F.lit(i), F.substring(line, begin.cast("int"), m)))
    return out


def _sketch(line: Column) -> Column:
    """Counts, modulo 2^BITS, of the LETTERS, in one long."""
    total = F.lit(0).cast("long")
    for k, c in enumerate(LETTERS):
        n = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))
        total = total.bitwiseOR(F.shiftleft(n.cast("long").bitwiseAND((1 << BITS) - 1), BITS * k))
    return total


def _apart(a: Column, b: Column) -> Column:
    """The sum of the counts' differences: an edit changes two by one at most."""
    out, top, half = F.lit(0).cast("long"), (1 << BITS) - 1, 1 << (BITS - 1)
    for k in range(len(LETTERS)):
        d = F.shiftrightunsigned(a, BITS * k).bitwiseAND(top) - F.shiftrightunsigned(b, BITS * k).bitwiseAND(top)
        out = out + F.abs((d + half).bitwiseAND(top) - half)
    return out


def lines(docs: DataFrame) -> DataFrame:
    """doc, copy (the text's hash), pos, line, id (the line's hash, null where it
    stays as it is: under LEAST, or blank and under NEAR) and place (its rank by document and position)."""
    rows = docs.select(F.col("doc_id").alias("doc"), text_or_empty().alias("_text"))
    parted = rows.select("doc", F.xxhash64("_text").alias("copy"), F.posexplode(F.split("_text", "\n")).alias("pos", "line"))
    place = F.coalesce(F.col("doc").cast("decimal(20,0)"), F.lit(-(1 << 63)).cast("decimal(20,0)")) * F.lit(10**10).cast("decimal(11,0)") + F.col("pos")
    return parted.withColumn("id", F.when((F.length("line") >= NEAR) | (F.length("line") >= LEAST) & F.col("line").rlike(r"[^\x20\x09-\x0D]"), F.xxhash64("line"))).withColumn("place", place.cast("decimal(38,0)"))


def candidates(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of ids, a < b, whose lines share a segment in place and whose
    letter counts are near: all pairs within EDITS are among them.

    The keys of a line are plain columns of an aggregate by line that combines
    before the shuffle, so repeated lines are posted once. Keys that only one
    line has, nearly all, go before the join.
    """
    size = F.length("line")
    own = F.floor((size - NEAR) / CLASS).cast("int")
    below = F.floor((size - EDITS - NEAR) / CLASS).cast("int")
    crosses = (below < own) & (below >= 0)
    probes = _segments()
    far = rows.filter(F.col("id").isNotNull() & (size >= NEAR)).select(
        "id", _sketch(F.col("line")).alias("sketch"),
        *(k.alias(f"own{n}") for n, k in enumerate(_keys(F.col("line"), size, own))),
        *(F.when(crosses, k).alias(f"below{n}") for n, k in enumerate(_keys(F.col("line"), size, below))),
    )
    names = [c for c in far.columns if c != "id"]
    distinct = far.groupBy("id").agg(*(F.first(c).alias(c) for c in names))
    entries = [F.struct(F.col(f"own{n}").alias("key"), F.lit(indexed).alias("indexed")) for n, (_, _, indexed) in enumerate(probes)]
    entries += [F.struct(F.col(f"below{n}").alias("key"), F.lit(False).alias("indexed")) for n in range(len(probes))]
    posted = distinct.select("id", "sketch", F.explode(F.filter(F.array(*entries), lambda e: e["key"].isNotNull())).alias("e")).select("id", "sketch", "e.key", "e.indexed")
    of_key = Window.partitionBy("key")
    shared = materialize(
        posted.withColumn("_low", F.min("id").over(of_key)).withColumn("_high", F.max("id").over(of_key)).filter("_low <> _high").drop("_low", "_high").distinct(), "postings"
    )
    a = shared.filter("indexed").select("key", F.col("id").alias("a"), F.col("sketch").alias("sa"))
    b = shared.select("key", F.col("id").alias("b"), F.col("sketch").alias("sb"), F.col("indexed").alias("both"))
    # Where both are indexed, either order has the pair.
    near = ((F.col("a") < F.col("b")) | ~F.col("both") & (F.col("a") != F.col("b"))) & (_apart(F.col("sa"), F.col("sb")) <= 2 * EDITS)
    return a.join(b, (a["key"] == b["key"]) & near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def within(a: Column, b: Column) -> Column:
    """Whether two lines are within EDITS, by a bit-parallel automaton in a band.

    For each number of edits up to EDITS, the bits of one number are the diagonals
    of the band on which the characters so far can be aligned with as many edits.
    A character moves all of them at once: matched diagonals stay; with one edit
    more all stay (it is replaced), go down (it is deleted) or, from the new bits,
    up (one is inserted). The lines are within EDITS if the last bits have the
    diagonal of their lengths' difference.
    """
    width = 2 * EDITS + 1
    full = (1 << width) - 1
    start = [sum(1 << (EDITS + d) for d in range(e + 1)) for e in range(EDITS + 1)]

    def run(pair: Column) -> Column:
        one, two = pair["a"], pair["b"]

        def step(state: Column, i: Column) -> Column:
            c = F.get(one, i)
            same = F.lit(0)
            for d in range(width):
                same = same.bitwiseOR(F.when(F.get(two, i + (d - EDITS)) == c, 1 << d).otherwise(0))

            def moved(m: Column) -> Column:
                new = [state["r0"].bitwiseAND(m)]
                for e in range(1, EDITS + 1):
                    old = state[f"r{e - 1}"]
                    up = F.shiftleft(new[-1], 1).bitwiseAND(full)
                    new.append(state[f"r{e}"].bitwiseAND(m).bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(up))
                return F.struct(*(r.alias(f"r{e}") for e, r in enumerate(new)))

            return let(same, moved)

        first = F.struct(*(F.lit(r).alias(f"r{e}") for e, r in enumerate(start)))
        last = F.aggregate(F.sequence(F.lit(0), F.size(one) - 1), first, step)
        return F.call_function("shiftright", last[f"r{EDITS}"], F.size(two) - F.size(one) + EDITS).bitwiseAND(1) == 1

    near = F.abs(F.length(a) - F.length(b)) <= EDITS
    short = F.least(F.length(a), F.length(b)) == 0
    letters = F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b"))
    return F.when(~near, False).when(short, True).otherwise(let(letters, run))


def links(rows: DataFrame) -> DataFrame:
    """All pairs (a, b) of ids, a < b, of different lines within EDITS. The texts
    of the candidates' lines are fetched once, and verified in a band."""
    pairs = materialize(candidates(rows), "candidates")
    wanted = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "wanted")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = materialize(rows.filter(F.length("line") >= NEAR).select("id", "line").join(wanted, "id", "left_semi").distinct(), "lines")
    one = texts.select(F.col("id").alias("a"), F.col("line").alias("la"))
    two = texts.select(F.col("id").alias("b"), F.col("line").alias("lb"))
    return pairs.join(one, "a").join(two, "b").filter(within(F.col("la"), F.col("lb"))).select("a", "b").distinct()


def removals(docs: DataFrame) -> DataFrame:
    """doc, copy, n_removed, n_links and removed (positions, ascending), a row for
    each distinct (doc_id, text). A line that lines() gives an id goes where
    the same line, or one within EDITS (both at least NEAR long), first stands
    earlier by doc_id and position, whether that one stays or not. n_links counts
    the different lines that the document's lines are linked to."""
    rows = lines(docs)
    pairs = materialize(links(rows), "links")
    slim = rows.filter(F.col("id").isNotNull()).select("doc", "copy", "pos", "id", "place")
    firsts = slim.groupBy("id").agg(F.min("place").alias("first"))
    ends = pairs.unionByName(pairs.select(F.col("a").alias("b"), F.col("b").alias("a")))
    linked = ends.select(F.col("a").alias("id")).distinct()
    known = materialize(firsts.join(linked, "id", "left_semi"), "linked")
    at = ends.join(known.select(F.col("id").alias("a"), F.col("first").alias("fa")), "a").join(known.select(F.col("id").alias("b"), F.col("first").alias("fb")), "b")
    later = at.groupBy("a").agg(F.max(F.col("fb") < F.col("fa")).alias("_later"), F.count(F.lit(1)).alias("_links")).select(F.col("a").alias("id"), "_later", "_links")
    by_id = firsts.join(later, "id", "left")
    met = slim.join(by_id, "id").select("doc", "copy", "pos", ((F.col("place") > F.col("first")) | F.coalesce("_later", F.lit(False))).alias("_goes"), F.coalesce("_links", F.lit(0)).alias("_links"))
    each = met.groupBy("doc", "copy", "pos").agg(F.max("_goes").alias("_goes"), F.max("_links").alias("_links"))
    return each.groupBy("doc", "copy").agg(
        F.count(F.when(F.col("_goes"), 1)).alias("n_removed"), F.sum("_links").alias("n_links"), F.sort_array(F.collect_list(F.when(F.col("_goes"), F.col("pos")))).alias("removed")
    )


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, n_links and removed for each row of docs.

    Lines end at line feeds; null and empty texts are one empty line. Null
    doc_ids come first in the order. Rows that repeat doc_id and text are one
    document there and are each returned. Other columns are ignored, an empty
    table gives no rows.
    """
    gone = removals(docs)
    rows = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("_copy"), F.size(F.split(text_or_empty(), "\n")).cast("long").alias("n_lines"))
    return rows.join(gone, rows["doc_id"].eqNullSafe(gone["doc"]) & (rows["_copy"] == gone["copy"]), "left").select(
        "doc_id", "n_lines", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed")
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs, with all columns, each text without the lines that go. Null texts
    stay null; an empty table stays empty."""
    gone = removals(docs).filter(F.size("removed") > 0).select("doc", "copy", "removed")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(text_or_empty()).alias("_copy"))
    met = rows.join(gone, F.col("row")["doc_id"].eqNullSafe(F.col("doc")) & (F.col("_copy") == F.col("copy")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size(F.split(F.col("row")["text"], "\n")) - 1), F.col("removed"))
    kept = let(F.split(F.col("row")["text"], "\n"), lambda lines: F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    text = F.when(F.col("removed").isNull(), F.col("row")["text"]).otherwise(kept)
    return met.select(*(text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
