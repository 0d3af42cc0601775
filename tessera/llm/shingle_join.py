"""An exact join on the Jaccard similarity of word shingles, for near dedup."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty
from .components import roots

WORDS, LEAST, SEED = 5, 0.8, 42
#: Frequent shingles are told from one text in SAMPLE; those that FREQUENT of
#: these have, at most ORDERED of them, come last in the shingles' order. Any
#: order gives the same result: this one keeps the lists of the index short.
SAMPLE, FREQUENT, ORDERED = 16, 4, 100_000
#: Bits of a set's parity sketch: each shingle flips one.
PARITY = 1_024
#: Texts are looked up by broadcast up to this many ids of 8 bytes, by a shuffle
#: of the texts beyond it.
BROADCAST_IDS = 1_000_000
#: Sets of one list that a task takes together; a longer list is parted into
#: blocks of that many, and each pair of blocks is a task's.
LIST = 2_048


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The different XXH64 hashes, ascending, of the runs of words (of all words,
    where they are fewer; none of a text without words)."""
    import xxhash

    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(parts), max(1, len(parts) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[-n:].tolist(), strict=True)), np.uint64, n))


def _set_id(grams: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(grams.tobytes(), SEED)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _lists(values: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.zeros(0, np.uint64), *values]).view(np.int64)
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, values)]).astype(np.int32), pa.array(flat))


def _parities(grams: list[np.ndarray]) -> pa.Array:
    bits = [np.bincount((g >> np.uint64(20)).astype(np.int64) % PARITY, minlength=PARITY) & 1 for g in grams]
    flat = np.packbits(np.array(bits, np.uint8).reshape(-1, PARITY), axis=1).view(np.int64).ravel()
    return pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, PARITY // 64, dtype=np.int32), pa.array(flat))


def shingle_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """set (the hash of all shingles) and grams (the shingles) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                grams = [shingles(t.as_py(), words) for t in batch["_text"][at : at + 512]]
                yield pa.RecordBatch.from_arrays([_signed([_set_id(g) for g in grams]), _lists(grams)], ["set", "grams"])

    return docs.select(text_or_empty().alias("_text")).mapInArrow(run, "set long, grams array<long>")


def frequent(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """The frequent shingles, the most frequent last."""
    some = docs.filter(F.pmod(F.xxhash64(text_or_empty()), F.lit(SAMPLE)) == 0).select("text").distinct()
    counts = shingle_sets(some, words).select(F.explode("grams").alias("g")).groupBy("g").count().filter(F.col("count") >= FREQUENT)
    rows = counts.orderBy(F.desc("count"), "g").limit(ORDERED).collect()
    return np.array([r["g"] for r in reversed(rows)], np.int64).view(np.uint64)


def _majority(grams: np.ndarray) -> int:
    """The 64 majority bits of the shingles; 0 of none."""
    ones = np.unpackbits(grams.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(grams), bitorder="little").view("<u8")[0])


def prefixes(docs: DataFrame, words: int, least: Fraction, last: np.ndarray) -> DataFrame:
    """doc_id, copy (the text's hash), set, n (how many shingles), prefix (the
    first n - ceil(least n) + 1 shingles in the order), parity (for each of PARITY
    bits, whether an odd number of shingles has it) and fp (the SimHash of the
    different shingles) for each row of docs."""
    by_value = np.argsort(last)
    ordered, rank = last[by_value], by_value + 1

    def prefix(grams: np.ndarray) -> np.ndarray:
        n = len(grams)
        if len(ordered) and n:
            at = np.minimum(np.searchsorted(ordered, grams), len(ordered) - 1)
            grams = grams[np.argsort(np.where(ordered[at] == grams, rank[at], 0), kind="stable")]
        return grams[: n - -(-n * least.numerator // least.denominator) + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                grams = [shingles(t.as_py(), words) for t in some["_text"]]
                columns = [some["doc_id"], some["copy"], _signed([_set_id(g) for g in grams]), pa.array([len(g) for g in grams], pa.int64()), _lists([prefix(g) for g in grams]), _parities(grams), _signed([_majority(g) for g in grams])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "copy", "set", "n", "prefix", "parity", "fp"])

    rows = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("copy"), text_or_empty().alias("_text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, copy long, set long, n long, prefix array<long>, parity array<long>, fp long")


def _possible(a: dict[str, Column], b: dict[str, Column], least: Fraction) -> Column:
    """Whether sets whose first common shingle is at these places can be alike."""
    need = (a["n"] + b["n"]) * least.numerator
    most = F.least(a["n"] - a["at"], b["n"] - b["at"])
    return most * (least.numerator + least.denominator) >= need


def _pairs_in(sets: np.ndarray, n: np.ndarray, at: np.ndarray, of: np.ndarray, parity: np.ndarray, least: Fraction) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of one list, the pairs that aren't connected yet and that sizes, places and
    parities let be alike, a row against all behind it at a time."""
    num, den, a, b = least.numerator, least.denominator, [], []
    left = n - at
    for i in range(len(sets) - 1):
        j = i + 1 + np.flatnonzero((of[i + 1 :] != of[i]) & (np.minimum(left[i + 1 :], left[i]) * (num + den) >= (n[i + 1 :] + n[i]) * num))
        if len(j):
            apart = np.bitwise_count(parity[j] ^ parity[i]).sum(axis=1, dtype=np.int64)
            j = j[apart * (num + den) <= (n[j] + n[i]) * (den - num)]
        if len(j):
            a.append(np.full(len(j), sets[i]))
            b.append(sets[j])
    return a, b


def _candidates(least: Fraction):
    """Rows (list, set, n, at, of, parity), sorted by list, to pairs (a, b)."""
    names = ["list", "set", "n", "at", "of", "parity"]

    def work(rows: pa.Table) -> pa.RecordBatch:
        cols = [rows[c].to_numpy() for c in names[:5]]
        parity = rows["parity"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, PARITY // 64)
        starts = np.concatenate(([0], np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1, [len(cols[0])]))
        a, b = [], []
        for x, y in zip(starts, starts[1:], strict=False):
            more = _pairs_in(*(c[x:y] for c in cols[1:]), parity[x:y], least)
            a += more[0]
            b += more[1]
        a, b = (np.concatenate([np.zeros(0, np.int64), *c]) for c in (a, b))
        both = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]).select(names)
            rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
            if not rows.num_rows:
                continue
            # The last list may go on in the next batch.
            last = rows["list"].to_numpy()
            cut = int(np.searchsorted(last, last[-1]))
            if cut:
                yield work(rows.slice(0, cut))
            held = rows.slice(cut)
        if held is not None and held.num_rows:
            yield work(held)

    return run


def unconnected(shared: DataFrame, up: DataFrame, prints: DataFrame, least: Fraction) -> DataFrame:
    """Pairs (a, b) of sets in one list that roots (node, root) don't connect and
    that can be alike. Lists whose sets are all connected go; in the others sets
    meet in arrays with their sketches, so that pairs which can't be alike, nearly
    all in a dense group, are no rows."""
    of_key = Window.partitionBy("key")
    named = shared.join(up, shared["set"] == up["node"], "left").select("key", "set", "n", "at", F.coalesce("root", "set").alias("of"))
    apart = materialize(named.withColumn("_low", F.min("of").over(of_key)).withColumn("_high", F.max("of").over(of_key)).filter("_low <> _high").drop("_low", "_high"), "apart")
    sketches = prints.groupBy("set").agg(F.first("parity").alias("parity"))
    hot = apart.groupBy("key").agg(F.count(F.lit(1)).alias("_m")).filter(F.col("_m") > LIST).select("key", F.ceil(F.col("_m") / LIST).cast("int").alias("_blocks"))
    own = F.pmod(F.xxhash64("set"), F.col("_blocks")).cast("int")
    cells = F.when(F.col("_blocks").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda b: F.greatest(b, own) * F.col("_blocks") + F.least(b, own)))
    placed = apart.join(hot, "key", "left").withColumn("cell", F.explode(cells)).withColumn("list", F.when(F.col("cell") == 0, F.col("key")).otherwise(F.xxhash64("key", "cell")))
    rows = placed.join(sketches, "set").select("list", "set", F.col("n").cast("long").alias("n"), F.col("at").cast("long").alias("at"), "of", "parity")
    return rows.repartition("list").sortWithinPartitions("list").mapInArrow(_candidates(least), "a long, b long").distinct()


def hubs(shared: DataFrame, least: Fraction) -> DataFrame:
    """Pairs (a, b) of each list's sets with one of them: the set whose lists are
    the longest, such as a text of which the others are copies."""
    sizes = shared.groupBy("key").agg(F.count(F.lit(1)).alias("_m"))
    weight = shared.join(sizes, "key").groupBy("set").agg(F.sum("_m").alias("w"))
    one = shared.join(weight, "set").select("key", F.struct("w", "set", "n", "at").alias("x"))
    first = one.groupBy("key").agg(F.max("x").alias("y"))
    x, y = ({c: F.col(f"{p}.{c}") for c in ("set", "n", "at")} for p in "xy")
    met = one.join(first, "key").filter((x["set"] != y["set"]) & _possible(x, y, least))
    return met.select(F.least(x["set"], y["set"]).alias("a"), F.greatest(x["set"], y["set"]).alias("b")).distinct()


def verified(pairs: DataFrame, prints: DataFrame, docs: DataFrame, words: int, least: Fraction) -> DataFrame:
    """Those of the pairs (a, b) of sets whose Jaccard similarity is least or more.
    Two sets differ in at least as many shingles as their parities in bits, so
    pairs that differ in too many go first, without loss. For the others shingles
    are made again, once for each set in a pair."""
    sums = prints.groupBy("set").agg(F.first("n").alias("_n"), F.first("parity").alias("_p"))
    side = lambda c: sums.select(F.col("set").alias(c), F.col("_n").alias(f"_n{c}"), F.col("_p").alias(f"_p{c}"))
    apart = F.aggregate(F.zip_with("_pa", "_pb", lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda acc, x: acc + x)
    # Of a + b shingles, alike sets share 2 least / (1 + least) or more.
    near = apart * (least.numerator + least.denominator) <= (F.col("_na") + F.col("_nb")) * (least.denominator - least.numerator)
    pairs = materialize(pairs.join(side("a"), "a").join(side("b"), "b").filter(near).select("a", "b"), "candidates")
    wanted = materialize(pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct(), "wanted")
    ids = materialize(prints.join(wanted, "set", "left_semi").groupBy("set").agg(F.min("doc_id").alias("_id")).select("_id").distinct(), "ids")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi")
    # A doc_id may repeat with other texts; equal sets have equal shingles.
    grams = shingle_sets(texts, words).join(wanted, "set", "left_semi").groupBy("set").agg(F.first("grams").alias("grams"))
    grams = materialize(grams, "shingles")
    both = pairs.join(grams.select(F.col("set").alias("a"), F.col("grams").alias("_ga")), "a").join(grams.select(F.col("set").alias("b"), F.col("grams").alias("_gb")), "b")
    shared = F.size(F.array_intersect("_ga", "_gb"))
    return both.filter(shared * (least.numerator + least.denominator) >= (F.size("_ga") + F.size("_gb")) * least.numerator).select("a", "b")


def shared_postings(prints: DataFrame) -> DataFrame:
    """(key, set, n, at): each set under the shingles of its prefix, of the
    shingles that several sets have."""
    posted = prints.select("set", "n", F.posexplode("prefix").alias("at", "key"))
    of_key = Window.partitionBy("key")
    several = posted.withColumn("_low", F.min("set").over(of_key)).withColumn("_high", F.max("set").over(of_key)).filter("_low <> _high")
    return several.drop("_low", "_high").distinct()


def alike(docs: DataFrame, prints: DataFrame, words: int, least: Fraction, candidates: DataFrame) -> DataFrame:
    """Links (a, b) that connect sets as all pairs of a Jaccard similarity of least
    or more do; candidates are pairs that are looked at first.

    By prefix filtering: two such sets have their first common shingle, in any one
    order of all shingles, within both prefixes; sets are listed under each
    shingle of their prefix, and sizes and that shingle's places bound what else
    they can share. In each list all are first paired with one; pairs that links
    connect by then are left out. Candidates are verified on all their shingles.
    """
    shared = materialize(shared_postings(prints), "postings")
    links = materialize(verified(candidates.unionByName(hubs(shared, least)).distinct(), prints, docs, words, least), "near")
    up = materialize(roots(links), "roots")
    return links.unionByName(verified(unconnected(shared, up, prints, least), prints, docs, words, least))
