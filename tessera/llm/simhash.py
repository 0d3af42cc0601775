"""SimHash near-dedup with a byte-position inverted index and count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingle_join
from .common import fresh_names, materialize, text_or_empty
from .components import roots

WORDS, DISTANCE, SEED = 4, 4, 42
#: Fingerprints within DISTANCE share so many of their eight bytes at least.
BYTES = 8 - DISTANCE
#: Postings of one key that a task takes together; a longer list is parted into
#: blocks of that many, and each pair of blocks is a task's.
LIST = 4_096


def _guards() -> list[tuple[int, int, int]]:
    """Triples of byte positions such that any four of the eight hold one: with
    the positions in three groups, the triples inside a group and those with two
    in a group and one in the next (Turán)."""
    group = [0, 0, 0, 1, 1, 1, 2, 2]
    wanted = {(g, g, g) for g in range(3)} | {tuple(sorted((g, g, (g + 1) % 3))) for g in range(3)}
    return [t for t in combinations(range(8), 3) if tuple(sorted(group[i] for i in t)) in wanted]


GUARDS = _guards()


def fingerprint(text: str) -> int:
    """The 64 majority bits of the XXH64 of the word shingles, repeats counted."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - WORDS + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[-n:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + 65_536], stops[at : at + 65_536], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch["_text"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps)], ["doc_id", "fp"])

    rows = docs.select("doc_id", text_or_empty().alias("_text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, fp long")


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs are within DISTANCE bits: the positions at which they share a
    byte are tallied, and only pairs with BYTES of them or more are verified."""
    apart = np.atleast_1d(x ^ y)
    near = (apart.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= BYTES
    near[near] = np.bitwise_count(apart[near].view(np.uint64)) <= DISTANCE
    return near


def _spanning(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of one list: from each fingerprint reached, its
    neighbours among those not reached yet, so a cluster costs a few sweeps."""
    left, out = np.unique(fps), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count((left ^ x).view(np.uint64)) <= DISTANCE
            if near.any():
                out += [(int(x), int(y)) for y in left[near]]
                queue += list(left[near])
                left = left[~near]
    return out


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among the fingerprints of each list; rows come sorted by list."""

    def links(lists: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.concatenate(([0], np.flatnonzero(lists[1:] != lists[:-1]) + 1, [len(lists)]))
        sizes = np.diff(starts)
        a, b = [], []
        small = np.repeat(sizes <= 16, sizes)
        for lag in range(1, min(16, int(sizes.max(initial=1)))):
            same = (lists[lag:] == lists[:-lag]) & small[lag:]
            x, y = fps[lag:][same], fps[:-lag][same]
            near = _alike(x, y) & (x != y)
            a.append(x[near])
            b.append(y[near])
        for i in np.flatnonzero(sizes > 16):
            if found := _spanning(fps[starts[i] : starts[i + 1]]):
                x = np.array(found, np.int64)
                a.append(x[:, 0])
                b.append(x[:, 1])
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *a]), np.concatenate([none, *b])

    held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for batch in batches:
        lists, fps = (np.concatenate((h, batch[c].to_numpy(zero_copy_only=False))) for h, c in zip(held, ("list", "fp"), strict=True))
        # The last list may go on in the next batch.
        cut = int(np.searchsorted(lists, lists[-1])) if len(lists) else 0
        held = lists[cut:], fps[cut:]
        a, b = links(lists[:cut], fps[:cut])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
    a, b = links(*held)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints (fp) as all pairs of at
    most DISTANCE differing bits do.

    Such a pair shares at least 8 - DISTANCE = 4 of the 8 bytes in place. The
    index lists fingerprints under each (three positions, their bytes) of GUARDS,
    of which any pair with four shared bytes has one in common: that is the count
    filter on the byte postings, met without tallying each byte's own long list.
    Candidates are then verified on all 64 bits. In a list, only links of a
    spanning forest are made, so a dense group costs rows in proportion.
    """
    byte = lambda i: F.shiftrightunsigned("fp", 8 * i).bitwiseAND(255)
    keys = [
        (F.lit(n).cast("long") * (1 << 24) + byte(i) * (1 << 16) + byte(j) * (1 << 8) + byte(k)) for n, (i, j, k) in enumerate(GUARDS)
    ]
    posted = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    hot = posted.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > LIST).select("key", F.ceil(F.col("_n") / LIST).cast("int").alias("_blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("_blocks")).cast("int")
    cells = F.when(F.col("_blocks").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda b: F.greatest(b, own) * F.col("_blocks") + F.least(b, own))
    )
    lists = posted.join(hot, "key", "left").select("fp", "key", F.explode(cells).alias("cell")).select(F.when(F.col("cell") == 0, F.col("key")).otherwise(F.xxhash64("key", "cell")).alias("list"), "fp")
    return lists.repartition("list").sortWithinPartitions("list").mapInArrow(_verified, "a long, b long")


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of docs.

    Null and empty texts, and those without a word, have the fingerprint zero and
    are linked like any other. component_id is the smallest doc_id that links of
    fingerprints reach; null doc_ids give way to others. Repeated rows are each
    returned, other columns are ignored, an empty table gives no rows.
    """
    prints = materialize(fingerprints(docs), "simhash")
    up = roots(fingerprint_links(prints.select("fp").distinct()))
    rooted = materialize(prints.join(up, prints["fp"] == up["node"], "left").select("doc_id", "fp", F.coalesce("root", "fp").alias("root")), "rooted")
    names = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(names, "root").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_copies(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id, copy (the text's hash) and component_id for each row of docs.

    Two texts are linked where the Jaccard similarity of their sets of word
    shingles is least (above 0) or more. First by SimHash: texts whose
    fingerprints differ in at most DISTANCE bits, by the byte-position index, are
    candidates, verified on all their shingles. At 0.8 about ten of 64 bits differ
    and no byte of the eight need agree, so no index of them finds all such pairs:
    those that are left come from an exact join on the shingles (see
    shingle_join.alike), which leaves out what is connected already.

    component_id is the smallest doc_id that links reach; null doc_ids give way to
    others. Null, empty and wordless texts are one group. Repeated rows are each
    returned, other columns are ignored, an empty table gives no rows.
    """
    least = Fraction(str(least))
    prints = materialize(shingle_join.prefixes(docs, words, least, shingle_join.frequent(docs, words)), "prints")
    # One set stands for all of a fingerprint.
    named = prints.groupBy("fp").agg(F.min("set").alias("rep"))
    same = prints.join(named, "fp").filter("set <> rep").select(F.least("set", "rep").alias("a"), F.greatest("set", "rep").alias("b"))
    other = lambda c: named.select(F.col("fp").alias(c), F.col("rep").alias(f"_{c}"))
    near = fingerprint_links(named.select("fp")).join(other("a"), "a").join(other("b"), "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
    up = materialize(roots(shingle_join.alike(docs, prints, words, least, same.unionByName(near))), "roots")
    rooted = materialize(prints.join(up, prints["set"] == up["node"], "left").select("doc_id", "copy", F.coalesce("root", "set").alias("root")), "rooted")
    # Hot groups combine before the shuffle, and the join can split them.
    names = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(names, "root").select("doc_id", "copy", "component_id")


def near_dedup(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of docs that stay, with all columns: of each group of near_copies,
    that of its smallest doc_id. Rows that repeat that doc_id and text all stay."""
    kept = near_copies(docs, words, least).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept"), F.col("copy").alias("_copy")).distinct()
    texts = fresh_names(docs, kept)
    return docs.join(texts, docs["doc_id"].eqNullSafe(texts[texts.columns[0]]) & (F.xxhash64(text_or_empty()) == texts[texts.columns[1]]), "left_semi")
