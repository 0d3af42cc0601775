"""Suffix-array dedup: repeated byte windows by depth-limited radix passes.

The suffixes of all texts are ordered only as deep as the window, by passes on
ever longer digits, and groups that a pass leaves with one suffix are done. The
passes needn't take every suffix: a window's least hash of GRAM bytes marks the
same place in each of its copies, so suffixes at these marks stand for the
windows around them.

1. The first digit is the mark's GRAM bytes.
2. The second is the whole stretch of windows that share the mark. Of equal
   stretches all but the first are repeats, window by window.
3. Where a first digit has several second digits, the first stretch of each is
   taken apart into its windows; equal groups at this depth are the repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty
from .mixing import ranked

WINDOW, GRAM = 100, 24
#: Bytes that are worked on at once.
BLOCK = 2_000_000
#: A mark with so many second digits in one block is dealt by both digits, and
#: one with so many of them in all is dealt by window in the last pass.
HOT_BLOCK, HOT = 64, 20_000
NO_ID = -(1 << 63)
MARK, HOT_MARK, SIGN, DONE = 0, 1, 2, 3

_U = np.uint64
_TABLE = np.random.default_rng(7).integers(1, 1 << 63, (2, 256), dtype=np.uint64) | _U(1)
_BASE = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_MOD = 1 << 64


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM = 16 + 8 bytes at each place, by doubling."""
    power = lambda n: _U(pow(_BASE[0], n, _MOD))
    h, held = _TABLE[0][data], {}
    for n in (1, 2, 4, 8):
        h = h[:-n] * power(n) + h[n:]
        held[2 * n] = h
    return _mix(held[16][: len(data) - GRAM + 1] * power(8) + held[8][16:])


class Stretches:
    """Hashes of any stretch of data, from sums of its bytes by place."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, which: int):
        if which not in self._powers or len(self._powers[which][0]) <= len(data):
            self._powers[which] = tuple(self._rising(x, max(BLOCK + 400, len(data)) + 1) for x in (_BASE[which], pow(_BASE[which], -1, _MOD)))
        up, self.down = self._powers[which]
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[which][data] * up[: len(data)], dtype=np.uint64)))

    @staticmethod
    def _rising(x: int, n: int) -> np.ndarray:
        steps = np.full(n, x, np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    def hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[begin]) * self.down[begin])


def _marks(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, mark, hash at the mark) of the stretches of
    data, where ends has for each place the end of its text."""
    none = np.zeros(0, np.int64)
    if len(data) < WINDOW:
        return none, none, none, none.astype(np.uint64)
    h = _gram_hashes(data)
    low = (h & ~_U(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    for n in (1, 2, 4, 8, 16, 32):
        low = np.minimum(low[:-n], low[n:])
    wide = WINDOW - GRAM + 1
    low = np.minimum(low[: len(low) - (wide - 64)], low[wide - 64 :])
    at = np.flatnonzero(np.arange(len(low)) + WINDOW <= ends[: len(low)])
    mark = (low[at] & _U(0xFFFFFF)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (mark[1:] != mark[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:] - 1, [len(at) - 1])) if len(at) else first
    return at[first], at[last], mark[first], h[mark[first]]


def _blocks(batch: pa.RecordBatch) -> Iterator[list[tuple[int, int, bytes]]]:
    """(doc, offset, bytes) of texts or, of those beyond BLOCK, of pieces that
    overlap by a window less one byte."""
    out, size = [], 0
    for doc, text in zip(batch["_doc"].to_pylist(), batch["_text"], strict=True):
        raw = text.as_py().encode("utf-8", "surrogatepass")
        for at in range(0, max(1, len(raw) - WINDOW + 1), BLOCK):
            piece = raw[at : at + BLOCK + WINDOW - 1]
            if out and size + len(piece) > BLOCK:
                yield out
                out, size = [], 0
            out.append((doc, at, piece))
            size += len(piece)
    if out:
        yield out


def _runs(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of covered bytes, from stretches in any order."""
    if not len(doc):
        return doc, begin, end
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    group = np.cumsum(np.concatenate(([0], doc[1:] != doc[:-1])))
    # Ends never exceed this, so one running maximum serves all documents.
    far = end + group * (int(end.max()) + 1)
    upto = np.maximum.accumulate(far) - group * (int(end.max()) + 1)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (begin[1:] > upto[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:] - 1, [len(doc) - 1]))
    return doc[first], begin[first], upto[last]


def _pack(mark: np.ndarray, before: np.ndarray, after: np.ndarray, kind: np.ndarray | int) -> np.ndarray:
    return mark << 18 | before << 11 | after << 4 | kind


def _digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes 1 and 2 of each block: rows (key, second, doc, at), one for each
    pair of digits, its first; the others' runs are decided and are rows too."""
    for batch in batches:
        for block in _blocks(batch):
            data = np.frombuffer(b"".join(x[2] for x in block), np.uint8)
            sizes = np.array([len(x[2]) for x in block])
            stops = np.cumsum(sizes)
            first, last, mark, gram = _marks(data, np.repeat(stops, sizes))
            if not len(first):
                continue
            of = np.searchsorted(stops, mark, side="right")
            doc = np.array([x[0] for x in block], np.int64)[of]
            move = np.array([x[1] for x in block], np.int64)[of] - (stops - sizes)[of]
            before, after = mark - first, mark - last
            second = _mix(Stretches(data, 1).hash(first, last + WINDOW) + (before << 8 | after).astype(np.uint64))
            place = mark + move
            order = np.lexsort((place, doc, second, gram))
            gram, second, doc, place, before, after = (x[order] for x in (gram, second, doc, place, before, after))
            new = np.ones(len(gram), bool)
            new[1:] = (gram[1:] != gram[:-1]) | (second[1:] != second[:-1])
            front = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            again = (doc != doc[front]) | (place != place[front])
            d, b, e = _runs(doc[again], (place - before)[again], (place - after)[again] + WINDOW)
            fresh = np.ones(len(gram), bool)
            fresh[1:] = gram[1:] != gram[:-1]
            starts = np.flatnonzero(fresh)
            hot = np.repeat(np.add.reduceat(new, starts) >= HOT_BLOCK, np.diff(np.append(starts, len(gram))))
            key = np.where(hot, gram ^ _mix(second), gram)[new].view(np.int64)
            sign = gram[fresh & hot].view(np.int64)
            spread = _mix(d.view(np.uint64) * _U(_BASE[0]) + b.astype(np.uint64)).view(np.int64)
            zero = np.zeros(len(sign), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((key, sign, spread))), pa.array(np.concatenate((second[new].view(np.int64), zero, e))),
                    pa.array(np.concatenate((doc[new], zero + NO_ID, d))),
                    pa.array(np.concatenate((_pack(place[new], before[new], after[new], np.where(hot[new], HOT_MARK, MARK)), zero + SIGN, b << 18 | DONE))),
                ],
                ["key", "second", "doc", "at"],
            )


_FOUND = ["doc", "begin", "finish", "gram", "at"]


def _found(doc: np.ndarray, begin: np.ndarray, end: np.ndarray, ask_doc: np.ndarray | None = None, gram: np.ndarray | None = None, at: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of runs (at null), then rows that ask for a stretch's windows."""
    n, m = len(doc), 0 if ask_doc is None else len(ask_doc)
    cat = lambda x, y: np.concatenate((x, np.zeros(0, np.int64) if y is None else y)).astype(np.int64)
    zero = np.zeros(m, np.int64)
    mask = np.arange(n + m) < n
    return pa.RecordBatch.from_arrays([pa.array(cat(doc, ask_doc)), pa.array(cat(begin, zero)), pa.array(cat(end, zero)), pa.array(cat(np.zeros(n, np.int64), gram)), pa.array(cat(np.zeros(n, np.int64), at), mask=mask)], _FOUND)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes 1 and 2 of all blocks together; rows come sorted. Of the key that a
    batch ends in, the first rows of its second digits are held over."""

    def work(rows: list[np.ndarray], final: bool) -> tuple[pa.RecordBatch, list[np.ndarray]]:
        key, second, doc, at = rows
        done = (at & 15) == DONE
        runs = doc[done], at[done] >> 18, second[done]
        key, second, doc, at = (x[~done] for x in rows)
        if not len(key):
            return _found(*runs), [key, second, doc, at]
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        new = fresh.copy()
        new[1:] |= second[1:] != second[:-1]
        kind, place = at & 15, at >> 18
        front = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        again = ((doc != doc[front]) | (place != place[front])) & (kind != SIGN)
        before, after = at >> 11 & 127, at >> 4 & 127
        runs = [np.concatenate((x, y)) for x, y in zip(runs, (doc[again], (place - before)[again], (place - after)[again] + WINDOW), strict=True)]
        starts = np.flatnonzero(fresh)
        several = np.repeat(np.add.reduceat(new, starts) > 1, np.diff(np.append(starts, len(key))))
        closed = np.ones(len(key), bool)
        if not final:
            closed[starts[-1] :] = False
        ask = new & (kind != SIGN) & (several | (kind == HOT_MARK)) & closed
        gram = np.where(kind == HOT_MARK, key ^ _mix(second.view(np.uint64)).view(np.int64), key)
        keep = new & ~closed
        return _found(*_runs(*runs), doc[ask], gram[ask], at[ask]), [x[keep] for x in (key, second, doc, at)]

    held = [np.zeros(0, np.int64)] * 4
    for batch in batches:
        rows = [np.concatenate((h, batch[c].to_numpy(zero_copy_only=False))) for h, c in zip(held, ("key", "second", "doc", "at"), strict=True)]
        out, held = work(rows, False)
        yield out
    yield work(held, True)[0]


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches asked for: rows (key, other, doc, at, bytes); of hot marks,
    rows of single windows, with the window's two hashes as key and other."""
    for batch in batches:
        for doc, text, asked in zip(batch["_doc"].to_pylist(), batch["_text"], batch["asked"], strict=True):
            raw = text.as_py().encode("utf-8", "surrogatepass")
            out: list[tuple[int, int, int, int, bytes | None]] = []
            for x in asked.as_py():
                at, place = x["at"], x["at"] >> 18
                begin, last = place - (at >> 11 & 127), place - (at >> 4 & 127)
                if not x["hot"]:
                    out.append((x["gram"], 0, doc, at & ~15, raw[begin : last + WINDOW]))
                    continue
                data = np.frombuffer(raw[begin : last + WINDOW], np.uint8)
                j = np.arange(last - begin + 1)
                one, two = (Stretches(data, k).hash(j, j + WINDOW).view(np.int64).tolist() for k in (0, 1))
                out += [(a, b, doc, _pack(begin + i, 0, 0, HOT_MARK), None) for i, (a, b) in enumerate(zip(one, two, strict=True))]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in out], pa.int64()) for i in range(4)), pa.array([r[4] for r in out], pa.binary())], ["key", "other", "doc", "at", "bytes"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass 3: of equal windows, all but the first. Rows come sorted; those of
    the key that a batch ends in are held over, of single windows the first."""

    def work(rows: pa.Table) -> pa.RecordBatch:
        doc, at = (rows[c].to_numpy() for c in ("doc", "at"))
        place, before, after = at >> 18, at >> 11 & 127, at >> 4 & 127
        whole = (at & 15) != HOT_MARK
        raws = [x or b"" for x in rows["bytes"].to_pylist()]
        data = np.frombuffer(b"".join(raws), np.uint8)
        offset = np.concatenate(([0], np.cumsum([len(x) for x in raws])))[:-1]
        n = np.where(whole, before - after + 1, 1)
        row = np.repeat(np.arange(len(n)), n)
        j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        begin = (place - before)[row] + j
        one, two = rows["key"].to_numpy()[row], rows["other"].to_numpy()[row]
        inside = whole[row]
        if inside.any():
            a = (offset[row] + j)[inside]
            one, two = one.copy(), two.copy()
            one[inside], two[inside] = (Stretches(data, k).hash(a, a + WINDOW).view(np.int64) for k in (0, 1))
        d = doc[row]
        order = np.lexsort((begin, d, two, one))
        new = np.ones(len(order), bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        front = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        again = order[(d[order] != d[front]) | (begin[order] != begin[front])]
        return _found(*_runs(d[again], begin[again], begin[again] + WINDOW))

    names = ["key", "other", "doc", "at", "bytes"]
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]).select(names)
        rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
        if not rows.num_rows:
            continue
        key = rows["key"].to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield work(rows.slice(0, cut))
        held = rows.slice(cut)
        if held.num_rows > 2 * HOT and held["bytes"].null_count == held.num_rows:
            yield work(held)
            other = held["other"].to_numpy()
            held = held.take(pa.array(np.unique(other, return_index=True)[1]))
    if held is not None and held.num_rows:
        yield work(held)


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, _doc, _text: a number for each document, in the order of doc_ids, null
    first. It is the doc_id itself, unless some doc_id has several texts: then the
    distinct pairs of doc_id and text are counted, texts of one doc_id in the order
    of their hash."""
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_doc"), text_or_empty().alias("_text"))
    told = rows.select("_doc", F.md5("_text").alias("_h")).distinct()
    if not told.groupBy("_doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").take(1):
        return rows
    own = ranked(told.withColumn("_key", F.struct("_doc", "_h")), "_key").select("_doc", "_h", F.col("_rank").cast("long").alias("_n"))
    return rows.withColumn("_h", F.md5("_text")).join(own, ["_doc", "_h"]).select("doc_id", F.col("_n").alias("_doc"), "_text")


def repeats(rows: DataFrame) -> DataFrame:
    """For rows (_doc, _text), doc, begin, finish: runs of bytes covered by a window
    that also starts earlier, in any number and order, overlaps included."""
    rows = rows.select("_doc", "_text")
    kinds = "doc long, begin long, finish long, gram long, at long"
    digits = rows.mapInArrow(_digits, "key long, second long, doc long, at long")
    found = materialize(digits.repartition("key").sortWithinPartitions("key", "second", "doc", "at").mapInArrow(_grouped, kinds), "digits")
    asked = found.filter("at is not null").select("doc", "gram", "at")
    hot = asked.groupBy("gram").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HOT).select("gram", F.lit(True).alias("_hot"))
    by_doc = asked.join(hot, "gram", "left").groupBy("doc").agg(F.collect_set(F.struct("gram", "at", F.coalesce("_hot", F.lit(False)).alias("hot"))).alias("asked"))
    met = rows.join(by_doc, rows["_doc"] == by_doc["doc"]).select("_doc", "_text", "asked")
    apart = met.mapInArrow(_apart, "key long, other long, doc long, at long, bytes binary")
    deep = apart.repartition("key").sortWithinPartitions("key", "doc", "at").mapInArrow(_windows, kinds)
    return found.filter("at is null").select("doc", "begin", "finish").unionByName(deep.select("doc", "begin", "finish"))


def _cut(raw: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[bytes, int, int]:
    """What is left of raw, how many bytes went, and in how many runs."""
    if not len(begin):
        return raw, 0, 0
    edge = np.zeros(len(raw) + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, end, -1)
    gone = np.cumsum(edge[:-1]) > 0
    left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
    return left, len(raw) - len(left), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())


def dedup(docs: DataFrame, keep_bytes: bool = True) -> DataFrame:
    """For each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and,
    with keep_bytes, kept: its UTF-8 bytes without those covered by a WINDOW-byte
    string that also starts earlier (a smaller doc_id, or the same and an earlier
    start), judged on the input.

    Strings count as equal where two 64-bit hashes do. Null and empty texts have
    no bytes. A null doc_id comes before any other. Rows that repeat a doc_id and
    its text are one document and are each returned; with other texts they are
    documents of their own, in the order of their texts' hashes. Other columns are
    ignored, an empty table gives no rows.
    """
    rows = numbered(docs)
    runs = repeats(rows).groupBy("doc").agg(F.collect_list(F.struct("begin", "finish")).alias("_runs"))
    met = rows.join(runs, rows["_doc"] == runs["doc"], "left").select("doc_id", "_text", "_runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                some = batch.slice(start, 512)
                out = []
                for text, runs in zip(some["_text"], some["_runs"], strict=True):
                    raw = text.as_py().encode("utf-8", "surrogatepass")
                    found = runs.values
                    begin, end = (found.field(i).to_numpy() for i in (0, 1)) if found is not None else (np.zeros(0, np.int64),) * 2
                    out.append((len(raw), *_cut(raw, np.minimum(begin, len(raw)), np.minimum(end, len(raw)))))
                columns = [some["doc_id"], pa.array([x[0] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.int64()), pa.array([hashlib.sha256(x[1]).hexdigest() for x in out], pa.string())]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if keep_bytes:
                    columns.append(pa.array([x[1] for x in out], pa.binary()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return met.mapInArrow(cut, schema + (", kept binary" if keep_bytes else ""))
