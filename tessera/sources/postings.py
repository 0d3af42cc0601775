"""The keyword index: blocks of postings in segments, with what bounds their scores.

A segment's texts are dealt to parts: of texts of about one length, of so many at
most. A block is a term's postings in a part, with the highest count of the term and
the least length, so a query's best score in a part is bounded without its postings
being read. Lengths stand in the postings; nothing else is read to score them.

Segments are added, and those of forgotten texts count against the ones before;
levels of segments are merged as they fill.
"""

from __future__ import annotations

import json
import math
import uuid
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


from ..functions import text as X
from ..functions.stem import stem
from .tables import shared_dir
from .versions import Files, Versions

#: Texts of a part at most, on average.
PART = 64
#: Postings of a folder of terms, on average.
FOLDER = 4_000_000
#: Length classes a doubling of the length.
CLASSES = 4
#: Segments of a level that are merged into one of the next.
FAN = 4
BLOCK = "bucket int, term string, part long, n int, most int, least int, ids array<string>, tfs array<int>, dls array<int>, ats array<array<int>>"


@dataclass(frozen=True)
class Segment:
    """path: where its blocks and texts (their words) lie; counts of texts and of their words;
    dead: its texts are gone from the segments before it."""

    path: str
    buckets: int
    n: int
    words: int
    level: int = 0
    dead: bool = False


@dataclass(frozen=True)
class Index:
    """What a version of the index consists of, the oldest segment first."""

    spark: SparkSession
    segments: tuple[Segment, ...]
    stemmed: bool = True

    @property
    def n(self) -> int:
        return sum(-s.n if s.dead else s.n for s in self.segments)

    @property
    def avgdl(self) -> float:
        return sum(-s.words if s.dead else s.words for s in self.segments) / max(self.n, 1)

    @property
    def counts(self) -> DataFrame:
        return self.spark.createDataFrame([(self.n, self.avgdl if self.n else None)], "n long, avgdl double")

    def blocks(self, terms: list[str] | None = None, prefix: str | None = None, positions: bool = True) -> DataFrame:
        """Blocks (seg, dead, term, part, n, most, least, ...) of terms or of those
        with a beginning: folders and, by their statistics, row groups of other terms
        aren't read; where the arrays aren't used, they aren't either."""
        out = None
        for number, s in enumerate(self.segments):
            rows = self.spark.read.schema(BLOCK).parquet(f"{s.path}/blocks")
            if terms is not None:
                rows = rows.filter(F.col("bucket").isin(sorted({bucket_of(t, s.buckets) for t in terms})) & F.col("term").isin(sorted(set(terms))))
            elif prefix is not None:
                rows = rows.filter(F.col("term").startswith(prefix))
            rows = rows.select(F.lit(number).alias("seg"), F.lit(s.dead).alias("dead"), *([c for c in rows.columns if c != "bucket" and (positions or c != "ats")]))
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], f"seg int, dead boolean, {BLOCK.split(', ', 1)[1]}")

    def gone(self) -> DataFrame | None:
        """(id, killed): texts forgotten, and the last segment that forgets them."""
        out = None
        for number, s in enumerate(self.segments):
            if s.dead:
                rows = self.spark.read.schema("id string, dl int").parquet(f"{s.path}/texts").select("id", F.lit(number).alias("killed"))
                out = rows if out is None else out.unionByName(rows)
        return out.groupBy("id").agg(F.max("killed").alias("killed")) if out is not None else None

    def alive(self, rows: DataFrame) -> DataFrame:
        """rows (id, seg, ...) of texts that no later segment forgets."""
        gone = self.gone()
        return rows if gone is None else rows.join(gone, "id", "left").filter(F.col("killed").isNull() | (F.col("killed") < F.col("seg"))).drop("killed")

    def postings(self, blocks: DataFrame) -> DataFrame:
        """(term, id, tf, dl, at) of blocks, without forgotten texts."""
        at = ["ats"] if "ats" in blocks.columns else []
        rows = blocks.filter(~F.col("dead")).select("seg", "term", F.explode(F.arrays_zip("ids", "tfs", "dls", *at)).alias("p"))
        rows = rows.select("seg", "term", F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"), *(F.col(f"p.{c}").alias("at") for c in at))
        return self.alive(rows).drop("seg")

    def query_terms(self, text: Column) -> Column:
        """The words of many queries' texts (each once) as an array column."""
        if not self.stemmed:
            return F.array_distinct(X.words(text))
        return F.array_distinct(F.pandas_udf(_stems, "array<string>")(X.words(text)))

    def terms_of(self, text: str) -> list[str]:
        """The words of a query's text, as this index has them."""
        return X.terms(text) if self.stemmed else X.plain_terms(text)


def _stems(lists: pd.Series) -> pd.Series:
    return lists.map(lambda words: [stem(w) for w in words])


def bucket_of(term: str, buckets: int) -> int:
    """The folder of a term, as a segment's writer computes it."""
    return zlib.crc32(term.encode()) % buckets


def _class(dl: Column) -> Column:
    return F.floor(CLASSES * F.log2(F.greatest(dl, F.lit(1)).cast("double"))).cast("int")


def _parts(docs: DataFrame) -> Column:
    """The part of a row (id, dl) of docs: its length class and, by a hash, one of as
    many parts as the class needs. A row a class goes to the driver."""
    sizes = {r["c"]: math.ceil(r["n"] / PART) for r in docs.groupBy(_class(F.col("dl")).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    many = F.coalesce(F.create_map(*(F.lit(x) for kv in (sizes or {0: 1}).items() for x in kv))[_class(F.col("dl"))], F.lit(1))
    return (_class(F.col("dl")).cast("long") * (1 << 32) + F.pmod(F.xxhash64("id"), many.cast("long"))).alias("part")


POSTED = pa.schema(
    [("bucket", pa.int32()), ("term", pa.string()), ("part", pa.int64()), ("n", pa.int32()), ("most", pa.int32()), ("least", pa.int32()), ("ids", pa.list_(pa.string())), ("tfs", pa.list_(pa.int32())), ("dls", pa.list_(pa.int32())), ("ats", pa.list_(pa.list_(pa.int32())))]
)
SENT = pa.schema([("slot", pa.int32()), ("size", pa.int64()), ("data", pa.binary())])
#: Words of the parts whose blocks a task sends together, about; stems that it remembers.
GROUP, STEMS = 250_000, 100_000


def _blocks(part: int, ids: list[str], texts: list[np.ndarray], words: list[str], stems: dict[str, str] | None, buckets: int) -> pa.RecordBatch:
    """The blocks of a part's texts (numbers of words), a row a term, by bucket."""
    if stems is not None:
        words = [stems[w] if w in stems else stems.setdefault(w, stem(w)) for w in words]
    terms = sorted(set(words))
    bucket = np.array([bucket_of(t, buckets) for t in terms], np.int32)
    at = np.argsort(bucket, kind="stable")
    terms, bucket = [terms[i] for i in at.tolist()], bucket[at]
    number = {t: i for i, t in enumerate(terms)}
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.array([number[w] for w in words], np.int64)[np.concatenate(texts)]
    doc = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keys = flat * len(texts) + doc
    order = np.argsort(keys, kind="stable")
    keys, place = keys[order], place[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))  # of each posting
    term, own = np.divmod(keys[first], len(texts))
    tf, dl = np.diff(first, append=len(keys)), sizes[own]
    begin = np.flatnonzero(np.diff(term, prepend=-1))  # of each block
    offsets = pa.array(np.append(begin, len(term)), pa.int32())
    lists = lambda values: pa.ListArray.from_arrays(offsets, values)
    ats = pa.ListArray.from_arrays(pa.array(np.append(first, len(keys)), pa.int32()), pa.array(place, pa.int32()))
    columns = [
        pa.array(bucket), pa.array(terms, pa.string()), pa.array(np.full(len(terms), part)), pa.array(np.diff(begin, append=len(term)), pa.int32()), pa.array(np.maximum.reduceat(tf, begin), pa.int32()), pa.array(np.minimum.reduceat(dl, begin), pa.int32()),
        lists(pa.array(ids, pa.string()).take(pa.array(own))), lists(pa.array(tf, pa.int32())), lists(pa.array(dl, pa.int32())), lists(ats),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=POSTED)


def _sent(blocks: list[pa.RecordBatch], salts: int) -> pa.RecordBatch:
    """Blocks of some parts as one row a slot (a bucket's share of the parts), packed."""
    every = pa.concat_batches(blocks)
    salt = np.repeat([zlib.crc32(b"%d" % b["part"][0].as_py()) % salts for b in blocks], [b.num_rows for b in blocks])
    slot = every["bucket"].to_numpy().astype(np.int64) * salts + salt
    order = np.argsort(slot, kind="stable")
    every, slot = every.take(pa.array(order)), slot[order]
    begin = np.flatnonzero(np.diff(slot, prepend=-1))
    raw = [every.slice(x, y - x).serialize() for x, y in zip(begin, np.append(begin[1:], len(slot)), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(slot[begin], pa.int32()), pa.array([r.size for r in raw], pa.int64()), pa.array([pa.compress(r, "zstd", asbytes=True) for r in raw], pa.binary())], schema=SENT)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of packed rows."""
    for batch in batches:
        for size, data in zip(batch["size"], batch["data"], strict=True):
            yield pa.ipc.read_record_batch(pa.decompress(data.as_buffer(), size.as_py(), "zstd"), POSTED)


def _posted(stemmed: bool, buckets: int, salts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows (part, id, w), those of a part one after the other, its blocks, packed.
    Texts are taken one by one; of those of a part only the words' numbers are held."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[str], list[np.ndarray], list[str]]]:
        now, ids, texts = None, [], []
        codes: dict[str, int] = defaultdict()
        codes.default_factory = codes.__len__
        for batch in batches:
            for part, key, words in zip(batch["part"], batch["id"], batch["w"], strict=True):
                if (part := part.as_py()) != now:
                    if ids:
                        yield now, ids, texts, list(codes)
                    now, ids, texts = part, [], []
                    codes.clear()
                if words := words.as_py():
                    ids.append(key.as_py())
                    texts.append(np.array([codes[w] for w in words.split(" ")], np.int32))
        if ids:
            yield now, ids, texts, list(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems: dict[str, str] | None = {} if stemmed else None
        held, n = [], 0
        for part, ids, texts, words in parts(batches):
            if stems is not None and len(stems) > STEMS:
                stems.clear()
            held.append(_blocks(part, ids, texts, words, stems, buckets))
            n += sum(map(len, texts))
            if n >= GROUP:
                yield _sent(held, salts)
                held, n = [], 0
        if held:
            yield _sent(held, salts)

    return run


TEXTS = "id string, dl int, w string"


def _write(spark: SparkSession, path: str, stemmed: bool, level: int, dead: bool) -> Segment:
    """Write the blocks of path/texts to path/blocks. Texts are shuffled once, to their
    parts, blocks once, packed, to their terms. There are as many tasks as the words
    need, and a term that stands in all texts is as many tasks' as these need."""
    rows = spark.read.schema(TEXTS).parquet(f"{path}/texts")
    told = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
    n, words = int(told[0]), int(told[1])
    salts = max(1, math.ceil(n / FOLDER))
    buckets = max(1, math.ceil(words / FOLDER / salts))
    dealt = rows.select(_parts(rows.select("id", "dl")), "id", "w").repartition("part").sortWithinPartitions("part", "id")
    sent = dealt.mapInArrow(_posted(stemmed, buckets, salts), "slot int, size long, data binary").repartitionById(buckets * salts, F.col("slot"))
    sent.mapInArrow(_unpacked, BLOCK).sortWithinPartitions("bucket", "term", "part").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/blocks")
    segment = Segment(path, buckets, n, words, level, dead)
    spark.createDataFrame([(json.dumps(segment.__dict__ | {"path": ""}),)], "told string").coalesce(1).write.parquet(f"{path}/segment")
    return segment


def write_segment(memories: DataFrame, path: str, stemmed: bool = True, level: int = 0, dead: bool = False) -> Segment:
    """Write the words and the postings of memories (id, content) as a segment."""
    rows = memories.select("id", X.words(F.col("content")).alias("w")).select("id", F.size("w").alias("dl"), F.array_join("w", " ").alias("w"))
    rows.write.option("compression", "zstd").parquet(f"{path}/texts")
    return _write(memories.sparkSession, path, stemmed, level, dead)


def merged_segment(index: Index, path: str, level: int) -> Segment:
    """The segments of index as one, without what is forgotten, from their words: a
    text's words are far shorter than its postings as rows."""
    spark, texts = index.spark, None
    for number, s in enumerate(index.segments):
        if not s.dead:
            rows = spark.read.schema(TEXTS).parquet(f"{s.path}/texts").withColumn("seg", F.lit(number))
            texts = rows if texts is None else texts.unionByName(rows)
    texts = texts if texts is not None else spark.createDataFrame([], f"{TEXTS}, seg int")
    index.alive(texts).select("id", "dl", "w").write.option("compression", "zstd").parquet(f"{path}/texts")
    return _write(spark, path, index.stemmed, level, False)


def build(memories: DataFrame, path: str | None = None, stemmed: bool = True) -> str:
    """Write the index of memories, superseded ones too, to path (a new folder in
    the shared one if none) and return it."""
    path = path or f"{shared_dir(memories.sparkSession)}/index-{uuid.uuid4().hex}"
    IndexStore(memories.sparkSession, path, stemmed).insert(memories)
    return path


def load(spark: SparkSession, path: str) -> Index:
    return IndexStore(spark, path).open()


class IndexStore:
    """An index that is kept up to date: a manifest names its segments."""

    def __init__(self, spark: SparkSession, root: str, stemmed: bool = True, fan: int = FAN):
        self.spark, self.root, self.fan = spark, root.rstrip("/"), fan
        self.versions = Versions(spark, root)
        self.stemmed = self.versions.manifest().marks.get("stemmed", stemmed)

    def open(self, version: int | None = None) -> Index:
        told = self.versions.manifest(version).marks.get("segments", [])
        return Index(self.spark, tuple(Segment(**s | {"path": f"{self.root}/{s['path']}"}) for s in told), self.stemmed)

    def _add(self, memories: DataFrame, dead: bool) -> None:
        with self.versions.change() as c:
            name = f"data/{uuid.uuid4().hex}"
            s = write_segment(memories, f"{self.root}/{name}", self.stemmed, 0, dead)
            own = c.manifest.marks.get("segments", [])
            c.mark("segments", [*own, s.__dict__ | {"path": name}] if s.n else own)
            c.mark("stemmed", self.stemmed)
        self.settle()

    def insert(self, memories: DataFrame) -> None:
        """Add texts whose ids the index doesn't have; merge levels that are full."""
        self._add(memories, False)

    def forget(self, memories: DataFrame) -> None:
        """Take texts that the index has, given with their contents, out of it."""
        if self.open().segments:
            self._add(memories, True)

    def settle(self) -> None:
        """Merge the newest segments, from the first of a run of `fan` of a level, into
        one of the next level, until no level is full. Segments stay in their order; a
        run in which texts are forgotten is merged with all before it, where those
        texts may be."""
        while (run := self._full()) is not None:
            self.merge(*run)

    def _full(self) -> tuple[int, int] | None:
        own = self.open().segments
        for level in {s.level for s in own}:
            at = [i for i, s in enumerate(own) if s.level <= level]
            first = next((i for i, s in enumerate(own) if all(x.level <= level for x in own[i:])), None)
            if first is not None and sum(own[i].level == level for i in at if i >= first) >= self.fan:
                forgets = any(s.dead for s in own[first:])
                return (0, 1 + max(s.level for s in own)) if forgets else (first, level + 1)
        return None

    def merge(self, first: int = 0, level: int | None = None) -> None:
        """Write the segments from place `first` on as one; all, where texts are
        forgotten in them."""
        with self.versions.change() as c:
            own = c.manifest.marks.get("segments", [])
            index = self.open(c.manifest.version or None)
            first = 0 if any(x.dead for x in index.segments[first:]) else first
            tail = Index(self.spark, index.segments[first:], self.stemmed)
            name = f"data/{uuid.uuid4().hex}"
            s = merged_segment(tail, f"{self.root}/{name}", level if level is not None else 1 + max((x.level for x in tail.segments), default=0))
            c.mark("segments", [*own[:first], s.__dict__ | {"path": name}] if s.n else own[:first])

    def vacuum(self, keep: int = 1) -> None:
        """Drop all but the last versions and the folders that none of these names."""
        v, numbers = self.versions, self.versions.numbers()
        stay = {s["path"] for n in numbers[-keep:] for s in v.manifest(n).marks.get("segments", [])}
        for n in numbers[:-keep]:
            v.files.delete(f"_versions/{n:020d}.json")
        for name, _ in v.files.list("data"):
            if f"data/{name}" not in stay:
                v.files.delete(f"data/{name}")


_BUILT: dict[str, tuple[tuple, str]] = {}


def state_of(spark: SparkSession, path: str) -> tuple:
    """Names and times of what a path has, which tell that data there changed."""
    files = Files(spark, path)
    if not files.fs.exists(files.path("")):
        return ()
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in files.fs.listStatus(files.path(""))))


def kept(memories: DataFrame, key: object, stemmed: bool = True, path: str | None = None) -> Index:
    """The index that this session built for key, built at the first call and again
    where the data under path, if given, is no longer the same."""
    spark = memories.sparkSession
    name, state = json.dumps([spark.sparkContext.applicationId, str(key), stemmed]), state_of(spark, path) if path else ()
    if name not in _BUILT or _BUILT[name][0] != state:
        _BUILT[name] = state, build(memories, stemmed=stemmed)
    return load(spark, _BUILT[name][1])


