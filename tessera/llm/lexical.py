"""Ranked lexical search: an index in shards, each a dual-sorted wavelet tree."""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, shared_dir

#: A shard is closed at so many bytes of text, terms or documents.
SHARD_BYTES, SHARD_TERMS, SHARD_DOCS = 16 << 20, 3_000_000, 1 << 16
#: Bytes that are split into terms at a time.
STRETCH = 1 << 20
#: Items that are searched together.
BLOCK = 256
#: Letters, digits and all bytes of other characters, A-Z lower; what parts terms is a space.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_IN_TERM = np.frombuffer(_LOWER, np.uint8) != 32


def _stretches(text: bytes) -> Iterator[bytes]:
    """text in pieces that begin and end where terms do."""
    at = 0
    while at < len(text):
        end = at + STRETCH
        while end < len(text) and _IN_TERM[text[end]]:
            end += 1
        yield text[at:end]
        at = end


def _count(text: bytes | None) -> int:
    total = 0
    for piece in _stretches(text or b""):
        inside = _IN_TERM[np.frombuffer(piece, np.uint8)]
        total += int(inside[0]) + int(np.count_nonzero(inside[1:] & ~inside[:-1]))
    return total


def _bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = terms = 0
    for batch in batches:
        for text in _bytes(batch.column(0)):
            n = _count(text)
            docs, terms = docs + (n > 0), terms + n
    yield pa.RecordBatch.from_pydict({"docs": [docs], "terms": [terms]})


class _Builder:
    """The shard that a task is filling."""

    def __init__(self, n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.ids: list = []
        self.vocabulary: dict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.parts: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.bytes = self.terms = 0

    def add(self, doc, text: bytes) -> None:
        n = 0
        for piece in _stretches(text):
            terms = piece.translate(_LOWER).split()
            self.parts.append(np.fromiter(map(self.vocabulary.__getitem__, terms), np.int32, len(terms)))
            n += len(terms)
        if not n:
            return
        self.ids.append(doc)
        self.sizes.append(n)
        self.bytes, self.terms = self.bytes + len(text), self.terms + n

    def full(self) -> bool:
        return self.bytes >= SHARD_BYTES or self.terms >= SHARD_TERMS or len(self.ids) >= SHARD_DOCS

    def rows(self, shard: int) -> tuple[dict, list[bytes], np.ndarray, np.ndarray]:
        """The shard's row, its terms in order, where each one's list begins, its length."""
        from .dual_sorted import pack, squeeze

        by_id = sorted(range(len(self.ids)), key=lambda x: (self.ids[x] is None, self.ids[x] if self.ids[x] is not None else 0))
        number = np.empty(len(by_id), np.int64)
        number[by_id] = np.arange(len(by_id))
        sizes = np.array(self.sizes, np.int64)
        words = list(self.vocabulary)
        spelled = sorted(range(len(words)), key=words.__getitem__)
        place = np.empty(len(words), np.int64)
        place[spelled] = np.arange(len(words))
        keys = place[np.concatenate(self.parts)] * len(by_id) + np.repeat(number, sizes)
        keys, tf = np.unique(keys, return_counts=True)
        term, doc = np.divmod(keys, len(by_id))
        m = (100 - 90 + (90 * sizes * self.n_docs) // self.n_terms)[np.array(by_id)][doc]
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m)
        order = np.argsort((term << 21) - impact, kind="stable")
        term, doc, impact = term[order], doc[order], impact[order]
        start = np.flatnonzero(np.diff(term, prepend=-1))
        row = {"shard": shard, "ids": [self.ids[x] for x in by_id], "impacts": squeeze(impact.astype(np.int32)), "planes": pack(doc.astype(np.uint16), len(by_id))}
        return row, [words[x] for x in spelled], start, np.diff(start, append=len(term))


def _fields(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("shard", T.LongType()), T.StructField("term", T.StringType()), T.StructField("start", T.LongType()), T.StructField("n", T.LongType()),
         T.StructField("ids", T.ArrayType(id_type)), T.StructField("impacts", T.BinaryType()), T.StructField("planes", T.BinaryType())]
    )


def _shards(n_docs: int, n_terms: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        building = _Builder(n_docs, n_terms)

        def close() -> Iterator[pa.RecordBatch]:
            row, terms, start, n = building.rows(first + made)
            for at in range(0, len(terms), 50_000):
                part = slice(at, at + 50_000)
                size = len(terms[part])
                given = {"kind": pa.array(["term"] * size), "shard": pa.array(np.full(size, row["shard"])), "term": pa.array(terms[part], pa.binary()).cast(pa.string()), "start": pa.array(start[part]), "n": pa.array(n[part])}
                yield pa.RecordBatch.from_arrays([given[f.name] if f.name in given else pa.nulls(size, f.type) for f in schema], schema=schema)
            yield pa.RecordBatch.from_pylist([{"kind": "shard", **row}], schema)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), _bytes(batch.column(1)), strict=True):
                if text:
                    building.add(doc, text)
                    if building.full():
                        yield from close()
                        building, made = _Builder(n_docs, n_terms), made + 1
        if building.ids:
            yield from close()

    return run


@dataclass
class LexicalIndex:
    """Shards (ids, impacts, planes), the lexicon (term, shard, start, n), and the
    number of documents with a term and of all terms."""

    shards: DataFrame
    lexicon: DataFrame
    n_docs: int
    n_terms: int


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> LexicalIndex:
    """Index docs under path, by default in a new folder of the shared one. Every row
    with a term is indexed; null and empty texts have none. Rows that repeat an id
    are documents of their own; other columns are ignored.

    No text is shuffled: a first pass counts documents and terms, a second one makes
    shards of the rows that a task reads anyhow, of bounded size. A task that is run
    again makes the same shards.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/lexical-{uuid.uuid4().hex}"
    count = docs.select(F.col(text_col).cast("string")).mapInArrow(_stats, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    n_docs, n_terms = (int(x or 0) for x in count)
    fields = _fields(docs.schema[id_col].dataType)
    schema = spark.createDataFrame([], fields).toArrow().schema
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(_shards(n_docs, n_terms, schema), fields)
    rows.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/index")
    spark.createDataFrame([(json.dumps({"docs": n_docs, "terms": n_terms}), fields.json())], "stats string, fields string").coalesce(1).write.parquet(f"{path}/stats")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> LexicalIndex:
    """The index that build() has written under path."""
    told = spark.read.schema("stats string, fields string").parquet(f"{path}/stats").first()
    stats, fields = json.loads(told["stats"]), T.StructType.fromJson(json.loads(told["fields"]))
    every = spark.read.schema(fields).parquet(f"{path}/index")
    return LexicalIndex(every.filter("kind = 'shard'").select("shard", "ids", "impacts", "planes"), every.filter("kind = 'term'").select("term", "shard", "start", "n"), stats["docs"], stats["terms"])


def terms_of(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), 0))


def _search(k: int, item_type: pa.DataType, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .dual_sorted import Tree

        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in batch.schema.names}
                ids = row["ids"].values
                tree = Tree(row["planes"].as_py(), row["impacts"].as_py(), len(ids))
                lists = {x["term"]: (x["w"], x["start"], x["start"] + x["n"]) for x in row["lists"].as_py()}
                items, docs, scores = [], [], []
                for item in row["items"].as_py():
                    own = [lists[t] for t in item["terms"] if t in lists and lists[t][0]]
                    if own:
                        found, score = tree.top(*np.array(own, np.int64).T, k)
                        items += [item["item"]] * len(found)
                        docs.append(found)
                        scores.append(score)
                if items:
                    yield pa.RecordBatch.from_arrays([pa.array(items, item_type), ids.take(pa.array(np.concatenate(docs))).cast(id_type), pa.array(np.concatenate(scores))], names=["item_id", "doc_id", "score"])

    return run


def search(index: LexicalIndex, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest score above 0 for
    each item, equal scores by ascending doc_id, null last.

    Rows that share an item_id, null too, are one item with all their terms; an item
    without a term that the index knows has no rows; other columns are ignored.

    Terms meet the lexicon in a join, which also gives their document counts; each
    shard then gets the lists that a block of items asks for, and is searched best
    first for each item. What leaves a shard is k rows an item and ties.
    """
    spark = items.sparkSession
    asked = items.select(F.col(id_col).alias("item"), F.explode(terms_of(F.col(text_col))).alias("term")).distinct()
    n_items = items.select(id_col).distinct().count()
    asked = materialize(asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(-(-max(n_items, 1) // BLOCK)))), "asked")
    lists = materialize(index.lexicon.join(asked.select("block", "term").distinct(), "term"), "lists")
    counted = lists.groupBy("block", "term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * index.n_docs + 2)) / (2 * F.col("df") + 1))).cast("long")
    by_shard = lists.join(counted.select("block", "term", weight.alias("w")), ["block", "term"]).groupBy("block", "shard").agg(F.collect_list(F.struct("term", "w", "start", "n")).alias("lists"))
    blocks = asked.groupBy("block", "item").agg(F.collect_list("term").alias("terms")).groupBy("block").agg(F.collect_list(F.struct("item", "terms")).alias("items"))
    work = index.shards.join(by_shard, "shard").join(blocks, "block").select("ids", "impacts", "planes", "lists", "items")
    item_type, id_type = items.schema[id_col].dataType, index.shards.schema["ids"].dataType.elementType
    out = T.StructType([T.StructField("item_id", item_type), T.StructField("doc_id", id_type), T.StructField("score", T.LongType())])
    arrow = spark.createDataFrame([], out).toArrow().schema
    found = work.mapInArrow(_search(k, arrow.field("item_id").type, arrow.field("doc_id").type), out)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), p AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM t GROUP BY ALL
), d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id
), g AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM d
), w AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, g GROUP BY term
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), s AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // terms)))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN d USING (doc_id), g
  GROUP BY item_id, doc_id
), r AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0
)
SELECT * FROM r WHERE rank <= 10
"""
