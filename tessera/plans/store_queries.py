"""Named queries of stores in versions: tables, streams, the keyword index's upkeep."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.match import plain
from ..operators import search as Q
from ..sources import catalog as K
from ..sources import postings as P
from ..sources.tables import shared_dir
from ..sources.versions import Files, Versions
from ..streaming import ingest
from . import base
from .base import MEM, NOW, bm25_sql, matching, now, query
from .graph_queries import BIP


def _new(spark, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@query(f"WITH {MEM} SELECT id, access_count + CASE WHEN id < 'mem_00000200' THEN 5 ELSE 0 END AS access_count, CASE WHEN superseded_at IS NULL AND importance < 0.2 THEN '{NOW}' ELSE strftime(superseded_at, '%Y-%m-%d %H:%M:%S') END AS superseded FROM mem WHERE mem_type <> 'event'")
def store_versions(spark, sf_dir):
    """A store after rows came in twice, were changed twice, went and were compacted."""
    store, rows = Versions(spark, _new(spark, "store")), K.memories(spark, sf_dir)
    for part in (rows.filter("access_count % 2 = 0"), rows.filter("access_count % 2 = 1")):
        with store.change() as c:
            c.append("memories", part, ["id"])
    with store.change() as c:
        back = rows.filter("id < 'mem_00000200'").select("id").withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(5))))
        c.upsert("memories", K.accessed(c.read("memories"), back).filter("id < 'mem_00000200'"))
    with store.change() as c:
        low = c.read("memories").filter("importance < 0.2 and superseded_at is null")
        c.upsert("memories", low.withColumn("superseded_at", now()))
        c.delete("memories", rows.filter("mem_type = 'event'").select("id"))
    store.compact()
    store.vacuum()
    return store.read("memories").select("id", "access_count", F.date_format("superseded_at", "yyyy-MM-dd HH:mm:ss").alias("superseded"))


def in_files(rows, path: str, batches: int) -> int:
    """Write rows (memory_id, entity_id) as files of as many tasks as a shuffle has, a
    memory's in several of them; of how many files each of so many batches is."""
    spark = rows.sparkSession
    tasks = max(batches, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows.repartition(tasks, F.xxhash64("entity_id", "memory_id")).write.parquet(path)
    files = sum(name.endswith(".parquet") for name, _ in Files(spark, path).list(""))
    return max(1, -(-files // batches))


@query(f"WITH {BIP} SELECT source_id, target_id, count FROM pc WHERE count >= 2")
def streamed_pairs(spark, sf_dir):
    """Memberships that come in three batches, so that most memories grow."""
    root = _new(spark, "stream")
    rows = K.membership(spark, sf_dir).select("memory_id", "entity_id")
    each = in_files(rows, f"{root}/in", 3)
    store = Versions(spark, f"{root}/store")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(f"{root}/in")
    ingest.pairs_of(store, stream, "members", f"{root}/checkpoint").awaitTermination()
    return store.read(ingest.PAIRS).filter("count >= 2")


@query(f"WITH {MEM.replace('FROM documents', 'FROM documents WHERE doc_id % 7 <> 2')}, {bm25_sql([matching(p) for p in base.STEMS], 'TRUE', None, 100)} SELECT id, score FROM kw")
def keyword_after_upkeep(spark, sf_dir):
    """An index that texts came into in five parts, and some were taken out of."""
    rows, store = K.memories(spark, sf_dir), P.IndexStore(spark, _new(spark, "upkeep"))
    for part in range(4):
        store.insert(rows.filter(F.substring("id", 5, 8).cast("long") % 4 == part))
    store.forget(rows.filter(F.substring("id", 5, 8).cast("long") % 7 == 2))
    index = store.open()
    return Q.bm25(index, plain(base.TEXT, words=index.terms_of), 100)
