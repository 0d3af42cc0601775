"""Tables of the engine: adapters from the driver's tables, imports, versions."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import hooks as H
from ..functions import text as X
from ..operators import graph as G
from ..operators.maintain import Store
from .tables import written

MEMORY_SCHEMA = (
    "id string, content string, mem_type string, namespace string, importance double, access_count bigint, pinned boolean, "
    "created_at timestamp_ntz, updated_at timestamp_ntz, superseded_at timestamp_ntz, edge_count bigint"
)
#: White space that contents are trimmed of.
BLANKS = " \t\n\v\f\r\x85\xa0"
IMPORT_SCHEMA = "content string, namespace string, type string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as memories; all columns are functions of doc_id, text and lang."""
    d = F.col("doc_id")
    day0 = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'")
    days = lambda n: F.make_dt_interval(n.cast("int"))
    types = F.array(*map(F.lit, C.TYPES))
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("mem_"), F.lpad(d.cast("string"), 8, "0")).alias("id"), F.col("text").alias("content"), F.get(types, (d % 9).cast("int")).alias("mem_type"),
        F.col("lang").alias("namespace"), ((d % 11) / 10.0).cast("double").alias("importance"), (d % 13).alias("access_count"), (d % 17 == 0).alias("pinned"),
        (day0 + days(d % 200)).alias("created_at"), (day0 + days(d % 200)).alias("updated_at"),
        F.when(d % 10 == 3, day0 + days(d % 200 + 30)).alias("superseded_at"), (d % 7).alias("edge_count"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("mem_"), F.lpad(F.col("vec_id").cast("string"), 8, "0")).alias("id"), F.col("embedding").alias("vec"), "vec_id")


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(memory_id, entity_id, weight): orders as memories, parts as entities."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("memory_id"), F.col("l_partkey").cast("long").alias("entity_id")).distinct().withColumn("weight", F.lit(1.0))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey").cast("long")
    return table(spark, sf_dir, "part").select(p.alias("entity_id"), F.concat(F.lit("part "), p.cast("string")).alias("name"), F.when(p % 3 == 0, "tech").otherwise("org").alias("category"), (p % 23).alias("access_count"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))


def submitted(rows: DataFrame, now: str, gate: bool = True) -> DataFrame:
    """Rows (content, namespace, type) that somebody wants to store, all of them,
    as memories with status (stored, empty, blocked) and reason, the name of the
    secret that blocks one. Contents are trimmed, defaults filled in, the type of
    notes inferred. Ids are hashes, so a repeated run gives the same rows."""
    clean = rows.select(F.btrim(F.coalesce("content", F.lit("")), F.lit(BLANKS)).alias("content"), F.coalesce(F.nullif("namespace", F.lit("")), F.lit("default")).alias("namespace"), F.coalesce(F.nullif("type", F.lit("")), F.lit("note")).alias("type"))
    reason = X.secret(F.col("content")) if gate else F.lit("")
    at = F.lit(now).cast("timestamp_ntz")
    marked = clean.withColumn("reason", reason).withColumn("status", F.when(F.col("content") == "", "empty").when(F.col("reason") != "", "blocked").otherwise("stored"))
    return marked.select(
        X.content_id("mem_", F.col("namespace"), F.col("content")).alias("id"), "content",
        F.when(F.col("type") == "note", X.infer_type(F.col("content"))).otherwise(F.col("type")).alias("mem_type"), "namespace",
        F.lit(0.4).alias("importance"), F.lit(0).cast("long").alias("access_count"), F.lit(False).alias("pinned"), at.alias("created_at"), at.alias("updated_at"),
        F.lit(None).cast("timestamp_ntz").alias("superseded_at"), F.lit(0).cast("long").alias("edge_count"), "status", "reason",
    )


def stored(rows: DataFrame, now: str, gate: bool = True) -> DataFrame:
    """The memories of submitted rows that are stored."""
    return submitted(rows, now, gate).filter("status = 'stored'").drop("status", "reason")


def import_json(spark: SparkSession, path: str, now: str) -> DataFrame:
    return stored(spark.read.schema(IMPORT_SCHEMA).json(path, multiLine=True), now)


def insert(store: Store, rows: DataFrame, now: str, embedder: H.Embedder | H.Chain | None = None, gate: bool = True) -> tuple[Store, DataFrame]:
    """store after rows came in, with their entities, typed relations and vectors;
    and (id, status, reason, edge_count, matched) of each row. A memory that is
    there already isn't taken in again."""
    marked = written(submitted(rows, now, gate), "submitted")
    new = marked.filter("status = 'stored'").drop("status", "reason").dropDuplicates(["id"]).join(store.memories.select("id"), "id", "left_anti")
    new = written(new, "inserted")
    graph, counts = G.with_entities(store.graph, new)
    graph, matched = G.with_typed_edges(graph, new)
    counts = written(counts.select(F.col("memory_id").alias("id"), F.col("edge_count").alias("_n")), "counts")
    full = new.join(counts, "id", "left").withColumn("edge_count", F.coalesce("_n", F.lit(0))).select(new.columns)
    vectors = store.vectors
    if embedder is not None:
        more = embedder.embed(new.select("id", "content")).filter("vec is not null")
        vectors = vectors.unionByName(more) if vectors is not None else more
    report = marked.select("id", "status", "reason").join(counts, "id", "left").join(matched.select(F.col("memory_id").alias("id"), F.lit(True).alias("_m")), "id", "left")
    report = report.select("id", "status", "reason", F.coalesce("_n", F.lit(0)).alias("edge_count"), F.coalesce("_m", F.lit(False)).alias("matched"))
    return replace(store, memories=store.memories.unionByName(full.select(store.memories.columns)), graph=graph, vectors=vectors), report


def store_stats(memories: DataFrame, vectors: DataFrame, nodes: DataFrame, membership: DataFrame) -> DataFrame:
    """One row of counts; namespaces maps each to its active memories."""
    live = F.col("superseded_at").isNull()
    own = memories.agg(F.count_if(live).alias("total_memories"), F.count_if(live & F.col("pinned")).alias("pinned_memories"), F.count_if(~live).alias("superseded"))
    by = memories.filter(live & F.col("namespace").isNotNull()).groupBy("namespace").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("namespace", "n"))).alias("namespaces"))
    for rows, name in ((vectors, "vector_indexed"), (nodes, "entity_nodes"), (membership, "entity_edges")):
        own = own.crossJoin(rows.agg(F.count(F.lit(1)).alias(name)))
    return own.crossJoin(by)  # one row each


def get(memories: DataFrame, ident: str) -> DataFrame:
    """The memory of an id, superseded or not."""
    return memories.filter(F.col("id") == ident)


def get_many(memories: DataFrame, ids: list[str]) -> DataFrame:
    """The active memories of a list of ids, which the scan takes as a filter."""
    return memories.filter(F.col("superseded_at").isNull() & F.col("id").isin(list(dict.fromkeys(ids)))) if ids else memories.limit(0)


def number(text: str | None, default: int) -> int:
    """The number that a text begins with, if it is 1 or more, else the default."""
    m = re.match(r"\s*([+-]?\d+)", text or "")
    return int(m[1]) if m and int(m[1]) >= 1 else default


def page(memories: DataFrame, namespace: str = "", page: str | None = None, per_page: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One page of the active memories, newest first, and (total, page, per_page):
    how many there are in the namespace."""
    n, size = number(page, 1), number(per_page, 20)
    live = memories.filter("superseded_at is null")
    live = live.filter(F.col("namespace") == namespace) if namespace else live
    rows = live.orderBy(F.desc("created_at"), "id").offset((n - 1) * size).limit(size)
    items = rows.select("id", "content", F.col("mem_type").alias("type"), "namespace", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), "importance", "pinned", "edge_count")
    return items, live.agg(F.count(F.lit(1)).alias("total")).select("total", F.lit(n).alias("page"), F.lit(size).alias("per_page"))


def as_json(rows: DataFrame) -> DataFrame:
    """(value): each row as a JSON object, nulls too."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_json(rows: DataFrame, path: str) -> None:
    as_json(rows).write.text(path)


def as_lines(rows: DataFrame) -> DataFrame:
    """(rank, value): recalled rows as lines for people: rank, score, type and the
    content's beginning, its white space as single blanks."""
    content = X.truncate(F.regexp_replace(F.btrim("content", F.lit(BLANKS)), r"\s+", " "), 200)
    return rows.select("rank", F.format_string("%d. [%.3f] (%s) %s", F.col("rank").cast("int"), F.col("score").cast("double"), F.col("type"), content).alias("value")).orderBy("rank")


def as_object(rows: DataFrame, name: str = "results", **more: Column) -> DataFrame:
    """(value): a list's rows, by rank, as one JSON object: {name: [...], "count": n}
    and what else is given. For lists that are cut; a whole table goes to as_json."""
    own = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.struct(*rows.columns).alias("r")))), lambda x: x["r"])
    out = rows.agg(own.alias(name), F.count(F.lit(1)).alias("count"))
    return out.select(F.to_json(F.struct(name, "count", *(c.alias(k) for k, c in more.items())), {"ignoreNullFields": "false"}).alias("value"))


def log_compaction(log: DataFrame, path: str) -> None:
    """Append rows of a compaction log."""
    log.write.mode("append").parquet(path)


def write_archive(memories: DataFrame, now: Column, path: str) -> DataFrame:
    """Append the superseded memories to an archive; those that stay are returned."""
    stay, gone = archive(memories, now)
    gone.write.mode("append").parquet(path)
    return stay


def ingest_files(spark: SparkSession, path: str, pattern: str = "*.{txt,md,json,csv}") -> DataFrame:
    """(filename, source_type, content): each file in path as one text."""
    rows = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    return rows.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("filename"), F.col("value").alias("content")).withColumn("source_type", X.source_type(F.col("filename")))


def parse_time(text: Column) -> Column:
    """RFC 3339 or 'YYYY-MM-DD HH:MM:SS' or a date."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def forget(memories: DataFrame, ids: list[str], now: Column) -> DataFrame:
    """Soft delete: the next version of memories."""
    return memories.withColumn("superseded_at", F.when(F.col("id").isin(ids) & F.col("superseded_at").isNull(), now).otherwise(F.col("superseded_at")))


def archive(memories: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, superseded rows with archived_at)."""
    return memories.filter("superseded_at is null"), memories.filter("superseded_at is not null").withColumn("archived_at", now)


def accessed(memories: DataFrame, returned: DataFrame) -> DataFrame:
    """access_count raised by the number of times an id was returned."""
    n = returned.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    return memories.join(n, "id", "left").withColumn("access_count", F.col("access_count") + F.coalesce("_n", F.lit(0))).drop("_n")
