"""Chunked documents and conversations: chunk, retrieve, compact."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hooks as H
from ..functions import scoring as S
from ..functions import text as X
from ..sources.tables import one_of, ranked, written
from .search import Vector, _with_query


def cut_text(text: str, size: int = 500) -> list[str]:
    """Chunks of at most size bytes that join to text: each is cut behind the last
    blank line, else sentence, else line feed in its second half; none inside a
    character. A text of size bytes or less is one chunk, an empty one too."""
    raw, begin, out = text.encode("utf-8", "surrogatepass"), 0, []
    while len(raw) - begin > size:
        end = begin + size
        for mark in (b"\n\n", b". ", b"\n"):
            at = raw.rfind(mark, begin, end)
            if at - begin > size // 2:
                end = at + len(mark)
                break
        while raw[end] & 0xC0 == 0x80:
            end -= 1
        out.append(raw[begin:end].decode("utf-8", "surrogatepass"))
        begin = end
    return [*out, raw[begin:].decode("utf-8", "surrogatepass")] if begin < len(raw) or not out else out


#: Texts that are cut at once.
TEXTS = 64
#: Shares that a collection's files are dealt to.
SHARES = 64


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, _size, ...) as chunks, TEXTS of them at once. What else a row
    has goes with its first chunk."""
    for b in (whole.slice(at, TEXTS) for whole in batches for at in range(0, whole.num_rows, TEXTS)):
        cut = [cut_text(t or "", n) for t, n in zip(b["text"].to_pylist(), b["_size"].to_pylist(), strict=True)]
        own = pa.array([k for k, parts in enumerate(cut) for _ in parts], pa.int32())
        more = [c for c in b.schema.names if c not in ("doc_id", "text", "_size")]
        first = pa.array([None if i else k for k, parts in enumerate(cut) for i in range(len(parts))], pa.int32())
        yield pa.RecordBatch.from_arrays([b["doc_id"].take(own), pa.array([i for parts in cut for i in range(len(parts))], pa.int32()), pa.array([c for parts in cut for c in parts], pa.string()), *(b[c].take(first) for c in more)], names=["doc_id", "chunk_index", "content", *more])


def chunks(docs: DataFrame, size: int | Column = 500, more: Sequence[str] = ()) -> DataFrame:
    """(doc_id, chunk_index, content) of (doc_id, text); where a chunk ends depends
    on where the one before did, so texts go through Python, a few at once. Columns of
    more are in each text's first chunk, null in others."""
    size = F.lit(size) if isinstance(size, int) else size
    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("doc_id", *more)}
    return docs.select("doc_id", "text", size.cast("int").alias("_size"), *more).mapInArrow(_cut_texts, f"doc_id {kinds['doc_id']}, chunk_index int, content string" + "".join(f", {c} {kinds[c]}" for c in more))


@dataclass(frozen=True)
class Library:
    """collections (collection_id, name, description, chunk_size, created_at),
    documents (document_id, collection_id, filename, source_type, metadata,
    chunk_count, created_at), chunks (chunk_id, document_id, chunk_index, content),
    vectors (id, vec) of chunks."""

    collections: DataFrame
    documents: DataFrame
    chunks: DataFrame
    vectors: DataFrame


def empty_library(spark: SparkSession) -> Library:
    frame = lambda kind: spark.createDataFrame([], kind)
    return Library(
        frame("collection_id long, name string, description string, chunk_size int, created_at timestamp_ntz"),
        frame("document_id string, collection_id long, filename string, source_type string, metadata string, chunk_count long, created_at timestamp_ntz"),
        frame("chunk_id string, document_id string, chunk_index int, content string"), frame("id string, vec array<float>"),
    )


def with_collections(library: Library, names: DataFrame, now: Column, chunk_size: int = 500) -> Library:
    """library with the collections of names (name, and description if it has one)
    that it lacks; ids go on behind the largest, in the order of the names."""
    about = F.col("description") if "description" in names.columns else F.concat(F.lit("Auto-created for "), F.col("name"))
    new = names.select("name", about.alias("description")).groupBy("name").agg(F.min("description").alias("description")).join(library.collections.select("name"), "name", "left_anti")
    last = library.collections.agg(F.coalesce(F.max("collection_id"), F.lit(0)).alias("_last"))
    size = chunk_size if chunk_size > 0 else 500
    added = ranked(new, [F.col("name")], "_n").crossJoin(F.broadcast(last)).select(  # one row
        (F.col("_n") + F.col("_last")).cast("long").alias("collection_id"), "name", "description", F.lit(size).alias("chunk_size"), now.alias("created_at")
    )
    return replace(library, collections=library.collections.unionByName(added))


def ingested(library: Library, files: DataFrame, now: Column, embedder: H.Embedder | H.Chain | None = None) -> Library:
    """library with files (collection, filename, content; metadata, a JSON object,
    if it has one): missing collections are made, texts are chunked to their
    collection's size, chunks embedded. Ids are hashes of collection, filename and
    content, so a repeated file is one document."""
    library = with_collections(library, files.select(F.col("collection").alias("name")).distinct(), now)
    meta = F.coalesce(F.col("metadata"), F.lit("{}")) if "metadata" in files.columns else F.lit("{}")
    key = X.content_id("rag_doc_", F.col("collection"), F.col("filename"), F.coalesce("content", F.lit("")))
    rows = files.select(key.alias("document_id"), F.col("collection").alias("name"), "filename", F.coalesce("content", F.lit("")).alias("text"), meta.alias("metadata"))
    # Texts are dealt by their collection's name and a share, so that a large collection is many tasks'.
    rows = rows.withColumn("_share", F.pmod(F.xxhash64("document_id"), F.lit(SHARES)).cast("int"))
    sizes = library.collections.select("name", "collection_id", "chunk_size", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("_share"))
    rows = rows.join(sizes, ["name", "_share"]).dropDuplicates(["name", "_share", "document_id"]).join(library.documents.select("document_id"), "document_id", "left_anti")
    told = [F.struct("collection_id", "filename", "metadata").alias("_told")]
    cut = chunks(rows.select(F.col("document_id").alias("doc_id"), "text", "chunk_size", *told), F.col("chunk_size"), ["_told"])
    cut = written(cut.select(F.concat(F.lit("rag_chk_"), "doc_id", F.lit("_"), F.col("chunk_index").cast("string")).alias("chunk_id"), F.col("doc_id").alias("document_id"), "chunk_index", "content", "_told"), "chunks")
    parts = cut.drop("_told")
    docs = cut.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.max("_told").alias("_told")).select("document_id", "_told.*", "chunk_count")  # the first chunk tells
    docs = docs.select("document_id", "collection_id", "filename", X.source_type(F.col("filename")).alias("source_type"), "metadata", "chunk_count", now.alias("created_at"))
    vectors = library.vectors
    if embedder is not None:
        vectors = vectors.unionByName(embedder.embed(parts.select(F.col("chunk_id").alias("id"), "content")).filter("vec is not null"))
    return replace(library, documents=library.documents.unionByName(docs), chunks=library.chunks.unionByName(parts), vectors=vectors)


def without_collection(library: Library, name: str) -> Library:
    """library without a collection, its documents, their chunks and vectors."""
    gone = library.collections.filter(F.col("name") == name).select("collection_id")
    docs = library.documents.join(gone, "collection_id", "left_semi").select("document_id")
    parts = library.chunks.join(docs, "document_id", "left_semi").select(F.col("chunk_id").alias("id"))
    return Library(
        library.collections.filter(F.col("name") != name), library.documents.join(gone, "collection_id", "left_anti"),
        library.chunks.join(docs, "document_id", "left_anti"), library.vectors.join(parts, "id", "left_anti"),
    )


def collections(library: Library) -> DataFrame:
    """All collections, by name, with doc_count, 0 of empty ones."""
    n = library.documents.groupBy("collection_id").agg(F.count(F.lit(1)).alias("_n"))
    return library.collections.join(n, "collection_id", "left").withColumn("doc_count", F.coalesce("_n", F.lit(0))).drop("_n").orderBy("name")


def library_stats(library: Library) -> DataFrame:
    """One row: collections, documents, chunks."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(library.collections, "collections").crossJoin(count(library.documents, "documents")).crossJoin(count(library.chunks, "chunks"))  # one row each


def query_chunks(library: Library, text: str, vector: Vector, k: int = 5, collection: str | None = None, rerankers: Sequence[H.Reranker] = ()) -> DataFrame:
    """(chunk_id, content, document, chunk_index, score) of the k best chunks: of
    the nearest 5 k, or 10 k where a reranker is there to order them anew. The
    collection is filtered first. A reranker's errors leave the order."""
    k = k if k > 0 else 5
    reranker = H.chosen(rerankers)
    fetch = k * (5 if reranker.name == "noop" else 10)
    docs = library.documents.select("document_id", "collection_id", F.col("filename").alias("document"))
    if collection:
        docs = docs.join(library.collections.filter(F.col("name") == collection).select("collection_id"), "collection_id", "left_semi")
    ids = library.chunks.select(F.col("chunk_id").alias("id"), "document_id").join(docs.select("document_id"), "document_id", "left_semi").select("id")
    rows, q = _with_query(library.vectors, vector)
    scores = rows.select("id", F.round(S.closeness(S.l2(F.col("vec"), q)), 6).alias("score")).join(ids, "id", "left_semi")
    near = [tuple(r) for r in scores.orderBy(F.desc("score"), "id").limit(fetch).collect()]  # fetch rows
    listed = library.chunks.sparkSession.createDataFrame(near, "chunk_id string, score double")
    found = library.chunks.filter(one_of("chunk_id", [i for i, _ in near])).join(F.broadcast(listed), "chunk_id")
    found = docs.join(F.broadcast(found), "document_id").select("chunk_id", "content", "document", "chunk_index", "score")  # fetch rows
    if reranker.name != "noop":
        found = rescored(found, text, reranker)
    return found.orderBy(F.desc("score"), "chunk_id").limit(k)


def rescored(found: DataFrame, text: str, reranker: H.Reranker) -> DataFrame:
    """found, a top list, with the reranker's scores, where it gives any."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        rows = pd.concat(parts).sort_values(["score", "chunk_id"], ascending=[False, True])
        try:
            given = list(reranker.score(text, list(rows["content"])))[: len(rows)]
        except Exception:  # noqa: BLE001 - as without one
            given = []
        rows["score"] = [float(x) for x in given] + list(rows["score"])[len(given) :]
        yield rows

    # Not coalesce(1): that would have one task find them too.
    return found.repartition(1).mapInPandas(run, found.schema)


def rag_query(vectors: DataFrame, docs: DataFrame, query: Vector, k: int = 5, collection: str | None = None) -> DataFrame:
    """(doc_id, collection, score) of the k nearest, the collection filtered first."""
    rows = vectors.join(docs.select("doc_id", F.col("source").alias("collection")), vectors["vec_id"] == F.col("doc_id"))
    rows = rows.filter(F.col("collection") == collection) if collection else rows
    rows, q = _with_query(rows, query)
    return rows.select("doc_id", "collection", F.round(S.closeness(S.l2(F.col("vec"), q)), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def reranked(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """rows with the scores of a reranker (doc_id, new_score) where it gave any."""
    return rows.join(scores, "doc_id", "left").withColumn("score", F.coalesce("new_score", "score")).drop("new_score")


MESSAGES = "array<map<string,string>>"


def parsed(transcripts: DataFrame) -> DataFrame:
    """(conv_id, turn, role, content) of (conv_id, messages), a JSON array of
    objects; a role or content that is missing or no string is empty. Text that is
    no such array has no rows."""
    own = lambda c: F.coalesce(F.when(F.schema_of_variant(F.variant_get("_m", f"$.{c}", "variant")) == "STRING", F.try_variant_get("_m", f"$.{c}", "string")), F.lit(""))
    items = F.try_variant_get(F.try_parse_json("messages"), "$", "array<variant>")
    rows = transcripts.select("conv_id", F.posexplode(items).alias("turn", "_m"))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), own("role").alias("role"), own("content").alias("content"))


def emitted(messages: DataFrame) -> DataFrame:
    """(conv_id, messages): a JSON array of role and content, by turn."""
    each = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return messages.groupBy("conv_id").agg(F.to_json(each).alias("messages"))


def pruned(messages: DataFrame, role: str = "tool", most: int = 8192, engine: str = "engine") -> DataFrame:
    """Contents of a role's messages beyond most bytes become numbered notes."""
    big = (F.lower("role") == role) & (F.octet_length("content") > most)
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    i = F.coalesce(F.sum(big.cast("int")).over(before), F.lit(0))
    note = F.concat(F.lit(f"[tool result stored in {engine}:"), i.cast("string"), F.lit("]"))
    return messages.withColumn("content", F.when(big, note).otherwise(F.col("content")))


def segments(messages: DataFrame, size: int = 40, overlap: int = 5, keep: int = 30) -> DataFrame:
    """(conv_id, segment, turn, role, content): overlapping runs of each
    conversation but its last keep messages; none for senseless parameters."""
    if size < 1 or overlap < 0 or overlap >= size:
        return messages.limit(0).withColumn("segment", F.lit(0))
    of = Window.partitionBy("conv_id")
    p = F.row_number().over(of.orderBy("turn")) - 1
    rows = messages.withColumn("_p", p).withColumn("_l", F.count(F.lit(1)).over(of) - keep).filter("_p < _l")
    step = size - overlap
    n = F.when(F.col("_l") <= size, 1).otherwise(F.ceil((F.col("_l") - size) / step) + 1)
    first = F.greatest(F.lit(0), F.ceil((F.col("_p") - size + 1) / step))
    last = F.least(F.floor(F.col("_p") / step), n - 1)
    return rows.filter(first <= last).withColumn("segment", F.explode(F.sequence(first.cast("int"), last.cast("int")))).drop("_p", "_l")


def token_stats(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.sum(X.tokens(F.col("role")) + X.tokens(F.col("content"))).alias("tokens"))


def summaries(segmented: DataFrame, summarise: H.Summariser | None = None, focus: str = "") -> DataFrame:
    """(conv_id, segment, summary): the summariser's, or where there is none or it
    fails, role and content of the segment's messages."""
    line = F.concat("role", F.lit(": "), "content", F.lit("\n"))
    rows = segmented.groupBy("conv_id", "segment").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("t")))), lambda x: x["t"]), "").alias("summary"),
        F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("_messages"),
    )
    if summarise is None:
        return rows.drop("_messages")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for messages, plain in zip(b["_messages"], b["summary"], strict=True):
                try:
                    out.append(summarise([(m["role"], m["content"]) for m in messages], focus))
                except Exception:  # noqa: BLE001 - compaction goes on without
                    out.append(plain)
            yield pd.DataFrame({"conv_id": b["conv_id"], "segment": b["segment"], "summary": out})

    kinds = dict(rows.dtypes)
    return rows.mapInPandas(run, f"conv_id {kinds['conv_id']}, segment {kinds['segment']}, summary string")


# The texts that a summariser is asked with and that stand around a summary.
PROMPT = (
    "You are a conversation summarizer for a context-compaction system.\n"
    "Summarize the conversation segment below into a compact working state.\n"
    "Preserve: user intent, key decisions, files/actions, errors and fixes, pending tasks.\n"
    "Be concise. Use plain text, no markdown headers.\n"
)
BOUNDARY = "--- CONTEXT COMPACTION BOUNDARY ---\nSession: "
CONTINUE = "Continue without re-asking. The context above has been compacted."
BETWEEN = "\n\n---\n\n"


def prompts(segmented: DataFrame, focus: str = "") -> DataFrame:
    """(conv_id, segment, prompt) that asks for each segment's summary."""
    head = PROMPT + (f"Focus especially on: {focus}\n" if focus else "") + "--- SEGMENT START ---\n"
    return summaries(segmented).select("conv_id", "segment", F.concat(F.lit(head), "summary", F.lit("--- SEGMENT END ---\n")).alias("prompt"))


def summary_block(texts: DataFrame) -> DataFrame:
    """(conv_id, turn, role, content) of (conv_id, text, session): the boundary, the
    summary and the request to go on, as turns 0 to 2."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    three = F.array(message("system", F.concat(F.lit(BOUNDARY), "session")), message("system", F.col("text")), message("user", F.lit(CONTINUE)))
    return texts.select("conv_id", F.posexplode(three).alias("turn", "m")).select("conv_id", F.col("turn").cast("long").alias("turn"), "m.role", "m.content")


@dataclass(frozen=True)
class Compacted:
    """messages (conv_id, turn, role, content) that stand for each transcript,
    stats, the summaries as memories, and the log's new rows."""

    messages: DataFrame
    stats: DataFrame
    memories: DataFrame
    log: DataFrame


def compacted(
    messages: DataFrame, now: Column, size: int = 40, overlap: int = 0, keep: int = 30, role: str = "tool", most: int = 8192, engine: str = "engine",
    summarise: H.Summariser | None = None, focus: str = "", session: Column | None = None, namespace: str = "context",
) -> Compacted:
    """Each conversation with its long tool results noted, its older messages as a
    summary, the last `keep` as they are. One that is too short for a segment stays
    as it is and has no memory; its tokens are the same in and out."""
    size, keep, most, overlap = size if size > 0 else 40, keep if keep > 0 else 30, most if most > 0 else 8192, overlap if overlap >= 0 else 5
    ready = pruned(messages, role, most, engine)
    segmented = segments(ready, size, overlap, keep)
    texts = joined(summaries(segmented, summarise, focus))
    key = session if session is not None else F.col("conv_id").cast("string")
    named = texts.withColumn("session", key)
    of = Window.partitionBy("conv_id")
    place = F.row_number().over(of.orderBy("turn"))
    tail = ready.withColumn("_b", F.count(F.lit(1)).over(of) - place).filter(F.col("_b") < keep).drop("_b").join(texts.select("conv_id"), "conv_id", "left_semi")
    block = summary_block(named)
    done = block.unionByName(tail.withColumn("turn", F.col("turn").cast("long") + 3).select("conv_id", "turn", "role", "content"))
    same = messages.join(texts.select("conv_id"), "conv_id", "left_anti").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "content")
    out = done.unionByName(same)
    numbers = segmented.groupBy("conv_id").agg(F.countDistinct("segment").alias("segments"))
    big = messages.filter((F.lower("role") == role) & (F.octet_length("content") > most)).groupBy("conv_id").agg(F.count(F.lit(1)).alias("_pruned"))
    stats = token_stats(messages).select("conv_id", F.col("messages").alias("messages_in"), F.col("tokens").alias("tokens_in"))
    stats = stats.join(token_stats(out).select("conv_id", F.col("messages").alias("messages_out"), F.col("tokens").alias("tokens_out")), "conv_id")
    stats = stats.join(numbers, "conv_id", "left").join(big, "conv_id", "left")
    cut = F.when(F.col("tokens_in") > 0, F.greatest(F.lit(0.0), (F.col("tokens_in") - F.col("tokens_out")) / F.col("tokens_in") * 100)).otherwise(0.0)
    stats = stats.select(
        "conv_id", "messages_in", "messages_out", "tokens_in", "tokens_out", F.round(cut, 6).alias("reduction"), F.coalesce("segments", F.lit(0)).alias("segments"),
        F.when(F.col("segments").isNull(), 0).otherwise(F.coalesce("_pruned", F.lit(0))).cast("long").alias("pruned"), F.col("segments").isNull().alias("noop"),
    )
    ident = X.content_id("summary_", F.col("session"), F.col("text"))
    memories = named.select(
        ident.alias("id"), F.col("text").alias("content"), F.lit("context").alias("mem_type"), F.lit(namespace).alias("namespace"), F.lit(0.4).alias("importance"),
        F.lit(0).cast("long").alias("access_count"), F.lit(False).alias("pinned"), now.alias("created_at"), now.alias("updated_at"), F.lit(None).cast("timestamp_ntz").alias("superseded_at"), F.lit(0).cast("long").alias("edge_count"),
    )
    log = named.filter(F.col("session") != "").select(F.col("session").alias("session_key"), ident.alias("summary_id"), now.alias("created_at"))
    return Compacted(out, stats, memories, log)


def joined(parts: DataFrame) -> DataFrame:
    """(conv_id, text): a conversation's summaries in order."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "summary"))), lambda x: x["summary"]), BETWEEN)
    return parts.groupBy("conv_id").agg(text.alias("text"))


def compaction(messages: DataFrame, size: int = 40, overlap: int = 5, keep: int = 30, role: str = "tool", most: int = 8192) -> DataFrame:
    """(conv_id, tokens_in, tokens_out, reduction) of each conversation that has
    segments: summaries joined, with the messages that were kept."""
    ready = pruned(messages, role, most)
    summary = joined(summaries(segments(ready, size, overlap, keep)))
    of = Window.partitionBy("conv_id")
    tail = ready.withColumn("_b", F.count(F.lit(1)).over(of) - F.row_number().over(of.orderBy("turn"))).filter(F.col("_b") < keep)
    out = token_stats(messages).withColumnRenamed("tokens", "tokens_in").join(summary, "conv_id").join(token_stats(tail).select("conv_id", F.col("tokens").alias("_tail")), "conv_id", "left")
    out = out.withColumn("tokens_out", X.tokens(F.col("text")) + F.coalesce("_tail", F.lit(0)))
    cut = F.when(F.col("tokens_in") > 0, F.greatest(F.lit(0.0), (F.col("tokens_in") - F.col("tokens_out")) / F.col("tokens_in") * 100)).otherwise(0.0)
    return out.select("conv_id", "tokens_in", "tokens_out", F.round(cut, 6).alias("reduction"))
