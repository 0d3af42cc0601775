"""Named queries of documents in collections and of conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents as D
from ..sources import catalog as K
from ..sources.postings import state_of
from ..sources.tables import written
from .base import NOW, VEC, now, q, query, vector

#: doc_id, i, chunk: texts cut as the engine cuts them. Every character is followed
#: by a mark for each byte beyond its first, so that characters count as bytes.
CHUNKS = r"""pad AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '([\x{80}-\x{7FF}])', '\1' || chr(1), 'g'), '([\x{800}-\x{FFFF}])', '\1' || chr(1) || chr(1), 'g'), '([\x{10000}-\x{10FFFF}])', '\1' || chr(1) || chr(1) || chr(1), 'g') AS t FROM documents),
c AS (SELECT doc_id, 0 AS i, '' AS chunk, t AS rest FROM pad UNION ALL
SELECT doc_id, i + 1, substr(rest, 1, cut), substr(rest, cut + 1) FROM (SELECT *, CASE WHEN length(rest) <= 500 THEN 500 WHEN a > 250 THEN a + 2 WHEN b > 250 THEN b + 2 WHEN n > 250 THEN n + 1 WHEN substr(rest, 501, 1) = chr(1) THEN length(rtrim(substr(rest, 1, 500), chr(1))) - 1 ELSE 500 END AS cut FROM (
SELECT *, 500 - instr(reverse(substr(rest, 1, 500)), chr(10) || chr(10)) - 1 + CASE WHEN instr(reverse(substr(rest, 1, 500)), chr(10) || chr(10)) = 0 THEN -1000 ELSE 0 END AS a,
500 - instr(reverse(substr(rest, 1, 500)), ' .') - 1 + CASE WHEN instr(reverse(substr(rest, 1, 500)), ' .') = 0 THEN -1000 ELSE 0 END AS b,
500 - instr(reverse(substr(rest, 1, 500)), chr(10)) + CASE WHEN instr(reverse(substr(rest, 1, 500)), chr(10)) = 0 THEN -1000 ELSE 0 END AS n FROM c WHERE rest <> '' OR i = 0)))"""


@query(f"WITH RECURSIVE {CHUNKS} SELECT doc_id, (i - 1)::INT AS chunk_index, replace(chunk, chr(1), '') AS content FROM c WHERE i > 0")
def rag_chunks(spark, sf_dir):
    return D.chunks(K.table(spark, sf_dir, "documents"))


@query(f"WITH {VEC} SELECT doc_id, source AS collection, round(1 / (1 + list_distance(v, q)), 6) AS score FROM vec JOIN documents ON vec_id = doc_id, qv WHERE source = 'src3' ORDER BY score DESC, doc_id LIMIT 5")
def rag_query(spark, sf_dir):
    return D.rag_query(K.vectors(spark, sf_dir), K.table(spark, sf_dir, "documents"), vector(spark, sf_dir), 5, "src3")


NAMED = "nd AS (SELECT doc_id, source AS collection, 'doc_' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' ELSE '' END AS filename, coalesce(text, '') AS text FROM documents WHERE source IS NOT NULL), dd AS (SELECT *, 'rag_doc_' || substr(sha256(strlen(collection) || ':' || collection || strlen(filename) || ':' || filename || strlen(text) || ':' || text), 1, 32) AS document_id FROM nd)"
_LIBRARIES: dict = {}
#: Parts of a chunk's vector: how often each of these strings stands in it.
GRAMS = ("e", "th", "en", "on", "as", "un", "er", "la")
COUNTS = ", ".join(f"((length(x) - length(replace(x, '{g}', ''))) / {len(g)})::DOUBLE" for g in GRAMS)


def chunk_vector(text):
    """Counts of some strings, as a model that SQL can follow."""
    return F.array(*((F.length(text) - F.length(F.replace(text, F.lit(g), F.lit("")))) / len(g) for g in GRAMS)).cast("array<double>")


PROBE = "the song of the last season"
NEAREST = f"qc AS (SELECT [{COUNTS}] AS q FROM (SELECT '{PROBE}' AS x)), ck AS (SELECT 'rag_chk_' || document_id || '_' || (i - 1) AS chunk_id, replace(chunk, chr(1), '') AS x, filename AS document, (i - 1)::INT AS chunk_index, collection FROM dd JOIN c USING (doc_id) WHERE i > 0), ch AS (SELECT chunk_id, x AS content, document, chunk_index, round(1 / (1 + list_distance([{COUNTS}], q)), 6) AS score, collection FROM ck, qc)"


def _probe(spark):
    return spark.createDataFrame([(PROBE,)], "x string").select(chunk_vector(F.col("x")).alias("q"))


def _library(spark, sf_dir):
    """Documents as files, their sources as collections, and an empty collection;
    each chunk has the vector of chunk_vector()."""
    key, state = (spark.sparkContext.applicationId, sf_dir), state_of(spark, f"{sf_dir}/documents.parquet")
    if key not in _LIBRARIES or _LIBRARIES[key][0] != state:
        docs = K.table(spark, sf_dir, "documents").filter("source is not null")
        end = F.when(F.col("doc_id") % 3 == 0, ".md").when(F.col("doc_id") % 3 == 1, ".txt").otherwise("")
        files = docs.select("doc_id", F.col("source").alias("collection"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), end).alias("filename"), F.col("text").alias("content"))
        library = D.with_collections(D.empty_library(spark), spark.createDataFrame([("zz empty", "none yet")], "name string, description string"), now())
        library = D.ingested(library, files, now())
        library = D.replace(library, documents=written(library.documents, "documents"))
        vectors = library.chunks.select(F.col("chunk_id").alias("id"), chunk_vector(F.col("content")).alias("vec"))
        _LIBRARIES[key] = state, D.replace(library, vectors=written(vectors, "chunk_vectors"))
    return _LIBRARIES[key][1]


@query("SELECT source AS name, 'Auto-created for ' || source AS description, 500 AS chunk_size, count(*) AS doc_count FROM documents WHERE source IS NOT NULL GROUP BY 1 UNION ALL SELECT 'zz empty', 'none yet', 500, 0")
def collection_stats(spark, sf_dir):
    return D.collections(_library(spark, sf_dir)).select("name", "description", "chunk_size", "doc_count")


@query(f"WITH RECURSIVE {CHUNKS} SELECT (SELECT count(DISTINCT source) FROM documents) + 1 AS collections, (SELECT count(*) FROM documents WHERE source IS NOT NULL) AS documents, (SELECT count(*) FROM c JOIN documents USING (doc_id) WHERE i > 0 AND source IS NOT NULL) AS chunks")
def library_stats(spark, sf_dir):
    return D.library_stats(_library(spark, sf_dir))


@query(f"WITH RECURSIVE {NAMED}, {CHUNKS} SELECT document_id, collection, filename, CASE doc_id % 3 WHEN 0 THEN 'markdown' WHEN 1 THEN 'text' ELSE 'file' END AS source_type, '{{}}' AS metadata, count(*) AS chunk_count FROM dd JOIN c USING (doc_id) WHERE i > 0 GROUP BY ALL")
def library_documents(spark, sf_dir):
    library = _library(spark, sf_dir)
    return library.documents.join(library.collections.select("collection_id", F.col("name").alias("collection")), "collection_id").select("document_id", "collection", "filename", "source_type", "metadata", "chunk_count")


@query(f"WITH RECURSIVE {CHUNKS} SELECT (SELECT count(DISTINCT source) FROM documents WHERE source <> 'src3') + 1 AS collections, (SELECT count(*) FROM documents WHERE source <> 'src3') AS documents, (SELECT count(*) FROM c JOIN documents USING (doc_id) WHERE i > 0 AND source <> 'src3') AS chunks")
def collection_deleted(spark, sf_dir):
    return D.library_stats(D.without_collection(_library(spark, sf_dir), "src3"))


@query(f"WITH RECURSIVE {NAMED}, {CHUNKS}, {NEAREST} SELECT chunk_id, content, document, chunk_index, score FROM ch WHERE collection = 'src3' ORDER BY score DESC, chunk_id LIMIT 5")
def rag_query_chunks(spark, sf_dir):
    return D.query_chunks(_library(spark, sf_dir), PROBE, _probe(spark), 5, "src3")


@query(f"WITH RECURSIVE {NAMED}, {CHUNKS}, {NEAREST}, f AS (SELECT * FROM ch ORDER BY score DESC, chunk_id LIMIT 50) SELECT chunk_id, document, length(content)::DOUBLE AS score FROM f ORDER BY 3 DESC, chunk_id LIMIT 5")
def rag_query_reranked(spark, sf_dir):
    by_length = D.H.Reranker("length", lambda query, texts: [float(len(t)) for t in texts])
    return D.query_chunks(_library(spark, sf_dir), PROBE, _probe(spark), 5, None, [by_length]).select("chunk_id", "document", "score")


PRUNED = """pr AS (SELECT conv_id, turn, role, CASE WHEN big THEN '[tool result stored in engine:' || coalesce(sum(big::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT || ']' ELSE text END AS content
FROM (SELECT *, lower(role) = 'assistant' AND strlen(text) > 500 AS big FROM conversations))"""
SEG = f"{PRUNED}, sp AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, count(*) OVER (PARTITION BY conv_id) - 2 AS l FROM pr), sg AS (SELECT conv_id, s::INT AS segment, turn, role, content FROM sp, generate_series(0, (SELECT max(l)::BIGINT FROM (SELECT count(*) AS l FROM pr GROUP BY conv_id))) g(s) WHERE p < l AND s * 2 <= p AND p < s * 2 + 3 AND s < CASE WHEN l <= 3 THEN 1 ELSE ceil((l - 3) / 2.0) + 1 END)"
TOKENS = "(CASE WHEN {0} = '' THEN 0 ELSE greatest(1, strlen({0}) // 4) END)"


def _pruned(spark, sf_dir):
    return D.pruned(K.messages(spark, sf_dir), "assistant", 500)


@query(f"WITH {PRUNED} SELECT * FROM pr")
def prune_tool_results(spark, sf_dir):
    return _pruned(spark, sf_dir)


@query(f"WITH {SEG} SELECT * FROM sg")
def segments(spark, sf_dir):
    return D.segments(_pruned(spark, sf_dir), 3, 1, 2)


@query(f"SELECT conv_id, count(*) AS messages, sum({TOKENS.format('role')} + {TOKENS.format('text')})::BIGINT AS tokens FROM conversations GROUP BY 1")
def token_stats(spark, sf_dir):
    return D.token_stats(K.messages(spark, sf_dir))


@query(f"WITH {SEG} SELECT conv_id, segment, string_agg(role || ': ' || content || chr(10), '' ORDER BY turn) AS summary FROM sg GROUP BY 1, 2")
def summary_text(spark, sf_dir):
    return D.summaries(D.segments(_pruned(spark, sf_dir), 3, 1, 2))


@query(f"""WITH {SEG}, su AS (SELECT conv_id, segment, string_agg(role || ': ' || content || chr(10), '' ORDER BY turn) AS t FROM sg GROUP BY 1, 2), tx AS (SELECT conv_id, string_agg(t, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY segment) AS t FROM su GROUP BY 1),
i AS (SELECT conv_id, sum({TOKENS.format('role')} + {TOKENS.format('text')})::BIGINT AS tokens_in FROM conversations GROUP BY 1), o AS (SELECT conv_id, sum({TOKENS.format('role')} + {TOKENS.format('content')})::BIGINT AS tail FROM sp WHERE p >= l GROUP BY 1)
SELECT conv_id, tokens_in, ({TOKENS.format('t')} + coalesce(tail, 0))::BIGINT AS tokens_out, round(CASE WHEN tokens_in > 0 THEN greatest(0.0, (tokens_in - ({TOKENS.format('t')} + coalesce(tail, 0))) / tokens_in::DOUBLE * 100) ELSE 0 END, 6) AS reduction FROM tx JOIN i USING (conv_id) LEFT JOIN o USING (conv_id)""")
def compaction(spark, sf_dir):
    return D.compaction(K.messages(spark, sf_dir), 3, 1, 2, "assistant", 500)


JOINED = f"su AS (SELECT conv_id, segment, string_agg(role || ': ' || content || chr(10), '' ORDER BY turn) AS t FROM sg GROUP BY 1, 2), ct AS (SELECT conv_id, string_agg(t, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY segment) AS t FROM su GROUP BY 1)"
BLOCK = f"bl AS (SELECT conv_id, 0::BIGINT AS turn, 'system' AS role, {q(D.BOUNDARY)} || conv_id AS content FROM ct UNION ALL SELECT conv_id, 1, 'system', t FROM ct UNION ALL SELECT conv_id, 2, 'user', {q(D.CONTINUE)} FROM ct)"
OUT = "ou AS (SELECT * FROM bl UNION ALL SELECT conv_id, turn::BIGINT + 3, role, content FROM sp WHERE p >= l AND conv_id IN (SELECT conv_id FROM ct) UNION ALL SELECT conv_id, turn::BIGINT, role, text FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM ct))"


def _compacted(spark, sf_dir):
    return D.compacted(K.messages(spark, sf_dir), now(), 3, 1, 2, "assistant", 500)


@query(f"WITH {SEG} SELECT conv_id, segment, {q(D.PROMPT + 'Focus especially on: names' + chr(10) + '--- SEGMENT START ---' + chr(10))} || string_agg(role || ': ' || content || chr(10), '' ORDER BY turn) || '--- SEGMENT END ---' || chr(10) AS prompt FROM sg GROUP BY 1, 2")
def summary_prompts(spark, sf_dir):
    return D.prompts(D.segments(_pruned(spark, sf_dir), 3, 1, 2), "names")


@query(f"WITH {SEG}, {JOINED}, {BLOCK} SELECT * FROM bl")
def summary_blocks(spark, sf_dir):
    texts = D.joined(D.summaries(D.segments(_pruned(spark, sf_dir), 3, 1, 2)))
    return D.summary_block(texts.withColumn("session", F.col("conv_id").cast("string")))


@query(f"WITH {SEG}, {JOINED}, {BLOCK}, {OUT} SELECT * FROM ou")
def compacted_messages(spark, sf_dir):
    return _compacted(spark, sf_dir).messages


@query(f"""WITH {SEG}, {JOINED}, {BLOCK}, {OUT}, i AS (SELECT conv_id, count(*) AS messages_in, sum({TOKENS.format('role')} + {TOKENS.format('text')})::BIGINT AS tokens_in, count(*) FILTER (lower(role) = 'assistant' AND strlen(text) > 500) AS big FROM conversations GROUP BY 1),
o AS (SELECT conv_id, count(*) AS messages_out, sum({TOKENS.format('role')} + {TOKENS.format('content')})::BIGINT AS tokens_out FROM ou GROUP BY 1), n AS (SELECT conv_id, count(DISTINCT segment) AS n FROM sg GROUP BY 1)
SELECT conv_id, messages_in, messages_out, tokens_in, tokens_out, round(CASE WHEN tokens_in > 0 THEN greatest(0.0, (tokens_in - tokens_out) / tokens_in::DOUBLE * 100) ELSE 0 END, 6) AS reduction, coalesce(n, 0) AS segments, CASE WHEN n IS NULL THEN 0 ELSE big END AS pruned, n IS NULL AS noop FROM i JOIN o USING (conv_id) LEFT JOIN n USING (conv_id)""")
def compaction_stats(spark, sf_dir):
    return _compacted(spark, sf_dir).stats


@query(f"WITH {SEG}, {JOINED} SELECT 'summary_' || substr(sha256(strlen(conv_id::VARCHAR) || ':' || conv_id || strlen(t) || ':' || t), 1, 32) AS id, t AS content, 'context' AS mem_type, 'context' AS namespace, 0.4::DOUBLE AS importance FROM ct")
def compaction_memories(spark, sf_dir):
    return _compacted(spark, sf_dir).memories.select("id", "content", "mem_type", "namespace", "importance")


@query(f"WITH {SEG}, {JOINED} SELECT conv_id::VARCHAR AS session_key, 'summary_' || substr(sha256(strlen(conv_id::VARCHAR) || ':' || conv_id || strlen(t) || ':' || t), 1, 32) AS summary_id, '{NOW}' AS created_at FROM ct")
def compaction_log(spark, sf_dir):
    return _compacted(spark, sf_dir).log.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT conv_id, turn::BIGINT AS turn, CASE turn % 3 WHEN 0 THEN role ELSE '' END AS role, text AS content FROM conversations")
def parsed_messages(spark, sf_dir):
    role = F.when(F.col("turn") % 3 == 0, F.to_json(F.struct("role", "content"))).when(F.col("turn") % 3 == 1, F.to_json(F.struct(F.lit(7).alias("role"), "content"))).otherwise(F.to_json(F.struct("content")))
    rows = K.messages(spark, sf_dir).withColumn("_j", role)
    each = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "_j"))), lambda x: x["_j"]), ",")
    return D.parsed(rows.groupBy("conv_id").agg(F.concat(F.lit("["), each, F.lit("]")).alias("messages")))


@query("SELECT conv_id, to_json(list({role: role, content: text} ORDER BY turn))::VARCHAR AS messages FROM conversations GROUP BY 1")
def emitted_messages(spark, sf_dir):
    return D.emitted(K.messages(spark, sf_dir))
