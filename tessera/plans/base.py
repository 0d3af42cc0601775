"""What the named queries share: the register, the driver's tables as SQL, time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.match import plain
from ..operators import search as Q
from ..sources import catalog as K
from ..sources import postings as P

QUERIES: dict = {}
SQL: dict[str, str] = {}
NOW = "2024-08-01 00:00:00"
AS_OF = "2024-03-01 00:00:00"
TEXT = "that rest"
#: For each word of TEXT, the words with its stem.
STEMS = ["thats?", "rest(es?|s|ed|ings?)?"]
#: Likewise of other words.
OF, THE, UND = "ofs?", "thes?", "unds?"
SEEDS = range(1, 21)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def now():
    return F.expr(f"TIMESTAMP_NTZ '{NOW}'")


def as_of():
    return F.expr(f"TIMESTAMP_NTZ '{AS_OF}'")


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


MEM = (
    "mem AS (SELECT 'mem_' || lpad(doc_id::VARCHAR, 8, '0') AS id, text AS content, ["
    + ", ".join(map(q, C.TYPES))
    + f"""][doc_id % 9 + 1] AS mem_type, lang AS namespace, ((doc_id % 11) / 10.0)::DOUBLE AS importance,
  doc_id % 13 AS access_count, doc_id % 17 = 0 AS pinned, TIMESTAMP '2024-01-01' + to_days((doc_id % 200)::INT) AS created_at,
  CASE WHEN doc_id % 10 = 3 THEN TIMESTAMP '2024-01-01' + to_days((doc_id % 200 + 30)::INT) END AS superseded_at, doc_id % 7 AS edge_count,
  TIMESTAMP '{NOW}' AS now FROM documents)"""
)
VEC = "vec AS (SELECT 'mem_' || lpad(vec_id::VARCHAR, 8, '0') AS id, vec_id, embedding::DOUBLE[] AS v FROM embeddings), qv AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
WEIGHT = "CASE mem_type " + " ".join(f"WHEN {q(t)} THEN {w}" for t, (w, _) in C.TYPES.items()) + f" ELSE {C.OTHER[0]} END"
DECAY = "CASE mem_type " + " ".join(f"WHEN {q(t)} THEN {d}" for t, (_, d) in C.TYPES.items()) + f" ELSE {C.OTHER[1]} END"
BOOSTS = f"(0.05 * exp(-greatest(0.0, date_diff('second', created_at, now) / 3600.0) / ({DECAY})) + 0.1 * ({WEIGHT}) * least(access_count / 10.0, 1.0) + 0.1 * pinned::INT + 0.03 * ln(1 + edge_count))"
WORDS = "list_filter(regexp_split_to_array(strip_accents(lower(coalesce(content, ''))), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
LIVE = "superseded_at IS NULL"
PAST = f"created_at <= TIMESTAMP '{AS_OF}' AND (superseded_at IS NULL OR superseded_at > TIMESTAMP '{AS_OF}')"


def bm25_sql(counts: list[str], keep: str = LIVE, holds: str | None = None, k: int = 60) -> str:
    """kw (id, score) and what it needs: counts are SQL for the hits of each phrase
    in ws, the list of a text's words."""
    n = range(len(counts))
    holds = holds or " AND ".join(f"tf{i} > 0" for i in n)
    return f"""w AS (SELECT *, {WORDS} AS ws FROM mem), tf AS (SELECT *, len(ws) AS dl, {', '.join(f"{c} AS tf{i}" for i, c in enumerate(counts))} FROM w),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {', '.join(f'count(*) FILTER (tf{i} > 0) AS df{i}' for i in n)} FROM tf),
kw AS (SELECT id, round({' + '.join(f'greatest(1e-6, ln((n - df{i} + 0.5) / (df{i} + 0.5))) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))' for i in n)}, 6) AS score
 FROM tf, st WHERE {keep} AND ({holds}) ORDER BY score DESC, id LIMIT {k})"""


def matching(pattern: str) -> str:
    return f"len(list_filter(ws, lambda w: regexp_full_match(w, '{pattern}')))"


def words_sql(keep: str = LIVE) -> str:
    return bm25_sql([matching(p) for p in STEMS], keep)


def near_sql(keep: str = LIVE) -> str:
    return f"nn AS (SELECT vec.id, round(list_distance(v, q), 6) AS distance FROM vec JOIN mem ON mem.id = vec.id AND {keep}, qv ORDER BY distance, vec.id LIMIT 60)"


FUSED = """rv AS (SELECT id, row_number() OVER (ORDER BY distance, id) AS vector_rank FROM nn), rk AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS keyword_rank FROM kw),
fu AS (SELECT coalesce(rv.id, rk.id) AS id, vector_rank, keyword_rank, coalesce(1 / (60.0 + vector_rank), 0) + coalesce(1 / (60.0 + keyword_rank), 0) AS rrf_score FROM rv FULL JOIN rk ON rv.id = rk.id)"""


SCORED = f"sc AS (SELECT mem.*, rrf_score, rrf_score + {BOOSTS} AS full_score FROM mem JOIN fu ON mem.id = fu.id)"


def recall_sql(keep: str = LIVE, vectors: bool = True, least: float = 0.0, columns: str = "id, mem_type, namespace, round(rrf_score, 6) AS rrf_score, round(full_score, 6) AS score") -> str:
    nn = near_sql(keep) if vectors else "nn AS (SELECT '' AS id, 0.0 AS distance WHERE false)"
    return f"""WITH {MEM}, {VEC}, {words_sql(keep)}, {nn}, {FUSED}, {SCORED}
SELECT {columns}, row_number() OVER (ORDER BY round(full_score, 6) DESC, id) AS rank FROM sc WHERE round(full_score, 6) >= {least} ORDER BY round(full_score, 6) DESC, id LIMIT 20"""


def vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query's vector, as a table of one row."""
    return K.vectors(spark, sf_dir).filter("vec_id = 0").select(F.col("vec").alias("q"))


def index(spark: SparkSession, sf_dir: str, stemmed: bool = True) -> P.Index:
    """The keyword index of the memories, written once a session."""
    return P.kept(K.memories(spark, sf_dir), sf_dir, stemmed, f"{sf_dir}/documents.parquet")


def lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Active memories, and the nearest and best matching 60 of them."""
    live = Q.active(K.memories(spark, sf_dir))
    near = Q.nearest(K.vectors(spark, sf_dir).join(live.select("id"), "id", "left_semi"), vector(spark, sf_dir))
    return live, near, Q.bm25(index(spark, sf_dir), plain(TEXT), 60, live)
