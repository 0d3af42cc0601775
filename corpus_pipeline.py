"""The corpus pipeline: from documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir), where docs has the columns of documents,
and works on all rows that the stage before kept; all but the last return those
columns. It belongs to tessera.llm and goes with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language_id, line_dedup, mixing, piece_codec, simhash
from tessera.llm.common import materialize, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found, with that as their lang; those
    without a letter, and no others, go: null and empty texts too. Repeated rows
    are each judged, an empty table stays empty."""
    return language_id.spoken(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand, alike, earlier; documents of which
    nothing but white space is left go, null and empty texts too. n_chars follows
    the text. Rows that repeat doc_id and text are one document, and each stays
    alike; an empty table stays empty."""
    kept = line_dedup.dedup_lines(docs).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.select(*(F.length("text").cast(dict(docs.dtypes)[c]).alias(c) if c == "n_chars" else c for c in docs.columns))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id:
    texts whose five-word shingles have a Jaccard similarity of 0.8 or more. Null
    and empty texts are one group, rows that repeat the doc_id and text that stays
    all stay, an empty table stays empty."""
    return simhash.near_dedup(docs, words=5, least=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for, whole. Null sources
    are one source; documents without words follow their place in the order; of
    repeated rows each has its share of the copies; an empty table stays empty."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document; null and empty texts have none,
    an empty table has no rows."""
    import public_tokenizers

    encoded = piece_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_near),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Suffix automata, XXH64 and byte-pair merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's are written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
