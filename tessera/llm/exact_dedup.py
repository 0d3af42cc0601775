"""Exact dedup: 128-bit content hash, smallest id stays, bytes compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id_col, keep_id, group_size, kept, text_sha256.

    Groups are keyed by the MD5 (128 bits) and the normalised text itself, so the
    aggregate's own key comparison compares the bytes inside a hash group; texts
    that collide fall into different groups. The aggregate combines before the
    shuffle, so a group of copies, however large, sends one row from each task.
    Rows then look up their group by hash; the digest of the text keeps colliding
    texts apart there. That join has one row a group on one side, and its other
    side is free for the engine to split where a group is hot.

    Null texts count as empty, an all-space text is one space. A null id never
    stays while its group has another; a group of null ids has a null keep_id and
    all its rows are kept. Rows that repeat an id and text are each returned.
    Other columns are ignored. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_text"))
    md5, sha = F.unhex(F.md5("_text")), F.unhex(F.sha2("_text", 256))
    groups = (
        rows.groupBy(md5.alias("_h"), "_text")
        .agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("_h", sha.alias("_s"), "keep_id", "group_size")
    )
    return (
        rows.select("_id", md5.alias("_h"), sha.alias("_s"))
        .join(groups, ["_h", "_s"])
        .select(
            F.col("_id").alias(id_col),
            "keep_id",
            "group_size",
            F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("_s")).alias("text_sha256"),
        )
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; rows that repeat a kept
    id and its text stay too, those of the id with another text only if that is kept."""
    kept = exact_groups(docs, id_col, text_col).filter("kept").select(F.col(id_col).alias("_kept_id"), F.col("text_sha256").alias("_kept_sha")).distinct()
    same = docs[id_col].eqNullSafe(kept["_kept_id"]) & (F.sha2(normalised(docs[text_col]), 256) == kept["_kept_sha"])
    return docs.join(kept, same, "left_semi")


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY n) AS keep_id,
       count(*) OVER (PARTITION BY n) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY n) AS kept,
       sha256(n) AS text_sha256
FROM t
"""
