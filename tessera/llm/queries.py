"""The queries opN_<name>, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import edited_likeness

    return edited_likeness(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_report

    return line_report(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import dedup

    return dedup(table(spark, sf_dir, "documents"), keep_bytes=False)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_groups

    return near_groups(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_ids

    return token_ids(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece_codec import encode_and_decode

    return encode_and_decode(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import build, search

    return search(build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), 10)


def op12_late_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .late_rows import late_overwrite, with_copies

    sales = table(spark, sf_dir, "sales")
    return late_overwrite(with_copies(sales), until="2024-03-01", per_file=1 + sales.count() // 900)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import report

    return report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from . import exact_dedup, lexical, mixing

    return {"op7_exact_dedup": exact_dedup.ORACLE_SQL, "op10_mixing": mixing.ORACLE_SQL, "op11_ranked_search": lexical.ORACLE_SQL}
