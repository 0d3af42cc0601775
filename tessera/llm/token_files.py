"""Token-ID output: texts to ids, one wavelet-matrix file a shard, and back."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from string import punctuation

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held, shared_dir, text_or_empty
from .ragged import WordIds
from .wavelet import WaveletMatrix, dump, load

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
END_ID = 2
SHARD_IDS = 4_000_000


# The parts of a tokenizer that PartIds knows, as its file has them.
KNOWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
KNOWN_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
#: Characters that NFC leaves alone and whose letters and digits Python tells as
#: the tokenizer does: ASCII and the letters of Latin-1.
PLAIN = bytes([*range(0x20, 0x7F), *range(0x09, 0x0E), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])
PLAIN_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
SPECIAL = "<|"


def _plain(text: str) -> bool:
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return not raw.translate(None, PLAIN) and SPECIAL not in text


def split_texts(texts: Iterable[str]) -> list[list[str]]:
    """Each text's words, the plain ones in lower case."""
    out = []
    for text in texts:
        if _plain(text):
            out.append(text.lower().split())
        else:
            out.append([w.lower() if _plain(w) else w for w in WORDS.findall(text)])
    return out


class PartIds(WordIds):
    """Ids of words for a tokenizer of known steps: the parts into which it would
    split a plain word go to its model straight; those behind or before a mark
    are held as words too."""

    def __init__(self, tokenizer, **options):
        from tokenizers import pre_tokenizers

        super().__init__(**options)
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def made(self, word: str) -> bytes:
        core = word.rstrip(punctuation)
        if core.isascii() and core.isalpha():
            # Marks behind letters are one part.
            return array("i", [x.id for x in self.model.tokenize(core)]).tobytes() if core == word else self[core] + self[word[len(core) :]]
        if not _plain(word):
            return array("i", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        parts = PLAIN_PARTS.findall(word)
        if len(parts) > 1:
            return b"".join([self[p] for p in parts])
        return array("i", [x.id for x in self.model.tokenize(word if word.isascii() else self.as_bytes.pre_tokenize_str(word)[0][0])]).tobytes()


def text_encoder(path: str) -> tuple[WordIds, Callable[[Iterable[str]], list[list[str]]], int]:
    """For the tokenizer in path: a table of the ids of a text's words, the
    function that splits texts into them, and its number of ids. The tokenizer
    drops white space and joins nothing across it."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    steps = json.loads(tokenizer.to_str())
    normal, before = steps["normalizer"] or {}, (steps["pre_tokenizer"] or {}).get("pretokenizers", [])
    known = (
        [x["type"] for x in normal.get("normalizers", [])] == KNOWN_NORMALIZERS
        and [x["type"] for x in before] == ["Split", "ByteLevel"]
        and before[0]["pattern"] == {"Regex": KNOWN_SPLIT} and before[0]["behavior"] == "Removed" and before[0]["invert"]
        and not before[1]["add_prefix_space"] and not before[1]["use_regex"]
        and all(SPECIAL in x["content"] for x in steps["added_tokens"])
    )
    size = tokenizer.get_vocab_size(with_added_tokens=True)
    if known:
        return PartIds(tokenizer), split_texts, size
    return WordIds(lambda w: tokenizer.encode(w, add_special_tokens=False).ids), lambda texts: list(map(WORDS.findall, texts)), size


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Write the ids of every text, each ended by end_id, in ascending doc_id
    order as shard files: rows (part, shard, n_tokens, n_docs, file) of a Parquet
    table in path, where file is the whole wavelet-matrix file of a shard.

    Documents are dealt and sorted by range of doc_id; a partition writes a shard
    whenever it has shard_ids ids, so a task holds one shard and one document.
    The table's writer commits a task's shards once, however often it is tried.

    Null text counts as empty: its only id is end_id. Null ids come first. Rows
    that repeat an id follow each other, ordered by text. Columns besides doc_id
    and text are ignored. An empty table writes no shards.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, table, split, width, end = TaskContext.get().partitionId(), None, None, 0, np.array([end_id], np.int32).tobytes()
        shard, so_far, ids, ends = 0, 0, [], []

        def flush() -> pa.RecordBatch:
            nonlocal shard, so_far, ids, ends
            flat, upto, base = np.concatenate([x for x, _ in ends]), [], 0
            for x, e in ends:
                upto.append(e + base)
                base += len(x)
            blob = dump(WaveletMatrix.build(flat, width), ids, np.concatenate(upto))
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(flat)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([blob], pa.binary())],
                ["part", "shard", "n_tokens", "n_docs", "file"],
            )
            shard, so_far, ids, ends = shard + 1, 0, [], []
            return row

        for batch in batches:
            if table is None:
                # Kept for the worker's next tasks: words come back.
                table, split, size = held(("words", tokenizer), lambda: text_encoder(tokenizer))
                width = max(size - 1, end_id, 1).bit_length()
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                flat, stop = table.texts(split(some["_text"].to_pylist()), end)
                ends.append((flat.view(np.uint32), stop))
                ids += [None if x is None else int(x) for x in some["_id"].to_pylist()]
                so_far += len(flat)
                if so_far >= shard_ids:
                    yield flush()
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("string").alias("_id"), text_or_empty().alias("_text"), F.col("doc_id").alias("_key"))
    dealt = rows.repartitionByRange(F.col("_key").asc_nulls_first()).sortWithinPartitions(F.col("_key").asc_nulls_first(), "_text").select("_id", "_text")
    dealt.mapInArrow(shards, "part int, shard int, n_tokens long, n_docs long, file binary").write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of the files in path: doc_id, start (ids of all
    documents before it), n_tokens, ids_crc32, all from the files."""

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, shard, blob in zip(batch["part"], batch["shard"], batch["file"], strict=True):
                matrix, ids, ends = load(blob)
                flat = matrix.to_array().astype("<u4")
                starts = np.concatenate(([0], ends[:-1]))
                yield pd.DataFrame({
                    "part": part, "shard": shard, "doc_id": pd.array(ids, "Int64"), "_at": starts, "n_tokens": ends - starts,
                    "ids_crc32": [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)],
                })

    files = spark.read.parquet(path)
    docs = files.select("part", "shard", "file").mapInPandas(documents, "part int, shard int, doc_id long, _at long, n_tokens long, ids_crc32 long")
    shards = files.select("part", "shard", "n_tokens").withColumn("_in", F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)))
    # One row a partition: the only step in one task.
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    bases = shards.join(parts, "part").select("part", "shard", (F.coalesce("_in", F.lit(0)) + F.coalesce("_before", F.lit(0))).alias("_base"))
    return docs.join(bases, ["part", "shard"]).select("doc_id", (F.col("_at") + F.col("_base")).alias("start"), "n_tokens", "ids_crc32")


def token_ids(docs: DataFrame, tokenizer: str, path: str | None = None, **options) -> DataFrame:
    """write_shards to path (a new folder in the shared one if none), then read_shards."""
    import uuid

    path = path or f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_shards(docs, path, tokenizer, **options)
    return read_shards(docs.sparkSession, path)
