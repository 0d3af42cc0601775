"""SentencePiece encoding and decoding of documents."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, materialize, text_or_empty
from .pieces import EDGE, SPACE, Chunk, PieceIds, PieceModel, State, borders, compose
from .ragged import WordIds

#: Longer texts are split into chunks of this many characters.
CHUNK = 16_384
#: Matrices that are combined into one in a round.
FAN = 64

Matrix = dict[State, set[State]]


def _read(path: str) -> tuple[PieceModel, WordIds]:
    m = PieceModel(path)
    return m, PieceIds(m)


def _model(path: str) -> tuple[PieceModel, WordIds]:
    """A worker reads a model once and keeps the words that it has encoded."""
    return held(("pieces", path), lambda: _read(path))


def _whole(rows: DataFrame, model: str, digest: bool) -> DataFrame:
    """Ids of texts that are one chunk, between the states at the text's edges:
    no piece crosses a word's beginning, so each distinct word is traced once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, words = _model(model)
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                flat, ends = words.texts([m.words(m.spaced(t.as_py())) for t in some["_text"]])
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(flat))
                columns = [some["doc_id"], ids, *(_digests(m, ids) if digest else [])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "n_tokens", "text_sha256"][: len(columns)])

    return rows.mapInArrow(encode, f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>" + (DIGESTS if digest else ""))


def _dump(matrix: Matrix) -> str:
    return json.dumps([[s, sorted(to)] for s, to in matrix.items()])


def _load(text: str) -> Matrix:
    return {tuple(s): {tuple(x) for x in to} for s, to in json.loads(text)}


def _states(matrices: DataFrame, most: int, fan: int) -> DataFrame:
    """From (_key, i, matrix), at most `most` to a key, the states at both ends of
    each: (_key, i, entering, leaving). In rounds, fan neighbours are combined into
    one matrix, until a key has fan at most; their borders are found, then, round
    by round back, those inside each of them. No row holds more than fan matrices."""

    def grouped(level: DataFrame) -> DataFrame:
        group = level.groupBy("_key", F.floor(F.col("i") / fan).cast("int").alias("up"))
        return group.agg(F.array_sort(F.collect_list(F.struct("i", "matrix"))).alias("parts"))

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch["parts"].to_pylist():
                whole = _load(row[0]["matrix"])
                for x in row[1:]:
                    whole = compose(whole, _load(x["matrix"]))
                out.append(_dump(whole))
            yield pa.RecordBatch.from_arrays([batch["_key"], batch["up"], pa.array(out, pa.string())], ["_key", "i", "matrix"])

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places, entering, leaving = [], [], [], []
            for row in batch.to_pylist():
                first, last = (tuple(json.loads(row[c])) for c in ("entering", "leaving"))
                found = [json.dumps(s) for s in borders([_load(x["matrix"]) for x in row["parts"]], first, last)]
                keys += [row["_key"]] * len(row["parts"])
                places += [x["i"] for x in row["parts"]]
                entering += found[:-1]
                leaving += found[1:]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(places, pa.int32()), pa.array(entering, pa.string()), pa.array(leaving, pa.string())], ["_key", "i", "entering", "leaving"])

    levels = [matrices]
    while most > fan:
        levels.append(materialize(grouped(levels[-1]).mapInArrow(combined, "_key string, i int, matrix string"), "matrices"))
        most = -(-most // fan)
    edge = F.lit(json.dumps(EDGE))
    ends = None
    for level in reversed(levels):
        parts = grouped(level)
        if ends is None:
            parts = parts.select("_key", "parts", edge.alias("entering"), edge.alias("leaving"))
        else:
            parts = parts.join(ends.withColumnRenamed("i", "up"), ["_key", "up"]).select("_key", "parts", "entering", "leaving")
        ends = parts.mapInArrow(inside, "_key string, i int, entering string, leaving string")
    return ends


def _chunked(rows: DataFrame, model: str, chunk: int, fan: int) -> DataFrame:
    """Ids of longer texts. Each chunk gives its matrix in any task; matrices are
    combined, and the states at all borders found, in _states; each chunk is then
    traced back on its own. Equal texts are encoded once: of their rows the one
    numbered first. Chunks are cut where their text is read and dealt out once, to
    meet their states."""
    longest = _model(model)[0].longest
    keyed = rows.withColumn("_key", F.sha2("_text", 256))
    spaced = F.concat(F.lit(SPACE), F.replace("_text", F.lit(" "), F.lit(SPACE)))
    size = F.length("_text") + 1
    numbered = keyed.select("_key", "_text", F.monotonically_increasing_id().alias("_row"))
    ats = numbered.select("_key", "_row", spaced.alias("_s"), size.alias("_size"), F.explode(F.sequence(F.lit(0), size - 1, F.lit(chunk))).alias("at"))
    begin = F.greatest(F.lit(0), F.col("at") - longest)
    chunks = materialize(
        ats.select(
            "_key", "_row", (F.col("at") / chunk).cast("int").alias("i"), (F.col("at") - begin).alias("lead"), F.least(F.lit(chunk), F.col("_size") - F.col("at")).alias("size"),
            (F.col("at") + chunk >= F.col("_size")).alias("ends"),
            F.substring("_s", begin + 1, F.col("at") - begin + chunk + longest).alias("piece"),
        ), "chunks",
    )

    def made(x: object) -> Chunk:
        return Chunk(_model(model)[0], x.piece, int(x.lead), int(x.size), x.i == 0, bool(x.ends))

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"_key": batch["_key"], "_row": batch["_row"], "i": batch["i"], "matrix": [_dump(made(x).transfer()) for x in batch.itertuples()]})

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            m, words = _model(model)
            for at in range(0, len(whole), 64):
                batch = whole.iloc[at : at + 64]
                parts = [made(x).parts(tuple(json.loads(x.entering)), tuple(json.loads(x.leaving))) for x in batch.itertuples()]
                flat, ends = words.texts([middle for _, middle, _ in parts])
                out = [
                    np.concatenate((np.array(m.piece_ids(head), np.int32), ids, np.array(m.piece_ids(rest), np.int32)))
                    for (head, _, rest), ids in zip(parts, np.split(flat, ends[:-1]), strict=True)
                ]
                yield pd.DataFrame({"_key": batch["_key"], "i": batch["i"], "ids": out})

    most = chunks.agg(F.max("i")).first()[0]
    first = chunks.filter("i = 0").groupBy("_key").agg(F.min("_row").alias("_row"))
    level = materialize(chunks.mapInPandas(matrices, "_key string, _row long, i int, matrix string").join(first, ["_key", "_row"]), "matrices")
    states = _states(level.drop("_row"), (most or 0) + 1, fan).join(first, "_key")
    # States of all chunks are no broadcast: there are as many as chunks.
    traced = chunks.join(states.hint("merge"), ["_key", "_row", "i"]).mapInPandas(trace, "_key string, i int, ids array<int>")
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "ids"))), lambda x: x["ids"]))
    return keyed.select("doc_id", "_key").join(traced.groupBy("_key").agg(joined.alias("ids")), "_key").select("doc_id", "ids")


def _parted(docs: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    rows = docs.select("doc_id", text_or_empty().alias("_text"))
    long = F.length("_text") + 1 > chunk
    return rows.filter(~long), rows.filter(long)


def encode(docs: DataFrame, model: str, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """doc_id, ids for each row of docs: the model's encoding of the whole text,
    as its own library gives it. Null and empty texts have no ids, characters
    that the model doesn't know are their UTF-8 bytes. Repeated rows are each
    returned, other columns are ignored, an empty table gives no rows."""
    short, long = _parted(docs, chunk)
    return _whole(short, model, False).unionByName(_chunked(long, model, chunk, fan))


DIGESTS = ", n_tokens long, text_sha256 string"


def _digests(m: PieceModel, ids: pa.ListArray) -> list[pa.Array]:
    """How many ids each list has, and the digest of the text it decodes to."""
    out = [hashlib.sha256(b).hexdigest() for b in m.decoded(ids).to_pylist()]
    return [pa.array(np.diff(ids.offsets.to_numpy()).astype(np.int64)), pa.array(out, pa.string())]


def _slices(batches: Iterator[pa.RecordBatch], make: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            yield make(batch.slice(at, 512))


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text for each row of encoded; null ids are none. A text comes back
    as it was, but for its U+2581, which the models use for the space. Bytes that
    are no UTF-8 are read as U+FFFD."""

    def texts(some: pa.RecordBatch) -> pa.RecordBatch:
        raw = _model(model)[0].decoded(some["ids"])
        out = [b.decode("utf-8", "replace") for b in raw.to_pylist()]
        return pa.RecordBatch.from_arrays([some["doc_id"], pa.array(out, pa.string())], ["doc_id", "text"])

    ids = F.coalesce("ids", F.array().cast("array<int>")).alias("ids")
    return encoded.select("doc_id", ids).mapInArrow(lambda batches: _slices(batches, texts), f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def encode_and_decode(docs: DataFrame, model: str, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """doc_id, ids, n_tokens, and text_sha256 of the text that the ids decode to.
    A text of one chunk is encoded and decoded by the same worker."""

    def digests(some: pa.RecordBatch) -> pa.RecordBatch:
        columns = [some["doc_id"], some["ids"], *_digests(_model(model)[0], some["ids"])]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "n_tokens", "text_sha256"])

    short, long = _parted(docs, chunk)
    encoded = _chunked(long, model, chunk, fan)
    kinds = f"doc_id {dict(encoded.dtypes)['doc_id']}, ids array<int>" + DIGESTS
    return _whole(short, model, True).unionByName(encoded.mapInArrow(lambda batches: _slices(batches, digests), kinds))
