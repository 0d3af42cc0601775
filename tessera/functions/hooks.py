"""Hooks for models outside the engine: embedders, rerankers, summarisers."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import AccumulatorParam
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scoring import normalise

Vectors = Callable[[Sequence[str]], Sequence[Sequence[float] | None]]


class _First(AccumulatorParam):
    """(how many, the first message)."""

    def zero(self, value: tuple) -> tuple:
        return 0, ""

    def addInPlace(self, a: tuple, b: tuple) -> tuple:  # noqa: N802 - Spark's name
        return a[0] + b[0], a[1] or b[1]


class Errors:
    """Errors of a hook in workers, once the job that ran it is over. A task that is
    run again counts its errors again."""

    def __init__(self, spark: SparkSession):
        self._seen = spark.sparkContext.accumulator((0, ""), _First())

    def add(self, error: Exception) -> None:
        self._seen.add((1, f"{type(error).__name__}: {error}"))

    @property
    def count(self) -> int:
        return self._seen.value[0]

    @property
    def first(self) -> str:
        return self._seen.value[1]


@dataclass(frozen=True)
class Embedder:
    """run gives a vector, or none, for each of some texts; it runs in workers. An
    error is no vector for all of them; Errors, if given, counts them and keeps the
    first message. available tells whether to try at all."""

    name: str
    dims: int
    run: Vectors
    available: Callable[[], bool] = lambda: True
    errors: Errors | None = None

    def embed(self, rows: DataFrame) -> DataFrame:
        """(id, vec) of (id, content); vec is null where there is none."""
        run, errors = self.run, self.errors

        def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for at in range(0, len(part), 256):
                    some = part.iloc[at : at + 256]
                    try:
                        vecs = [None if v is None else [float(x) for x in v] for v in run([t or "" for t in some["content"]])]
                    except Exception as e:  # noqa: BLE001 - a failing model is like an absent one
                        vecs = [None] * len(some)
                        if errors is not None:
                            errors.add(e)
                    yield pd.DataFrame({"id": some["id"], "vec": pd.Series(vecs, index=some.index, dtype=object)})

        return rows.select("id", "content").mapInPandas(batches, f"id {dict(rows.dtypes)['id']}, vec array<float>")

    def one(self, text: str) -> list[float] | None:
        try:
            v = self.run([text])[0]
        except Exception as e:  # noqa: BLE001
            if self.errors is not None:
                self.errors.add(e)
            return None
        return None if v is None else [float(x) for x in v]


def hashing_embedder(dims: int = 64) -> Embedder:
    """Signed counts of hashed words, normalised: needs no model."""

    def run(texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(dims)
            for w in t.lower().split():
                h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
                v[h % dims] += 1 if h >> 16 & 1 else -1
            n = np.sqrt(v @ v)
            out.append((v / n if n else v).tolist())
        return out

    return Embedder("hashing", dims, run)


@dataclass(frozen=True)
class Chain:
    """Embedders in order of preference; of the same dims, as vectors of one text
    may come from any."""

    embedders: tuple[Embedder, ...]

    @property
    def current(self) -> Embedder | None:
        return next((e for e in self.embedders if e.available()), None)

    def embed(self, rows: DataFrame) -> DataFrame:
        """(id, vec): of each row the first embedder's vector that there is. Rows go
        on to the next embedder only where the ones before gave none."""
        out = None
        for e in self.embedders:
            if not e.available():
                continue
            if out is None:
                out = e.embed(rows)
                continue
            left = rows.join(out.filter("vec is null").select("id"), "id", "left_semi")
            more = e.embed(left).select("id", F.col("vec").alias("_next"))
            out = out.join(more, "id", "left").select("id", F.coalesce("vec", "_next").alias("vec"))
        return out if out is not None else rows.select("id", F.lit(None).cast("array<float>").alias("vec"))

    def one(self, text: str) -> list[float] | None:
        for e in self.embedders:
            if e.available() and (v := e.one(text)) is not None:
                return v
        return None


def mean_pool(vectors: Column, mask: Column) -> Column:
    """The mean of the vectors whose mask isn't 0, normalised; zeros of none."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] != 0), lambda x: x["v"].cast("array<double>"))
    zero = F.transform(F.get(vectors, F.lit(0)), lambda _: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return normalise(F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1))))


@dataclass(frozen=True)
class Reranker:
    """score gives a number for each of a query's candidate texts."""

    name: str
    score: Callable[[str, Sequence[str]], Sequence[float]]
    available: Callable[[], bool] = lambda: True


#: Leaves the order as it is.
NOOP = Reranker("noop", lambda query, texts: [1.0] * len(texts))


def chosen(rerankers: Sequence[Reranker]) -> Reranker:
    """The first that is available."""
    return next((r for r in rerankers if r.available()), NOOP)


#: (messages as (role, content), focus) -> summary; an error takes the plain text.
Summariser = Callable[[Sequence[tuple[str, str]], str], str]
