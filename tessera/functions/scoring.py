"""Scores: vectors, rank fusion, boosts. All are built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.sqrt(_sum(F.zip_with(F.slice(_double(a), F.lit(1), n), F.slice(_double(b), F.lit(1), n), lambda x, y: (x - y) * (x - y))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for unlike or no lengths and for vanishing norms."""
    dot = _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y))
    norm = lambda v: F.sqrt(_sum(F.transform(_double(v), lambda x: x * x)))
    product = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (product >= 1e-9), dot / product).otherwise(0.0)


def normalise(v: Column) -> Column:
    norm = F.sqrt(_sum(F.transform(_double(v), lambda x: x * x)))
    return F.when(norm > 0, F.transform(_double(v), lambda x: x / norm)).otherwise(_double(v))


def closeness(distance: Column) -> Column:
    return 1 / (1 + distance)


def rrf(rank: Column, k: int = 60) -> Column:
    """1 / (k + rank), nothing for a missing rank."""
    return F.coalesce(1 / (F.lit(float(k if k > 0 else 60)) + rank), F.lit(0.0))


def _of_type(mem_type: Column, which: int) -> Column:
    out = F.lit(float(C.OTHER[which]))
    for name, values in C.TYPES.items():
        out = F.when(mem_type == name, float(values[which])).otherwise(out)
    return out


def boosts(now: Column, recency: float = 0.05, importance: float = 0.1) -> dict[str, Column]:
    """temporal, importance and other boosts of a memory's row."""
    age = F.greatest(F.lit(0.0), F.timestamp_diff("SECOND", F.col("created_at"), now) / 3600.0)
    return {
        "temporal_boost": F.lit(recency) * F.exp(-age / _of_type(F.col("mem_type"), 1)),
        "importance_boost": F.lit(importance) * _of_type(F.col("mem_type"), 0) * F.least(F.col("access_count") / 10.0, F.lit(1.0)),
        "other_boost": F.col("pinned").cast("double") * 0.1 + 0.03 * F.log1p(F.col("edge_count").cast("double")),
    }
