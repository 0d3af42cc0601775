"""Connected components of a link table, by large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _contracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each batch of links as stars around its own smallest nodes."""
    for batch in batches:
        up: dict[int, int] = {}

        def root(x: int, up: dict[int, int] = up) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        out = [(x, root(x)) for x in list(up)]
        yield pd.DataFrame([x for x in out if x[0] != x[1]], columns=["a", "b"]).astype("int64")


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One round. A node's minimum is an aggregate that combines before the
    shuffle; its links then meet it in a join that can split a hot node."""
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    near = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else down
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = near.join(least, "u")
    if large:
        out = met.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def roots(links: DataFrame, contract: bool = True) -> DataFrame:
    """node, root for each node in links (a long, b long): root is the smallest
    node that it reaches. A node that is its own root has no row. contract joins
    links inside Arrow batches first (with False all is DataFrame operations).

    Each round ends in a table in the shared folder; rounds go on until a round
    changes nothing, about the logarithm of the longest path.
    """
    if contract:
        links = links.mapInPandas(_contracted, "a long, b long")
    now, seen = materialize(links.filter("a <> b").distinct(), "links"), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        now = materialize(_star(materialize(_star(now, True), "stars"), False), "links")
    return now.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
