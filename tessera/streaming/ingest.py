"""Streams of memories into a versioned store, each batch once.

A batch is one change of all tables, marked with its number: run again, after a
failure or a restart of the query, it finds its mark and changes nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import graph as G
from ..sources.catalog import submitted
from ..sources.tables import written
from ..sources.versions import Change, Versions

MEMORIES, MEMBERS, PAIRS, EDGES = "memories", "membership", "pairs", "edges"
PAIR = ["source_id", "target_id"]
#: Memberships whose pairs are one task's, on average.
DEALT = 250_000


def marked(change: Change, stream: str, batch: int) -> bool:
    """Whether a batch of a stream is in the version that change begins at."""
    return change.manifest.marks.get(f"stream {stream}", -1) >= batch


def count_pairs(change: Change, members: DataFrame, least: int = 2) -> None:
    """Add memberships (memory_id, entity_id) to a change, and what follows: counts
    of pairs that now share more memories go up, and those that reach `least` become
    or update related_to edges. Only pairs of the memories that came in are read and
    written; memberships that exist already count nothing."""
    new = members.select("memory_id", "entity_id").distinct()
    if change.has(MEMBERS):
        new = new.join(change.read(MEMBERS), ["memory_id", "entity_id"], "left_anti")
    new = written(new, "new_members")
    if not new.take(1):
        return
    touched = new.select("memory_id").distinct()
    if change.has(MEMBERS):
        old = written(change.read(MEMBERS).join(touched, "memory_id", "left_semi"), "old_members")
        # A memory that was there has pairs counted already: those of its old members.
        before = G.pair_counts(old).withColumn("count", -F.col("count"))
        every = G.pair_counts(old.unionByName(new)).unionByName(before)
    else:
        every = G.pair_counts(new)
    # Explicitly many tasks: a few MB of narrow rows, shuffled, are many pairs to sort and join.
    tasks = max(1, math.ceil((new.count() + (old.count() if change.has(MEMBERS) else 0)) / DEALT))
    delta = every.repartition(tasks, *PAIR).groupBy(*PAIR).agg(F.sum("count").alias("count")).filter("count <> 0")
    if change.has(PAIRS):
        known = change.read(PAIRS).withColumnRenamed("count", "_old")
        delta = delta.join(known, PAIR, "left").select(*PAIR, (F.col("count") + F.coalesce("_old", F.lit(0))).alias("count"))
    delta = written(delta, "pairs")
    change.append(MEMBERS, new, ["memory_id", "entity_id"])
    change.upsert(PAIRS, delta, PAIR)
    change.upsert(EDGES, G.related_edges(delta, least), [*PAIR, "rel_type"])


def pairs_of(versions: Versions, rows: DataFrame, stream: str, checkpoint: str, **options) -> StreamingQuery:
    """Start a stream of memberships (memory_id, entity_id) into versions: counts of
    pairs and related edges are kept up with every batch."""

    def batch(members: DataFrame, number: int) -> None:
        with versions.change() as c:
            if not marked(c, stream, number):
                count_pairs(c, members)
                c.mark(f"stream {stream}", number)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).options(**options).trigger(availableNow=True).start()


def memories_of(versions: Versions, rows: DataFrame, stream: str, checkpoint: str, now: str, gate: bool = True) -> StreamingQuery:
    """Start a stream of rows (content, namespace, type) into versions: those that are
    stored become memories, each once, with the entities named in them; pairs of
    entities are counted as they come."""

    def batch(given: DataFrame, number: int) -> None:
        with versions.change() as c:
            if marked(c, stream, number):
                return
            new = submitted(given, now, gate).filter("status = 'stored'").drop("status", "reason").dropDuplicates(["id"])
            if c.has(MEMORIES):
                new = new.join(c.read(MEMORIES).select("id"), "id", "left_anti")
            new = written(new, "streamed")
            c.append(MEMORIES, new, ["id"])
            # An entity is known by its name: no numbers are handed out.
            count_pairs(c, G.extracted(new).select("memory_id", F.xxhash64("name_key").alias("entity_id")))
            c.mark(f"stream {stream}", number)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
