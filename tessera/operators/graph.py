"""The entity graph: build, traverse, shortest path, look-ups."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.tables import ranked, written

#: Entities of one memory that are paired in one task; a larger memory's are
#: parted into blocks of that many.
BLOCK = 512


#: Steps of a folder of the adjacency, on average.
FOLDER = 2_000_000


@dataclass(frozen=True)
class Steps:
    """An adjacency (src, dst, ...) in folders by a hash of src, written once."""

    rows: DataFrame
    folders: int

    def of(self, front: DataFrame, column: str = "entity_id") -> DataFrame:
        """The steps out of a frontier's folders; the others aren't listed or read.
        What the driver gets is the numbers of folders."""
        if self.folders == 1:
            return self.rows
        wanted = [r[0] for r in front.select(_folder(F.col(column), self.folders)).distinct().collect()]
        return self.rows.filter(F.col("folder").isin(sorted(wanted)))


@dataclass(frozen=True)
class SharedSteps:
    """The steps between entities that share `least` memories or more, as both_ways
    of related_edges has them, counted for a frontier alone: pairs are made in its
    memories, so what a walk costs besides two scans a hop follows its frontiers."""

    membership: DataFrame
    least: int = 2

    def of(self, front: DataFrame, column: str = "entity_id") -> DataFrame:
        member = self.membership.select("memory_id", "entity_id")
        begun = member.join(front.select(F.col(column).alias("entity_id")).distinct(), "entity_id", "left_semi").distinct()
        begun = written(begun.select("memory_id", F.col("entity_id").alias("src")), "begun")
        met = member.join(begun.select("memory_id").distinct(), "memory_id", "left_semi").distinct()
        met = written(met.select("memory_id", F.col("entity_id").alias("dst")), "shared")
        # As in pair_counts, a large memory's pairs are made in blocks.
        large = met.groupBy("memory_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks")).filter("_blocks > 1")
        parted = lambda rows: rows.join(large, "memory_id", "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
        a = parted(begun).select("memory_id", "src", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"))
        b = parted(met).select("memory_id", "dst", F.pmod(F.xxhash64("dst"), F.col("_blocks")).cast("int").alias("_block"))
        pairs = a.join(b, ["memory_id", "_block"]).filter("src <> dst")
        return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= self.least).select("src", "dst")


def _folder(node: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(folders)).cast("int").alias("folder")


@dataclass
class Graph:
    """nodes (entity_id, name, category, access_count), membership (memory_id,
    entity_id, weight), edges (source_id, target_id, rel_type, weight), pairs
    (source_id, target_id, count)."""

    nodes: DataFrame
    membership: DataFrame
    edges: DataFrame
    pairs: DataFrame | None = None
    _steps: Steps | None = field(default=None, repr=False)

    def steps(self) -> Steps:
        """The edges in either direction, written once for all walks."""
        if self._steps is None:
            self._steps = adjacency(self.edges)
        return self._steps


def empty_graph(spark) -> Graph:
    frame = lambda kind: spark.createDataFrame([], kind)
    return Graph(
        frame("entity_id long, name string, category string, access_count long"), frame("memory_id string, entity_id long, weight double"),
        frame("source_id long, target_id long, rel_type string, weight double"), frame("source_id long, target_id long, count long"),
    )


def pair_counts(membership: DataFrame) -> DataFrame:
    """(source_id, target_id, count): memories that two entities share. A memory's
    entities are paired within its row; those of a memory that has more than a BLOCK,
    as a count before tells, meet in blocks, so that it is no single task's."""
    member = membership.select("memory_id", "entity_id")
    large = written(member.groupBy("memory_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks")).filter("_blocks > 1"), "large")
    some = bool(large.take(1))
    small = member.join(large, "memory_id", "left_anti") if some else member
    own = small.groupBy("memory_id").agg(F.array_sort(F.collect_set("entity_id")).alias("_e")).filter(F.size("_e") > 1)
    first = own.select("_e", F.posexplode("_e").alias("_at", "source_id"))
    pairs = first.select("source_id", F.explode(F.slice("_e", F.col("_at") + 2, F.size("_e"))).alias("target_id"))
    if some:
        rows = member.join(large, "memory_id").distinct()
        a = rows.select("memory_id", F.col("entity_id").alias("source_id"), F.pmod(F.xxhash64("entity_id"), F.col("_blocks")).cast("int").alias("_block"))
        b = rows.select("memory_id", F.col("entity_id").alias("target_id"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"))
        pairs = pairs.unionByName(a.join(b, ["memory_id", "_block"]).filter("source_id < target_id").select("source_id", "target_id"))
    return pairs.groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("count"))


def related_edges(pairs: DataFrame, least: int = 2) -> DataFrame:
    return pairs.filter(F.col("count") >= least).select("source_id", "target_id", F.lit("related_to").alias("rel_type"), F.col("count").cast("double").alias("weight"))


def rebuilt(graph: Graph) -> tuple[Graph, DataFrame]:
    """graph with pair counts and related_to edges from its membership, typed ones
    kept, and a row of counters: memories scanned, pairs counted (all occurrences),
    edges updated, edges pruned (related_to before), nodes, edges, average degree."""
    pairs = written(pair_counts(graph.membership), "pairs")
    typed = graph.edges.filter("rel_type <> 'related_to'")
    out = replace(graph, edges=typed.unionByName(related_edges(pairs)), pairs=pairs, _steps=None)
    counters = (
        graph.membership.agg(F.countDistinct("memory_id").alias("memories_scanned"))
        .crossJoin(pairs.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("pairs_counted"), F.count_if(F.col("count") >= 2).alias("edges_updated")))
        .crossJoin(graph.edges.agg(F.count_if(F.col("rel_type") == "related_to").alias("edges_pruned"), F.count_if(F.col("rel_type") != "related_to").alias("_typed")))
        .crossJoin(graph.nodes.agg(F.count(F.lit(1)).alias("nodes_total")))  # one row each
        .withColumn("edges_total", F.col("edges_updated") + F.col("_typed")).drop("_typed")
    )
    return out, counters.withColumn("avg_degree", F.when(F.col("nodes_total") > 0, F.round(2.0 * F.col("edges_total") / F.col("nodes_total"), 6)).otherwise(0.0))


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges in either direction, so a hop is one equality join."""
    return edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).unionByName(edges.select(F.col("target_id").alias("src"), F.col("source_id").alias("dst"))).distinct()


def adjacency(edges: DataFrame, folder: int = FOLDER) -> Steps:
    """both_ways as a table in folders of about so many steps."""
    return stepped(both_ways(edges), folder)


def stepped(steps: DataFrame, folder: int = FOLDER) -> Steps:
    """steps (src, dst, ...) as an adjacency in folders; one of very many steps from
    one node is several tasks'."""
    folders = max(1, math.ceil(steps.count() / folder))
    rows = steps.withColumn("folder", _folder(F.col("src"), folders)).repartition("folder", F.pmod(F.xxhash64("dst"), F.lit(4))).sortWithinPartitions("folder", "src")
    return Steps(written(rows, "steps", "folder"), folders)


def hops(seeds: DataFrame, steps: Steps | SharedSteps, depth: int) -> DataFrame:
    """(entity_id, hop) of entities within depth of seeds, at their least hop, over
    an adjacency. A hop reads the folders of its frontier, or counts its steps."""
    seen = seeds.select("entity_id").distinct().withColumn("hop", F.lit(0))
    front = seen = written(seen, "hops")
    for hop in range(1, depth + 1):
        own = steps.of(front)
        front = front.join(own, front["entity_id"] == own["src"]).select(F.col("dst").alias("entity_id")).distinct().join(seen.select("entity_id"), "entity_id", "left_anti").withColumn("hop", F.lit(hop))
        front = written(front, "hops")
        seen = seen.unionByName(front)
    return seen


def traverse(seeds: DataFrame, edges: DataFrame | None, membership: DataFrame, depth: int = 2, limit: int | None = 10, nodes: DataFrame | None = None, steps: Steps | SharedSteps | None = None) -> DataFrame:
    """(memory_id, score, path_length): each entity reached gives its memories
    weight * 0.5^hop / (hop + 1). With nodes also entity, the name of the entity,
    first of equals, over which the memory is nearest. Where steps are given, edges
    aren't read."""
    found = hops(seeds, steps if steps is not None else adjacency(edges), depth)
    reached = found.join(nodes.select("entity_id", "name"), "entity_id") if nodes is not None else found
    # Ahead of a membership's own distinct, so that only the rows reached are dealt out.
    membership = membership.join(found.select("entity_id"), "entity_id", "left_semi")
    share = F.col("weight") * F.pow(F.lit(0.5), F.col("hop")) / (F.col("hop") + 1)
    by = [F.min_by("name", F.struct("hop", "name")).alias("entity")] if nodes is not None else []
    out = membership.join(reached, "entity_id").groupBy("memory_id").agg(F.round(F.sum(share), 6).alias("score"), F.min("hop").alias("path_length"), *by)
    return out.orderBy(F.desc("score"), "memory_id").limit(limit) if limit else out


def seeds_by_name(nodes: DataFrame, names: list[str]) -> DataFrame:
    return nodes.filter(F.lower("name").isin([n.lower() for n in names])).select("entity_id")


def seeds_in_text(nodes: DataFrame, query: str, n: int = 3) -> DataFrame:
    """Entities whose name, of three bytes at least, is in the query's text."""
    hit = F.lit(query.lower()).contains(F.lower("name")) & (F.octet_length("name") >= 3)
    return nodes.filter(hit).orderBy(F.desc("access_count"), "entity_id").limit(n).select("entity_id")


#: Bits of the table that tells which beginnings names have.
BITS = 20
#: Lengths of the beginnings that names are looked up by, in bytes.
BEGINNINGS = (8, 4, 3)


def _spread(values: np.ndarray) -> np.ndarray:
    """Places in the table of bits, for beginnings as numbers."""
    return (values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)


def _begins(raw: np.ndarray, size: int) -> np.ndarray:
    """For each place of some bytes the next `size` of them as a number."""
    n = max(0, len(raw) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out |= raw[i : i + n].astype(np.uint64) << np.uint64(8 * i)
    return out


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(size, begin) of names (name)."""
    for batch in batches:
        sizes, begins = [], []
        for name in batch.column(0).cast(pa.binary()).to_pylist():
            size = next(s for s in BEGINNINGS if len(name) >= s)
            sizes.append(size)
            begins.append(int.from_bytes(name[:size], "little", signed=False) - (1 << 64) * (size == 8 and name[7] > 127))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(begins, pa.int64())], names=["name", "size", "begin"])


def _found_beginnings(bits: np.ndarray, sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1).cast(pa.large_string()).cast(pa.large_binary()), strict=True):
                raw = np.frombuffer(text.as_py() or b"", np.uint8)
                for size in sizes:
                    own = np.concatenate([np.unique(part[bits[_spread(part)]]) for at in range(0, len(raw), 1 << 20) if len(part := _begins(raw[at : at + (1 << 20) + size - 1], size))] or [np.zeros(0, np.uint64)])
                    own = np.unique(own).view(np.int64)
                    if len(own):
                        yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(own), batch.column(0).type), pa.array([size] * len(own), pa.int32()), pa.array(own)], names=["id", "size", "begin"])

    return run


def names_in_texts(names: DataFrame, texts: DataFrame, least: int = 3) -> DataFrame:
    """(id, entity_id): the names (entity_id, name), of so many bytes at least (3 or
    more), that stand anywhere in texts (id, text), without regard to case.

    A name is known by its first eight bytes, or four or three. A small table of bits
    tells a text's places at which some name may begin; what stands there meets the
    names in a join, and the few pairs left are verified in the text. So neither the
    number of names nor that of texts is bounded, and no name is tried on a text that
    hasn't its beginning. Texts with ids of their own, each once.
    """
    spark = texts.sparkSession
    kind = texts.schema["id"].dataType.simpleString()
    low = names.select("entity_id", F.lower("name").alias("name")).filter(F.octet_length("name") >= max(3, least)).distinct()
    keyed = written(low.select("name").distinct().mapInArrow(_beginnings, "name string, size int, begin long"), "beginnings")
    told = keyed.select("size", "begin").distinct()
    spread = told.mapInArrow(_bits_of, "size int, bit int").distinct().collect()  # at most 3 * 2^BITS
    if not spread:
        return spark.createDataFrame([], f"id {kind}, entity_id {names.schema['entity_id'].dataType.simpleString()}")
    bits = np.zeros(1 << BITS, bool)
    bits[[r["bit"] for r in spread]] = True
    rows = texts.select("id", F.lower("text").alias("text"))
    met = rows.mapInArrow(_found_beginnings(bits, sorted({r["size"] for r in spread})), f"id {kind}, size int, begin long")
    pairs = met.join(keyed, ["size", "begin"]).select("id", "name")
    held = pairs.join(rows, "id").filter(F.contains("text", "name")).select("id", "name")
    return held.join(low, "name").select("id", "entity_id").distinct()


def _bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = _spread(batch["begin"].to_numpy().view(np.uint64)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch["size"], pa.array(bits)], names=["size", "bit"])


def seeds_in_texts(nodes: DataFrame, texts: DataFrame, n: int = 3) -> DataFrame:
    """(id, entity_id): for each of many texts what seeds_in_text finds."""
    met = names_in_texts(nodes, texts).join(nodes.select("entity_id", "access_count"), "entity_id")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("access_count"), "entity_id"))
    return met.withColumn("_n", rank).filter(F.col("_n") <= n).select("id", "entity_id")


def shortest_paths(pairs: DataFrame, steps: Steps, depth: int = 4) -> DataFrame:
    """(source, target, hop, `from`, `to`): for each pair (source, target) the
    shortest path of at most depth steps, of several the one whose nodes come first
    in order; no rows where there is none, or where both are the same.

    The search goes on from that end of all pairs whose frontier is smaller, and keeps
    for each node found the distance alone: levels are tables of (pair, node). When
    ends meet, the steps between levels are read once more, from the meeting nodes
    outwards, and a path is chosen step by step.
    """
    asked = written(pairs.select("source", "target").distinct().filter("source <> target").withColumn("pair", F.xxhash64("source", "target")), "asked")
    sides = {s: [written(asked.select("pair", F.col(s).alias("node")), s)] for s in ("source", "target")}
    left, met = asked.select("pair"), None
    while len(sides["source"]) + len(sides["target"]) - 2 < depth:
        sizes = {s: sides[s][-1].join(left, "pair", "left_semi").count() for s in sides}
        if not all(sizes.values()):
            break
        side = min(sizes, key=sizes.get)
        other = "target" if side == "source" else "source"
        front = written(sides[side][-1].join(left, "pair", "left_semi"), "front")
        own = steps.of(front, "node")
        reached = front.join(own, front["node"] == own["src"]).select("pair", F.col("dst").alias("node")).distinct()
        for level in sides[side]:
            reached = reached.join(level, ["pair", "node"], "left_anti")
        sides[side].append(written(reached, side))
        # Levels of the other end overlap in its last one first.
        hit = sides[side][-1].join(sides[other][-1], ["pair", "node"], "left_semi").select("pair", "node", F.lit(len(sides["source"]) - 1).alias("a"), F.lit(len(sides["target"]) - 1).alias("b"))
        met = written(hit if met is None else met.unionByName(hit), "met")
        left = written(left.join(met.select("pair").distinct(), "pair", "left_anti"), "left")
    if met is None:
        return asked.select("source", "target", F.lit(0).alias("hop"), F.col("source").alias("from"), F.col("target").alias("to")).limit(0)

    def links(side: str) -> list[DataFrame]:
        """Per level, nearest the meeting nodes first, the steps (pair, far, near, n)
        of shortest paths: n is how far from `side` the step's outer end is."""
        out, own = [], "a" if side == "source" else "b"
        here = None
        for n in range(len(sides[side]) - 1, 0, -1):
            begun = met.filter(F.col(own) == n).select("pair", "node")
            here = begun if here is None else here.unionByName(begun).distinct()
            here = written(here, "here")
            near = steps.of(here, "node")
            back = here.join(near, here["node"] == near["src"]).select("pair", F.col("dst").alias("node"), F.col("src").alias("inner")).join(sides[side][n - 1], ["pair", "node"], "left_semi")
            back = written(back, "links")
            out.append(back.select("pair", F.lit(n - 1).alias("n"), F.col("node").alias("outer"), "inner"))
            here = back.select("pair", "node").distinct()
        return out

    ways = met.groupBy("pair").agg((F.first("a") + F.first("b")).alias("length"))
    parts = [x.select("pair", F.col("n").alias("hop"), F.col("outer").alias("from"), F.col("inner").alias("to")) for x in links("source")]
    parts += [x.join(ways, "pair").select("pair", (F.col("length") - 1 - F.col("n")).alias("hop"), F.col("inner").alias("from"), F.col("outer").alias("to")) for x in links("target")]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = written(every.distinct(), "ways")
    at, out = asked.join(met.select("pair").distinct(), "pair", "left_semi").select("pair", F.col("source").alias("from")), None
    for hop in range(depth):
        step = every.filter(F.col("hop") == hop).join(at, ["pair", "from"]).groupBy("pair", "from").agg(F.min("to").alias("to")).withColumn("hop", F.lit(hop + 1))
        step = written(step, "step")
        out = step if out is None else out.unionByName(step)
        at = step.select("pair", F.col("to").alias("from"))
    return out.join(asked, "pair").select("source", "target", "hop", "from", "to")


def find_path(nodes: DataFrame, edges: DataFrame, source: str, target: str, depth: int = 4) -> DataFrame:
    """(hop, from, to, rel_type, weight) of a shortest path, in walking order;
    no rows where a name is unknown, both are the same or the path is longer.
    Each node found keeps the edge of least id that led to it."""
    ends = {r["key"]: r["entity_id"] for r in nodes.withColumn("key", F.lower("name")).filter(F.col("key").isin(source.lower(), target.lower())).select("key", "entity_id").collect()}
    spark = nodes.sparkSession
    empty = spark.createDataFrame([], "hop int, `from` string, `to` string, rel_type string, weight double")
    a, b = ends.get(source.lower()), ends.get(target.lower())
    if a is None or b is None or a == b:
        return empty
    walk = F.struct("src", "dst", "rel_type", "weight")
    steps = written(edges.selectExpr("id", "source_id src", "target_id dst", "rel_type", "weight").unionByName(edges.selectExpr("id", "target_id src", "source_id dst", "rel_type", "weight")))
    front = spark.range(1).select(F.lit(a).cast("long").alias("node"), F.array().cast("array<struct<src:bigint,dst:bigint,rel_type:string,weight:double>>").alias("path"))
    seen = front.select("node")
    for _ in range(depth):
        met = front.join(steps, front["node"] == steps["src"]).select(F.col("dst").alias("node"), "id", F.concat("path", F.array(walk)).alias("path"))
        first = met.groupBy("node").agg(F.min_by("path", "id").alias("path"))
        front = written(first.join(seen, "node", "left_anti"))
        seen = written(seen.unionByName(front.select("node")))
        done = front.filter(F.col("node") == b)
        if done.take(1):
            name = lambda c, n: nodes.select(F.col("entity_id").alias(c), F.col("name").alias(n))
            rows = done.select(F.posexplode("path").alias("hop", "e")).select((F.col("hop") + 1).alias("hop"), "e.*")
            return rows.join(name("src", "from"), "src").join(name("dst", "to"), "dst").select("hop", "from", "to", "rel_type", "weight")
    return empty


def related_memories(membership: DataFrame, memory_id: object, limit: int = 10, nodes: DataFrame | None = None) -> DataFrame:
    """(memory_id, shared, score) of memories that share entities with one; with
    nodes also entity, the first by name of those shared."""
    own = membership.filter(F.col("memory_id") == memory_id).select("entity_id")
    met = membership.filter(F.col("memory_id") != memory_id).join(own, "entity_id", "left_semi")
    by = []
    if nodes is not None:
        met, by = met.join(nodes.select("entity_id", "name"), "entity_id"), [F.min("name").alias("entity")]
    out = met.groupBy("memory_id").agg(F.count(F.lit(1)).alias("shared"), *by).withColumn("score", F.round(0.1 * F.col("shared"), 6))
    return out.orderBy(F.desc("shared"), "memory_id").limit(limit)


def list_entities(nodes: DataFrame, name: str = "", category: str = "", limit: int = 50) -> DataFrame:
    rows = nodes.filter(F.col("name").ilike(f"%{name}%")) if name else nodes
    rows = rows.filter(F.col("category") == category) if category else rows
    return rows.orderBy(F.desc("access_count"), "entity_id").limit(limit)


def memories_by_entity(membership: DataFrame, nodes: DataFrame, name: str, limit: int = 10) -> DataFrame:
    hit = nodes.filter(F.col("name").ilike(f"%{name}%")).select("entity_id")
    return membership.join(hit, "entity_id", "left_semi").select("memory_id", "weight").distinct().orderBy(F.desc("weight"), "memory_id").limit(limit)


def entities_for_memory(membership: DataFrame, nodes: DataFrame, memory_id: object) -> DataFrame:
    return membership.filter(F.col("memory_id") == memory_id).join(nodes, "entity_id").select("entity_id", "name", "category").orderBy("name")


def _key(name: Column) -> Column:
    """Names are one entity without regard to the case of ASCII letters."""
    return F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def named(memories: DataFrame) -> DataFrame:
    """(memory_id, place, name, category, name_key): the names in each memory, in
    order: technologies, people, URLs cut to 64 bytes; blank ones are left out."""

    def all_of(t: Column) -> Column:
        of = lambda names, category: F.transform(names, lambda n: F.struct(F.trim(n).alias("name"), F.lit(category).alias("category")))
        cut = lambda e: F.transform(e["urls"], lambda n: X.first_bytes(n, 64))
        return X.let(X.entities(t, ("urls", "people", "tech")), lambda e: F.concat(of(F.concat(e["tech"], X.tech(t)), "tech"), of(e["people"], "person"), of(cut(e), "url")))

    rows = memories.select(F.col("id").alias("memory_id"), F.posexplode(all_of(F.col("content"))).alias("place", "e"))
    return rows.select("memory_id", "place", "e.name", "e.category", _key(F.col("e.name")).alias("name_key")).filter("name <> ''")


def extracted(memories: DataFrame) -> DataFrame:
    """(memory_id, name_key, name, category): each memory's names, once each."""
    first = lambda c: F.min_by(c, "place").alias(c)
    return named(memories).groupBy("memory_id", "name_key").agg(first("name"), first("category"))


def relations(memories: DataFrame) -> DataFrame:
    """(memory_id, place, rel_type, source, target, both categories) of each typed
    relation in a text; none from a name to itself."""
    return memories.select(F.col("id").alias("memory_id"), F.posexplode(X.relations(F.col("content"))).alias("place", "r")).select("memory_id", "place", "r.*")


def typed_edges(memories: DataFrame) -> DataFrame:
    """(source, target, rel_type, weight): typed relations, summed over texts."""
    rows = memories.select(F.explode(X.relations(F.col("content"))).alias("r")).select("r.*")
    return rows.groupBy(F.lower("source").alias("source"), F.lower("target").alias("target"), "rel_type").agg(F.count(F.lit(1)).alias("weight"))


def upserted(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """nodes (name, category, access_count) after names (name, category) came in:
    known ones count up, new ones follow."""
    new = names.groupBy(_key(F.col("name")).alias("_k")).agg(F.min("name").alias("_name"), F.min("category").alias("_category"), F.count(F.lit(1)).alias("_n"))
    both = nodes.withColumn("_k", _key(F.col("name"))).join(new, "_k", "full_outer")
    count = F.when(F.col("name").isNull(), F.col("_n") - 1).otherwise(F.col("access_count") + F.coalesce("_n", F.lit(0)))
    return both.select(F.coalesce("name", "_name").alias("name"), F.coalesce("category", "_category").alias("category"), count.alias("access_count"))


def _with_new(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """nodes and new ones (name_key, name, category, access_count), whose ids go on
    behind the largest, in the order of name_key."""
    last = nodes.agg(F.coalesce(F.max("entity_id"), F.lit(0)).cast("long").alias("_last"))
    numbered = ranked(new, [F.col("name_key")], "_n").crossJoin(F.broadcast(last))  # one row
    return nodes.unionByName(numbered.select((F.col("_n") + F.col("_last")).cast("long").alias("entity_id"), "name", "category", "access_count"))


def with_entities(graph: Graph, memories: DataFrame, new_pairs: bool = True) -> tuple[Graph, DataFrame]:
    """graph after the entities of memories came in, and (memory_id, edge_count):
    how many entities each has. Known nodes count up once a name, new ones begin at
    0; memberships that exist stay; with new_pairs, pairs of the memories' entities
    count up, and those of two and more become or update related_to edges."""
    names = written(named(memories), "names")
    first = F.struct("memory_id", "place")
    delta = names.groupBy("name_key").agg(F.min_by("name", first).alias("name"), F.min_by("category", first).alias("category"), F.count(F.lit(1)).alias("_n"))
    old = graph.nodes.withColumn("name_key", _key(F.col("name")))
    counted = old.join(delta.select("name_key", "_n"), "name_key", "left").select("entity_id", "name", "category", (F.col("access_count") + F.coalesce("_n", F.lit(0))).alias("access_count"))
    fresh = delta.join(old.select("name_key"), "name_key", "left_anti").select("name_key", "name", "category", (F.col("_n") - 1).alias("access_count"))
    nodes = written(_with_new(counted, fresh), "nodes")
    ids = nodes.select("entity_id", _key(F.col("name")).alias("name_key"))
    member = written(names.select("memory_id", "name_key").distinct().join(ids, "name_key").select("memory_id", "entity_id"), "member")
    added = member.join(graph.membership.select("memory_id", "entity_id"), ["memory_id", "entity_id"], "left_anti").withColumn("weight", F.lit(1.0))
    edges, pairs = graph.edges, graph.pairs
    if new_pairs:
        now = pair_counts(member)
        both = graph.pairs.unionByName(now) if graph.pairs is not None else now
        pairs = written(both.groupBy("source_id", "target_id").agg(F.sum("count").alias("count")), "pairs")
        strong = related_edges(pairs)
        other = edges.filter("rel_type <> 'related_to'").unionByName(edges.filter("rel_type = 'related_to'").join(strong.select("source_id", "target_id"), ["source_id", "target_id"], "left_anti"))
        edges = other.select("source_id", "target_id", "rel_type", "weight").unionByName(strong)
    counts = member.groupBy("memory_id").agg(F.count(F.lit(1)).alias("edge_count"))
    return replace(graph, nodes=nodes, membership=graph.membership.unionByName(added.select(graph.membership.columns)), edges=edges, pairs=pairs, _steps=None), counts


def with_typed_edges(graph: Graph, memories: DataFrame) -> tuple[Graph, DataFrame]:
    """graph after the typed relations of memories came in, and (memory_id) of
    those that had any. Names without a node get one, of the relation's category;
    an edge's weight goes up by one each time."""
    found = written(relations(memories), "relations")
    ends = found.select("memory_id", (2 * F.col("place")).alias("place"), F.col("source").alias("name"), F.col("source_category").alias("category")).unionByName(
        found.select("memory_id", (2 * F.col("place") + 1).alias("place"), F.col("target").alias("name"), F.col("target_category").alias("category"))
    ).withColumn("name_key", _key(F.col("name")))
    first = F.struct("memory_id", "place")
    fresh = ends.groupBy("name_key").agg(F.min_by("name", first).alias("name"), F.min_by("category", first).alias("category"))
    known = graph.nodes.select(_key(F.col("name")).alias("name_key"))
    nodes = written(_with_new(graph.nodes, fresh.join(known, "name_key", "left_anti").withColumn("access_count", F.lit(0).cast("long"))), "nodes")
    id_of = lambda c: nodes.select(F.col("entity_id").alias(f"{c}_id"), _key(F.col("name")).alias(f"_{c}"))
    met = found.withColumn("_source", _key(F.col("source"))).withColumn("_target", _key(F.col("target"))).join(id_of("source"), "_source").join(id_of("target"), "_target").filter("source_id <> target_id")
    new = met.groupBy("source_id", "target_id", "rel_type").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    edges = graph.edges.select("source_id", "target_id", "rel_type", "weight").unionByName(new).groupBy("source_id", "target_id", "rel_type").agg(F.sum("weight").alias("weight"))
    return replace(graph, nodes=nodes, edges=edges, _steps=None), met.select("memory_id").distinct()


def reextracted(graph: Graph, memories: DataFrame) -> tuple[Graph, DataFrame]:
    """graph after entities and typed relations of all active memories came in
    again, and a row of counters: memories scanned, entities added, edges added
    (memories whose relations were looked for). Memories without a technology, URL
    or person are left out whole. Typed edges are made anew, so a second run
    changes no weight."""
    live = memories.filter("superseded_at is null")
    having = live.join(named(live).select(F.col("memory_id").alias("id")).distinct(), "id", "left_semi")
    cleared = replace(graph, edges=graph.edges.filter("rel_type = 'related_to'"))
    graph, counts = with_entities(cleared, having, new_pairs=False)
    graph, _ = with_typed_edges(graph, having)
    return graph, live.agg(F.count(F.lit(1)).alias("memories_scanned")).crossJoin(counts.agg(F.coalesce(F.sum("edge_count"), F.lit(0)).alias("entities_added"), F.count(F.lit(1)).alias("edges_added")))  # one row each


def graph_stats(graph: Graph, inferred: DataFrame | None = None) -> DataFrame:
    """One row: entity_nodes, entity_edges, entity_entity_edges, typed_edges and,
    of inferred (a row a text: matched), infer_total, infer_matched and
    infer_miss_rate, 0 of no texts."""
    out = graph.nodes.agg(F.count(F.lit(1)).alias("entity_nodes")).crossJoin(graph.membership.agg(F.count(F.lit(1)).alias("entity_edges")))
    out = out.crossJoin(graph.edges.agg(F.count(F.lit(1)).alias("entity_entity_edges"), F.count_if(F.col("rel_type") != "related_to").alias("typed_edges")))
    if inferred is None:
        return out.selectExpr("*", "0L AS infer_total", "0L AS infer_matched", "0D AS infer_miss_rate")
    seen = inferred.agg(F.count(F.lit(1)).alias("infer_total"), F.count_if("matched").alias("infer_matched"))  # one row each
    return out.crossJoin(seen).withColumn("infer_miss_rate", F.when(F.col("infer_total") > 0, F.round(1 - F.col("infer_matched") / F.col("infer_total"), 6)).otherwise(0.0))
