"""Hybrid retrieval: BM25, nearest neighbours, rank fusion, boosts, graph merge."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.match import Node, Phrase, parse, phrases, plain
from ..sources.postings import PART, Index
from ..sources.tables import one_of, ranked, written
from .graph import Graph, seeds_in_text, traverse
from .vectors import CellIndex, knn

K1, B = 1.2, 0.75
DEFAULT_LIMIT = 20


def active(memories: DataFrame, at: Column | None = None, namespace: str | None = None) -> DataFrame:
    """Rows not superseded, now or as of a time; of one namespace if given."""
    keep = F.col("superseded_at").isNull() if at is None else (F.col("created_at") <= at) & (F.col("superseded_at").isNull() | (F.col("superseded_at") > at))
    return memories.filter(keep & (F.col("namespace") == namespace) if namespace else keep)


def _hits(index: Index, wanted: list[Phrase]) -> DataFrame:
    """One row a text that has a term of the phrases: id, dl and, for each phrase,
    pN, the places where it begins. One read of the terms' blocks, one shuffle by
    id, pre-summed."""
    words = list(dict.fromkeys(t for p in wanted for t in (p.terms[:-1] if p.prefix else p.terms)))
    begins = list(dict.fromkeys(p.terms[-1] for p in wanted if p.prefix and p.terms))
    parts = [index.postings(index.blocks(words))] if words else []
    parts += [index.postings(index.blocks(prefix=b)) for b in begins]
    rows = parts[0].select("term", "id", "dl", "at")
    for more in parts[1:]:
        rows = rows.unionByName(more.select("term", "id", "dl", "at"))
    rows = rows.distinct() if len(parts) > 1 else rows
    places = lambda hit: F.array_sort(F.flatten(F.collect_list(F.when(hit, F.col("at")))))
    grouped = rows.groupBy("id").agg(
        F.max("dl").alias("dl"), *(places(F.col("term") == t).alias(f"w{i}") for i, t in enumerate(words)), *(places(F.col("term").startswith(t)).alias(f"b{i}") for i, t in enumerate(begins))
    )

    def start(p: Phrase) -> Column:
        if not p.terms:
            return F.array().cast("array<int>")
        columns = [F.col(f"w{words.index(t)}") for t in (p.terms[:-1] if p.prefix else p.terms)]
        if p.prefix:
            columns.append(F.col(f"b{begins.index(p.terms[-1])}"))

        def follows(x: Column) -> Column:
            out = F.lit(True)
            for n, c in enumerate(columns[1:], 1):
                out = out & F.array_contains(c, x + n)
            return out

        return F.filter(columns[0], follows) if len(columns) > 1 else columns[0]

    return grouped.select("id", "dl", *(start(p).alias(f"p{i}") for i, p in enumerate(wanted)))


def _close(last: Column, size: int, within: int):
    return lambda y: (y <= last) & (last - y - size <= within)


def _holds(node: Node, wanted: list[Phrase]) -> Column:
    """Whether a row of _hits matches the tree."""
    parts = [_holds(x, wanted) for x in node.parts]
    if node.kind == "phrase":
        # A phrase without a word, of marks alone, asks for nothing.
        return F.size(f"p{wanted.index(node.phrase)}") > 0 if node.phrase.terms else F.lit(True)
    if node.kind == "and":
        return parts[0] & parts[1]
    if node.kind == "or":
        return parts[0] | parts[1]
    if node.kind == "not":
        return parts[0] & ~parts[1]
    # near: from the last of the phrases back, each begins close enough.
    each = [(F.col(f"p{wanted.index(x.phrase)}"), len(x.phrase.terms)) for x in node.parts]

    def close(last: Column) -> Column:
        out = F.lit(True)
        for places, size in each:
            out = out & F.exists(places, _close(last, size, node.within))
        return out

    return F.exists(F.concat(*(places for places, _ in each)), close)


def _idf(n: int, df: int) -> float:
    return max(1e-6, math.log((n - df + 0.5) / (df + 0.5)))


def _weight(tf: Column, dl: Column, avgdl: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(avgdl)))


def words_of(query: Node) -> tuple[list[str], str] | None:
    """The terms of a tree that is a chain of "and" or of "or" over single terms,
    each once, and which of both; none for other trees."""
    if query.kind == "phrase":
        return ([query.phrase.terms[0]], "and") if len(query.phrase.terms) == 1 and not query.phrase.prefix else None
    if query.kind not in ("and", "or"):
        return None
    terms: list[str] = []
    for part in query.parts:
        own = words_of(part)
        if own is None or part.kind not in ("phrase", query.kind):
            return None
        terms += [t for t in own[0] if t not in terms]
    return terms, query.kind


@dataclass(frozen=True)
class TopWords:
    """rows: (id, score) of the k best; blocks: how many the terms have; opened: of
    how many the postings were read."""

    rows: list[tuple[str, float]]
    blocks: int
    opened: int


#: The best parts of a query, which are scored first.
FIRST = 4
#: Heads that are weighed on the driver; more are weighed in a join.
HEADS = 200_000


@dataclass(frozen=True)
class _Bounds:
    """df of a query's terms that there are, how many blocks they have, and (seg,
    part, blocks, bound) of the parts that may hold a hit, the best first: as a
    list where that is short by the size of the index, else as a table."""

    df: dict[str, int]
    total: int
    listed: list[tuple] | None
    table: DataFrame | None = None

    KIND = "seg int, part long, blocks long, bound double"

    def first(self, n: int) -> list[tuple]:
        if self.listed is not None:
            return self.listed[:n]
        return [tuple(r) for r in self.table.orderBy(F.desc("bound"), "seg", "part").limit(n).collect()]

    def above(self, least: float) -> tuple[list[tuple] | DataFrame, int]:
        """The parts that may reach a score, and how many blocks they have."""
        if self.listed is not None:
            rows = [r for r in self.listed if r[3] >= least]
            return rows, sum(r[2] for r in rows)
        rows = self.table.filter(F.col("bound") >= least)
        return rows, int(rows.agg(F.sum("blocks")).first()[0] or 0)


def _of_parts(blocks: DataFrame, parts: list[tuple] | DataFrame) -> DataFrame:
    """Blocks of some parts: of a short list by a filter that the scan takes too."""
    if isinstance(parts, list) and len(parts) > 2000:
        parts = blocks.sparkSession.createDataFrame(parts, _Bounds.KIND)
    if not isinstance(parts, list):
        return blocks.join(F.broadcast(parts.select("seg", "part")), ["seg", "part"], "left_semi") if parts.isLocal() else blocks.join(parts.select("seg", "part"), ["seg", "part"], "left_semi")
    by: dict[int, list[int]] = {}
    for r in parts:
        by.setdefault(r[0], []).append(r[1])
    keep = F.lit(False)
    for seg, own in by.items():
        keep = keep | ((F.col("seg") == seg) & one_of("part", own))
    return blocks.filter(keep)


def _bounds(index: Index, terms: list[str], mode: str) -> _Bounds:
    """What each part can score at most, from the heads of the terms' blocks."""
    avgdl = max(index.avgdl, 1e-9)
    heads = index.blocks(terms, positions=False).select("seg", "dead", "term", "part", "n", "most", "least")
    short = len(terms) * sum(s.n // PART + 256 for s in index.segments) <= HEADS
    own = (heads if short else heads.groupBy("term", "dead").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("blocks"))).toPandas()
    df = {t: int(v) for t, v in (own["n"] * np.where(own["dead"].astype(bool), -1, 1)).groupby(own["term"]).sum().items()}
    met = [t for t in terms if t in df]
    idf = {t: _idf(index.n, df[t]) for t in met}
    if not met or mode == "and" and len(met) < len(terms):
        return _Bounds({}, 0, [])
    if short:
        live = own[~own["dead"].astype(bool)]
        at_most = live["term"].map(idf) * live["most"] * (K1 + 1) / (live["most"] + K1 * (1 - B + B * live["least"] / avgdl))
        by = live.assign(bound=at_most).groupby(["seg", "part"], as_index=False).agg(blocks=("term", "size"), bound=("bound", "sum"))
        by = by[by["blocks"] == len(met)] if mode == "and" else by
        rows = [(int(r.seg), int(r.part), int(r.blocks), float(r.bound)) for r in by.sort_values(["bound", "seg", "part"], ascending=[False, True, True]).itertuples()]
        return _Bounds({t: df[t] for t in met}, len(live), rows)
    of = F.create_map(*(F.lit(x) for kv in idf.items() for x in kv))
    table = heads.filter(~F.col("dead")).groupBy("seg", "part").agg(F.count(F.lit(1)).alias("blocks"), F.sum(of[F.col("term")] * _weight(F.col("most"), F.col("least"), avgdl)).alias("bound"))
    table = written(table.filter(F.col("blocks") == len(met)) if mode == "and" else table, "bounds")
    return _Bounds({t: df[t] for t in met}, int(own["blocks"][~own["dead"].astype(bool)].sum()), None, table)


def top_words(index: Index, terms: list[str], k: int, mode: str = "and", among: DataFrame | None = None) -> TopWords:
    """The k best texts by BM25 with all of some terms (or, with mode "or", any),
    of those in among (id), if given.

    What a part's texts can score at most is told by its blocks' heads, which are
    read without their postings. The parts of the highest bounds are scored first;
    their k-th score then rules out all parts below it, and only the postings of
    the others are read. among is asked for texts at the top of the list alone, more
    of them until k are in it.
    """
    avgdl, bounds = max(index.avgdl, 1e-9), _bounds(index, terms, mode)
    df, met = bounds.df, list(bounds.df)
    if not met:
        return TopWords([], bounds.total, 0)
    blocks = index.blocks(met, positions=False)

    def scored(these: list[tuple] | DataFrame) -> DataFrame:
        found = index.postings(_of_parts(blocks, these))
        each = found.groupBy("id").agg(F.max("dl").alias("dl"), *(F.max(F.when(F.col("term") == t, F.col("tf"))).alias(f"t{i}") for i, t in enumerate(met)))
        if mode == "and":
            each = each.dropna(subset=[f"t{i}" for i in range(len(met))])
        score = sum((F.coalesce(F.lit(_idf(index.n, df[t])) * _weight(F.col(f"t{i}"), F.col("dl"), avgdl), F.lit(0.0)) for i, t in enumerate(met)), F.lit(0.0))
        return each.select("id", F.round(score, 6).alias("score"))

    def best(these: list[tuple] | DataFrame, m: int) -> list:
        return [(r["id"], r["score"]) for r in scored(these).orderBy(F.desc("score"), "id").limit(m).collect()]

    known: dict[str, bool] = {}

    def kept(found: list) -> list:
        if among is None:
            return found
        asked = [i for i, _ in found if i not in known]
        if asked:
            live = {r["id"] for r in among.select("id").filter(one_of("id", asked)).collect()}  # of found's ids
            known.update((i, i in live) for i in asked)
        return [x for x in found if known[x[0]]]

    m, first, least = (k if among is None else 4 * k), max(FIRST, -(-2 * k // PART)), float("-inf")
    head = bounds.first(first)
    opened, n = head, sum(r[2] for r in head)
    found = best(opened, m)
    own = kept(found)
    while len(head) == first or len(own) < k and len(found) == m:
        least = max(least, own[k - 1][1]) if len(own) >= k else least
        opened, n = bounds.above(least - 2e-6)  # scores are rounded
        found = best(opened, m)
        own = kept(found)
        if len(own) >= k or len(found) < m:
            break
        m *= 4
    return TopWords(own[:k], bounds.total, n)


#: A list of at most so many is made by top_words.
LISTED = 1000


def bm25(index: Index, query: Node | None, k: int | None = 60, among: DataFrame | None = None) -> DataFrame:
    """(id, score): the k best texts that match a query tree, in order, or all of
    them; of those in among (id), if given. N, average length and the number of texts
    with a phrase take in all texts of the index, superseded ones too. Chains of
    single terms are searched by top_words."""
    wanted = phrases(query) if query else []
    none = index.spark.createDataFrame([], "id string, score double")
    if not any(p.terms for p in wanted) or not index.segments:
        return none
    if k is not None and k <= LISTED and (words := words_of(query)):
        return index.spark.createDataFrame(top_words(index, words[0], k, words[1], among).rows, none.schema)
    hits = _hits(index, wanted)
    df = hits.agg(*(F.count(F.when(F.size(f"p{i}") > 0, 1)).alias(f"df{i}") for i in range(len(wanted))))
    met = hits.filter(_holds(query, wanted)).select("id", "dl", *(F.size(f"p{i}").cast("double").alias(f"tf{i}") for i in range(len(wanted))))
    met = met.join(among.select("id"), "id", "left_semi") if among is not None else met
    met = met.crossJoin(F.broadcast(df))  # one row
    score = F.lit(0.0)
    for i in range(len(wanted)):
        n = F.col(f"df{i}")
        score = score + F.greatest(F.lit(1e-6), F.log((index.n - n + 0.5) / (n + 0.5))) * _weight(F.col(f"tf{i}"), F.col("dl"), index.avgdl)
    rows = met.select("id", F.round(score, 6).alias("score"))
    return rows if k is None else rows.orderBy(F.desc("score"), "id").limit(k)


Vector = list[float] | DataFrame


def _with_query(vectors: DataFrame, query: Vector) -> tuple[DataFrame, Column]:
    """vectors with the query's, as a literal or, of a one-row table (q), joined."""
    if isinstance(query, DataFrame):
        return vectors.crossJoin(F.broadcast(query.select(F.col("q").alias("_q")).limit(1))), F.col("_q")  # one row
    return vectors, F.array(*(F.lit(float(x)) for x in query))


def nearest(vectors: DataFrame, query: Vector, k: int = 60) -> DataFrame:
    """(id, distance): exact k nearest by Euclidean distance; each task keeps k."""
    rows, q = _with_query(vectors, query)
    return rows.select("id", F.round(S.l2(F.col("vec"), q), 6).alias("distance")).orderBy("distance", "id").limit(k)


def most_similar(vectors: DataFrame, query: Vector, k: int = 60) -> DataFrame:
    rows, q = _with_query(vectors, query)
    return rows.select("id", F.round(S.cosine(F.col("vec"), q), 6).alias("cosine")).orderBy(F.desc("cosine"), "id").limit(k)


def with_rank(top: DataFrame, order: list, name: str) -> DataFrame:
    """Ranks of a list already cut to its top k rows: k rows in one task."""
    return top.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def fuse(vector: DataFrame, keyword: DataFrame, k: int = 60) -> DataFrame:
    """(id, vector_rank, keyword_rank, rrf_score) of two lists of top rows."""
    v = with_rank(vector, ["distance", "id"], "vector_rank").select("id", "vector_rank")
    w = with_rank(keyword, [F.desc("score"), "id"], "keyword_rank").select("id", "keyword_rank")
    return v.join(w, "id", "full_outer").withColumn("rrf_score", S.rrf(F.col("vector_rank"), k) + S.rrf(F.col("keyword_rank"), k))


def scored(fused: DataFrame, memories: DataFrame, now: Column) -> DataFrame:
    """Fused rows that exist, with boosts and score. memories meets a list of at
    most two top-k's, which is broadcast."""
    rows = memories.join(F.broadcast(fused), "id")
    b = S.boosts(now)
    out = rows.withColumns({k: v for k, v in b.items()})
    return out.withColumn("score", F.col("rrf_score") + F.col("temporal_boost") + F.col("importance_boost") + F.col("other_boost"))


BOOSTS = ("temporal_boost", "importance_boost", "other_boost")


def merged(results: DataFrame, graph: DataFrame, memories: DataFrame, now: Column) -> DataFrame:
    """id, rrf_score, boosts and score of results with graph's (memory_id, score):
    in both, half as much again; in graph alone, a tenth of its score and the
    boosts. graph is a top list, and is broadcast."""
    both = results.join(F.broadcast(graph.select(F.col("memory_id").alias("id"), F.lit(True).alias("_in"))), "id", "left")
    old = both.withColumn("score", F.when(F.col("_in"), F.col("score") * 1.5).otherwise(F.col("score"))).select("id", "rrf_score", *BOOSTS, "score")
    new = memories.join(F.broadcast(graph.select(F.col("memory_id").alias("id"), F.col("score").alias("_g"))), "id").join(results.select("id"), "id", "left_anti")
    new = new.withColumns(S.boosts(now)).select("id", F.lit(0.0).alias("rrf_score"), *BOOSTS, (0.1 * F.col("_g") + sum(map(F.col, BOOSTS))).alias("score"))
    return old.unionByName(new)


def top(rows: DataFrame, limit: int | None = 20, least: float = 0.0) -> DataFrame:
    """Rows by score, at least `least` of it where that is above 0, with rank; with
    no limit all rows, ranked by ranges of the score."""
    rows = rows.withColumn("score", F.round("score", 6))
    rows = rows.filter(F.col("score") >= least) if least > 0 else rows
    order = [F.desc("score"), F.col("id")]
    return with_rank(rows.orderBy(*order).limit(limit), order, "rank") if limit else ranked(rows, order, "rank")


def _listed(spark: SparkSession, rows: DataFrame, most: int) -> tuple[list, DataFrame]:
    """A list of at most `most` rows, and the same as a table of its own, so that it
    isn't worked out again wherever it is used."""
    found = rows.limit(most).collect()
    return found, spark.createDataFrame([tuple(r) for r in found], rows.schema)


def _near(vectors: DataFrame, vector: Vector, live: DataFrame, depth: int) -> list[tuple[str, float]]:
    """The nearest `depth` of live: of longer and longer lists those that are in it,
    until there are enough, so that vectors meet no other table."""
    m = 4 * depth
    while True:
        found = [(r["id"], r["distance"]) for r in nearest(vectors, vector, m).collect()]
        here = {r["id"] for r in live.select("id").filter(one_of("id", [i for i, _ in found])).collect()} if found else set()  # of found's ids
        own = [x for x in found if x[0] in here]
        if len(own) >= depth or len(found) < m:
            return own[:depth]
        m *= 4
        if m > 64 * depth:  # few are live: those first
            return [(r["id"], r["distance"]) for r in nearest(vectors.join(live.select("id"), "id", "left_semi"), vector, depth).collect()]


ITEM = ("id", "content", "type", "namespace", "created_at", "score", "rrf_score", *BOOSTS[:2], "rank")


def _items(rows: DataFrame, *more: str) -> DataFrame:
    created = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    own = {"type": F.col("mem_type"), "created_at": created, **{c: F.round(c, 6) for c in ("rrf_score", *BOOSTS[:2])}}
    return rows.select(*more, *(own[c].alias(c) if c in own else F.col(c) for c in ITEM))


def recall(
    memories: DataFrame, index: Index, text: str, now: Column, vectors: DataFrame | None = None, vector: Vector | None = None, graph: Graph | None = None,
    namespace: str | None = None, at: Column | None = None, limit: int | None = 20, least: float = 0.0, grammar: bool = False,
) -> DataFrame:
    """id, content, type, namespace, created_at (RFC 3339), score, rrf_score,
    temporal_boost, importance_boost, rank of the memories that a text recalls.

    Keyword and vector lists of max(3 limit, 50) each are fused; without a vector
    the keyword list is alone. Namespace and time (as of `at`) hold for both before
    they are cut. With a graph, memories that its entities named in the text reach
    within two steps are merged in. limit None ranks all that was found at the
    default depth. With grammar, text is a query as parse() has it.

    The lists are short: memories are read once for those on them, by their ids.
    """
    spark, depth = memories.sparkSession, max(3 * (limit or DEFAULT_LIMIT), 50)
    live = active(memories, at, namespace)
    query = parse(text, words=index.terms_of) if grammar else plain(text, words=index.terms_of)
    words = [r["id"] for r in bm25(index, query, depth, live).collect()]  # lists of depth
    near = [i for i, _ in _near(vectors, vector, live, depth)] if vectors is not None and vector is not None else []
    places: dict[str, list] = {i: [n, None] for n, i in enumerate(near, 1)}
    for n, i in enumerate(words, 1):
        places.setdefault(i, [None, None])[1] = n
    ranks = spark.createDataFrame([(i, *p) for i, p in places.items()], "id string, vector_rank int, keyword_rank int")
    fused = ranks.withColumn("rrf_score", S.rrf(F.col("vector_rank")) + S.rrf(F.col("keyword_rank")))
    ids, reached = list(places), None
    if graph is not None:
        seeds = seeds_in_text(graph.nodes, text)
        near, reached = _listed(spark, traverse(seeds, graph.edges, graph.membership, 2, 2 * (limit or DEFAULT_LIMIT), steps=graph.steps()), 2 * (limit or DEFAULT_LIMIT))
        ids += [r["memory_id"] for r in near if r["memory_id"] not in places]
    own = live.filter(one_of("id", ids)) if ids else live.limit(0)
    rows = scored(fused, own, now)
    if reached is None:
        return _items(top(rows, limit, least))
    rows = top(merged(rows, reached, own, now), limit, least).select("id", "score", "rrf_score", *BOOSTS, "rank")
    return _items(own.select("id", "content", "mem_type", "namespace", "created_at").join(F.broadcast(rows), "id"))  # the lists' rows


def keyword_lists(index: Index, queries: DataFrame, k: int, among: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score): the k best texts with all words of each query's text
    (query_id, text). As top_words(), for all queries at once: heads give each
    query's bounds of parts, its best parts its k-th score, which tells what other
    parts it needs. A query without words finds nothing."""
    spark, avgdl = queries.sparkSession, max(index.avgdl, 1e-9)
    kind = queries.schema["query_id"].dataType.simpleString()
    if not index.segments:
        return spark.createDataFrame([], f"query_id {kind}, id string, score double")
    asked = queries.select("query_id", F.explode(index.query_terms(F.coalesce("text", F.lit("")))).alias("term")).distinct()
    asked = written(asked, "asked")
    many = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("many"))
    terms = asked.select("term").distinct()
    blocks = index.blocks(positions=False).join(terms, "term", "left_semi")
    heads = written(blocks.select("seg", "dead", "term", "part", "n", "most", "least"), "heads")
    df = heads.groupBy("term").agg(F.sum(F.when(F.col("dead"), -F.col("n")).otherwise(F.col("n"))).alias("df"))
    idf = F.greatest(F.lit(1e-6), F.log((index.n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    asked = written(asked.join(df.select("term", idf.alias("idf")), "term").join(many, "query_id"), "asked")
    part = heads.filter(~F.col("dead")).join(asked, "term").groupBy("query_id", "many", "seg", "part").agg(
        F.sum(F.col("idf") * _weight(F.col("most"), F.col("least"), avgdl)).alias("bound"), F.count(F.lit(1)).alias("have")
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "seg", "part"))
    first = max(FIRST, -(-2 * k // PART))
    part = written(part.filter("have = many").select("query_id", "seg", "part", "bound", (place <= first).alias("early")), "bounds")

    def scored_in(parts: DataFrame) -> DataFrame:
        wanted = parts.select("query_id", "seg", "part").join(asked, "query_id")
        met = index.blocks(positions=False).filter(~F.col("dead")).join(wanted, ["seg", "part", "term"])
        each = met.select("query_id", "many", "idf", "seg", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p")).select("query_id", "many", "seg", F.col("p.ids").alias("id"), (F.col("idf") * _weight(F.col("p.tfs"), F.col("p.dls"), avgdl)).alias("w"))
        rows = index.alive(each).groupBy("query_id", "many", "id").agg(F.sum("w").alias("score"), F.count(F.lit(1)).alias("have")).filter("have = many")
        rows = rows.select("query_id", "id", F.round("score", 6).alias("score"))
        rows = rows.join(among.select("id"), "id", "left_semi") if among is not None else rows
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return rows.withColumn("rank", rank).filter(F.col("rank") <= k)

    early = written(scored_in(part.filter("early")), "early")
    least = early.filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    late = part.filter("not early").join(least, "query_id", "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 2e-6))
    both = early.unionByName(scored_in(late)).drop("rank")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return both.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "id", "score")


def recall_many(memories: DataFrame, index: Index, queries: DataFrame, now: Column, vectors: DataFrame | None = None, limit: int = 20, least: float = 0.0) -> DataFrame:
    """recall() for a table of queries (query_id, text and, with vectors, vec): each
    query's rows, by query_id. Queries are rows throughout: words meet postings in
    joins, vectors in blocks, lists are cut and fused by query, and memories are read
    once for all. A query without a vector has its keyword list alone."""
    depth = max(3 * limit, 50)
    live = active(memories)
    words = keyword_lists(index, queries, depth, live).withColumn("keyword_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    words = words.select("query_id", "id", "keyword_rank")
    if vectors is not None:
        near = knn(vectors.join(live.select("id"), "id", "left_semi"), queries.filter("vec is not null").select("query_id", "vec"), depth).select("query_id", "id", F.col("rank").alias("vector_rank"))
        fused = near.join(words, ["query_id", "id"], "full_outer")
    else:
        fused = words.withColumn("vector_rank", F.lit(None).cast("int"))
    fused = fused.withColumn("rrf_score", S.rrf(F.col("vector_rank")) + S.rrf(F.col("keyword_rank")))
    rows = live.join(fused.select("query_id", "id", "rrf_score"), "id").withColumns(S.boosts(now))
    rows = rows.withColumn("score", F.round(F.col("rrf_score") + sum(map(F.col, BOOSTS)), 6))
    rows = rows.filter(F.col("score") >= least) if least > 0 else rows
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    rows = rows.withColumn("rank", rank).filter(F.col("rank") <= limit)
    return _items(rows, "query_id")


class VectorIndex:
    """Approximate nearest vectors by bucketed random projections. The model and
    its hashes are fitted once, and can be saved and loaded."""

    def __init__(self, model, hashed: DataFrame):
        self.model, self.hashed = model, hashed

    @classmethod
    def fit(cls, vectors: DataFrame, tables: int = 16, width: float = 4.0) -> VectorIndex:
        from pyspark.ml.feature import BucketedRandomProjectionLSH
        from pyspark.ml.functions import array_to_vector

        rows = vectors.select("id", array_to_vector("vec").alias("features"))
        model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=width, numHashTables=tables, seed=42).fit(rows)
        return cls(model, model.transform(rows))

    def save(self, path: str) -> None:
        self.model.write().save(f"{path}/model")
        self.hashed.write.parquet(f"{path}/hashed")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        from pyspark.ml.feature import BucketedRandomProjectionLSHModel

        return cls(BucketedRandomProjectionLSHModel.load(f"{path}/model"), spark.read.parquet(f"{path}/hashed"))

    def without(self, ids: DataFrame) -> VectorIndex:
        """The index without the vectors of some ids."""
        return VectorIndex(self.model, self.hashed.join(ids.select("id"), "id", "left_anti"))

    def nearest(self, query: list[float], k: int = 10, over: int = 4) -> DataFrame:
        """(id, distance): of over * k candidates the k nearest by their distance."""
        from pyspark.ml.linalg import Vectors

        found = self.model.approxNearestNeighbors(self.hashed, Vectors.dense(query), over * k, distCol="distance")
        return found.select("id", F.round("distance", 6).alias("distance")).orderBy("distance", "id").limit(k)
