import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import dual_sorted, lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, term string, shard long, n long, score double"
ITEMS = "item_id long, text string, block string, rank int, doc_id long"


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(docs, items, k):
    """Scores by the definition; ties in text order of ids, null last."""
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n, total = len(counted), sum(x[2] for x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms(text))
    out = set()
    for item, own in asked.items():
        scored = []
        for d, c, size in counted:
            m = 100 - 90 + 90 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in own if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out |= {(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])}
    return out


def messy():
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(40)] + ["über", "é▁你", "a\x80b", "don't", "MIT"]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 60)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, " \t..."), (303, "w1 " * 40_000 + "only"), (None, "w1 w2 MIT"), (305, "w7"), (306, "w7"), (307, "W7")]
    return [*rows, rows[5], rows[305], rows[5]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "x", 1, 2, 0.5) for d, t in messy()], DOCS)


def items():
    return [(1, "w1 W1 w2, w3"), (2, "only"), (3, "none of these"), (4, None), (5, ""), (6, " ".join(f"w{i}" for i in range(40)) + " über"), (7, "w7"), (None, "mit"), (7, "a\x80b"), (1, "w1 W1 w2, w3")]


def test_search_matches_definition(spark, docs, monkeypatch):
    asked = spark.createDataFrame([(i, t, "b", 1, 2) for i, t in items()], ITEMS)
    for parts, block in ((1, 256), (40, 2)):
        monkeypatch.setattr(lexical, "BLOCK", block)
        index = lexical.build(docs.repartition(parts))
        assert 1 <= index.shards.count() <= parts and (parts == 1 or index.shards.count() > 10)
        for k in (1, 10, 1000):
            got = lexical.search(index, asked, k).collect()
            assert len(got) == len(set(got)) or k > 1
            assert {tuple(r) for r in got} == expected(messy(), items(), k)


def test_index_is_read_again(spark, docs, tmp_path):
    lexical.build(docs, path=f"file://{tmp_path}/index")
    index = lexical.load(spark, f"file://{tmp_path}/index")
    counted = Counter(t for d, x in messy() for t in set(terms(x)))
    assert {(r["term"], r["df"]) for r in index.lexicon.groupBy("term").agg({"n": "sum"}).toDF("term", "df").collect()} == set(counted.items())
    asked = spark.createDataFrame([(2, "only", "b", 1, 2)], ITEMS)
    assert [r["doc_id"] for r in lexical.search(index, asked).collect()] == [303]


def test_empty_tables(spark, docs):
    none, asked = docs.filter("false"), spark.createDataFrame([(1, "w1", "b", 1, 2)], ITEMS)
    assert lexical.search(lexical.build(none), asked).collect() == []
    assert lexical.search(lexical.build(docs.filter("doc_id = 300")), asked).collect() == []
    assert lexical.search(lexical.build(docs), asked.filter("false")).collect() == []


@pytest.mark.parametrize("wave", [3, 256])
def test_tree_finds_exact_top(monkeypatch, wave):
    monkeypatch.setattr(dual_sorted, "WAVE", wave)
    rnd = np.random.default_rng(3)
    for n_docs in (1, 2, 3, 64, 1000, 5000):
        lists, start = [], 0
        docs, impacts = [], []
        for size in (min(n_docs, s) for s in (1, 5, 300, 4000)):
            own = np.sort(rnd.choice(n_docs, size, replace=False))
            x = rnd.integers(1, 30, size) * 1000
            order = np.lexsort((own, -x))
            docs.append(own[order])
            impacts.append(x[order])
            lists.append((int(rnd.integers(1, 9000)), start, start + size))
            start += size
        docs, impacts = np.concatenate(docs), np.concatenate(impacts).astype(np.int32)
        tree = dual_sorted.Tree(dual_sorted.pack(docs.astype(np.uint16), n_docs), dual_sorted.squeeze(impacts), n_docs)
        total = np.zeros(n_docs, np.int64)
        for w, i, j in lists:
            total[docs[i:j]] += w * impacts[i:j].astype(np.int64)
        for k in (1, 10):
            got, scores = tree.top(*np.array(lists, np.int64).T, k)
            best = sorted(((-s, d) for d, s in enumerate(total.tolist()) if s))
            want = [x for x in best if len(best) < k or x[0] <= best[k - 1][0]]
            assert list(zip((-scores).tolist(), got.tolist(), strict=True)) == want


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(lexical, "STRETCH", 5)
    text = "abc defghijklmnop q é你é你é你 r".encode()
    pieces = list(lexical._stretches(text))
    assert b"".join(pieces) == text and [t for p in pieces for t in p.translate(lexical._LOWER).split()] == text.split()
    assert lexical._count(text) == 5 and lexical._count(b"") == lexical._count(None) == lexical._count(b" . ") == 0


def test_tree_opens_few_nodes(monkeypatch):
    """A rare term of high weight beside a frequent one: most subtrees stay closed."""
    n_docs, opened = 1 << 14, []
    docs = np.concatenate([np.arange(n_docs), [77, 9000]])
    impacts = np.concatenate([np.full(n_docs, 1000), [900_000, 800_000]]).astype(np.int32)
    tree = dual_sorted.Tree(dual_sorted.pack(docs.astype(np.uint16), n_docs), dual_sorted.squeeze(impacts), n_docs)
    rank = tree.rank
    monkeypatch.setattr(dual_sorted, "WAVE", 4)
    monkeypatch.setattr(tree, "rank", lambda level, at: opened.append(len(at)) or rank(level, at))
    got, scores = tree.top(np.array([1, 5000]), np.array([0, n_docs]), np.array([n_docs, n_docs + 2]), 2)
    assert got.tolist() == [77, 9000] and scores.tolist() == [4_500_001_000, 4_000_001_000] and sum(opened) < 1000
