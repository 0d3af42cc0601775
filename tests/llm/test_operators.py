import hashlib
import random
import re
import time
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from oracle import same
from pyspark.sql import functions as F

from tessera.llm import components, exact_dedup, html_text, language_id, line_dedup, minhash, mixing, piece_codec, pieces, queries, ragged, shingle_join, simhash, suffix_dedup, token_files, wavelet

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key long, fp long, size string, line string, target string, root string, list string"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SPACES = re.compile(r"[\x20\x09-\x0D]+")


def messy_rows():
    """Nulls, empty and long texts, repeated rows, ties, odd characters."""
    long = " ".join(f"wort{i % 977} x{i % 31}" for i in range(6000))
    texts = [None, "", " \t\n ", "one", "one  two\tthree\nfour five six", "one two three four five six", long, long, long + " end", "é▁你 \x1c\x85\xa0x", "a\n" * 50, "12 34 !!"]
    rows = [(i, t, ["en", "fr", None][i % 3], ["b", "a", None, "c"][i % 4], 1, *["x", 1, 2, "s", "l", "t", "r", "q"]) for i, t in enumerate(texts)]
    return [*rows, rows[4], rows[6], (None, "one two", None, None, None, *[None] * 8), (None, None, None, None, None, *[None] * 8)]


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return sorted((r["doc_id"], r["text"] or "") for r in documents.select("doc_id", "text").collect())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, duck, name):
    same(queries.queries()[name](spark, sf_dir), duck, queries.oracle_sql()[name])


OPERATORS = {
    "minhash": minhash.edited_likeness, "lines": line_dedup.line_report, "suffixes": suffix_dedup.dedup, "simhash": simhash.near_groups, "language": language_id.identify,
    "exact": exact_dedup.exact_groups, "tokens": lambda d: token_files.token_ids(d, WORD_BPE), "pieces": lambda d: piece_codec.encode_and_decode(d, PIECES, 1000), "mix": mixing.mix,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_messy_and_empty_tables(messy, empty, name):
    got = OPERATORS[name](messy).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in messy_rows())
    assert OPERATORS[name](empty).collect() == []


def test_filters_keep_columns(messy):
    for f in (exact_dedup.exact_dedup, line_dedup.dedup_lines, simhash.near_dedup, mixing.mixed_documents, language_id.spoken):
        assert f(messy).columns == messy.columns
        f(messy).collect()


def test_exact_dedup_of_one_id_with_several_texts(spark):
    rows = [(1, "a"), (1, "b"), (0, "b"), (1, "a"), (2, "a  c"), (2, "a\tc"), (None, None), (None, "b"), (3, "")]
    got = Counter(tuple(r) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(1, "a"), (1, "a"), (0, "b"), (2, "a  c"), (2, "a\tc"), (3, "")])


def test_minhash_estimates_and_equal_texts(documents, texts):
    got = {r["doc_id"]: r for r in minhash.edited_likeness(documents).collect()}
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    errors, prints = [], {}
    for i, (doc, text) in enumerate(texts):
        after = texts[(i + 1) % len(texts)][1]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        r, a, b = got[doc], shingles(text), shingles(edited)
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        errors.append(r["near_edited"] - len(a & b) / len(a | b))
        prints.setdefault(text, set()).add(r["fingerprint"])
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05
    assert max(map(len, prints.values())) == 1


def plain_fingerprint(text):
    """One-permutation MinHash by its definition: bins, least hashes, walks, four bits."""
    import xxhash

    words = SPACES.sub(" ", text.lower()).strip(" ").split(" ")
    if words == [""]:
        return ""
    rng = random.Random(minhash.BINS)
    starts = [rng.randrange(minhash.BINS) for _ in range(minhash.BINS)]
    steps = [rng.randrange(minhash.BINS) | 1 for _ in range(minhash.BINS)]
    least = {}
    for i in range(max(1, len(words) - minhash.SHINGLE + 1)):
        h = 42
        for w in words[i : i + minhash.SHINGLE]:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        h -= (h >> 63) << 64
        b = (h >> 56) + 128
        least[b] = min(least.get(b, h), h)
    out = []
    for b in range(minhash.BINS):
        j, at = 0, b
        while at not in least:
            at, j = (starts[b] + steps[b] * j) % minhash.BINS, j + 1
        out.append(least[at] & 15)
    return "".join(f"{x:x}" for x in out)


def test_minhash_by_its_definition(spark, documents, texts):
    got = {r["doc_id"]: r["f"] for r in minhash.fingerprints(documents).select("doc_id", minhash.as_hex(F.col("fingerprint")).alias("f")).collect()}
    assert got == {d: plain_fingerprint(t) for d, t in texts}


def near_lines(rows):
    """Brute force: positions that go and numbers of links, by document."""

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
        return row[-1]

    first = {}
    for doc, text in rows:
        for i, line in enumerate(text.split("\n")):
            if len(line) >= line_dedup.LEAST:
                first.setdefault(line, (doc, i))
    near = {x: [] for x in first}
    for a, b in combinations([x for x in first if len(x) >= line_dedup.NEAR], 2):
        if abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2:
            near[a].append(b)
            near[b].append(a)
    out = {}
    for doc, text in rows:
        own = [(i, x) for i, x in enumerate(text.split("\n")) if x in first]
        out[doc] = [i for i, x in own if (doc, i) > first[x] or any(first[y] < first[x] for y in near[x])], sum(len(near[x]) for _, x in own)
    return out


def test_line_dedup_is_exact(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdent ") for _ in range(rng.choice([38, 40, 41, 55, 56, 57, 72]))) for _ in range(12)]

    def edited(s):
        for _ in range(rng.randint(0, 3)):
            k, c = rng.randrange(len(s)), rng.choice(["", "x", "yz"])
            s = s[:k] + c + s[k + 1 :]
        return s

    rows = [(i, "\n".join(edited(rng.choice(base)) for _ in range(4))) for i in range(40)]
    got = {r["doc_id"]: (r["removed"], r["n_links"]) for r in line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == near_lines(rows)


def test_line_dedup_takes_short_lines(spark):
    given = [
        (1, "Anheerat, by in ofonthhahe er. Erin.\nThwhesnd. Esator...\n}\n\n \nabcdefghijklmnopqrst"),
        (2, "Anheerat by in ofonthhahe er. Erin.\nThwhesnd, esator...\n}\n\n \nabcdefghiXklmnopqrs"),
        (3, "Thwhesnd. Esator...\nshort\nabcdefghiXklmnopqrXtu\nshort"),
    ]
    df = spark.createDataFrame(given, "doc_id long, text string")
    # 19 characters match exactly, 20 within two edits, blank lines stay.
    assert {r["doc_id"]: r["removed"] for r in line_dedup.line_report(df).collect()} == {1: [], 2: [0, 2], 3: [0, 3]}
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdent ") for _ in range(rng.choice([5, 19, 20, 21, 22, 34, 35, 36, 37, 38]))) for _ in range(16)]

    def edited(s):
        for _ in range(rng.randint(0, 3)):
            k, c = rng.randrange(len(s)), rng.choice(["", "x", "yz"])
            s = s[:k] + c + s[k + 1 :]
        return s

    rows = [(i, "\n".join(edited(rng.choice(base)) for _ in range(4))) for i in range(60)]
    got = {r["doc_id"]: (r["removed"], r["n_links"]) for r in line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == near_lines(rows)


def without_repeats(rows, window=suffix_dedup.WINDOW):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        raw = text.encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - window + 1):
            w = raw[i : i + window]
            if w in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(w)
        left = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out[doc] = len(raw), len(raw) - len(left), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(left).hexdigest()
    return out


def suffix_rows():
    rng = random.Random(5)
    common = "".join(rng.choice("abcdefgh é") for _ in range(2000))
    rows = []
    for i in range(80):
        parts = []
        for _ in range(rng.randint(0, 4)):
            a = rng.randrange(1900)
            parts.append(rng.choice([common[a : a + rng.choice([60, 99, 100, 101, 130, 700])], "x" * 150, "ab" * 90, "".join(rng.choice("abcdefgh ") for _ in range(200))]))
        rows.append((i, "".join(parts)))
    return rows


def test_suffix_dedup_is_exact(spark, documents, texts, monkeypatch):
    columns = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    for hot in (suffix_dedup.HOT, 3):
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        got = suffix_dedup.dedup(spark.createDataFrame(suffix_rows(), "doc_id long, text string").repartition(4)).collect()
        assert {r["doc_id"]: tuple(r[c] for c in columns) for r in got} == without_repeats(suffix_rows())
    assert {r["doc_id"]: tuple(r[c] for c in columns) for r in suffix_dedup.dedup(documents).collect()} == without_repeats(texts)


def test_suffix_dedup_of_one_id_with_several_texts(spark):
    rng = random.Random(8)
    a, b, c = ("".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(3))
    rows = [(1, a), (2, a), (2, b), (2, b + c[:150]), (None, c), (2, b), (3, None)]
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    first = min((b, b + c[:150]), key=lambda t: hashlib.md5(t.encode()).hexdigest()) == b  # of doc 2's texts that share b
    whole, longer = (0, 450) if first else (300, 150)
    assert got == Counter([(1, 300, 0), (2, 300, 300), (2, 300, whole), (2, 300, whole), (2, 450, longer), (None, 300, 0), (3, 0, 0)])


def test_suffix_dedup_with_hot_marks_and_pieces(monkeypatch):
    """The Arrow functions in this process, with tiny blocks."""
    monkeypatch.setattr(suffix_dedup, "HOT_BLOCK", 2)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    rows = suffix_rows()
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows])], ["_doc", "_text"])
    digits = pa.Table.from_batches(list(suffix_dedup._digits(iter([batch])))).sort_by([("key", "ascending"), ("second", "ascending"), ("doc", "ascending"), ("at", "ascending")])
    found = pa.Table.from_batches(list(suffix_dedup._grouped(iter(digits.to_batches(max_chunksize=97))))).to_pylist()
    asked = {}
    for r in found:
        if r["at"] is not None:
            asked.setdefault(r["doc"], []).append({"gram": r["gram"], "at": r["at"], "hot": r["gram"] % 2 == 0})
    batch = pa.RecordBatch.from_arrays([pa.array(list(asked)), pa.array([dict(rows)[d] for d in asked]), pa.array(list(asked.values()))], ["_doc", "_text", "asked"])
    apart = pa.Table.from_batches(list(suffix_dedup._apart(iter([batch])))).sort_by([("key", "ascending"), ("doc", "ascending"), ("at", "ascending")])
    found += pa.Table.from_batches(list(suffix_dedup._windows(iter(apart.to_batches(max_chunksize=53))))).to_pylist()
    want = without_repeats(rows)
    for doc, text in rows:
        mine = [(r["begin"], r["finish"]) for r in found if r["doc"] == doc and r["at"] is None]
        left, removed, spans = suffix_dedup._cut(text.encode(), np.array([a for a, _ in mine], np.int64), np.array([b for _, b in mine], np.int64))
        assert (len(text.encode()), removed, spans, hashlib.sha256(left).hexdigest()) == want[doc]


def test_simhash_matches_all_pairs(spark, documents, texts):
    import xxhash

    prints = {}
    for doc, text in texts:
        w = text.encode().lower().split()
        grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints[doc] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    up = {d: d for d in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_groups(documents).collect()}
    assert got == {d: (f"{p:016x}", root(d)) for d, p in prints.items()}


def test_simhash_links_in_dense_and_hot_lists(spark, monkeypatch):
    assert len(simhash.GUARDS) == 20 and all(any(set(g) <= set(c) for g in simhash.GUARDS) for c in combinations(range(8), 4))
    rng = random.Random(2)
    fps = {0} | {sum(1 << b for b in rng.sample(range(64), rng.randint(1, 7))) for _ in range(400)} | {rng.getrandbits(64) for _ in range(200)}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    want = Counter()
    for a, b in combinations(signed, 2):
        if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
            want[(a, b)] = 1
    for most in (simhash.LIST, 40):
        monkeypatch.setattr(simhash, "LIST", most)
        rows = spark.createDataFrame([(x,) for x in signed], "fp long")
        one = {r["node"]: r["root"] for r in components.roots(simhash.fingerprint_links(rows)).collect()}
        two = {r["node"]: r["root"] for r in components.roots(spark.createDataFrame(list(want), "a long, b long"), contract=False).collect()}
        assert one == two


def test_near_stage_links_all_texts_of_jaccard_08(spark, sf_dir, documents, texts, messy, empty):
    import corpus_pipeline

    rng = random.Random(6)
    rows = list(texts)
    for k in (8, 12, 20, 60, 300):
        for j in range(6):
            words = [f"w{rng.randrange(5000)}" for _ in range(k)]
            rows.append((100_000 + 100 * k + 10 * j, " ".join(words)))
            for i in range(1, 6):
                some = list(words)
                for _ in range(max(1, k * i // 100)):
                    some[rng.choice([0, -1, rng.randrange(k)])] = f"v{rng.randrange(5000)}"
                rows.append((100_000 + 100 * k + 10 * j + i, " ".join(some)))
    sets = {d: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4)) if w} for d, t in rows}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(df).collect()}
    assert got == {d: root(d) for d in sets}
    assert sorted(r["doc_id"] for r in corpus_pipeline.dedup_near(spark, df, sf_dir).collect()) == sorted({root(d) for d in sets})
    assert Counter(r["doc_id"] for r in simhash.near_copies(messy).collect()) == Counter(r[0] for r in messy_rows())
    assert simhash.near_dedup(messy).columns == messy.columns and simhash.near_copies(empty).collect() == []


PAGE = """<html><head><title>T</title><script>a < b</script></head><body class="nav-open"><header><h1>Site</h1></header><nav><a href=x>m</a></nav>
<article><h1>Head&eacute;</h1><p>First, of some, length &amp; more <b>bold</b>
 text.<p>Second<br>line<div class="advert">buy</div><form><p>name</p></form><ul class=related-links><li><a>x</a></ul></article>
<aside>side</aside><div id="comments"><p>a, b, c, d, e, f, g, h, i</p></div><footer>&copy;</footer><p"""


def test_near_copies_around_a_hub(spark, monkeypatch):
    """A dense group, of which many are alike the original alone, in long lists."""
    monkeypatch.setattr(shingle_join, "LIST", 16)
    rng = random.Random(12)
    base = [f"w{i}" for i in range(120)]

    def edited(n):
        out = list(base)
        for _ in range(n):
            out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
        return " ".join(out)

    rows = [(i, edited(i % 7)) for i in range(140)] + [(1000 + i, " ".join(f"v{rng.randrange(50)}" for _ in range(60))) for i in range(30)]
    sets = {d: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(len(w) - 4)} for d, t in rows}
    want = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a, b in combinations(sets, 2):
            if want[a] != want[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                low, high = sorted((want[a], want[b]))
                want = {d: low if x == high else x for d, x in want.items()}
                changed = True
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) > 40


def test_names_that_operators_use_themselves(spark):
    names = "score lang_pred _removed _doc _copies _key removed doc copy row key copies more sum n h slot before _kept _copy set root _text lines".split()
    rows = [(i, f"the cat sat on a mat number {i} of all\nthe same line in each of the texts here", "en", "s", *[f"{c}{i}" for c in names]) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in names))
    for f in (exact_dedup.exact_dedup, line_dedup.dedup_lines, simhash.near_dedup, mixing.mixed_documents, language_id.spoken):
        got = f(df)
        assert got.columns == df.columns
        found = got.collect()
        assert found and all(r[c] == f"{c}{r['doc_id']}" for r in found for c in names)


def test_edits_by_the_automaton(spark):
    rng = random.Random(21)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
        return row[-1]

    word = lambda n: "".join(rng.choice("ab😀é") for _ in range(n))
    pairs = [("", ""), ("", "ab"), ("abc", ""), ("a" * 100, "a" * 98)]
    for _ in range(1500):
        a = word(rng.randint(0, 30))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = word(rng.randint(0, 1))
        pairs.append((a, "".join(b)))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", line_dedup.within(F.col("a"), F.col("b")).alias("near")).collect()
    assert all(r["near"] == (distance(r["a"], r["b"]) <= line_dedup.EDITS) for r in got) and len({r["near"] for r in got}) == 2


def test_html():
    assert html_text.main_text(PAGE) == "Headé\n\nFirst, of some, length & more bold text.\n\nSecond line"
    assert [html_text.main_text(x) for x in (None, "", "<", "<p", "plain", "<nav>x</nav>")] == ["", "", "<", "", "plain", ""]
    deep = "<div>" * 3000 + "<p>in, the, deep</p>"
    assert html_text.main_text(deep) == "in, the, deep"
    loose = "<body><div><p>" + "Some, long, prose here. " * 20 + "</p><p>" + "More, of it. " * 20 + "</p></div><div><a href=1>one</a> <a href=2>two</a></div></body>"
    assert "one" not in html_text.main_text(loose) and "More, of it." in html_text.main_text(loose)


def test_html_keeps_siblings_and_doubted_wholes():
    main = html_text.main_text
    four = ["One, short text.", "Two of them.", "Three, now here.", "Four at last."]
    p = [f"<p>{x}</p>" for x in four]
    assert main(f"<body><div>{p[0]}{p[1]}</div><div>{p[2]}{p[3]}</div></body>") == "\n\n".join(four)
    long = ["Some, long, prose stands here. " * 20, "More of it, of another section, without a link. " * 3]
    a, b = (f"<p>{x}</p>" for x in long)
    for page in (f"<main><article>{a}</article><section>{b}</section></main>", f"<body><div>{a}{a}</div><div>{b}</div></body>"):
        assert long[0].strip() in main(page) and long[1].strip() in main(page)
    assert main(f"<body><div><h1>Title</h1></div><div>{a}{a}</div></body>").startswith("Title\n\nSome")
    # A wrapper with a word of the list, what such a word names inside it, and nothing else on the page.
    assert main(f"<body><h2>Name</h2><div class='page side'>{a}<div class=sidebar>{p[0]}</div></div></body>") == f"Name\n\n{long[0].strip()}"
    assert main(f"<body><div>x</div><div class='post comments-open'><h1>Title</h1>{a}</div></body>") == f"Title\n\n{long[0].strip()}"
    assert main(f"<body><div>{a}</div><div id=comments>{b}{a}{a}</div></body>") == long[0].strip()
    assert main(f"<body><div class=share><div class=ad>{p[0]}</div></div></body>") == four[0]


PROSE = [f"This is a passage, number {i}, of the text that a page is for, and it goes on for a while, as prose does." for i in range(6)]
BODY = "".join(f"<p>{x}</p>" for x in PROSE)


@pytest.mark.parametrize("page", [
    "<body><form action=x>{}</form></body>", "<body><form><div><article>{}</article></div><input name=a></form></body>", "<article>{}</article>", "<body><article><fieldset>{}</fieldset></article></body>",
    *(f"<body><div class='{w}'>{{}}</div></body>" for w in sorted(html_text.DROPPED_WORDS - html_text.DROPPED_WHOLE)), *(f"<body><{t}>{{}}</{t}></body>" for t in sorted(html_text.CONTAINERS - html_text.DROPPED - {"html", "body", "header", "table", "thead", "tbody", "tfoot", "tr"})),
])
def test_html_keeps_all_of_a_wrapped_page(page):
    assert html_text.main_text(page.format(BODY)) == "\n\n".join(PROSE)


@pytest.mark.parametrize(("inside", "text"), [
    ("<section class='side-effects'><p>Headaches, mostly.</p></section>", "Headaches, mostly."), ("<div class='related-work'><p>Others did it.</p></div>", "Others did it."), ("<div role=note><p>Mind this.</p></div>", "Mind this."),
    ("<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p>", "So x=2 holds."), ("<p>Press <button>Save</button> twice.</p>", "Press Save twice."), ("<fieldset><legend>Terms</legend><p>All of them.</p></fieldset>", "Terms\n\nAll of them."),
    ("<h2>Sources</h2><ul><li><a href=1>One, a book</a></li><li><a href=2>Two, a talk</a></li></ul>", "Sources\n\nOne, a book\n\nTwo, a talk"), ("<section id=comment-on-law><p>It binds.</p></section>", "It binds."),
    ("<div class=advert>buy</div>", None), ("<div class='related-links'><a href=1>a</a></div>", None), ("<form><input><p>name</p></form>", None), ("<aside>s</aside>", None), ("<div class='comments'><p>So true, friend.</p></div>", None), ("<nav><a>x</a></nav>", None),
])
def test_html_inside_an_article(inside, text):
    page = f"<body><nav><a href=/>Home</a></nav><article>{BODY}{inside}<p>{PROSE[0]}</p></article><footer>f</footer></body>"
    assert html_text.main_text(page) == "\n\n".join([*PROSE, *([text] if text else []), PROSE[0]])


def test_html_keeps_short_siblings_between_long_ones():
    page = f"<body><div class=menu><a href=1>a</a></div><div>{BODY}</div><div>Short.</div><div>{BODY}</div></body>"
    assert html_text.main_text(page) == "\n\n".join([*PROSE, "Short.", *PROSE])


@pytest.mark.parametrize("page", ["<div><p></body>" * 20_000, "<div></section>" * 20_000, "<section><article>" + "<div></section>" * 20_000, "<body>" * 5000 + "</div>" * 20_000])
def test_html_work_is_linear_in_broken_pages(page):
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 5


def test_html_rows(spark):
    rows = [(1, "u", PAGE, 5), (2, None, None, None), (None, "v", "<p>x</p>", 1), (1, "u", PAGE, 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    got = html_text.extract(df).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract(df.limit(0)).collect() == []


def test_language_accuracy_and_parse(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    right, n = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 150 and right > 0.98
    parser = language_id.CrossParser({"a": "the cat sat on the mat ", "b": "der hund lief um das haus "})

    def phrases(text, reference):
        text, reference = (bytes(parser.symbols(x)) for x in (text, reference))
        n = i = 0
        while i < len(text):
            k = 1
            while i + k < len(text) and text[i : i + k + 1] in reference and text[i] and 0 not in text[i : i + k + 1]:
                k += 1
            n, i = n + 1, i + k
        return n

    for t in ["the mat sat", "das haus der hund", "zq the", "x", "cat  \n 12 hund"]:
        assert parser.phrases([t])[0][0].tolist() == [phrases(t, "the cat sat on the mat "), phrases(t, "der hund lief um das haus ")]
    assert parser.predict([None, "", "12 !", "the cat"])[0] == ["und", "und", "und", "a"]


def test_language_of_long_texts_in_lanes(spark, texts, monkeypatch):
    references = {"a": texts[0][1][:3000] or "a b", "b": texts[7][1][:3000] or "c d", "c": texts[20][1][:3000] or "e f"}
    given = [t[:3000] for t in sorted((t for _, t in texts), key=len)[-6:]] + ["", "x", "ab " * 700, texts[0][1][:2500]]
    whole = None
    for lane in (1 << 30, 1024, 50, 7):
        monkeypatch.setattr(language_id, "LANE", lane)
        counts = language_id.CrossParser(references).phrases(given)[0].tolist()
        whole = whole or counts
        assert counts == whole


def test_language_predictions_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    references = language_id.sample(docs)
    parser = language_id.CrossParser(references)
    whole = {k: "".join(map(chr, parser.symbols(t).tolist())) for k, t in references.items()}

    def phrases(text, known):
        n = i = 0
        while i < len(text):
            k = 1
            while i + k < len(text) and text[i : i + k + 1] in known:
                k += 1
            n, i = n + 1, i + k
        return n

    rows = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    checked = 0
    for r in docs.collect():
        text = (r["text"] or "")
        if not any(c.isalpha() for c in text):
            assert rows[r["doc_id"]]["lang_pred"] == "und"
            continue
        if len(text) > 1500:
            continue
        symbols = "".join(map(chr, parser.symbols(text).tolist()))
        rates = [(phrases(symbols, whole[k]) * np.log2(max(2, len(whole[k]))), k) for k in sorted(references)]
        best = min(x for x, _ in rates)
        assert rows[r["doc_id"]]["lang_pred"] in [k for x, k in rates if x <= best * (1 + 1e-12)]
        checked += 1
    assert checked > 50


def test_language_of_large_alphabets_and_many_names(spark, monkeypatch):
    rng = random.Random(8)
    words = lambda low, n: [chr(low + rng.randrange(n)) + chr(low + rng.randrange(n)) for _ in range(300)]
    # Three of hundreds of letters each behind Latin, two from one range in parts.
    of = {"ja": words(0x4E00, 3000), "zh": words(0x4E00 + 2000, 3000), "en": [f"{a}{b}" for a in "abcdeth" for b in "aeiou"], "ko": words(0xAC00, 3000)}
    text = lambda k, n: " ".join(rng.choice(of[k]) for _ in range(n))
    references = {k: text(k, 40 if k == "en" else 1000) for k in of}
    asked = [(k, text(k, 60)) for k in of for _ in range(20)]
    whole = language_id.CrossParser(references)
    got = whole.predict([t for _, t in asked])
    assert got[0] == [k for k, _ in asked]
    mixed = [t for _, t in asked] + ["a\u4e00 zq", "", "\u9fff" * 5, text("zh", 9) + text("en", 3000)]
    counts = whole.phrases(mixed)[0]
    assert whole.width == whole.letters
    for cells in (1, 40 * sum(map(len, references.values()))):
        monkeypatch.setattr(language_id, "CELLS", cells)
        narrow = language_id.CrossParser(references)
        assert narrow.width < narrow.letters and (narrow.phrases(mixed)[0] == counts).all()
    reference, symbols = whole.symbols(references["zh"]).tolist(), whole.symbols(asked[25][1]).tolist()
    runs, n, i = {tuple(reference[j : j + k]) for k in range(1, 12) for j in range(len(reference))}, 0, 0
    while i < len(symbols):
        k = 1
        while i + k < len(symbols) and tuple(symbols[i : i + k + 1]) in runs:
            k += 1
        n, i = n + 1, i + k
    assert counts[25][whole.names.index("zh")] == n
    rows = [(j, f"w{chr(97 + j % 26)}{chr(97 + j // 26)} " * 20, f"l{j:03}") for j in range(100)]
    assert language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).count() == 100


def test_language_stage_writes_what_it_finds(spark):
    texts = {"a": "the cat sat on the mat with that hat ", "b": "der hund lief um das haus und durch den wald "}
    rows = [(i, texts["ab"[i % 2]] * 3, "ab"[i % 2]) for i in range(40)] + [(40, texts["a"], "b"), (41, texts["b"], None), (42, "12 !", "a")]
    got = {r["doc_id"]: r["lang"] for r in language_id.spoken(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got == {i: "ab"[i % 2] for i in range(40)} | {40: "a", 41: "b"}


def test_exact_dedup_keeps_the_smallest_id(messy):
    got = exact_dedup.exact_groups(messy).collect()
    rows = Counter((r[0], SPACES.sub(" ", r[1] or "")) for r in messy_rows())
    for r in got:
        mine = [t for (d, t) in rows if d == r["doc_id"] and hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"]]
        group = [(d, t) for (d, t) in rows.elements() if t == mine[0]]
        ids = [d for d, _ in group if d is not None]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(ids, default=None), len(group), r["doc_id"] == min(ids, default=None))


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 3000):
        ids = rng.integers(0, 50, n)
        ends = np.array([n // 2, n])
        m, docs, e = wavelet.load(wavelet.dump(wavelet.WaveletMatrix.build(ids, 16), [7, None], ends))
        assert docs == [7, None] and e.tolist() == ends.tolist() and m.to_array().tolist() == ids.tolist()
        assert [m.access(i) for i in range(0, n, 37)] == ids[::37].tolist()
        for token in (0, 17, 49, 51, 70_000):
            assert m.count(token) == int((ids == token).sum())
            assert m.occurrences(token)[:20] == np.flatnonzero(ids == token)[:20].tolist()


def test_token_files(documents, texts, spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    got = {r["doc_id"]: r for r in token_files.token_ids(documents, WORD_BPE, str(tmp_path / "out"), shard_ids=5000).collect()}
    start = 0
    for doc, text in texts:
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        r = got[doc]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    odd = ["a<|endoftext|>b", "x\x1cy", "é ́x q\x85w", "don't'S 1a你。", "İI ß"]
    rng = random.Random(8)
    letters = [*"abAZzéÉßÿÀñ 019.,'-<|>_\t\n\x1c\x85\xa0ª×µ’中\u0301sStdm", "<|endoftext|>", "'s", "'ll", "İ", "ﬁ"]
    odd += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 20))) for _ in range(3000)]
    table, split, _ = token_files.text_encoder(WORD_BPE)
    flat, ends = table.texts(split(odd))
    assert flat.tolist() == [i for x in odd for i in t.encode(x, add_special_tokens=False).ids] and ends[-1] == len(flat)


def test_pieces_match_the_library(spark, documents):
    import sentencepiece

    lib, model = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.PieceModel(PIECES)
    rng = random.Random(4)
    odd = ["".join(rng.choice("abe \n▁té你#-=_/'0129the ") for _ in range(rng.randint(1, 200))) for _ in range(60)] + ["a" * 120, "    ", "=-=" * 40]
    for text in odd:
        s = model.spaced(text)
        for size in (5, 40):
            cut = []
            for at in range(0, len(s), size):
                low, n = max(0, at - model.longest), min(size, len(s) - at)
                cut.append(pieces.Chunk(model, s[low : at + n + model.longest], at - low, n, at == 0, at + n == len(s)))
            matrices = [c.transfer() for c in cut]
            path = pieces.borders(matrices)
            assert model.piece_ids([p for c, a, b in zip(cut, path, path[1:], strict=False) for p in c.pieces(a, b)]) == lib.encode(text)
        if len(matrices) > 2:
            a, b, c = matrices[:3]
            assert pieces.compose(pieces.compose(a, b), c) == pieces.compose(a, pieces.compose(b, c))
    for _ in range(3000):
        text = "".join(rng.choice("aeinrstl.,é\n0▁") for _ in range(rng.randint(1, 25)))
        assert all(model.word(w) == model.merge(w) for w in pieces.WORDS.findall(text))
    for chunk, fan in ((300, 3), (piece_codec.CHUNK, piece_codec.FAN)):
        rows = piece_codec.encode_and_decode(documents, PIECES, chunk, fan).join(documents.select("doc_id", "text"), "doc_id").collect()
        for r in rows:
            assert r["ids"] == lib.encode(r["text"]) and r["text_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_neighbours_as_by_merges():
    model, rng = pieces.PieceModel(PIECES), random.Random(5)
    names = list(model.ids)
    for _ in range(4000):
        left, right = rng.choice(names), rng.choice(names)
        if rng.random() < 0.5 and len(left + right) > 1:
            cut = rng.randint(1, len(left + right) - 1)
            left, right = (left + right)[:cut], (left + right)[cut:]
        if model.known(left) and model.known(right) and not (left[-1] != pieces.SPACE and right[0] == pieces.SPACE):
            assert model.fits(left, right) == (model.merge(left + right) == [left, right])


def test_word_table_is_bounded():
    calls = []

    def ids(word):
        calls.append(word)
        return [len(word), ord(word[0])]

    table = ragged.WordIds(ids, limit=50)
    words = [[f"{'x' * (i % 7)}{i * j % 90}" for i in range(100)] for j in range(30)]
    for _ in range(2):
        flat, ends = table.texts(words)
        assert flat.tolist() == [x for t in words for w in t for x in (len(w), ord(w[0]))] and ends.tolist() == [200 * (i + 1) for i in range(30)]
        assert len(table) <= 50 and len(table.older) <= 50
    assert table.texts([])[0].size == 0


def test_mix_reaches_its_targets(messy, documents):
    got = mixing.mix(documents).collect()
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], []).append(r)
    for rows in by.values():
        assert sum(r["taken"] for r in rows) == round(rows[0]["target"]) and rows[0]["target"] <= 2 * rows[0]["source_size"]
    assert sum(rows[0]["target"] for rows in by.values()) == pytest.approx(1.5 * sum(r["size"] for r in got), rel=1e-6)
    assert sorted(map(str, mixing.mix(documents).collect())) == sorted(map(str, got))
    assert {r["doc_id"]: r["size"] for r in mixing.mix(messy).collect() if r["doc_id"] in (0, 2, 4)} == {0: 0, 2: 0, 4: 6}


def test_mixed_documents_deal_repeated_rows(spark):
    rows = [(None, f"w{i} x", "a") for i in range(100)] + [(7, "one two", "b")] * 9 + [(7, f"n{i} " * (i + 1), "b") for i in range(9)] + [(i, "a b c", None) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for share in (0.3, 0.5, 1.5):
        want = {(r["source"], r["size"]): r["n"] for r in mixing.mix(df, share).groupBy("source", "size").agg(F.sum("copies").alias("n")).filter("n > 0").collect()}
        assert len(want) > 1 and any(n % 100 for (source, _), n in want.items() if source == "a")
        got = Counter((r["source"], len(r["text"].split())) for r in mixing.mixed_documents(df, share=share).collect())
        assert got == want


def test_stages_on_messy_and_empty_tables(spark, sf_dir):
    import corpus_pipeline

    docs = spark.createDataFrame([r[:5] for r in messy_rows()], "doc_id long, text string, lang string, source string, n_chars long")
    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).collect() == [], name
        rows = stage(spark, rows, sf_dir)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert rows.columns == docs.columns
            rows = spark.createDataFrame(rows.collect(), docs.schema)
            assert rows.filter("text is null").count() == 0, name
    assert rows.count() > 0


def test_pipeline(spark, sf_dir, documents):
    import corpus_pipeline

    docs, rows = documents, {r["doc_id"]: r for r in documents.collect()}
    counts, after = [docs.count()], {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), documents.schema)
        assert docs.columns == documents.columns, name
        counts.append(docs.count())
        after[name] = docs.collect()
    # Each stage's rows, from plain versions of what it does.
    letters = {d for d, r in rows.items() if any(c.isalpha() for c in r["text"] or "")}
    assert {r["doc_id"] for r in after["language_id"]} == letters
    gone = near_lines([(r["doc_id"], r["text"]) for r in after["language_id"]])
    left = {r["doc_id"]: "\n".join(x for i, x in enumerate(r["text"].split("\n")) if i not in set(gone[r["doc_id"]][0])) for r in after["language_id"]}
    assert {r["doc_id"]: r["text"] for r in after["line_dedup"]} == {d: t for d, t in left.items() if t.strip(" \t\n\v\f\r")}
    assert all(r["n_chars"] == len(r["text"]) for r in after["line_dedup"])
    assert {r["doc_id"] for r in after["simhash_near_dedup"]} <= {r["doc_id"] for r in after["line_dedup"]}
    copies = Counter(r["doc_id"] for r in after["mixing"])
    taken = spark.createDataFrame(after["simhash_near_dedup"], documents.schema)
    assert copies == {r["doc_id"]: r["copies"] for r in mixing.mix(taken).collect() if r["copies"]}
    assert counts[1] >= 0.95 * counts[0] and counts[3] <= counts[2] <= counts[1]
    kept = {r["doc_id"] for r in docs.collect()}
    assert kept <= set(rows)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == docs.count() and corpus_pipeline.run(spark, sf_dir).count() == docs.count()


def test_pieces_of_chunks_that_are_dealt_out_once(spark, monkeypatch):
    """Chunks are cut where texts are read, copies in several partitions are traced
    once, and chunks meet their states by a merge at every size (op9)."""
    plans, inner = {}, piece_codec.materialize

    def seen(df, label="step"):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString()
        return inner(df, label)

    monkeypatch.setattr(piece_codec, "materialize", seen)
    texts = [("word salad, and more of it " * 9)[: 60 + 37 * (i % 4)] for i in range(16)] + ["x" * 150, " " * 90, "é中 " * 60, None, "", "short"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert docs.rdd.getNumPartitions() > 1
    out = piece_codec.encode(docs, PIECES, 50)
    got, want = ({r["doc_id"]: r["ids"] for r in df.collect()} for df in (out, piece_codec.encode(docs, PIECES, 10_000)))
    assert got == want and len(got) == len(texts)
    assert not any(x in plans["chunks"] for x in ("Repartition", "Aggregate", "Distinct"))
    assert "strategy=merge" in out._jdf.queryExecution().optimizedPlan().toString()
