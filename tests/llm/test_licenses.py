import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import license_rules, license_scan, queries

RULES = license_rules.rules()
SCHEMA = "doc_id long, text string, label string, rule int, score double, base string, words string"
TEXTS = [
    None, "", " \t\n", "MIT License", "mit\nlicense: MIT, License; apache-license and General Public\x00License!", "KMIT license mit licensé mit license",
    "This work is licensed under the GNU General Public License, version 3. Released under the MIT License.",
    "Licensed under CC BY-NC 4.0. All rights reserved.", "SPDX-License-Identifier: Apache-2.0", "the GPL v2 or later, LGPL 2.1, agplv3", "mit license " * 3000,
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "Do what the fuck you want to public license https://creativecommons.org/licenses/by-nc-sa/3.0/ Copyright (c) 2019",
]


def expected(text):
    """All rules on all words; a detection goes if any other one covers it."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    joined, spans = f" {' '.join(words)} ", []
    at = lambda i: joined[:i].count(" ") - 1
    for n, r in enumerate(RULES):
        spans += [(at(m.start()), at(m.start()) + len(m[0].split(" ")), r.tier, n) for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", joined)]
    covers = lambda a, b: a != b and a[0] <= b[0] and a[1] >= b[1] and (a[2], a[0] - a[1], a[3]) < (b[2], b[0] - b[1], b[3])
    left = [b for b in spans if not any(covers(a, b) for a in spans)] if len(spans) < 500 else spans
    base = [(i, license_scan.BASE[p]) for i in range(len(words)) for p in license_scan.BASE if words[i : i + len(p.split())] == p.split()]
    return words, base, sorted((RULES[n].label, n, start, end - 1) for start, end, _, n in left)


@settings(max_examples=600, deadline=None, derandomize=True)
@given(st.sampled_from(RULES).flatmap(lambda r: st.tuples(st.just(r), st.from_regex(r.pattern, fullmatch=True, alphabet="abcdefghijklmnopqrstuvwxyz0123456789 "))))
def test_keywords_and_gates_stand_in_every_match(case):
    rule, text = case
    assert rule.keyword in text and any(g in text for g in license_rules.gates())


def test_rules_are_ordered():
    assert len(RULES) > 400 and [r.tier for r in RULES] == sorted(r.tier for r in RULES)
    assert all("," not in r.label and "'" not in r.pattern and "\\" not in r.pattern for r in RULES)


@pytest.fixture(scope="module")
def cases(spark):
    rows = [(i, t, "x", 1, 0.5, "b", "w") for i, t in enumerate(TEXTS)]
    rows += [rows[6], (None, "mit license", "x", 1, 0.5, "b", "w"), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_report_matches_brute_force(cases):
    docs, rows = cases
    got = Counter(tuple(r)[:8] for r in license_scan.report(docs).collect())
    want = Counter()
    for r in rows:
        words, base, left = expected(r[1])
        starts, named = [i for i, _ in base], sorted({label for _, label in base})
        score = max([0.0, *(RULES[n].score for _, n, _, _ in left), *([license_scan.BASE_SCORE] if base else [])])
        want[r[0], len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(named), ",".join(sorted({*named, *(x[0] for x in left)})), score] += 1
    assert got == want


def test_detections_match_brute_force(cases):
    docs, rows = cases
    got = defaultdict(list)
    for r in license_scan.scan(docs).collect():
        assert r["tier"] == RULES[r["rule"]].tier and r["score"] == RULES[r["rule"]].score
        got[r["doc_id"]].append((r["label"], r["rule"], r["first_word"], r["last_word"]))
    for doc, text, *_ in rows:
        if doc is not None and doc != 10:
            assert sorted(got[doc]) == expected(text)[2], text
    assert len(got[10]) == 3000 and len(got[None]) == 1


def test_query_over_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in queries.queries()["op13_license_scan"](spark, sf_dir).collect()}
    assert len(got) == len(texts) and any(r["n_base"] for r in got.values())
    for doc, text in texts.items():
        words, base, left = expected(text)
        assert (got[doc]["n_words"], got[doc]["n_base"], got[doc]["n_found"]) == (len(words), len(base), len(left))


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert license_scan.report(docs).collect() == [] and license_scan.scan(docs).collect() == []
