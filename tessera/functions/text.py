"""Text expressions: entities, types, relations, secrets, truncation, tokens."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C
from .stem import stem

_W = "[0-9A-Za-z_]"


def ascii_boundaries(pattern: str) -> str:
    r"""pattern with \b as RE2 has it: between ASCII word characters and others."""
    return pattern.replace(r"\b", rf"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))")


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(ascii_boundaries(pattern)), F.lit(group))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once a row however often body uses it."""
    return F.transform(F.array(value), body)[0]


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


#: For the place of each entity pattern, strings of which a match needs one.
NEEDED = {
    0: ("://",), 1: (".com", ".org", ".net", ".io", ".ai", ".dev", ".app", ".gov", ".edu"), 2: ("@",), 3: ("-",), 4: ("/",),
    5: ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"), 6: (".",), 7: (".",),
}


#: For the place of an entity pattern, a shorter one that stands in all its matches.
INSIDE = {6: r"[0-9]\.[0-9]", 7: r"[0-9]\.[0-9]", 8: "[0-9]{3}"}


def entities(text: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """Struct of arrays, one a kind; a string an earlier pattern found is not taken
    again. Each pattern runs once, and only where a cheap test lets it match. With
    kinds only the patterns of these are run; no string matches patterns of dates,
    or of numbers, and of another kind's."""
    none = F.array().cast("array<string>")
    patterns = [(i, kind, p) for i, (kind, p) in enumerate(C.ENTITY_PATTERNS) if kinds is None or kind in kinds]

    def step(t: Column, at: int, out: dict[str, Column], seen: Column) -> Column:
        if at == len(patterns):
            return F.struct(*(v.alias(k) for k, v in out.items()))
        i, kind, pattern = patterns[at]
        may = _any(t, NEEDED[i]) if i in NEEDED else F.lit(True)
        may = may & t.rlike(INSIDE[i]) if i in INSIDE else may
        new = F.when(may, F.array_except(F.array_distinct(found(t, pattern)), seen)).otherwise(none)
        return let(new, lambda n: step(t, at + 1, out | {kind: F.concat(out[kind], n) if kind in out else n}, F.concat(seen, n)))

    return let(F.coalesce(text, F.lit("")), lambda t: step(t, 0, {}, none))


def one_of_words(words: Iterable[str]) -> str:
    """A pattern for words (of ASCII letters and digits, in lower case) that stand
    alone, with their common beginnings told once; few places pass its first class."""

    def ends(rest: list[str]) -> str:
        heads: dict[str, list[str]] = {}
        for w in rest:
            heads.setdefault(w[:1], []).append(w[1:])
        parts = [re.escape(h) + ends(r) for h, r in sorted(heads.items()) if h]
        return (f"(?:{'|'.join(parts)})" + "?" * ("" in heads)) if parts else ""

    words = sorted(set(words))
    return rf"(?=[{''.join(sorted({w[0] for w in words}))}])(?<![0-9a-z_]){ends(words)}(?![0-9a-z_])"


def tech(text: Column) -> Column:
    """Canonical technology names in text, each once, sorted. Aliases of one word
    are found by one pattern in one pass; only the others need one each."""
    plain = {a: n for a, n in C.TECH.items() if re.fullmatch("[0-9a-z_]+", a)}
    names = F.create_map(*(F.lit(x) for pair in plain.items() for x in pair))

    def of(low: Column) -> Column:
        single = F.transform(F.array_distinct(F.regexp_extract_all(low, F.lit(one_of_words(plain)), F.lit(0))), lambda a: names[a])
        others = [F.when(low.contains(a) & low.rlike(ascii_boundaries(rf"\b{re.escape(a)}\b")), n) for a, n in C.TECH.items() if a not in plain]
        return F.sort_array(F.array_distinct(F.concat(single, F.array_compact(F.array(*others)))))

    return let(F.lower(F.coalesce(text, F.lit(""))), of)


def infer_type(text: Column) -> Column:
    """The type with most keyword points; the first of equals, note for none."""

    def of(low: Column) -> Column:
        scores = [(t, sum((low.contains(k).cast("int") * p for k in keywords), F.lit(0))) for t, (p, keywords) in C.TYPE_KEYWORDS.items()]
        # One struct an entry, sorted by score, then by place.
        best = F.array_max(F.array(*(F.struct(s.alias("s"), F.lit(-i).alias("i"), F.lit(t).alias("t")) for i, (t, s) in enumerate(scores))))
        return let(best, lambda b: F.when(b["s"] > 0, b["t"]).otherwise("note"))

    return let(F.lower(F.coalesce(text, F.lit(""))), of)


def relation_pattern(relation: str) -> str:
    _, _, verbs, ends = C.RELATIONS[relation]
    name = r"[\w][\w .\-]+?"
    return rf"(?i)\b({name})\s+(?:{'|'.join(verbs)})\s+({name})(?:\.|,|;|\s*\z|" + "|".join(rf"\s+{w}\s" for w in ends) + ")"


EDGES = "array<struct<rel_type:string,source:string,target:string,source_category:string,target_category:string>>"
#: No match goes past a character of another kind but one that ends it, so a text
#: is searched stretch by stretch, and only in those that have a verb.
STRETCH = r"[\w .\-\t\n\f\r]+(?:[^\w .\-\t\n\f\r]|\z)"


def _plain_verbs(verbs: tuple[str, ...]) -> tuple[str, ...]:
    """What a text has of one of the verbs in any case, without optional words."""
    return tuple(re.sub(r"\(\?:[^)]*\)\?", "", v) for v in verbs)


def relations(text: Column) -> Column:
    """Array of (rel_type, source, target, source_category, target_category)."""

    def of(relation: str, stretches: Column) -> Column:
        a, b, verbs, _ = C.RELATIONS[relation]
        # RE2's \s has no vertical tab.
        p = relation_pattern(relation).replace(r"\s", r"[\t\n\f\r ]")
        targets = lambda t: F.filter(F.transform(F.split(t, " dan | and |, |,"), lambda y: F.trim(y)), lambda y: y != "")
        edge = lambda x, y: F.struct(F.lit(relation).alias("rel_type"), F.trim(x["s"]).alias("source"), y.alias("target"), F.lit(a).alias("source_category"), F.lit(b).alias("target_category"))
        having = F.filter(stretches, lambda s: let(F.lower(s), lambda low: _any(low, _plain_verbs(verbs))))
        pairs = F.flatten(F.transform(having, lambda s: F.zip_with(found(s, p, 1), found(s, p, 2), lambda x, y: F.struct(x.alias("s"), y.alias("t")))))
        return F.flatten(F.transform(pairs, lambda x: F.transform(targets(x["t"]), lambda y: edge(x, y))))

    def every(t: Column) -> Column:
        may = let(F.lower(t), lambda low: _any(low, tuple(v for _, _, verbs, _ in C.RELATIONS.values() for v in _plain_verbs(verbs))))
        met = let(found(t, STRETCH), lambda s: F.concat(*(of(r, s) for r in C.RELATIONS)))
        return F.when(may, met).otherwise(F.array().cast(EDGES))

    out = let(F.coalesce(text, F.lit("")), every)
    return F.filter(out, lambda e: (e["source"] != "") & (F.lower(e["source"]) != F.lower(e["target"])))


#: For a secret's name, strings of which a match needs one.
SECRET_NEEDS = {
    "OpenAI Key": ("sk-",), "Anthropic Key": ("sk-ant-",), "AWS Access Key": ("AKIA",), "Bearer Token": ("Bearer ",), "GitHub Token": ("ghp_",), "GitHub PAT": ("github_pat_",),
    "JWT Token": ("eyJ",), "PostgreSQL URL": ("postgres",), "RSA Private Key": ("-----BEGIN RSA",), "EC Private Key": ("-----BEGIN EC",), "ENV Variable": ("=",),
}


def secret(text: Column) -> Column:
    """Name of the first secret pattern that matches, '' for none."""

    def of(t: Column) -> Column:
        out = F.lit("")
        for name, pattern, _ in reversed(C.SECRETS):
            hit = t.rlike(pattern.replace(r"\s", r"\t\n\f\r ") if "[^" in pattern else pattern)
            out = F.when(_any(t, SECRET_NEEDS[name]) & hit if name in SECRET_NEEDS else hit, name).otherwise(out)
        return out

    return let(F.coalesce(text, F.lit("")), of)


def censor(text: Column) -> Column:
    """All patterns replaced, one after the other, each only where a match may be."""

    def step(t: Column, i: int) -> Column:
        if i == len(C.SECRETS):
            return t
        name, pattern, replacement = C.SECRETS[i]
        new = F.regexp_replace(t, pattern, replacement)
        new = F.when(_any(t, SECRET_NEEDS[name]), new).otherwise(t) if name in SECRET_NEEDS else new
        return let(new, lambda n: step(n, i + 1))

    return let(text, lambda t: step(t, 0))


def _folding() -> tuple[str, str]:
    """Small letters with one mark and the letters without; marks alone go."""
    marked = [c for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if c.islower() and len(unicodedata.normalize("NFD", c)) == 2]
    return "".join(marked) + "".join(map(chr, range(0x300, 0x370))), "".join(unicodedata.normalize("NFD", c)[0] for c in marked)


MARKED, PLAIN = _folding()


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits without marks."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKED, PLAIN)
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def plain_terms(text: str) -> list[str]:
    """The words of a query's text, as words() has them."""
    folded = text.lower().translate(str.maketrans(MARKED[: len(PLAIN)], PLAIN, MARKED[len(PLAIN) :]))
    return re.findall(r"[^\W_]+", folded)


def terms(text: str) -> list[str]:
    """The stemmed words of a query's text, as a stemmed index has them."""
    return [stem(w) for w in plain_terms(text)]


def fields(text: Column) -> Column:
    """Lower-cased runs without white space."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Estimated tokens: a quarter of the bytes, at least one of a non-empty text."""
    n = F.octet_length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def first_bytes(text: Column, n: int) -> Column:
    """The longest beginning of text of at most n bytes that ends with a character."""

    def cut(raw: Column) -> Column:
        # A byte of 10xxxxxx goes on with the character before it.
        inside = lambda i: F.hex(F.substring(raw, i, 1)).rlike("^[89AB]")
        at = F.when(~inside(n + 1), n).when(~inside(n), n - 1).when(~inside(n - 1), n - 2).otherwise(n - 3)
        return F.substring(raw, F.lit(1), at).cast("string")

    return F.when(F.octet_length(text) > n, let(text.cast("binary"), cut)).otherwise(text)


def truncate(text: Column, n: int) -> Column:
    """Texts of more than n bytes, cut with '...' as their end to n at most."""
    return F.when(F.octet_length(text) > n, F.concat(first_bytes(text, n - 3), F.lit("..."))).otherwise(text)


def content_id(prefix: str, *parts: Column) -> Column:
    """prefix and 128 bits of a hash of some texts: of their lengths too, so that no
    two lists of texts are one where they are joined, and nulls are not empty."""
    told = [F.concat(F.coalesce(F.octet_length(p).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(p, F.lit(""))) for p in parts]
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(*told), 256), 1, 32))


def source_type(name: Column) -> Column:
    # File extension and source type.
    kinds = {"txt": "text", "md": "markdown", "json": "json", "csv": "csv"}
    out = F.lit("file")
    for extension, kind in kinds.items():
        out = F.when(F.lower(name).endswith("." + extension), kind).otherwise(out)
    return out
