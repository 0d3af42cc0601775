"""License scans: ordered signature rules behind keywords, overlaps resolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize
from .license_rules import NOTICE, gates, rules

#: The phrases that each place is counted of, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
BASE_SCORE = 0.6
#: What parts words, once A-Z are lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """text's words in lower case, each between single spaces: " a b ". lower()
    changes more letters than A-Z, none of which parts words; of those only the
    Kelvin sign becomes an ASCII letter, so that stays as it is."""
    spaced = F.regexp_replace(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")), BETWEEN, " ")
    return F.lower(F.replace(spaced, F.lit("K"), F.lit("�")))


def _spaces(x: str) -> str:
    return f"(char_length({x}) - char_length(replace({x}, ' ', '')))"


def _whole(pattern: str) -> str:
    return f"(?<= )(?:{pattern})(?= )"


def _places(words: str, pattern: str) -> str:
    """SQL for the places of pattern: how many words stand before the first match,
    between matches and after the last one, and how long each match is."""
    gaps = f"transform(split({words}, {pattern}), p -> int({_spaces('p')}) - 1)"
    lens = f"transform(regexp_extract_all({words}, {pattern}, 0), m -> int({_spaces('m')}) + 1)"
    return f"'gaps', {gaps}, 'lens', {lens}"


def _hits(words: str) -> str:
    """SQL for the numbers of the rules that match. A keyword is looked up once
    for all its rules; a rule is tried only where its keyword stands."""
    by: dict[str, list[int]] = {}
    for i, rule in enumerate(rules()):
        by.setdefault(rule.keyword, []).append(i)
    groups = []
    for keyword, own in by.items():
        tried = ", ".join(f"CASE WHEN {words} RLIKE '{_whole(rules()[i].pattern)}' THEN {i} END" for i in own)
        groups.append(f"CASE WHEN contains({words}, '{keyword}') THEN array({tried}) END")
    some = " OR ".join(f"contains({words}, '{gate}')" for gate in gates())
    return f"CASE WHEN {some} THEN filter(flatten(filter(array({', '.join(groups)}), g -> g IS NOT NULL)), r -> r IS NOT NULL) ELSE CAST(array() AS array<int>) END"


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each row of docs: id, _key (of rows alike in id and text), n_words,
    the base phrases' places and words, and the places of each rule that matches."""
    patterns = "array(" + ", ".join(f"'{_whole(r.pattern)}'" for r in rules()) + ")"
    base = f"'{_whole('|'.join(BASE))}'"
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Words are made once a row; the expressions over them are parsed as SQL, which
    # has to name them, so that name is bound by a lambda.
    rows = docs.select(F.col(id_col).alias("_id"), F.md5(F.concat_ws("|", F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit("n")), F.md5(text))).alias("_key"), words_of(F.col(text_col)).alias("_words"))
    scan = F.expr(f"""transform(array(_words), w -> named_struct(
        'n_words', bigint({_spaces('w')} - 1),
        'base', CASE WHEN contains(w, ' license ') AND w RLIKE {base} THEN named_struct({_places('w', base)}, 'said', regexp_extract_all(w, {base}, 0)) END,
        'found', transform({_hits('w')}, i -> named_struct('rule', i, {_places('w', f'element_at({patterns}, i + 1)')}))))[0]""")
    return materialize(rows.select("_id", "_key", scan.alias("_s")).select("_id", "_key", "_s.*"), "licenses")


def _survivors(found: DataFrame) -> DataFrame:
    """_key, label, rule, tier, score, first_word, last_word of the detections left.

    A detection goes where its words lie within those of one of a better tier, of a
    longer one of its own tier, or of one alike of an earlier rule. In the order of
    starts, longer ones first, one running maximum of ends for each tier tells so.
    """
    spark = found.sparkSession
    known = spark.createDataFrame([(i, r.label, r.tier, r.score) for i, r in enumerate(rules())], "rule int, label string, tier int, score double")
    each = found.filter(F.size("found") > 0).dropDuplicates(["_key"]).select("_key", F.explode("found").alias("f"))
    each = each.select("_key", "f.rule", F.posexplode(F.arrays_zip(F.expr("slice(f.gaps, 1, size(f.lens))").alias("gap"), F.col("f.lens").alias("len"))).alias("pos", "p"))
    upto = Window.partitionBy("_key", "rule").orderBy("pos")
    start = F.sum("p.gap").over(upto) + F.sum("p.len").over(upto) - F.col("p.len")
    spans = each.select("_key", "rule", start.alias("start"), (start + F.col("p.len")).alias("end")).join(F.broadcast(known), "rule")
    before = Window.partitionBy("_key").orderBy("start", F.desc("end"), "tier", "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = [F.max(F.when(F.col("tier") <= t, F.col("end"))).over(before) for t in range(NOTICE + 1)]
    own = F.element_at(F.array(*reach), F.col("tier") + 1)
    left = spans.withColumn("_reach", own).filter("_reach IS NULL OR _reach < end")
    return left.select("_key", "label", "rule", "tier", "score", F.col("start").alias("first_word"), (F.col("end") - 1).alias("last_word"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The detections left in each text: id_col, label, rule (its number in the
    order of rules), tier, score, first_word and last_word (from 0, inclusive).

    Null and empty texts have none, nor has an empty table. Rows alike in id and
    text are one, null ids too. Other columns are ignored. Whole texts are searched;
    a text's detections are put in order together, nothing else is.
    """
    found = _found(docs, id_col, text_col)
    out = _survivors(found)
    ids = found.filter(F.size("found") > 0).select("_key", "_id").dropDuplicates(["_key"])
    name = fresh(out, id_col)[0]
    return out.join(ids, "_key").select(F.col("_id").alias(name), "label", "rule", "tier", "score", "first_word", "last_word").withColumnRenamed(name, id_col)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, n_words, n_base, first_word, last_word,
    base_labels, labels, score, n_found (detections left).

    n_base counts all places of the base phrases, whatever the rules leave; labels
    are theirs and those of the detections left; score is the surest one's, 0 if
    there is none. Texts without any aren't shuffled. Null texts count as empty: no
    words, no labels. Rows that repeat are each returned, null ids too; other
    columns are ignored; an empty table gives no rows.
    """
    found = _found(docs, id_col, text_col)
    left = _survivors(found).groupBy("_key").agg(F.collect_set("label").alias("_labels"), F.max("score").alias("_score"), F.count(F.lit(1)).alias("_n"))
    some = F.size("found") > 0
    none = found.filter(~some).withColumns({"_labels": F.array().cast("array<string>"), "_score": F.lit(0.0), "_n": F.lit(0).cast("long")})
    rows = none.unionByName(found.filter(some).join(left, "_key"))
    said = F.coalesce(F.transform("base.said", lambda x: F.element_at(F.create_map(*(F.lit(v) for kv in BASE.items() for v in kv)), x)), F.array().cast("array<string>"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    n_base = F.coalesce(F.size("base.lens").cast("long"), F.lit(0).cast("long"))
    last = F.col("n_words") - F.element_at("base.gaps", -1) - F.element_at("base.lens", -1)
    return rows.select(
        F.col("_id").alias(id_col), "n_words", F.when(F.col("base").isNull(), F.lit(0).cast("long")).otherwise(n_base).alias("n_base"),
        F.element_at("base.gaps", 1).cast("long").alias("first_word"), last.cast("long").alias("last_word"),
        joined(said).alias("base_labels"), joined(F.concat(said, "_labels")).alias("labels"),
        F.greatest(F.col("_score"), F.when(F.col("base").isNotNull(), F.lit(BASE_SCORE)).otherwise(F.lit(0.0))).alias("score"), F.col("_n").alias("n_found"),
    )
