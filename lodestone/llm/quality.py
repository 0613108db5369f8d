"""Quality rules: a threshold table compiled into one projection.

Everything is a DataFrame expression: no user functions, no shuffle. Each row
is judged from its own text, so the plan is a scan and a few projections at any
size, and a hot source or a group of copies costs nothing extra.

Limit: stop words are those of STOP_WORDS's four languages, compared with case
as it stands; clean text in other languages or in capitals is rejected.

Defined cases: a null text counts as empty; an empty text has no words and is
rejected by the word minimum; repeated rows are judged alike; an empty table
gives an empty table; extra columns pass through, and an input column with the
name of an output column is replaced.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import fresh_name, whole_text

# Frequent function words of the four languages.
STOP_WORDS = {
    "en": "the of and to in a is that for it was on with as by at from be this are or an not have has but which".split(),
    "de": "der die das und ist mit von auf für ein eine den dem im zu nicht sich des als auch es an".split(),
    "fr": "le la les de des et que qui pour dans sur un une du au avec en est pas ne il par elle".split(),
    "es": "el la los las de que y en un una por con para del se no su al lo como es".split(),
}

WINDOW = 8


class Rule(NamedTuple):
    """A document fails where the metric lies outside [least, most]."""

    name: str
    metric: str
    least: float | None
    most: float | None


#: The production thresholds. The first two are the base verdict.
RULES = (
    Rule("few_words", "n_words", 20, None),
    Rule("repeated_windows", "repeat_ratio", None, 0.30),
    Rule("word_length", "mean_word_chars", 2.0, 14.0),
    Rule("symbols", "symbol_ratio", None, 0.25),
    Rule("no_stop_words", "stop_ratio", 0.02, None),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.60),
    Rule("shouting", "shout_ratio", None, 0.50),
    Rule("stutter", "stutter_ratio", None, 0.50),
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def verdict(rules, metrics: dict[str, Column]) -> Column:
    """The rule table as one boolean column: true where every rule holds."""
    tests = []
    for rule in rules:
        if rule.metric not in metrics:
            raise ValueError(f"rule {rule.name}: unknown metric {rule.metric}")
        if rule.least is not None:
            tests.append(metrics[rule.metric] >= F.lit(rule.least))
        if rule.most is not None:
            tests.append(metrics[rule.metric] <= F.lit(rule.most))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def judge(docs: DataFrame, text: str = "text", rules=RULES, stop_words=None) -> DataFrame:
    """Each row of docs with the five counts of COUNTS, base_failed and kept.

    n_repeat_words counts the words that lie in an 8-word window occurring
    twice or more in the text. Windows are compared by a 64-bit hash of their
    words' 64-bit hashes, within one text only; that two windows of a text
    collide is accepted (about 1e-8 for a text of a million words). The result
    can be filtered as it is.
    """
    stops = sorted({w for ws in (stop_words or STOP_WORDS).values() for w in ws})
    row, t = fresh_name(docs, "row"), whole_text(text)
    own = [c for c in docs.columns if c not in (*COUNTS, "base_failed", "kept")]
    df = docs.select(F.struct(*own).alias(row), t.alias("t"))
    df = df.select(
        row,
        F.array_remove(F.split("t", r"[ \t-\r]+"), "").alias("words"),
        F.filter(F.split("t", "\n"), lambda x: F.rlike(x, F.lit(r"[^ \t-\r]"))).alias("lines"),
        (F.length("t") - F.regexp_count("t", F.lit(r"[ \t-\r]"))).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit("!!")).alias("n_shouts"),
    )
    df = df.select(
        "*",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    ).drop("words", "lines")
    df = df.select(
        "*",
        F.size(F.filter("h", lambda x: x.isin([F.xxhash64(F.lit(w)) for w in stops]))).alias("n_stops"),
        F.size(F.filter("h", lambda x, i: F.coalesce(x == F.get(F.col("h"), i + 1), F.lit(False)))).alias("n_stutters"),
    )
    at = lambda i, k: F.get(F.col("h"), i + F.lit(k))
    windows = F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)]))
    df = df.withColumn("w", F.when(F.col("n_words") > WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("any_twice", F.size(F.array_distinct("w")) < F.size("w"))
    # most texts repeat no window; only for others the windows are sorted by
    # hash, and neighbours with equal hashes give the starts of repeated ones
    ordered = F.sort_array(F.transform("w", lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
    df = df.withColumn("o", F.when(F.col("any_twice"), ordered))
    same = lambda x, j: F.coalesce(F.get(F.col("o"), j)["w"] == x["w"], F.lit(False))
    twice = F.filter("o", lambda x, k: same(x, k - 1) | same(x, k + 1))
    df = df.withColumn("s", F.sort_array(F.transform(twice, lambda x: x["i"])))
    # a repeated window adds its words that the next repeated window does not hold
    added = F.transform("s", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("s"), k + 1) - p, F.lit(WINDOW))))
    covered = F.aggregate(added, F.lit(0), lambda a, x: a + x)
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    metrics = {
        "n_words": F.col("n_words"),
        "repeat_ratio": _ratio("n_repeat_words", "n_words"),
        "mean_word_chars": _ratio("word_chars", "n_words"),
        "symbol_ratio": _ratio("n_symbols", "n_words"),
        "stop_ratio": _ratio("n_stops", "n_words"),
        "dup_line_ratio": _ratio("n_dup_lines", "n_lines"),
        "shout_ratio": _ratio("n_shouts", "n_words"),
        "stutter_ratio": _ratio("n_stutters", "n_words"),
    }
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    # always true, and not deterministic to the optimizer: so a caller's filter
    # stays above these steps, and is not pushed below them with each inlined
    barrier = F.spark_partition_id() >= 0
    return df.select(f"{row}.*", *COUNTS, failed.alias("base_failed"), (~failed & verdict(rules, metrics) & barrier).alias("kept"))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")


def _duck_ratio(a: str, b: str) -> str:
    return f"(CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0 END)"


def oracle_op7(rules=RULES) -> str:
    stops = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
    metrics = {
        "n_words": "n_words",
        "repeat_ratio": _duck_ratio("n_repeat_words", "n_words"),
        "mean_word_chars": _duck_ratio("word_chars", "n_words"),
        "symbol_ratio": _duck_ratio("n_symbols", "n_words"),
        "stop_ratio": _duck_ratio("n_stops", "n_words"),
        "dup_line_ratio": _duck_ratio("n_dup_lines", "n_lines"),
        "shout_ratio": _duck_ratio("n_shouts", "n_words"),
        "stutter_ratio": _duck_ratio("n_stutters", "n_words"),
    }
    tests = [f"{metrics[r.metric]} >= {r.least}::DOUBLE" for r in rules if r.least is not None]
    tests += [f"{metrics[r.metric]} <= {r.most}::DOUBLE" for r in rules if r.most is not None]
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t,
         regexp_extract_all(t, '[^ \t-\r]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS ls
  FROM d
), p AS (
  SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 8
), g AS (
  SELECT doc_id, i, list_aggregate(ws[i:i + 7], 'string_agg', ' ') AS g FROM p
), r AS (
  SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), c AS (
  SELECT doc_id, sum(least(8, coalesce(nx - i, 8))) AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM r) GROUP BY doc_id
), m AS (
  SELECT w.doc_id,
         len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[ \t-\r]+', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(ls) AS n_lines,
         len(regexp_extract_all(t, '!!')) AS n_shouts,
         len(list_filter(ws, lambda x: x IN ({stops}))) AS n_stops,
         len(list_filter(ws, lambda x, i: x = ws[i + 1])) AS n_stutters
  FROM w LEFT JOIN c ON w.doc_id = c.doc_id
), f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(tests)} AS kept
FROM f
"""
