import re
from collections import Counter

from lodestone.llm.quality import COUNTS, RULES, judge

SCHEMA = "doc_id long, text string, row string, kept string"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered |= set(range(i, i + 8))
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_counts_of_odd_texts(spark):
    eight = "a b c d e f g h"
    texts = [
        None, "", " \n\t ", "one", eight, f"{eight} {eight}", f"{eight} x {eight}", "a " * 50, "a\nb\na\n\n\nb", "é ü\u00a0ß\x0bz\x0cy",
        "# * $ % & | < >", "same line\nsame line\nsame line", "x" * 50_000, " ".join(str(i % 97) for i in range(5_000)), eight + " h",
    ]
    got = judge(spark.createDataFrame([(i, t, "r", "k") for i, t in enumerate(texts)], SCHEMA)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r[c] for c in COUNTS) == brute(texts[r.doc_id]), texts[r.doc_id]
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r["row"] == "r" and not (r.kept and r.base_failed)


def test_rules_decide(spark):
    good = "The house of the old man is on the hill and it was for us to see that in the sun of may"
    bad = " ".join(f"{w}!!" for w in good.upper().split())
    rows = [(1, good), (1, good), (2, bad), (3, "%%% " * 30), (4, " ".join(f"zq{i}" for i in range(40)))]
    got = [(r.doc_id, r.kept) for r in judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert got == [(1, True), (1, True), (2, False), (3, False), (4, False)]
    assert judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rules_name_known_metrics(spark):
    assert {r.name for r in RULES} >= {"few_words", "symbols", "no_stop_words", "duplicate_lines"}


def test_a_filter_stays_above_the_steps(spark, sf):
    judged = judge(spark.read.parquet(f"{sf}/documents.parquet"))
    kept = judged.filter("kept and n_words > 30")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Project")
    want = sorted(r.doc_id for r in judged.collect() if r.kept and r.n_words > 30)
    assert sorted(r.doc_id for r in kept.collect()) == want
