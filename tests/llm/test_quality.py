"""Quality statistics against brute force, learned rules, and edges."""

from __future__ import annotations

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from ratingloom.llm.q_quality import op1_quality
from ratingloom.llm.quality import judged, learn_rules

DOCS, LABELS = "doc_id long, text string, n_words string, s int", "doc_id long, quality int, toxic int"


def brute_force(text: str | None) -> tuple[int, int, int, int, int, bool]:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[n : n + 5]) for n in range(len(words) - 4)]
    count, repeated = Counter(windows), set()
    for n, window in enumerate(windows):
        if count[window] > 1:
            repeated |= set(range(n, n + 5))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return len(words), sum(map(len, words)), symbols, dup, len(repeated), failed


def fixture() -> list[str | None]:
    rng = random.Random(3)
    prose = lambda n, v=500: " ".join(f"w{rng.randrange(v)}" for _ in range(n))
    texts = [prose(rng.randrange(5, 120)) for _ in range(30)] + [prose(60, 3) for _ in range(5)]
    line = prose(12)
    texts += [None, "", " \t\n", "x" * 100_000, "same " * 20_000, f"{line}\n{line}\n \n\n{line} \n{line}", "a b\x0bc\x0cd\re f g h i j"]
    texts += ["#*$%&|<> " * 12, "ä€😀 " * 11, "a b c d e " * 2, "a b c d e a b c d"]
    return texts


def write(spark, folder, texts, labels):
    rows = [(n, t, "clash", n) for n, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, LABELS).write.parquet(str(folder / "labels.parquet"))


def test_statistics_equal_brute_force(spark, tmp_path):
    texts = fixture()
    write(spark, tmp_path, texts, [])
    rows = {r["doc_id"]: r for r in op1_quality(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts)
    for n, text in enumerate(texts):
        r = rows[n]
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        assert got == brute_force(text), text and text[:80]
        assert r["kept"] == (not r["base_failed"])  # without labels the base rule decides alone


def test_a_learned_rule_rejects_what_the_base_rule_keeps(spark):
    rng = random.Random(4)
    words = [[f"word{rng.randrange(5_000)}" for _ in range(40)] for _ in range(240)]
    texts = [" ".join(w + ["$$$###"] * 4 + [f"z{n}"] if n % 3 == 0 else w) for n, w in enumerate(words)]
    docs = spark.createDataFrame([(n, t, "clash", n) for n, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(n, int(n % 3 > 0), 0) for n in range(200)] + [(5, 1, 0), (None, 0, 0), (7, None, 0)], LABELS)
    rules = learn_rules(docs, labels)
    assert rules
    found = judged(docs, rules, "verdict").select("doc_id", "n_words", "verdict.kept", "verdict.base_failed").collect()
    assert all(r["kept"] == (r["doc_id"] % 3 > 0) and not r["base_failed"] and r["n_words"] == "clash" for r in found)


def test_empty_table_null_ids_and_labels_of_one_kind(spark):
    labels = spark.createDataFrame([(n, 1, 0) for n in range(9)], LABELS)
    empty = spark.createDataFrame([], DOCS)
    assert learn_rules(empty, labels) == [] and judged(empty, [], "q").count() == 0
    docs = spark.createDataFrame([(None, " ".join(map(str, range(20))), "a", 1)] * 2, DOCS)
    assert learn_rules(docs, labels) == []
    assert [r[0] for r in judged(docs, [], "q").select(F.col("q.kept")).collect()] == [True, True]


def test_no_python_worker_and_learning_counts_labelled_texts_only(spark, tmp_path):
    write(spark, tmp_path, fixture(), [(n, n % 2, 0) for n in range(30)])
    plan = op1_quality(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert "Exchange" not in plan
