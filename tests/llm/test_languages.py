"""Character models against a plain Kneser-Ney in Python; both ways of scoring; held-out accuracy; edges."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratingloom.llm.languages import ORDER, arrays, gram_counts, identified, kneser_ney, learn
from ratingloom.llm.q_languages import QUERIES
from ratingloom.staging import Workspace

SF_DIR = "/root/testdata/sf0.01"
TEXTS = {
    "aa": ["the cat sat on the mat", "a dog and a cat", "the dog ran to the cat"],
    "bb": ["der hund lief zum haus", "die katze und der hund", "ein haus und ein hund"],
}


def brute_model(texts: list[str], letters: int):
    """Probability of a letter after those before it, straight from the definition."""
    tables = {ORDER: Counter()}
    for text in texts:
        line = " " * (ORDER - 1) + text + " "
        tables[ORDER].update(line[n : n + ORDER] for n in range(len(line) - ORDER + 1))
    for k in range(ORDER - 1, 0, -1):
        tables[k] = Counter(gram[1:] for gram in tables[k + 1])
    rules = {}
    for k, table in tables.items():
        kinds = Counter(table.values())
        discount = kinds[1] / (kinds[1] + 2 * kinds[2]) if kinds[1] and kinds[2] else 0.75
        after = defaultdict(list)
        for gram, n in table.items():
            after[gram[:-1]].append(n)
        rules[k] = (table, discount, after)

    def p(gram: str) -> float:
        if not gram:
            return 1.0 / (letters + 1)
        table, d, after = rules[len(gram)]
        seen = after.get(gram[:-1])
        if not seen:
            return p(gram[1:])
        return max(table[gram] - d, 0) / sum(seen) + d * len(seen) / sum(seen) * p(gram[1:])

    return p


def code(gram: str) -> int:
    return sum(ord(c) << 16 * n for n, c in enumerate(reversed(gram)))


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame([(lang, t, False) for lang, ts in TEXTS.items() for t in ts], "lang string, text string, held boolean")


def test_probabilities_equal_the_definition(spark, labelled):
    tables = kneser_ney(gram_counts(labelled).select("lang", "gram", "n"), Workspace(spark))
    letters = len({c for ts in TEXTS.values() for t in ts for c in t} | {" "})
    grams = ["the ", " the", "cat ", "hund", " hun", "xyzq", "e ha", "atze", "   d", "qqth"]
    got = arrays(tables).probabilities(np.array([code(g) for g in grams], np.uint64))
    for n, lang in enumerate(tables.languages):
        p = brute_model(TEXTS[lang], letters)
        assert got[:, n] == pytest.approx([p(g) for g in grams], rel=1e-12)


def test_both_ways_give_the_same_answers(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(150).select("doc_id", "text", "lang")
    docs = docs.unionByName(docs.where("doc_id % 3 = 0")).unionByName(spark.createDataFrame([(None, None, None), (9, "", None), (9, "12 34", "en")], docs.schema))
    small, large = learn(docs), learn(docs, model_bytes=0)
    assert small.curve == pytest.approx(large.curve) and small.least_score == pytest.approx(large.least_score)
    rows = [sorted(identified(docs, m).select("doc_id", "text", "language.lang", F.round("language.score", 9)).collect(), key=str) for m in (small, large)]
    assert rows[0] == rows[1] and len(rows[0]) == docs.count()


def test_no_group_of_letters_is_left_out(spark):
    draw = np.random.default_rng(1)
    rows = [("zz", "".join(map(chr, draw.integers(0x4E00, 0x4E00 + 3_000, 50_000)))) for _ in range(4)]
    counts = gram_counts(spark.createDataFrame(rows, "lang string, text string").withColumn("held", F.lit(False)))
    distinct = {t[n : n + 4] for _, t in rows for n in range(len(t) - 3)}
    found = counts.agg(F.count("*"), F.sum("n")).first()
    assert len(distinct) > 150_000 and found[0] >= len(distinct) and found[1] == sum(len(t) + 1 for _, t in rows)
    tables = kneser_ney(counts.select("lang", "gram", "n"), Workspace(spark))
    assert tables.grams[-1].count() == found[0]


def test_held_out_accuracy(spark):
    found = QUERIES["op6_languages"](spark, SF_DIR).join(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang"), "doc_id")
    found = found.where("held_out AND lang IS NOT NULL AND lang_pred != 'und'")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.98


def test_edges(spark):
    schema = "text string, lang string, margin string, key string, entropy string, n string"
    rows = [(t, lang, "m", "k", "e", "n") for lang, ts in TEXTS.items() for t in ts * 2]
    docs = spark.createDataFrame([*rows, (None, "aa", *"mken"), ("", "bb", *"mken"), ("12 !", None, *"mken"), ("the cat " * 50_000, None, *"mken")], schema)
    for model_bytes in (0, 64 << 20):
        out = identified(docs, learn(docs, model_bytes=model_bytes)).collect()
        assert [tuple(r)[2:6] for r in out] == [("m", "k", "e", "n")] * len(out) or {tuple(r)[2:6] for r in out} <= {("m", "k", "e", "n"), tuple("mken")}
        for r in out:
            assert 0 <= r["language"]["score"] <= 1 and not math.isnan(r["language"]["score"])
            if r["text"] in (None, "", "12 !"):
                assert r["language"]["lang"] == "und" and r["language"]["score"] == 0
            elif r["lang"]:
                assert r["language"]["lang"] == r["lang"]
            else:
                assert r["language"]["lang"] == "aa"
    assert learn(docs.where("false")) is None
    assert {r["language"]["lang"] for r in identified(docs, None).collect()} == {"und"}


def test_equal_languages_go_to_the_first_and_one_alone_wins(spark):
    same = spark.createDataFrame([(lang, "the cat sat", "x") for lang in ("bb", "aa")], "lang string, text string, own string")
    assert {r["language"]["lang"] for r in identified(same, learn(same)).collect()} == {"aa"}
    one = same.where("lang = 'bb'")
    assert [r["language"]["lang"] for r in identified(one, learn(one)).collect()] == ["bb"]
