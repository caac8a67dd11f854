from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from ratingloom.llm.licence_texts import BSD_2_CLAUSE, BSD_THIRD_CLAUSE, GPL_NOTICE, ISC, MIT, TEXTS
from ratingloom.llm.licences import BASE, scanned
from ratingloom.llm.q_licences import op4_licences

SCHEMA = "doc_id long, text string, l string, words int"
PROSE = "the software of a notice is in all copies and this may be a permission without any warranty or use of the rights "


def scan(spark, texts):
    rows = [(n, text, "l", n) for n, text in enumerate(texts)]
    found = scanned(spark.createDataFrame(rows, SCHEMA), "licence").collect()
    return {r["doc_id"]: r["licence"].asDict() for r in found}


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_every_whole_text_is_found_alone_and_inside_prose(spark):
    texts = [t for _, _, t in TEXTS] + [f"{PROSE * 5}{t.upper()} {PROSE * 5}" for _, _, t in TEXTS]
    found = scan(spark, texts)
    for n, (label, _, _) in enumerate(TEXTS + TEXTS):
        assert label in found[n]["labels"].split(",")
        assert found[n]["score"] == pytest.approx(1.0)


def test_an_edited_text_is_found_where_no_opening_stands(spark):
    words = MIT.split()[20:]
    edited = words[:40] + ["truly", "and", "wholly"] + words[40:70] + words[74:]
    other = [w if n % 13 else "changed" for n, w in enumerate(MIT.split()[20:])]
    found = scan(spark, [" ".join(edited), " ".join(other), PROSE + " ".join(edited) + PROSE])
    for n in (0, 2):
        assert found[n]["labels"] == "mit" and found[n]["base_labels"] == ""
        assert 0.7 < found[n]["score"] < 1
    assert found[1]["labels"] in ("", "mit")  # the key phrase may be among the changed words


def test_a_part_counts_by_its_share_and_needs_the_key_phrase(spark):
    words = ISC.split()
    keyless = " ".join(words).replace("for any purpose with or without fee", "for every end")
    found = scan(spark, [" ".join(words[7:90]), " ".join(words[:40]), keyless, " ".join(reversed(words)), PROSE * 50])
    assert found[0]["labels"] == "isc" and found[0]["score"] > 0.5
    assert found[1]["labels"] == "isc" and found[1]["score"] == 1.0  # the opening alone
    assert found[2]["labels"] in ("", "isc") and found[3]["labels"] == "" and found[4]["labels"] == ""


def test_texts_in_one_document_are_all_found(spark):
    found = scan(spark, [f"{BSD_2_CLAUSE}\n{BSD_THIRD_CLAUSE}\n{GPL_NOTICE}\n{MIT}", GPL_NOTICE.replace("General", "Affero General")])
    assert found[0]["labels"] == "bsd,bsd-3-clause,gpl,mit"
    assert found[1]["labels"] == "agpl"


def test_base_places_equal_brute_force_and_edges_are_defined(spark, tmp_path):
    texts = [None, "", "x" * 100_000, "mit " * 30_000, "the MIT License, MIT\nlicense mit license", "CC BY cc-by cc by nc", "GNU General Public License"]
    texts += ["Apache License" + " filler" * 20_000 + " apache license", "MIT Lİcense Key", "software " * 20_000]
    texts += texts[4:5]
    spark.createDataFrame([(n, t, "l", n) for n, t in enumerate(texts)], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in op4_licences(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts)
    for n, text in enumerate(texts):
        words = words_of(text)
        places = [(i, label) for p, label in BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in places]
        assert rows[n]["n_words"] == len(words) and rows[n]["n_base"] == len(places)
        assert rows[n]["first_word"] == (min(starts) if starts else None) and rows[n]["last_word"] == (max(starts) if starts else None)
        assert rows[n]["base_labels"] == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, rows[n]["base_labels"].split(","))) <= set(rows[n]["labels"].split(","))
        assert 0 <= rows[n]["score"] <= 1


def test_empty_table_null_ids_and_other_columns(spark):
    empty = scanned(spark.createDataFrame([], SCHEMA), "licence")
    assert empty.columns == ["doc_id", "text", "l", "words", "licence"] and empty.count() == 0
    one = scanned(spark.createDataFrame([(None, MIT, None, None)] * 2, SCHEMA), "licence")
    assert [r["labels"] for r in one.select(F.col("licence.labels")).collect()] == ["mit", "mit"]


def test_no_python_worker(spark):
    found = scanned(spark.createDataFrame([(1, MIT, "", 1)], SCHEMA), "licence")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert "from_json" not in plan  # the index is one constant
