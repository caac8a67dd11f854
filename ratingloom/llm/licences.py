"""Find licence phrases and texts in documents with a positional index of rare words.

Licences are known by titles, a few words that must all stand, and by whole texts, of which parts may be edited or missing. The
index holds the positions of each text's words, rarest first by inverse document frequency over the whole corpus.
Within a row, a text is looked at if all words of its mandatory key phrase occur. The row's ``RARE`` highest-IDF words of
that text are looked up; their postings are intersected by relative position (word place minus position in the text gives
the place where the text begins), and a beginning counts if at least two postings agree on it. An edit moves what follows it,
so one copy may have several beginnings. The key phrase must stand word by word at one of them; the score is then the
weight of the text's words that stand at their place from any of them, as a share of the weight of the whole text.

Everything happens within a row, so nothing is shuffled but the frequencies of the licences' words. Null and empty texts
have no words; a very long text is looked at whole, in time that grows with its hits. Repeated rows get equal results; other
columns are kept. On an empty table all words count as equally rare.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingloom.llm.arrays import indices, let
from ratingloom.llm.licence_texts import TEXTS

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANCHORS = 3
LEAST_SCORE = 0.8  # of the weight of a title or an opening
RARE = 16  # words of a whole text that are looked up
LEAST_SHARE = 0.5  # of a whole text's weight
KNOWN = "array<struct<label:string,words:array<string>,rare:array<string>,weight:array<double>,key:array<string>,key_at:int>>"
PLACES = "array<struct<label:string,base:boolean,start:int,score:double>>"

# The phrases that the contract names, with their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Further templates as label, opening words of the licence, and the key phrase that must stand in it.
TEMPLATES = [
    ("agpl", "gnu affero general public license", "gnu affero general public license"),
    ("lgpl", "gnu lesser general public license", "gnu lesser general public license"),
    ("mpl", "mozilla public license", "mozilla public license"),
    ("epl", "eclipse public license", "eclipse public license"),
    ("cc-by-nc", "cc by nc", "cc by nc"),
    ("cc-by-sa", "cc by sa", "cc by sa"),
    ("cc-by", "creative commons attribution", "creative commons attribution"),
    ("cc0", "cc0 1 0 universal", "cc0 1 0 universal"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "copy modify and or distribute"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("zlib", "this software is provided as is without any express or implied warranty", "without any express or implied warranty"),
]


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key: tuple[str, ...]
    base: bool

    @property
    def key_at(self) -> int:
        return next(n for n in range(len(self.words)) if self.words[n : n + len(self.key)] == self.key)


def templates() -> list[Template]:
    named = [(label, phrase, phrase, True) for phrase, label in BASE.items()] + [(*t, False) for t in TEMPLATES]
    return [Template(label, tuple(body.split()), tuple(key.split()), base) for label, body, key, base in named]


def licence_words(text: Column) -> Column:
    """Words of a text with A-Z in lower case. The Kelvin sign, the one other letter whose lower case is ASCII, is replaced first."""
    lower = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("κ")))
    return F.filter(F.split(lower, BREAKS), lambda w: w != "")


def whole_texts() -> list[Template]:
    cut = [(label, tuple(w for w in re.split(BREAKS, body.lower()) if w), tuple(key.split())) for label, key, body in TEXTS]
    return [Template(label, words, key, False) for label, words, key in cut]


def licence_vocabulary() -> list[str]:
    return sorted({w for t in templates() + whole_texts() for w in t.words})


def word_frequencies(docs: DataFrame, text: str = "text") -> tuple[int, dict[str, int]]:
    """Number of documents, and of those that have each word of a licence; both over the whole corpus."""
    known = licence_vocabulary()
    found = docs.select(F.array_distinct(F.filter(licence_words(F.col(text)), lambda w: w.isin(known))).alias("w"))
    rows = found.select(F.explode(F.array_append("w", "")).alias("w")).groupBy("w").count().collect()  # one row per known word
    counts = {r["w"]: r["count"] for r in rows}
    return counts.pop("", 0), counts


def weights(n_docs: int, counts: dict[str, int]) -> dict[str, float]:
    return {w: math.log((n_docs + 1) / (counts.get(w, 0) + 1)) + 1 for w in licence_vocabulary()}


def text_index(idf: dict[str, float]) -> Column:
    """The whole texts as one constant: words in order, distinct words from the rarest on, weights that add up to one."""
    rows = []
    for t in whole_texts():
        total = sum(idf[w] for w in t.words)
        rare = sorted(set(t.words), key=lambda w: (-idf[w], w))
        shares = [idf[w] / total for w in t.words]
        rows.append({"label": t.label, "words": t.words, "rare": rare, "weight": shares, "key": t.key, "key_at": t.key_at})
    return F.from_json(F.lit(json.dumps(rows)), KNOWN)


def beginnings(t: Column, ws: Column, hits: Column, here: Column) -> Column:
    """Places where a whole text begins, as at least two postings of the row's rarest words of it say."""

    def postings(rare: Column) -> Column:
        mine = F.filter(hits, lambda i: F.array_contains(rare, F.get(ws, i)))
        at = indices(F.size(t["words"]))
        return F.flatten(F.transform(mine, lambda i: F.transform(F.filter(at, lambda n: F.get(t["words"], n) == F.get(ws, i)), lambda n: i - n)))

    def agreed(starts: Column) -> Column:
        return F.array_distinct(F.filter(starts, lambda s, n: (n > 0) & (F.get(starts, F.greatest(n - 1, F.lit(0))) == s)))

    return let(F.slice(F.array_intersect(t["rare"], here), 1, RARE), lambda rare: let(F.array_sort(postings(rare)), agreed))


def text_place(t: Column, ws: Column, starts: Column) -> Column:
    """Where the key phrase of a whole text stands, if it does, and the share of the text that is there."""
    size = F.size(t["key"])
    keyed = F.filter(starts, lambda s: (s + t["key_at"] >= 0) & (F.slice(ws, F.greatest(s + t["key_at"] + 1, F.lit(1)), size) == t["key"]))

    def share(n: Column) -> Column:
        stands = F.exists(starts, lambda s: (s + n >= 0) & (F.get(ws, F.greatest(s + n, F.lit(0))) == F.get(t["words"], n)))
        return F.when(stands, F.get(t["weight"], n)).otherwise(F.lit(0.0))

    def place(first: Column) -> Column:
        score = F.aggregate(indices(F.size(t["words"])), F.lit(0.0), lambda x, n: x + share(n))
        return F.struct(t["label"].alias("label"), F.lit(False).alias("base"), first.alias("start"), F.least(score, F.lit(1.0)).alias("score"))

    return let(F.array_min(keyed), lambda first: F.when(first.isNotNull(), place(first)))


def text_places(index: Column, ws: Column, hits: Column) -> Column:
    """The whole texts that stand in a row, at least as far as their score says."""

    def looked_up(here: Column) -> Column:
        likely = F.filter(index, lambda t: F.size(F.array_except(t["key"], here)) == 0)
        found = F.transform(likely, lambda t: let(beginnings(t, ws, hits, here), lambda starts: text_place(t, ws, starts)))
        return F.filter(found, lambda p: p["score"] >= LEAST_SHARE)

    return let(F.array_distinct(F.transform(hits, lambda i: F.get(ws, i))), looked_up)


def _postings(t: Template, idf: dict[str, float]) -> list[tuple[str, int]]:
    """The key phrase's rarest word first, which every true place has; then the template's rarest other words."""
    inside = range(t.key_at, t.key_at + len(t.key))
    first = max(inside, key=lambda n: (idf[t.words[n]], -n))
    rest = sorted((n for n in range(len(t.words)) if n != first), key=lambda n: (-idf[t.words[n]], n))
    return [(t.words[n], n) for n in [first, *rest[: ANCHORS - 1]]]


def _starts(t: Template, idf: dict[str, float], ws: Column, hits: Column) -> Column:
    """Template starts at which the key phrase stands."""
    word, at = _postings(t, idf)[0]
    low, key = t.key_at, F.array(*[F.lit(w) for w in t.key])

    def stands(s: Column) -> Column:
        return (s + low >= 0) & (F.slice(ws, F.greatest(s + low + 1, F.lit(1)), F.lit(len(t.key))) == key)

    return F.filter(F.transform(F.filter(hits, lambda i: F.get(ws, i) == word), lambda i: i - at), stands)


def _score(t: Template, idf: dict[str, float], ws: Column, start: Column) -> Column:
    """Share of the template's weight that stands at its place, if enough of its rare words do."""

    def there(n: int, word: str) -> Column:
        return (start + n >= 0) & F.coalesce(F.get(ws, start + n) == word, F.lit(False))

    total = sum(idf[w] for w in t.words)
    share = reduce(lambda a, b: a + b, [F.when(there(n, w), F.lit(idf[w] / total)).otherwise(F.lit(0.0)) for n, w in enumerate(t.words)])
    anchors = _postings(t, idf)
    agreeing = reduce(lambda a, b: a + b, [there(n, w).cast("int") for w, n in anchors])
    return F.when(agreeing * 2 > len(anchors), F.least(share, F.lit(1.0))).otherwise(F.lit(0.0))


def scan(text: Column, idf: dict[str, float]) -> Column:
    """A struct of n_words, starts of base phrases, base labels, all labels and the best score."""
    known = templates()
    rare, vocabulary = sorted({_postings(t, idf)[0][0] for t in known}), licence_vocabulary()
    index = text_index(idf)

    def places(t: Template, ws: Column, hits: Column) -> Column:
        def place(s: Column) -> Column:
            score = F.lit(1.0) if t.words == t.key else _score(t, idf, ws, s)
            return F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), s.alias("start"), score.alias("score"))

        return F.transform(_starts(t, idf, ws, hits), place)

    def found(ws: Column, hits: Column) -> Column:
        titles = F.concat(*[places(t, ws, F.filter(hits, lambda i: F.get(ws, i).isin(rare))) for t in known]).cast(PLACES)
        titles = F.filter(titles, lambda p: p["score"] >= LEAST_SCORE)
        return F.when(F.size(hits) > 0, F.concat(titles, text_places(index, ws, hits).cast(PLACES))).otherwise(F.array().cast(PLACES))

    def result(ws: Column, places: Column) -> Column:
        base = F.transform(F.filter(places, lambda p: p["base"]), lambda p: p["start"].cast("long"))
        names = F.transform(F.filter(places, lambda p: p["base"]), lambda p: p["label"])
        every = F.transform(places, lambda p: p["label"])
        join = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            base.alias("base_starts"),
            join(names).alias("base_labels"),
            join(every).alias("labels"),
            F.coalesce(F.array_max(F.transform(places, lambda p: p["score"])), F.lit(0.0)).alias("score"),
        )

    return let(
        licence_words(text),
        lambda ws: let(
            F.filter(indices(F.size(ws)), lambda i: F.get(ws, i).isin(vocabulary)),
            lambda hits: let(found(ws, hits), lambda there: result(ws, there)),
        ),
    )


def scanned(docs: DataFrame, name: str = "licence", text: str = "text") -> DataFrame:
    """``docs`` with what was found in one struct column."""
    return docs.withColumn(name, scan(F.col(text), weights(*word_frequencies(docs, text))))
