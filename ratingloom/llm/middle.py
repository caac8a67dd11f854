"""Fill-in-middle: texts cut in three at code points, with the middle moved to the end.

A batch of texts is one run of UTF-8 bytes, read as 64-bit words. The last byte of every code point is marked in a
word by arithmetic on all eight bytes at once; marks are counted per word and summed, so the k-th code point of a
text is found by a search for its word and a select inside that word. No text is decoded.

Null text is empty; empty texts and texts with a marker stay plain; repeated rows are each cut by themselves and
rows of one id alike; a null id is cut as the empty string would be. Very long texts are worked on one at a time.
An empty table gives an empty table. Columns other than the id and the text are not carried, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingloom.llm.blocks import slices
from ratingloom.llm.tables import map_batches, text_bytes, tidy

PART = 1 << 22  # bytes of text cut at a time
TOP = np.uint64(0x8080808080808080)
ONES = np.uint64(0x0101010101010101)
_1, _7, _8, _56 = (np.uint64(n) for n in (1, 7, 8, 56))


class UnitIndex:
    """Rank and select of code points over bytes of UTF-8."""

    def __init__(self, data: np.ndarray) -> None:
        padded = np.zeros((len(data) + 15) // 8 * 8, np.uint8)
        padded[: len(data)] = data
        words = padded.view("<u8")
        begins = ~(words & ~(words << _1)) & TOP  # all bytes but 10xxxxxx
        # A unit ends where the next byte begins one: the marks move down a byte, the first of the next word to the top.
        self.ends = begins >> _8
        self.ends[:-1] |= begins[1:] << _56
        self.upto = np.cumsum(np.bitwise_count(self.ends), dtype=np.int64)  # marks in a word and all before

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Units that end before byte ``at``."""
        word, bits = at >> 3, (at & 7).astype(np.uint64) * _8
        here = self.ends[word]
        below = here & ((_1 << bits) - _1)
        return self.upto[word] - np.bitwise_count(here) + np.bitwise_count(below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte after the ``k``-th unit (from 1)."""
        word = np.searchsorted(self.upto, k, "left")
        here = self.ends[word]
        left = (k - self.upto[word] + np.bitwise_count(here)).astype(np.uint64)  # 1 … 8: which mark of the word
        sums = (here >> _7) * ONES  # byte j: marks in bytes 0 … j
        reached = ((sums | TOP) - left * ONES) & TOP  # no byte borrows: both are at most 8
        return word * 8 + 9 - np.bitwise_count(reached).astype(np.int64)


@dataclass(frozen=True)
class Recipe:
    """Which texts are cut, and how the parts are put together."""

    seed: int = 1
    plain_percent: int = 10  # texts left as they are
    suffix_first_percent: int = 20  # of the others, those with the suffix first
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def marked(self, text: str | Column) -> Column:
        body = F.col(text) if isinstance(text, str) else text
        return F.contains(body, F.lit(self.prefix)) | F.contains(body, F.lit(self.suffix)) | F.contains(body, F.lit(self.middle))

    def draws(self, key: str | Column) -> list[Column]:
        """Four integers of 32 bits that depend on the seed and the key alone."""
        body = F.col(key) if isinstance(key, str) else key
        digest = F.sha2(F.concat(F.lit(f"{self.seed}:"), F.coalesce(body.cast("string"), F.lit(""))), 256)
        return [F.conv(F.substring(digest, 8 * n + 1, 8), 16, 10).cast("long") for n in range(4)]

    def form(self, text: str | Column, key: str | Column) -> Column:
        body = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
        _, _, whole, order = self.draws(key)
        plain = (body == "") | self.marked(body) | (whole % 100 >= 100 - self.plain_percent)
        return F.when(plain, "plain").when(order % 100 < self.suffix_first_percent, "spm").otherwise("psm")


def _cut(batch: pa.RecordBatch, recipe: Recipe) -> pa.RecordBatch:
    """Columns: id, text, form, two draws."""
    data, bounds = text_bytes(batch.column(1))
    index = UnitIndex(data)
    before = index.rank(bounds)
    n = np.diff(before)
    draws = [np.asarray(batch.column(c)) % (n + 1) for c in (3, 4)]
    low, high = np.minimum(*draws), np.maximum(*draws)
    cuts = []
    for units in (low, high):
        # A cut before the first unit is the row's own start, which follows no mark of this row.
        at = bounds[:-1].copy()
        some = units > 0
        at[some] = index.select((before[:-1] + units)[some])
        cuts.append(at.tolist())
    raw, edges = data.tobytes(), bounds.tolist()
    p, s, m = (mark.encode() for mark in (recipe.prefix, recipe.suffix, recipe.middle))
    made, forms = [], batch.column(2).to_pylist()
    for r, form in enumerate(forms):
        a, b, c, d = edges[r], cuts[0][r], cuts[1][r], edges[r + 1]
        if form == "plain":
            made.append(raw[a:d])
        elif form == "psm":
            made.append(b"".join((p, raw[a:b], s, raw[c:d], m, raw[b:c])))
        else:
            made.append(b"".join((s, raw[c:d], p, raw[a:b], m, raw[b:c])))
    plain = np.array([form == "plain" for form in forms], bool)
    return pa.RecordBatch.from_pydict(
        {
            "id": batch.column(0),
            "n": pa.array(n),
            "form": batch.column(2),
            "prefix_chars": pa.array(low, mask=plain),
            "middle_chars": pa.array(high - low, mask=plain),
            "output": pa.array(made, pa.binary()).cast(pa.string()),
        }
    )


def fill_in_middle(docs: DataFrame, recipe: Recipe = Recipe(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n, form, prefix_chars, middle_chars, output``: every text cut and put together again by the recipe.

    The prefix ends after the smaller of two draws from 0 … n code points, the middle after the larger.
    """
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    first, second, _, _ = recipe.draws("id")
    rows = rows.select("id", "text", recipe.form("text", "id").alias("form"), first.alias("first"), second.alias("second"))

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b in slices(text_bytes(batch.column(1))[1], PART):
            yield _cut(batch.slice(a, b - a), recipe)
        tidy()

    kind = docs.schema[key].dataType.simpleString()
    found = map_batches(
        rows, cut, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    )
    return found.withColumnRenamed("id", key)


def restore(output: str | Column, form: str | Column, recipe: Recipe = Recipe()) -> Column:
    """The text that an output was made from. Cut texts hold no marker, so the three in an output are its own."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    marks = "|".join(re.escape(m) for m in (recipe.prefix, recipe.suffix, recipe.middle))
    parts = F.split(output, marks, -1)
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )
