"""Language identification with interpolated Kneser-Ney models of characters.

A text is its lower-case letters, with one space for anything else. Counts of four letters, continuation counts of shorter groups,
discounts and probabilities are Spark aggregations and joins over all groups of letters of all labelled texts; none is left out. Where the
finished model is known to fit into ``MODEL_BYTES`` it is broadcast as sorted arrays of packed letters, one for each order. Where
it does not, the groups of letters of the texts are joined to its tables and summed up by text; both ways give the same results. A
text gets the language of least cross-entropy per letter. The margin to the next one gives a score by a logistic curve. The curve, and the
score from which ``precision`` of the texts are right, come from margins of all texts of a tenth of the labelled ones, judged by a model that is
fitted to the other nine tenths; without such evidence the curve is the plain logistic one and the least score ``LEAST``.
Texts below it are marked as rejected.

Null texts and texts without letters are ``und`` with score 0, and so are all texts if nothing was learned (an empty table). Ties go to
the first language in alphabetical order. Repeated rows get equal results, very long texts are read whole; no column but the text takes
part, and further columns may have any name but that of the result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingloom.llm.blocks import slices
from ratingloom.llm.tables import per_process, share, text_bytes, tidy
from ratingloom.staging import Workspace

ORDER = 4
MODEL_BYTES = 64 << 20
HELD, LEAST = 10, 0.5
PART = 1 << 21
SPACE = 32


def _letters() -> np.ndarray:
    """Every code point's lower-case letter in 16 bits, or a space; letters beyond 16 bits share the surrogates' places."""
    table = np.full(0x110000, SPACE, np.uint16)
    for n in range(0x110000):
        if (c := chr(n)).isalpha():
            low = ord(c.lower()[0])
            table[n] = low if low < 0x10000 else 0xD800 + (low & 0x7FF)
    return table


def windows(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed ``ORDER`` letters that end at each letter or closing space, each row's first one, and its number of letters."""
    table = per_process("letters", _letters)
    lead = (data & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(lead)])[bounds]
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    letters = table[points]
    counts = np.diff(chars)
    n_letters = np.concatenate([[0], np.cumsum(letters != SPACE)])[chars]
    keep = np.ones(len(letters), bool)
    keep[1:] = (letters[1:] != SPACE) | (letters[:-1] != SPACE)
    starts = chars[:-1][counts > 0]
    keep[starts] = letters[starts] != SPACE
    kept = np.concatenate([[0], np.cumsum(keep)])[chars]
    size = np.diff(kept)
    room = size + ORDER
    at = np.cumsum(room) - room
    line = np.full(int(room.sum()), SPACE, np.uint16)
    rows = np.repeat(np.arange(len(size)), size)
    line[np.arange(len(rows)) - kept[rows] + at[rows] + ORDER - 1] = letters[keep]
    packed = np.zeros(max(len(line) - ORDER + 1, 0), np.uint64)
    for k in range(ORDER):
        packed = packed << np.uint64(16) | line[k : k + len(packed)]
    valid = np.ones(len(line), bool)
    for k in range(1, ORDER):
        valid[np.cumsum(room) - k] = False
    first = at - np.arange(len(size)) * (ORDER - 1)
    return packed[valid[: len(packed)]], np.append(first, int(size.sum()) + len(size)), np.diff(n_letters)


def _parts(texts: pa.Array) -> Iterator[tuple[int, int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    data, bounds = text_bytes(texts)
    for a, b in slices(bounds, PART):
        yield a, b, windows(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
    tidy()


def gram_counts(labelled: DataFrame) -> DataFrame:
    """Counts of letter groups by language, from columns lang, held and text: of all rows, and of those not held out."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, held = np.array(batch.column(0).to_pylist(), object), np.array(batch.column(1), bool)
            for a, b, (packed, first, n_letters) in _parts(batch.column(2)):
                row = np.repeat(np.arange(b - a), np.diff(first))
                for lang in sorted(set(names[a:b])):
                    mine = ((names[a:b] == lang) & (n_letters > 0))[row]
                    grams, at = np.unique(packed[mine], return_inverse=True)
                    rest = np.bincount(at, ~held[a:b][row[mine]], len(grams)).astype(np.int64)
                    columns = {"gram": grams.view(np.int64), "n": np.bincount(at, minlength=len(grams)), "rest": rest}
                    yield pa.RecordBatch.from_pydict({"lang": [lang] * len(grams)} | columns)

    found = labelled.select("lang", "held", "text").mapInArrow(each, "lang string, gram long, n long, rest long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("rest").alias("rest"))


def _last(gram: Column | str, k: int) -> Column:
    """The last ``k`` letters of a group."""
    gram = F.col(gram) if isinstance(gram, str) else gram
    return gram.bitwiseAND(F.lit((1 << 16 * k) - 1)) if k < 4 else gram


@dataclass
class Tables:
    """Kneser-Ney models as tables: for each order, from 1, ``grams`` (lang, gram, p) and ``contexts`` (lang, context, share)."""

    languages: list[str]
    grams: list[DataFrame]
    contexts: list[DataFrame]
    floor: float
    entries: int

    @property
    def dense_bytes(self) -> int:
        """Most bytes that sorted arrays with a column for each language can take."""
        return self.entries * 8 * (1 + len(self.languages))


def kneser_ney(counts: DataFrame, space: Workspace) -> Tables | None:
    """Interpolated Kneser-Ney probabilities from columns lang, gram and n; none without rows."""
    by_order = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct letters before a group
        by_order[k] = space.stage(by_order[k + 1].groupBy("lang", _last("gram", k).alias("gram")).agg(F.count("*").alias("n")), "letters")
    languages = sorted(r["lang"] for r in by_order[1].select("lang").distinct().collect())  # one row per language
    if not languages:
        return None
    floor = 1.0 / (by_order[1].select("gram").distinct().count() + 1)
    grams: list[DataFrame] = []
    contexts: list[DataFrame] = []
    for k in range(1, ORDER + 1):
        one, two = (F.count_if(F.col("n") == c) for c in (1, 2))
        discount = F.when((one > 0) & (two > 0), one / (one + 2 * two)).otherwise(0.75).alias("d")
        discounts = by_order[k].groupBy("lang").agg(discount)  # one row per language
        context = F.shiftrightunsigned("gram", 16).alias("context")
        totals = by_order[k].groupBy("lang", context).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        totals = totals.join(discounts, "lang")
        totals = space.stage(totals.select("lang", "context", "total", "d", (F.col("d") * F.col("kinds") / F.col("total")).alias("share")), "contexts")
        rows = by_order[k].select("lang", "gram", "n", context).join(totals, ["lang", "context"])
        lower = F.lit(floor)
        if grams:
            shorter = grams[-1].select("lang", F.col("gram").alias("shorter"), F.col("p").alias("lower"))
            rows = rows.withColumn("shorter", _last("gram", k - 1)).join(shorter, ["lang", "shorter"])
            lower = F.col("lower")
        p = F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("share") * lower
        grams.append(space.stage(rows.select("lang", "gram", p.alias("p")), "grams"))
        contexts.append(totals.select("lang", "context", "share"))
    entries = sum(t.count() for t in (*grams, *contexts))
    return Tables(languages, grams, contexts, floor, entries)


@dataclass
class Level:
    """Sorted packed letters of one order: probability of the last one, and the share left to lower orders after them, by language."""

    grams: np.ndarray
    probability: np.ndarray
    contexts: np.ndarray
    share: np.ndarray

    def find(self, table: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Places of keys in a sorted array, or -1."""
        if not len(table):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[at] == keys, at, -1)


@dataclass
class Arrays:
    """The tables of a small model as sorted arrays."""

    languages: list[str]
    levels: list[Level]  # from ORDER down to 1
    floor: float

    def probabilities(self, packed: np.ndarray, depth: int = 0) -> np.ndarray:
        """Probability of each group's last letter after the others, by language."""
        if depth == len(self.levels):
            return np.full((len(packed), len(self.languages)), self.floor)
        level = self.levels[depth]
        at = level.find(level.grams, packed)
        out = level.probability[at]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            after = packed[miss] >> np.uint64(16)
            context = level.find(level.contexts, after)
            share = np.where((context >= 0)[:, None], level.share[context], 1.0)
            shorter = packed[miss] & np.uint64((1 << 16 * (ORDER - depth - 1)) - 1)
            out[miss] = share * self.probabilities(shorter, depth + 1)
        return out

    def entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per letter of every text by language, and its number of letters."""
        found, letters = [], []
        for _, _, (packed, first, n_letters) in _parts(texts):
            total = np.zeros((len(first) - 1, len(self.languages)))
            if len(packed):
                total = -np.add.reduceat(np.log(self.probabilities(packed)), first[:-1], axis=0)
            found.append(total / np.maximum(np.diff(first), 1)[:, None])
            letters.append(n_letters)
        return np.concatenate(found), np.concatenate(letters)



def arrays(tables: Tables) -> Arrays:
    """Sorted arrays of all orders, for a model that is known to be small."""
    column = {lang: n for n, lang in enumerate(tables.languages)}
    levels: list[Level] = []

    def parts(table: DataFrame, key: str, value: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = table.select("lang", key, value).toArrow()
        of = np.array([column[x] for x in found.column(0).to_pylist()], np.int64)
        return of, found.column(1).to_numpy().view(np.uint64), found.column(2).to_numpy()

    for k in range(1, ORDER + 1):
        of, gram, p = parts(tables.grams[k - 1], "gram", "p")
        context_of, context, share_left = parts(tables.contexts[k - 1], "context", "share")
        grams, contexts = np.unique(gram), np.unique(context)
        shares = np.ones((len(contexts), len(column)))
        shares[np.searchsorted(contexts, context), context_of] = share_left
        shorter = grams & np.uint64((1 << 16 * (k - 1)) - 1)
        lower = Arrays(tables.languages, list(levels), tables.floor).probabilities(shorter) if levels else tables.floor
        probability = shares[np.searchsorted(contexts, grams >> np.uint64(16))] * lower
        probability[np.searchsorted(grams, gram), of] = p
        levels.insert(0, Level(grams, probability, contexts, shares))
    return Arrays(tables.languages, levels, tables.floor)


@dataclass
class Model:
    tables: Tables
    curve: tuple[float, float] = (0.0, 1.0)
    least_score: float = LEAST
    model_bytes: int = MODEL_BYTES


def _own(label: str) -> str:
    return f"{label}_{uuid.uuid4().hex}"


def _entropies(docs: DataFrame, model: Model, text: str, name: str) -> DataFrame:
    """``docs`` with a struct of cross-entropies per letter by language, in their order, and the number of letters."""
    if model.tables.dense_bytes <= model.model_bytes:
        shared = share(docs.sparkSession, arrays(model.tables))

        @F.arrow_udf("struct<entropy:array<double>,letters:long>")
        def judge(texts: pa.Array) -> pa.Array:
            entropy, letters = shared().entropies(texts) if len(texts) else (np.zeros((0, 1)), np.zeros(0, np.int64))
            width = entropy.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(entropy) + 1, dtype=np.int32) * width), pa.array(entropy.ravel()))
            return pa.StructArray.from_arrays([lists, pa.array(letters.astype(np.int64))], ["entropy", "letters"])

        return docs.withColumn(name, judge(F.col(text)))
    key = _own("key")
    keyed = docs.withColumn(key, F.sha2(F.col(text), 256))
    texts = keyed.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")).dropDuplicates(["key"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, (packed, first, n_letters) in _parts(batch.column(1)):
                order = np.lexsort((packed, row := np.repeat(np.arange(b - a), np.diff(first))))
                row, packed = row[order], packed[order]
                new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (packed[1:] != packed[:-1]))[: len(row)])
                columns = {
                    "key": batch.column(0).slice(a, b - a).take(pa.array(row[new])),
                    "gram": packed[new].view(np.int64),
                    "n": np.diff(np.append(new, len(row))),
                    "letters": n_letters[row[new]].astype(np.int64),
                }
                yield pa.RecordBatch.from_pydict(columns)

    space = Workspace(docs.sparkSession)
    grams = space.stage(texts.mapInArrow(spread, "key string, gram long, n long, letters long"), "texts")
    costs = space.stage(_costs(grams.select("gram").distinct(), model.tables), "costs")
    width = range(len(model.tables.languages))
    sums = [F.sum(F.col("n") * F.get("costs", F.lit(n))).alias(f"s{n}") for n in width]
    summed = grams.join(costs, "gram").groupBy("key").agg(*sums, F.sum("n").alias("n"), F.max("letters").alias("letters"))
    entropy = F.array(*[F.col(f"s{n}") / F.col("n") for n in width]).alias("entropy")
    summed = summed.select(F.col("key").alias(key), F.struct(entropy, "letters").alias(name))
    return keyed.join(summed, key, "left").drop(key)


def _costs(grams: DataFrame, tables: Tables) -> DataFrame:
    """Minus the logarithm of the last letter's probability for each group of letters, by language."""
    names = F.array(*[F.lit(x) for x in tables.languages])
    rows = grams.select("gram", F.explode(names).alias("lang"))
    p = F.lit(tables.floor)
    for k in range(1, ORDER + 1):
        own, share_left = f"p{k}", f"share{k}"
        known = tables.grams[k - 1].select("lang", F.col("gram").alias(f"g{k}"), F.col("p").alias(own))
        left = tables.contexts[k - 1].select("lang", F.col("context").alias(f"c{k}"), F.col("share").alias(share_left))
        last = _last("gram", k)
        rows = rows.withColumns({f"g{k}": last, f"c{k}": F.shiftrightunsigned(last, 16)})
        rows = rows.join(known, ["lang", f"g{k}"], "left").join(left, ["lang", f"c{k}"], "left").drop(f"g{k}", f"c{k}")
        p = F.coalesce(F.col(own), F.coalesce(F.col(share_left), F.lit(1.0)) * p)
    found = rows.select("gram", F.struct("lang", (-F.log(p)).alias("cost")).alias("x")).groupBy("gram")
    return found.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["cost"]).alias("costs"))  # one entry per language


def _margins(docs: DataFrame, model: Model, text: str, name: str) -> DataFrame:
    """``docs`` with a struct of best language, lead over the next one, and number of letters."""
    entropy, letters = F.col(name)["entropy"], F.coalesce(F.col(name)["letters"], F.lit(0))
    ordered = F.array_sort(entropy)
    lead = (F.get(ordered, F.lit(1)) - F.get(ordered, F.lit(0))) * F.sqrt(F.least(letters, F.lit(10_000)))
    if len(model.tables.languages) < 2:
        lead = F.lit(1.0)
    names = F.array(*[F.lit(x) for x in model.tables.languages])
    best = F.get(names, (F.array_position(entropy, F.array_min(entropy)) - 1).cast("int"))
    return _entropies(docs, model, text, name).withColumn(name, F.struct(best.alias("lang"), lead.alias("margin"), letters.alias("letters")))


def learn(labelled: DataFrame, precision: float = 0.99, model_bytes: int = MODEL_BYTES) -> Model | None:
    """Fit to rows of lang and text; rows that lack either are ignored."""
    space = Workspace(labelled.sparkSession)
    held = (F.pmod(F.xxhash64("text", F.lit(7)), F.lit(HELD)) == 0).alias("held")
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", held, "text")
    counts = space.stage(gram_counts(rows), "counts")
    whole = kneser_ney(counts.select("lang", "gram", "n"), space)
    if whole is None:
        return None
    model = Model(whole, model_bytes=model_bytes)
    rest = kneser_ney(counts.where("rest > 0").select("lang", "gram", F.col("rest").alias("n")), space)
    if rest is None:
        return model
    step = F.round(F.log1p(F.col("m.margin")) * 64).cast("int").alias("step")
    judged = _margins(rows.where("held").select("lang", "text"), replace(model, tables=rest), "text", "m").where("m.letters > 0")
    steps = judged.groupBy(step).agg(F.count("*").alias("n"), F.count_if(F.col("lang") == F.col("m.lang")).alias("ok")).orderBy("step").collect()
    if not steps:  # at most a few hundred steps: margins are below 10,000
        return model
    x, n, ok = (np.array([r[k] for r in steps], float) for k in ("step", "n", "ok"))
    x = np.expm1(x / 64)
    curve = _logistic(x, ok, n)
    right = np.cumsum(ok[::-1])[::-1] / np.cumsum(n[::-1])[::-1]
    good = np.flatnonzero(right >= precision)
    least = 1 / (1 + np.exp(-np.clip(curve[0] + curve[1] * x[good[0]], -30, 30))) if len(good) else 1.0
    return replace(model, curve=curve, least_score=float(least))


def _logistic(x: np.ndarray, ok: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton steps for ``ok`` of ``n`` texts at each margin, drawn a little towards 0 and 1."""
    a, b = 0.0, 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w, off = n * p * (1 - p), ok - n * p
        g = np.array([off.sum() - 1e-2 * a, (off * x).sum() - 1e-2 * (b - 1)])
        h = np.array([[w.sum() + 1e-2, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(max(b, 0.0))


def identified(docs: DataFrame, model: Model | None, text: str = "text", name: str = "language") -> DataFrame:
    """``docs`` with a struct column: lang, score, rejected."""
    if model is None:
        return docs.withColumn(name, F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")))
    own = _own("margin")
    a, b = model.curve
    some = F.col(own)["letters"] > 0
    curve = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), a + b * F.col(own)["margin"]))))
    score = F.when(some, curve).otherwise(0.0)
    lang = F.when(some, F.col(own)["lang"]).otherwise("und")
    found = F.struct(lang.alias("lang"), score.alias("score"), (score < model.least_score).alias("rejected"))
    return _margins(docs, model, text, own).withColumn(name, found).drop(own)
