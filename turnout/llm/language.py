"""Language ID by interpolated Kneser-Ney models over characters.

Letters are lower-cased and every run of other characters is one blank.  The highest order counts
four-character grams of all labelled texts per language; lower orders count distinct
continuations.  Each order lies in a sorted array of gram codes with a column per language, and
every value in it is already interpolated, so a gram that some language has seen costs one search.
The language with the lowest cross-entropy per character is taken.  A document is marked rejected
if its cross-entropy is beyond what ``ACCEPTED`` of the calibrating documents of that language have.
Where a language has ``ENOUGH`` learning documents, one in ``CALIBRATING`` of them is kept out of
the counts and calibrates; else those that were learned do.

Null texts and texts without a letter get ``und`` and score 0, as do all if nothing could be
learned.  Equal cross-entropies go to the first language in order.  A null id is not held out
and not learned from.  Repeated rows give repeated results, an empty table an empty one; other
columns are ignored.  Texts may be of any length: a text's grams are held by one task.

The model keeps every language and every gram.  Counts of all orders are derived in Spark and
written in the order of their codes.  Tasks hold ``CELLS`` grams times languages at a time: if the
model has more, it is taken in parts, a pass over the documents each, whose log-probabilities are
summed.  A part is a run of languages, or a slice of one language by the two characters before the
predicted one, with which all of a context's grams lie in one slice; single letters and pairs go
with each slice.  The driver holds four rows a language and one part.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from turnout.llm.base import apart, batched, saved
from turnout.llm.pieces import windows

ORDER = 4
#: Highest-order grams times languages in one part of the model (about 40 bytes each).
CELLS = 8_000_000
ACCEPTED = 0.999
ENOUGH = 1_000
CALIBRATING = 16
#: Characters' worth of evidence that a score stands for.
EVIDENCE = 20
#: Gram codes that a task holds before it folds them.
HELD = 4_000_000


@functools.cache
def letters() -> np.ndarray:
    """Code points of the basic plane that are letters."""
    return np.array([chr(c).isalpha() for c in range(1 << 16)])


def symbols(text: str) -> np.ndarray | None:
    """The text's letters with blanks (0) between words, behind three blanks; None without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    if len(points) and points.max() >= 1 << 16:  # other planes are folded into private code points
        far = points >= 1 << 16
        alpha = np.array([chr(c).isalpha() for c in points[far].tolist()])
        points = points.copy()
        points[far] = np.where(alpha, 0xE000 + points[far] % 0x1000, 0)
        is_letter = letters()[points] | (points >= 0xE000) & far
    else:
        is_letter = letters()[points]
    if not is_letter.any():
        return None
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    own = np.where(is_letter, points, 0)[keep]
    return np.concatenate([np.zeros(ORDER - 1, own.dtype), own, np.zeros(int(own[-1] != 0), own.dtype)])


def grams(sequence: np.ndarray) -> np.ndarray:
    """Codes of all grams of the highest order, the predicted character in the lowest bits."""
    wide = sequence.astype(np.uint64)
    code = wide[:-ORDER + 1] << np.uint64(16 * (ORDER - 1))
    for n in range(1, ORDER):
        code = code | wide[n:len(wide) - ORDER + 1 + n] << np.uint64(16 * (ORDER - 1 - n))
    return code


def remainder(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(remainder(doc_id) % 4 == 2, F.lit(False))


def gram_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``gram`` and how often it stands in all texts of ``docs``, whose ``lang`` is not null."""
    batched(docs.sparkSession)

    def fold(parts: list) -> tuple[np.ndarray, np.ndarray]:
        codes, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(codes)
        codes, counts = codes[order], counts[order]
        first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        return codes[first], np.add.reduceat(counts, first)

    def out(held: dict) -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            codes, counts = fold(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(counts.astype(np.int64))],
                ["lang", "gram", "n"])

    def run(batches):
        held: dict[str, list] = {}
        size = 0
        for batch in batches:
            texts: dict[str, list] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts.setdefault(lang, []).append(text)
            for lang, own in texts.items():
                for window in windows(own):
                    found = [grams(s) for s in map(symbols, window) if s is not None]
                    if found:
                        part = np.unique(np.concatenate(found), return_counts=True)
                        held.setdefault(lang, []).append(part)
                        size += len(part[0])
            if size > HELD:
                held = {lang: [fold(parts)] for lang, parts in held.items()}
                size = sum(len(parts[0][0]) for parts in held.values())
                if size > HELD // 2:
                    yield from out(held)
                    held, size = {}, 0
        yield from out(held)

    found = docs.select("text", "lang").filter("text IS NOT NULL").mapInArrow(run, "lang string, gram bigint, n bigint")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Order(NamedTuple):
    """Sorted gram codes with each language's probability, and contexts with the weight left to the next order."""
    codes: np.ndarray
    values: np.ndarray
    contexts: np.ndarray
    left: np.ndarray


def found(codes: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(codes, asked), len(codes) - 1)
    return at, codes[at] == asked


class Model:
    """Interpolated Kneser-Ney probabilities of some languages, or of a slice of one language.

    ``counts`` has codes in ascending order and counts per language and order, ``discounts`` a
    number per language and order, ``floor`` is the share of a letter that no language has.
    """

    def __init__(self, counts: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]], discounts: dict[tuple[str, int], float],
                 floor: float, slices: tuple[int, int] = (0, 1)):
        self.langs, self.floor, self.slices = sorted(counts), floor, slices
        self.orders: list[Order] = []
        for k in range(1, ORDER + 1):
            codes = np.unique(np.concatenate([own[k][0] for own in counts.values()]))
            contexts = np.unique(codes >> np.uint64(16))
            left = np.ones((len(contexts), len(self.langs)))
            alpha = np.zeros((len(codes), len(self.langs)))
            for n, lang in enumerate(self.langs):
                own_codes, c = counts[lang][k]
                if not len(own_codes):
                    continue
                d = discounts[lang, k]
                context = own_codes >> np.uint64(16)
                first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
                total = np.add.reduceat(c, first)
                kinds = np.diff(np.append(first, len(c)))
                alpha[np.searchsorted(codes, own_codes), n] = (c - d) / np.repeat(total, kinds)
                left[np.searchsorted(contexts, context[first]), n] = d * kinds / total
            at = np.searchsorted(contexts, codes >> np.uint64(16))
            self.orders.append(Order(codes, alpha + left[at] * self.lower(k, codes), contexts, left))
        self.logs = np.log(self.orders[-1].values).astype(np.float32)

    @staticmethod
    def mask(k: int) -> np.uint64:
        return np.uint64((1 << (16 * k)) - 1)

    def lower(self, k: int, codes: np.ndarray) -> np.ndarray:
        """Probabilities of the next lower order for codes of order ``k``."""
        if k == 1:
            return np.full((len(codes), len(self.langs)), self.floor)
        return self.of(k - 1, codes & self.mask(k - 1))

    def of(self, k: int, codes: np.ndarray) -> np.ndarray:
        order = self.orders[k - 1]
        if not len(order.codes):  # a slice without grams of this order
            return self.lower(k, codes)
        at, there = found(order.codes, codes)
        out = order.values[at]
        if not there.all():
            new = codes[~there]
            context, known = found(order.contexts, new >> np.uint64(16))
            out[~there] = np.where(known[:, None], order.left[context], 1.0) * self.lower(k, new)
        return out

    def sums(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Negative log-probability of each sequence under each language, and its characters."""
        coded = [grams(s) for s in sequences]
        sizes = np.array([len(c) for c in coded])
        codes = np.concatenate(coded)
        part, parts = self.slices
        if parts > 1:
            mine = np.flatnonzero(slice_of(codes, parts) == part)
            logs = np.zeros((len(codes), len(self.langs)), np.float32)
            logs[mine] = self.log_values(codes[mine])
        else:
            logs = self.log_values(codes)
        return -np.add.reduceat(logs, np.cumsum(sizes) - sizes, axis=0, dtype=np.float64), sizes

    def log_values(self, codes: np.ndarray) -> np.ndarray:
        top = self.orders[-1].codes
        if not len(top):
            return np.log(self.of(ORDER, codes)).astype(np.float32)
        at, there = found(top, codes)
        logs = self.logs[at]
        if not there.all():
            new, where = np.unique(codes[~there], return_inverse=True)
            logs[~there] = np.log(self.of(ORDER, new)).astype(np.float32)[where]
        return logs

    def texts(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, int] | None]:
        """Per text its sums and characters; None for texts without a letter."""
        for window in windows([t or "" for t in texts]):
            found_in = [symbols(t) for t in window]
            own = [s for s in found_in if s is not None]
            rows = iter(zip(*self.sums(own))) if own else iter(())
            yield from (None if s is None else next(rows) for s in found_in)

    def predictions(self, texts: list[str | None]) -> Iterator[tuple[str, float, float | None]]:
        """Language, score and cross-entropy of each text, by a model that is whole."""
        for row in self.texts(texts):
            if row is None:
                yield "und", 0.0, None
                continue
            e = row[0] / row[1]
            best = int(e.argmin())
            yield self.langs[best], float(1 / np.exp(-EVIDENCE * (e - e[best])).sum()), float(e[best])


def slice_of(codes, parts):
    """The slice of a gram (numpy or a column) by the two characters before the predicted one."""
    if isinstance(codes, np.ndarray):
        return (((codes >> np.uint64(16)) & np.uint64(0xFFFFFFFF)) * np.uint64(40503) >> np.uint64(8)) % np.uint64(parts)
    return F.shiftright(F.shiftright(codes, 16).bitwiseAND(0xFFFFFFFF) * 40503, 8) % parts


class Part(NamedTuple):
    """Languages of one part of the model, and which slice of how many it is."""
    langs: list[str]
    slices: tuple[int, int]


class Fitted:
    """All orders' counts as a written table, and how it is cut into parts."""

    def __init__(self, counts: DataFrame, cells: int = CELLS):
        self.counts = counts
        self.sizes = {(r["lang"], r["k"]): r for r in counts.groupBy("lang", "k").agg(
            F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).collect()}
        self.langs = sorted({lang for lang, _ in self.sizes})
        self.floor = 1.0 / (1 + max((self.sizes[lang, 1]["kinds"] for lang in self.langs), default=0))
        self.parts: list[Part] = []
        run, size = [], 0
        for lang in self.langs:
            own = self.sizes[lang, ORDER]["kinds"]
            if own > cells:
                pieces = -(-own // cells)
                self.parts += [Part([lang], (n, pieces)) for n in range(pieces)]
                continue
            if run and (size + own) * (len(run) + 1) > cells:
                self.parts.append(Part(run, (0, 1)))
                run, size = [], 0
            run, size = [*run, lang], size + own
        if run:
            self.parts.append(Part(run, (0, 1)))

    def discount(self, lang: str, k: int) -> float:
        r = self.sizes[lang, k]
        return min(0.9, max(0.1, r["once"] / max(1, r["once"] + 2 * r["twice"])))

    def model(self, part: Part) -> Model:
        """One part of the model, which holds ``CELLS`` grams times languages (and a slice's single hottest context)."""
        n, pieces = part.slices
        rows = self.counts.filter(F.col("lang").isin(part.langs))
        if pieces > 1:
            rows = rows.filter((F.col("k") <= 2) | (slice_of(F.col("gram"), pieces) == n))
        rows = rows.select("lang", "k", "gram", "n").toArrow()
        lang = pc.index_in(rows.column("lang"), pa.array(part.langs)).to_numpy()
        k, codes, c = rows.column("k").to_numpy(), rows.column("gram").to_numpy().view(np.uint64), rows.column("n").to_numpy().astype(float)
        order = np.lexsort((codes, k, lang))
        key, codes, c = (lang.astype(np.int64) * (ORDER + 1) + k)[order], codes[order], c[order]
        counts: dict[str, dict[int, tuple]] = {}
        for at, own in enumerate(part.langs):
            ends = np.searchsorted(key, at * (ORDER + 1) + np.arange(1, ORDER + 2))
            counts[own] = {i: (codes[x:y], c[x:y]) for i, x, y in zip(range(1, ORDER + 1), ends, ends[1:])}
        return Model(counts, {(own, i): self.discount(own, i) for own in part.langs for i in range(1, ORDER + 1)}, self.floor, part.slices)


def calibrates(docs: DataFrame) -> DataFrame:
    """``docs`` with ``learned`` and ``calibrating``, of which a document may be either, both or none."""
    usable = F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~F.col("held_out")
    many = docs.filter(usable).groupBy("lang").count().filter(F.col("count") >= ENOUGH).collect()  # of languages, like the model's sizes
    apart_ = F.col("lang").isin([r["lang"] for r in many])
    slice_ = apart_ & (F.floor(remainder() / 4) % CALIBRATING == 0)
    return docs.select("*", (usable & ~slice_).alias("learned"), (usable & (slice_ | ~apart_)).alias("calibrating"))


def order_counts(learned: DataFrame) -> DataFrame:
    """``lang``, order ``k``, ``gram`` and ``n``: occurrences in the highest order, below it distinct grams that end so."""
    own = saved(gram_counts(learned), "grams")
    every = own.select("lang", F.lit(ORDER).alias("k"), "gram", "n")
    for k in range(ORDER - 1, 0, -1):
        own = own.groupBy("lang", F.col("gram").bitwiseAND((1 << 16 * k) - 1).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        every = every.unionByName(own.select("lang", F.lit(k).alias("k"), "gram", "n"))
    return saved(every.repartitionByRange("lang", "k", "gram").sortWithinPartitions("lang", "k", "gram"), "orders")


def asked(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint"), held_out().alias("held_out"), "text", F.col("lang").cast("string"))


RESULT = "doc_id bigint, held_out boolean, calibrates_for string, lang_pred string, score double, cross_entropy double"


def whole(rows: DataFrame, model: Model | None) -> DataFrame:
    """Predictions of a model that has one part, or none."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in batches:
            texts = batch.column(3).to_pylist()
            found = list(own.predictions(texts)) if own else [("und", 0.0, None)] * len(texts)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([r[0] for r in found], pa.string()),
                 pa.array([r[1] for r in found], pa.float64()), pa.array([r[2] for r in found], pa.float64())],
                ["doc_id", "held_out", "calibrates_for", "lang_pred", "score", "cross_entropy"])

    return saved(rows.select("doc_id", "held_out", "calibrates_for", "text").mapInArrow(run, RESULT), "languages")


def by_parts(rows: DataFrame, model: Fitted) -> DataFrame:
    """The same by a model of several parts: a pass over the texts for each, sums met by row."""
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()), "texts")

    def part_sums(part: Part) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(model.model(part))

        def run(batches):
            for batch in batches:
                found = list(shared.value.texts(batch.column(1).to_pylist()))
                kept = [n for n, r in enumerate(found) if r is not None]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(kept, pa.int64())), pa.array([int(found[n][1]) for n in kept], pa.int64()),
                     pa.array([found[n][0].tolist() for n in kept], pa.list_(pa.float64()))], ["row", "size", "sums"])

        out = saved(rows.select("row", "text").mapInArrow(run, "row bigint, size bigint, sums array<double>"), "part")
        shared.unpersist()
        langs = F.array(*(F.lit(lang) for lang in sorted(part.langs)))
        return out.select("row", "size", F.explode(F.arrays_zip(langs.alias("lang"), F.col("sums").alias("s"))).alias("p")).select(
            "row", "size", "p.lang", "p.s")

    sums = functools.reduce(DataFrame.unionByName, map(part_sums, model.parts))
    entropies = sums.groupBy("row", "lang").agg((F.sum("s") / F.max("size")).alias("e"))
    each = entropies.groupBy("row").agg(F.collect_list("e").alias("es"), F.min(F.struct("e", "lang")).alias("best"))
    score = 1 / F.aggregate("es", F.lit(0.0), lambda total, e: total + F.exp(-EVIDENCE * (e - F.col("best.e"))))
    found_ = each.select("row", F.col("best.lang").alias("lang_pred"), score.alias("score"), F.col("best.e").alias("cross_entropy"))
    return saved(rows.drop("text").join(found_, "row", "left").select(
        "doc_id", "held_out", "calibrates_for", F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"),
        F.coalesce("score", F.lit(0.0)).alias("score"), "cross_entropy"), "languages")


def languages(docs: DataFrame, accepted: float = ACCEPTED, cells: int = CELLS) -> DataFrame:
    """Per document whether it was held out, the predicted language, a score and whether it is rejected."""
    batched(docs.sparkSession)
    rows = calibrates(asked(docs))
    model = Fitted(order_counts(rows.filter("learned")), cells)
    rows = rows.select("doc_id", "held_out", "text", F.when(F.col("calibrating"), F.col("lang")).alias("calibrates_for"))
    if len(model.parts) > 1:
        scored = by_parts(rows, model)
    else:
        scored = whole(rows, model.model(model.parts[0]) if model.parts else None)
    bound = (scored.filter("calibrates_for = lang_pred").groupBy("lang_pred")
             .agg(F.percentile_approx("cross_entropy", accepted, 10000).alias("_most")))
    return scored.join(apart(bound), "lang_pred", "left").select(
        "doc_id", "held_out", "lang_pred", "score", "cross_entropy",
        F.coalesce(F.col("cross_entropy") > F.col("_most"), F.lit(True)).alias("rejected"))
