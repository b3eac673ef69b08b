"""Quality rules: exact statistics of every text, and robust outliers by language and source.

Base rules fail documents of fewer than ten words and those where over a fifth of the words lie in
repeated five-word windows.  The others are held against the minimum covariance determinant
estimate of their language and source: from two starts (medians with quartile ranges, and all
rows' moments), concentration steps keep the three quarters of rows that lie nearest and estimate
again; per group the start that ends with the smaller determinant is taken.  A document goes if its
squared Mahalanobis distance exceeds ``CUT``.

The vector is: log of the mean word length, asinh of ten times the symbols per word, share of
repeated lines, log of distinct words over log of words, share of words in repeated windows.
``NOISE`` variances are added to every covariance, so statistics that are constant in a group
do not make every other value an outlier.  Groups of fewer than ``MEMBERS`` fitted documents use
the estimate of their language, or if that is small too, of all documents.

Only DataFrame functions are used.  Order statistics come from histograms, which add up the same
however rows are dealt out.  Windows are compared by 64-bit hashes within one text.

Null texts have no words and fail.  A null language or source is a group of its own.  Repeated
rows are judged alike; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from turnout.llm.base import saved

LEAST_WORDS = 10
REPEATED = 20
WINDOW = 5
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
NOISE = (0.15, 0.3, 0.1, 0.04, 0.05)
KEPT_SHARE = 0.75
#: Makes the covariance of the central three quarters that of all rows of a five-variate normal.
CONSISTENCY = 1.41
STEPS = 3
CUT = 40.0
MEMBERS = 50
SALTS = 16
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
P = len(NOISE)
X = [f"x{n}" for n in range(P)]
CELLS = list(combinations_with_replacement(range(P), 2))
KEY = ["level", "lang", "source"]
ANY = "∅"


def _sum(terms) -> Column:
    return reduce(lambda a, b: a + b, terms)


def statistics(docs: DataFrame, whole: bool = False) -> DataFrame:
    """The base statistics next to ``doc_id``, ``lang`` and ``source``; one row per row of ``docs``.

    ``whole`` keeps all columns as ``_row``.
    """
    text = F.coalesce("text", F.lit(""))
    bare = F.translate(text, SPACE, "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, SPACE, "")) > 0)
    counted = docs.select(
        F.col("doc_id").cast("bigint"), F.col("lang").cast("string"), F.col("source").cast("string"), *([F.struct(*docs.columns).alias("_row")] if whole else []),
        F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "").alias("_words"),
        F.length(bare).cast("bigint").alias("word_chars"),
        (F.length(bare) - F.length(F.translate(bare, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        lines.alias("_lines"))
    last = F.size("_words") - WINDOW + 1
    hashed = counted.select(
        "*", F.size("_words").cast("bigint").alias("n_words"), F.size(F.array_distinct("_words")).cast("bigint").alias("n_distinct"),
        F.size("_lines").cast("bigint").alias("n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda n: F.xxhash64(F.slice("_words", n, WINDOW)))).alias("_grams"))
    hashed = hashed.drop("_words", "_lines")
    placed = hashed.select("*", F.when(
        F.size(F.array_distinct("_grams")) < F.size("_grams"),
        F.array_sort(F.transform("_grams", lambda g, n: F.struct(g.alias("g"), n.alias("n"))))).alias("_placed")).drop("_grams")
    again = F.filter("_placed", lambda s, n: (F.get("_placed", n - 1)["g"] == s["g"]) | (F.get("_placed", n + 1)["g"] == s["g"]))
    found = placed.select("*", F.array_sort(F.transform(again, lambda s: s["n"])).alias("_at")).drop("_placed")
    reach = F.transform("_at", lambda at, n: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", n + 1) - at, F.lit(WINDOW))))
    repeated = F.coalesce(F.aggregate(reach, F.lit(0), lambda total, n: total + n), F.lit(0)).cast("bigint")
    return found.select("*", repeated.alias("n_repeat_words")).drop("_at").select(
        "*", ((F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))).alias("base_failed"))


def vectors(stats: DataFrame) -> DataFrame:
    """Adds the transformed statistics ``x0`` to ``x4``; null keys get a value of their own."""
    words = F.greatest(F.col("n_words"), F.lit(2)).cast("double")
    x = (F.log(F.greatest(F.col("word_chars") / words, F.lit(1.0))), F.asinh(10 * F.col("n_symbols") / words),
         F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), F.log(F.greatest(F.col("n_distinct"), F.lit(1)).cast("double")) / F.log(words),
         F.col("n_repeat_words") / words)
    return stats.select("*", *[F.round(c, 6).alias(name) for c, name in zip(x, X)])


def levels(rows: DataFrame) -> DataFrame:
    """The distinct vectors, each with its weight ``w``, under language and source, language, and all documents.

    ``salt`` spreads a key's vectors: no step deals rows out by the key alone.
    """
    lang, source = F.coalesce("lang", F.lit(ANY)), F.coalesce("source", F.lit(ANY))
    keys = [F.struct(F.lit(n).alias("level"), a.alias("lang"), b.alias("source"))
            for n, (a, b) in enumerate(((lang, source), (lang, F.lit("")), (F.lit(""), F.lit(""))))]
    each = rows.select(F.explode(F.array(*keys)).alias("_k"), *X).select("_k.*", *X)
    counted = each.groupBy(*KEY, *X).agg(F.count(F.lit(1)).alias("w"))
    return counted.select("*", F.pmod(F.xxhash64(*X), F.lit(SALTS)).cast("int").alias("salt"))


def salted(per_key: DataFrame) -> DataFrame:
    """A table of one row per key, once for each salt."""
    return per_key.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """Per key the bins of ``value`` (a whole number) that reach the shares of its rows, as ``q0``, ``q1`` ..."""
    bins = rows.groupBy(*keys, value).agg(F.sum("w").alias("_n"))
    own = Window.partitionBy(*keys)
    ran = bins.select("*", F.sum("_n").over(own.orderBy(value)).alias("_to"), F.sum("_n").over(own).alias("_all"))
    return ran.groupBy(*keys).agg(*[F.min(F.when(F.col("_to") >= F.ceil(F.col("_all") * share), F.col(value))).alias(f"q{n}") for n, share in enumerate(shares)])


def started(rows: DataFrame) -> DataFrame:
    """First estimates per key and ``start``: ``m0`` ... and the upper triangle ``c00`` ..."""
    cells = rows.select(*KEY, "w", F.explode(F.array(*[F.struct(F.lit(n).alias("dim"), F.floor(F.col(x) * 100).alias("bin")) for n, x in enumerate(X)])).alias("_c"))
    q = quantiles(cells.select(*KEY, "w", "_c.*"), [*KEY, "dim"], "bin", [0.25, 0.5, 0.75])
    of = lambda n, c: F.max(F.when(F.col("dim") == n, c))
    robust = q.groupBy(*KEY).agg(*[of(n, (F.col("q1") + 0.5) / 100).alias(f"m{n}") for n in range(P)],
                                 *[of(n, F.pow((F.col("q2") - F.col("q0")) / 134.9, F.lit(2.0))).alias(f"c{n}{n}") for n in range(P)])
    robust = robust.select(*KEY, F.lit(0).alias("start"), *[f"m{n}" for n in range(P)],
                           *[(F.col(f"c{a}{b}") if a == b else F.lit(0.0)).alias(f"c{a}{b}") for a, b in CELLS])
    return robust.unionByName(moments(rows.withColumn("start", F.lit(1))).drop("n"))


def moments(rows: DataFrame) -> DataFrame:
    """Mean and covariance per key and start."""
    sums = rows.groupBy(*KEY, "start").agg(
        F.sum("w").alias("n"), *[(F.sum(F.col("w") * F.col(x)) / F.sum("w")).alias(f"m{n}") for n, x in enumerate(X)],
        *[(F.sum(F.col("w") * F.col(X[a]) * F.col(X[b])) / F.sum("w")).alias(f"_{a}{b}") for a, b in CELLS])
    return sums.select(*KEY, "start", "n", *[F.round(f"m{n}", 9).alias(f"m{n}") for n in range(P)],
                       *[F.round(F.col(f"_{a}{b}") - F.col(f"m{a}") * F.col(f"m{b}"), 9).alias(f"c{a}{b}") for a, b in CELLS])


def inverted(estimates: DataFrame, factor: float) -> DataFrame:
    """The precision ``i00`` ... of ``factor`` times the covariance plus the noise, and ``det``, by sweeping each pivot."""
    at = lambda a, b: F.col(f"i{min(a, b)}{max(a, b)}")
    kept = [c for c in estimates.columns if not c.startswith("c")]
    now = estimates.select(*kept, F.lit(1.0).alias("det"), *[
        (factor * F.col(f"c{a}{b}") + (NOISE[a] ** 2 if a == b else 0.0)).alias(f"i{a}{b}") for a, b in CELLS])
    for k in range(P):
        pivot = at(k, k)
        now = now.select(*kept, (F.col("det") * pivot).alias("det"), *[
            (-1 / pivot if a == b == k else at(a, b) / pivot if k in (a, b) else at(a, b) - at(a, k) * at(k, b) / pivot).alias(f"i{a}{b}")
            for a, b in CELLS])
    return now.select(*kept, "det", *[(-F.col(f"i{a}{b}")).alias(f"i{a}{b}") for a, b in CELLS])


def distance() -> Column:
    """Squared Mahalanobis distance of ``x0`` ... under the joined estimate."""
    off = [F.col(x) - F.col(f"m{n}") for n, x in enumerate(X)]
    return _sum([(1 if a == b else 2) * F.col(f"i{a}{b}") * off[a] * off[b] for a, b in CELLS])


def estimates(rows: DataFrame) -> DataFrame:
    """The minimum covariance determinant estimate of each key with enough rows."""
    rows = saved(levels(rows), "vectors")
    now = saved(inverted(started(rows), 1.0), "mcd")
    for n in range(STEPS):
        near = rows.join(salted(now), [*KEY, "salt"]).select(*KEY, "start", "salt", "w", *X, F.floor(16 * F.log(F.greatest(distance(), F.lit(0.0)) + 1e-6)).alias("bin"))
        bound = saved(quantiles(near, [*KEY, "start"], "bin", [KEPT_SHARE]), "mcd")
        core = moments(near.join(salted(bound), [*KEY, "start", "salt"]).filter("bin <= q0"))
        now = saved(inverted(core, CONSISTENCY if n == STEPS - 1 else 1.0), "mcd")
    best = now.groupBy(*KEY).agg(F.min_by(F.struct(*[c for c in now.columns if c not in KEY]), F.struct("det", "start")).alias("_b"))
    return best.select(*KEY, "_b.*").filter(F.col("n") >= KEPT_SHARE * MEMBERS).drop("start")


def judged(docs: DataFrame, whole: bool = False) -> DataFrame:
    """Base statistics, ``base_failed``, squared ``distance`` (null where base rules failed) and ``kept``; ``_row`` if ``whole``."""
    stats = saved(vectors(statistics(docs, whole)), "stats")
    known = saved(estimates(stats.filter("NOT base_failed")), "mcd")
    named = stats.withColumn("_lang", F.coalesce("lang", F.lit(ANY))).withColumn("_source", F.coalesce("source", F.lit(ANY)))
    placed = named
    for n, (lang, source) in enumerate((("_lang", "_source"), ("_lang", None), (None, None))):
        own = known.filter(F.col("level") == n).drop("level", "n", "det")
        on = [F.col(lang) == F.col("_l") if lang else F.lit("") == F.col("_l"), F.col(source) == F.col("_s") if source else F.lit("") == F.col("_s")]
        measured = own.withColumnsRenamed({"lang": "_l", "source": "_s"})
        if lang:
            joined = placed.join(measured, on[:2] if source else on[:1], "left")
        else:  # one row at most
            joined = placed.join(F.broadcast(measured), on[0], "left")
        placed = joined.select(*placed.columns, F.round(distance(), 6).alias(f"_d{n}"))
    far = F.when(~F.col("base_failed"), F.coalesce("_d0", "_d1", "_d2", F.lit(0.0)))
    return placed.select("doc_id", *(["_row"] if whole else []), *BASE, "base_failed", far.alias("distance")).select(
        "*", (~F.col("base_failed") & (F.col("distance") <= CUT)).alias("kept"))


def quality(docs: DataFrame) -> DataFrame:
    """Per document the base statistics, the squared distance and the verdict."""
    return judged(docs)


def good(docs: DataFrame) -> DataFrame:
    """``docs`` less the rejected ones.

    The rows travel with their statistics, so texts are written once and never shuffled to be found again.
    """
    return judged(docs, whole=True).filter("kept").select("_row.*")
