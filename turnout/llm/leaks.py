"""Benchmark decontamination by a positional inverted index over the training documents.

The index stores a posting (document, position) for every document word that some test item has
too.  Of each 13-word window of an item (an item of fewer words is one window) the ``RAREST``
terms are taken; their posting lists are shifted by the term's place in the item and intersected,
which leaves the few alignments of an item with a document where a window may stand.  These are
compared word by word.  ``proximity`` finds the windows whose rarest terms stand near their places.

Only DataFrame functions are used.  A document is known by two hashes of its id and text, so rows
that share an id are told apart and repeated rows are judged alike.  Null texts have no words:
no hit, not contaminated.  Items without a word never occur; a null item id is listed as an empty
string.  Texts and items may be of any length, a window costs as much in a long item as in a short
one.  Empty tables are allowed on either side; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from turnout.llm.base import ascii_lower, row_key, saved, without

WINDOW = 13
RAREST = 2
#: A document is contaminated if one word in so many is hit.
ONE_IN = 20
OTHER = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
DOC = ["k1", "k2"]


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), OTHER), "")


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` with the two halves of the row's key, which are never null."""
    return docs.select("doc_id", "text", *row_key("doc_id", "text"))


def items_of(benchmark: DataFrame) -> DataFrame:
    """Distinct items with their words, their number ``n`` and the window length ``span``."""
    split = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("words"))
    split = split.filter(F.size("words") > 0).distinct()
    return split.select(F.xxhash64("item_id", "words").alias("item"), "item_id", "words", F.size("words").alias("n"),
                        F.least(F.lit(WINDOW), F.size("words")).alias("span"))


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings ``term``, ``k1``, ``k2``, ``pos`` of the given distinct ``terms`` in keyed documents."""
    placed = docs.select(*DOC, F.posexplode(words(F.col("text"))).alias("pos", "term"))
    return saved(placed.join(terms, "term").select("term", *DOC, "pos"), "postings")


def windows(items: DataFrame, postings: DataFrame) -> DataFrame:
    """Each window's rarest terms, ``rarest``: structs of frequency ``f``, place in the item ``p`` and ``t``.

    Windows with a term that no document has are left out.
    """
    often = postings.groupBy("term").agg(F.count(F.lit(1)).alias("f"))
    placed = items.select("item", F.posexplode("words").alias("p", "term")).join(often, "term", "left")
    ranked = placed.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("p", F.coalesce("f", F.lit(0)).alias("f"), F.col("term").alias("t")))).alias("placed"))
    # windows are cut before they get rows of their own, so that a long item is not copied into each
    own = lambda first: F.slice(F.array_sort(F.transform(
        F.slice("placed", first + 1, F.col("span")), lambda x: F.struct(x["f"].alias("f"), x["p"].alias("p"), x["t"].alias("t")))), 1, RAREST)
    each = items.select("item", "n", "span").join(ranked, "item").select(
        "item", "span", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - F.col("span")), own)).alias("first", "rarest"))
    return each.filter(F.get("rarest", F.lit(0))["f"] > 0)


def alignments(postings: DataFrame, rare: DataFrame) -> DataFrame:
    """``k1``, ``k2``, ``item`` and ``delta`` (document less item position) where a window's rarest terms all fit."""
    anchors = saved(rare.select("item", "span", F.explode("rarest").alias("_r")).select("item", "span", F.col("_r.p").alias("p"), F.col("_r.t").alias("term")).distinct(), "anchors")
    shifted = postings.join(anchors, "term").select(*DOC, "item", "span", (F.col("pos") - F.col("p")).alias("delta"), "p")
    # two of an item's anchors on one diagonal; a one-word item has but one
    return (shifted.groupBy(*DOC, "item", "span", "delta").agg(F.min("p").alias("_least"), F.max("p").alias("_most"))
            .filter("_least < _most OR span = 1").select(*DOC, "item", "delta"))


def phrases(cut: DataFrame, items: DataFrame) -> DataFrame:
    """``k1``, ``k2``, ``item``, ``start`` and ``end`` of runs of a window or more that equal the item's.

    ``cut`` has the aligned part of the document as ``got`` and where in the item it begins, ``skip``.
    """
    both = cut.join(items.select("item", "words", "span"), "item")
    size = F.size("got")
    differ = F.filter(F.sequence(F.lit(0), size - 1), lambda n: F.get("got", n) != F.get("words", F.col("skip") + n))
    runs = both.filter(size > 0).select(*DOC, "item", "span", "start", F.concat(F.array(F.lit(-1)), differ, F.array(size)).alias("_at"))
    run = F.transform(F.slice("_at", 1, F.size("_at") - 1), lambda at, n: F.struct((at + 1).alias("a"), F.get("_at", n + 1).alias("b")))
    whole = runs.select(*DOC, "item", "start", "span", F.explode(run).alias("_r")).filter("_r.b - _r.a >= span")
    return whole.select(*DOC, "item", (F.col("start") + F.col("_r.a")).alias("start"), (F.col("start") + F.col("_r.b")).alias("end"))


def searched(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keyed documents with ``n_words``, and the phrases found in them."""
    items = saved(items, "items")
    terms = saved(items.select(F.explode("words").alias("term")).distinct(), "terms")
    postings = index(docs, terms)
    found = saved(alignments(postings, windows(items, postings)), "alignments")
    lists = saved(found.join(items.select("item", "n"), "item").groupBy(*DOC).agg(
        F.collect_list(F.struct("item", "delta", "n")).alias("aligned")), "aligned")
    split = docs.join(lists, DOC, "left").select("doc_id", *DOC, words(F.col("text")).alias("words"), "aligned")
    part = F.transform("aligned", lambda c: F.struct(
        c["item"].alias("item"), F.greatest(c["delta"], F.lit(0)).alias("start"), F.greatest(-c["delta"], F.lit(0)).alias("skip"),
        F.slice("words", F.greatest(c["delta"], F.lit(0)) + 1, F.greatest(c["n"] + F.least(c["delta"], F.lit(0)), F.lit(0))).alias("got")))
    counted = saved(split.select("doc_id", *DOC, F.size("words").cast("bigint").alias("n_words"), part.alias("parts")), "aligned")
    cut = counted.filter("parts IS NOT NULL").select(*DOC, F.explode("parts").alias("_p")).select(*DOC, "_p.*")
    return counted.select("doc_id", *DOC, "n_words"), phrases(cut, items)


def proximity(docs: DataFrame, benchmark: DataFrame, slop: int) -> DataFrame:
    """``doc_id``, ``item_id``, the window's ``first`` item word and ``gap``: its two rarest terms stand within ``slop`` words of their distance."""
    docs, items = keyed(docs), saved(items_of(benchmark), "items")
    postings = index(docs, saved(items.select(F.explode("words").alias("term")).distinct(), "terms"))
    rare = windows(items, postings).filter(F.size("rarest") > 1)
    place = F.col("pos") - F.col("_p")
    lists = [postings.join(rare.select("item", "first", F.get("rarest", F.lit(n))["p"].alias("_p"), F.get("rarest", F.lit(n))["t"].alias("term")), "term")
             .select(*DOC, "item", "first", place.alias(f"_d{n}")) for n in range(2)]
    bucket = lambda c: F.floor(c / (slop + 1))
    one = lists[0].select("*", F.explode(F.array(*[bucket(F.col("_d0")) + n for n in (-1, 0, 1)])).alias("_b"))
    near = one.join(lists[1].withColumn("_b", bucket(F.col("_d1"))), [*DOC, "item", "first", "_b"])
    near = near.filter(F.abs(F.col("_d0") - F.col("_d1")) <= slop).groupBy(*DOC, "item", "first").agg(F.min(F.abs(F.col("_d0") - F.col("_d1"))).alias("gap"))
    return near.join(docs.select("doc_id", *DOC), DOC).join(items.select("item", "item_id"), "item").select("doc_id", "item_id", "first", "gap")


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Keyed documents with ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated``."""
    items = items_of(benchmark)
    counted, found = searched(keyed(docs), items)
    before = F.max("end").over(Window.partitionBy(*DOC).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(before, "start")))
    hits = (found.join(items.select("item", "item_id"), "item").select(*DOC, "item_id", new.alias("new"))
            .groupBy(*DOC).agg(F.sum("new").alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("items")))
    hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return counted.join(saved(hits, "hits"), DOC, "left").select(
        "doc_id", *DOC, "n_words", hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce("items", F.array().cast("array<string>"))), 256).alias("items_sha256"),
        ((hit > 0) & (ONE_IN * hit >= F.col("n_words"))).alias("contaminated"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document its words, those that windows of the benchmark hit, and the verdict."""
    return judged(docs, benchmark).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` less the contaminated ones."""
    gone = saved(judged(docs, benchmark).filter("contaminated").select(*DOC).distinct(), "contaminated")
    return without(docs, gone, "doc_id", "text")


def oracle() -> str:
    other = OTHER.replace("\\\\", "\\")
    split = f"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{other}'), lambda x: x <> '')"
    return f"""
    WITH d AS (SELECT doc_id, {split} AS w FROM documents),
    b AS (SELECT item_id, {split} AS w FROM benchmark),
    s AS (SELECT item_id, w, least({WINDOW}, len(w)) AS l FROM b WHERE len(w) > 0),
    g AS (SELECT DISTINCT item_id, l, array_to_string(w[p:p + l - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, (len(w) - l + 2)::BIGINT)) AS p FROM s)),
    dg AS (SELECT doc_id, l, p, array_to_string(w[p:p + l - 1], ' ') AS gram
        FROM (SELECT doc_id, w, l, unnest(range(1, (len(w) - l + 2)::BIGINT)) AS p FROM d, (SELECT DISTINCT l FROM s) x)),
    hits AS (SELECT dg.doc_id, g.item_id, dg.p, dg.l FROM dg JOIN g ON dg.l = g.l AND dg.gram = g.gram),
    pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM hits) GROUP BY 1),
    it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY 1)
    SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
        coalesce(n_hit, 0) > 0 AND {ONE_IN} * coalesce(n_hit, 0) >= len(d.w) AS contaminated
    FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)"""
