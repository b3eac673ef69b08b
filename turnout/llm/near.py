"""Near-duplicates: universal hash minima, bands, verification on full sets, connected components.

1. Every text becomes the set of its five-word shingles (64-bit hashes); equal sets are one class.
2. Each class's smallest document gets ``HASHES`` minima, cut into bands of ``ROWS``.
3. Within a band's bucket one pivot is paired with the others, never all with all.  Pairs whose
   sizes and signatures allow a link are confirmed on full sets: 100 * common >= 75 * union.
4. Components come from alternating large-star and small-star steps.
5. Buckets that still hold several components get another pivot, and so on while a turn confirms a
   fair part of its pairs.  Each turn makes as many pairs as the open buckets have members.
6. What the open buckets then hold beside their pivots is joined exactly, on the documents' rarest
   shingles with a bound by sizes and positions that no linked pair fails.

Null texts and texts without a word have an empty set, no link and themselves as component.
Documents with fewer than five words have their whole word sequence as the one shingle.  A null
``doc_id`` is its own row without links.  Repeated rows fall into the same class, rows of one id are one
node.  Empty tables give empty ones; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from turnout.llm.base import apart, batched, enough, saved

WORDS = 5
SHARE = 75
ROWS = 4
BANDS = 40
HASHES = ROWS * BANDS
#: Signatures of a pair at the bound agree in this share but for one case in a hundred thousand or fewer.
AGREED = 0.58
#: Pivots go on while one in so many of a turn's pairs is confirmed; the exact join does the rest.
YIELD = 10
SEED = 20240601
WORD_MEMO = 150_000
#: Rows of pairs and ids that a file holds, that a task compares by signature, and pairs that a task confirms.
ROWS_A_FILE = 500_000
ROWS_A_TASK = 100_000
PAIRS_A_TASK = 5_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def _params() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(SEED)
    return (random.integers(1, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1))[:, None], random.integers(0, 1 << 32, HASHES, dtype=np.uint32)[:, None]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler(dict):
    """64-bit hashes of words, remembered within a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORD_MEMO:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value

    def shingles(self, text: str | None) -> np.ndarray:
        """The sorted distinct shingles of a text."""
        words = (text or "").encode().lower().split()  # bytes: A-Z only, and ASCII white space
        if not words:
            return np.zeros(0, np.uint64)
        hashes = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        span = min(WORDS, len(words))
        with np.errstate(over="ignore"):
            rolled = np.zeros(len(words) - span + 1, np.uint64)
            for n in range(span):
                rolled = rolled * MIX + hashes[n:len(words) - span + 1 + n] + np.uint64(n + 1)
            return np.unique(mixed(rolled + np.uint64(span)))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The low halves of the least values of the hash functions a * x + b modulo 2**32, a odd."""
    a, b = _params()
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, np.uint32(0xFFFFFFFF))
    for start in range(0, len(low), 1024):
        out = np.minimum(out, (a * low[None, start:start + 1024] + b).min(axis=1))
    return out.astype("<u2")


def sketches(docs: DataFrame) -> DataFrame:
    """Per row its set's size, digest and signature; no text."""
    batched(docs.sparkSession)

    def run(batches):
        shingler = Shingler()
        for batch in batches:
            sizes, keys, signatures = [], [], []
            for text in batch.column(1).to_pylist():
                own = shingler.shingles(text)
                sizes.append(len(own))
                keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                signatures.append(minima(own).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())],
                ["doc_id", "n_shingles", "set_key", "signature"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, "doc_id bigint, n_shingles bigint, set_key binary, signature binary")


def bands(classes: DataFrame) -> DataFrame:
    """``doc_id`` and the ``bucket`` of each of its bands."""
    size = 2 * ROWS
    bucket = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda n: F.xxhash64(n, F.substring("signature", n * size + 1, F.lit(size))))
    return classes.select("doc_id", F.explode(bucket).alias("bucket"))


def agreed(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` whose sizes allow a link and whose signatures agree well enough."""
    first = classes.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("_n"), F.col("signature").alias("_s"))
    second = classes.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("_m"), F.col("signature").alias("_t"))
    sized = (pairs.join(first, "a").join(second, "b")
             .filter(f"100 * least(_n, _m) >= {SHARE} * greatest(_n, _m)"))
    least = int(np.ceil(AGREED * HASHES))

    def run(batches):
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, HASHES) for c in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((one == two).sum(axis=1) >= least))

    return sized.select("a", "b", "_s", "_t").mapInArrow(run, "a bigint, b bigint")


def confirmed(pairs: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """Those of ``n`` pairs ``a`` < ``b`` that link on their full sets; ``docs`` has the classes' texts."""
    involved = saved(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "involved", enough(n, ROWS_A_FILE))
    texts = saved(docs.join(involved, "doc_id"), "near-texts", enough(n, PAIRS_A_TASK))
    both = (pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("_t")), "b")
            .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("_s")), "a"))

    def run(batches):
        shingler, last, first = Shingler(), None, None
        for batch in batches:
            keep = []
            for a, one, two in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if a != last:
                    last, first = a, shingler.shingles(one)
                second = shingler.shingles(two)
                common = len(np.intersect1d(first, second, assume_unique=True))
                keep.append(100 * common >= SHARE * (len(first) + len(second) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return saved(both.select("a", "b", "_s", "_t").mapInArrow(run, "a bigint, b bigint"), "links", enough(n, PAIRS_A_TASK))


def components(links: DataFrame, n: int) -> DataFrame:
    """``doc_id`` and ``component_id`` of all documents in ``n`` ``links`` (``a``, ``b``), by alternating stars.

    Large-star hangs each node's larger neighbours on its smallest one, small-star the node and its
    smaller neighbours; the least neighbour is a map-side minimum, so a hub is no group in a task.
    """
    def hung(edges: DataFrame, larger: bool) -> DataFrame:
        """``edges`` are (node, other); each node's chosen neighbours hang on its least."""
        least = edges.groupBy("node").agg(F.min("other").alias("_m")).select("node", F.least("node", "_m").alias("root"))
        placed = edges.join(apart(least), "node")
        if larger:
            return placed.filter("other > node").select(F.col("other").alias("node"), F.col("root").alias("other")).distinct()
        return (placed.select(F.col("other").alias("node"), F.col("root").alias("other"))
                .unionByName(least.select("node", F.col("root").alias("other"))).filter("node > other").distinct())

    edges = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other")).filter("node > other").distinct()
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("other").alias("node"), F.col("node").alias("other")))
        edges = saved(hung(hung(both, True), False), "edges", enough(n, ROWS_A_FILE))
        now = edges.agg(F.count(F.lit(1)), F.sum("other"), F.sum(F.xxhash64("node", "other").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    return (edges.select(F.col("node").alias("doc_id"), F.col("other").alias("component_id"))
            .unionByName(edges.select(F.col("other").alias("doc_id"), F.col("other").alias("component_id")).distinct()))


def buckets(classes: DataFrame) -> tuple[DataFrame, int]:
    """``bucket`` and ``doc_id`` of all buckets of two or more, with ``weight``: the members that a document meets in all of them; and their count."""
    banded = bands(classes)
    sizes = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    met = saved(banded.join(apart(sizes), "bucket"), "buckets")
    weights = met.groupBy("doc_id").agg(F.sum("_n").alias("weight"))
    return met.select("bucket", "doc_id").join(weights, "doc_id"), met.count()


def open_buckets(members: DataFrame, placed: DataFrame) -> DataFrame:
    """Members with their component now, of the buckets that hold several."""
    held = (members.join(placed, "doc_id", "left")
            .select("bucket", "doc_id", "weight", "used", F.coalesce("component_id", "doc_id").alias("comp")))
    several = held.groupBy("bucket").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b")).filter("_a < _b").select("bucket")
    return held.join(apart(several), "bucket")


def pivoted(held: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a`` < ``b`` of each bucket's pivot with its members of other components, and the members, the pivot marked as used.

    There are as many pairs as members.  The first pivot is the member that meets most others, which
    in a group of copies is close to what they were made from.  Later ones come from the bucket's
    smallest component that has one left.
    """
    free = F.when(~F.col("used"), F.struct("weight", -F.col("doc_id")))
    parts = held.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("_n"), F.max_by(F.struct("doc_id", "weight"), free).alias("_best"))
    order = ([] if turn == 0 else [F.col("_n")]) + [-F.col("_best.weight"), F.col("_best.doc_id")]
    pivots = parts.filter("_best IS NOT NULL").groupBy("bucket").agg(F.min_by(F.struct("_best.doc_id", "comp"), F.struct(*order)).alias("_p"))
    met = held.join(apart(pivots), "bucket", "left")
    pairs = met.filter("comp <> _p.comp").select(F.least("doc_id", F.col("_p.doc_id")).alias("a"), F.greatest("doc_id", F.col("_p.doc_id")).alias("b")).distinct()
    return pairs, met.select("bucket", "doc_id", "weight", (F.col("used") | F.coalesce(F.col("doc_id") == F.col("_p.doc_id"), F.lit(False))).alias("used"))


def unpaired(members: DataFrame, placed: DataFrame | None) -> DataFrame:
    """``doc_id`` and ``comp`` of members that were no pivot, of buckets in which such members are of several components."""
    if placed is None:
        held = members.filter("NOT used").select("bucket", "doc_id", F.col("doc_id").alias("comp"))
    else:
        held = members.filter("NOT used").join(placed, "doc_id", "left").select("bucket", "doc_id", F.coalesce("component_id", "doc_id").alias("comp"))
    several = held.groupBy("bucket").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b")).filter("_a < _b").select("bucket")
    return held.join(apart(several), "bucket").select("doc_id", "comp").distinct()


def possible(rest: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs ``a`` < ``b`` of ``rest`` in different components; every linked pair is among them.

    Shingles are put in one order, rare ones first.  What two sets have in common lies at and behind
    their first common shingle, so neither holds fewer from there on than a link takes.  For the
    smaller set that bound is tighter, and a passage that is shared by a crowd just under the
    bound lies behind it in every set: the crowd's members do not meet there.
    """
    def run(batches):
        shingler = Shingler()
        for batch in batches:
            sets = [shingler.shingles(text) for text in batch.column(2).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets], dtype=np.int64)]).astype(np.int32)
            grams = pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), grams)],
                ["doc_id", "comp", "n", "grams"])

    sets = saved(docs.join(rest, "doc_id").select("doc_id", "comp", "text").mapInArrow(run, "doc_id bigint, comp bigint, n bigint, grams array<bigint>"), "near-sets")
    grams = sets.select("doc_id", "comp", "n", F.explode("grams").alias("gram"))
    common = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    onward = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("_n"), F.desc("gram")))
    placed = saved(grams.join(apart(common), "gram").withColumn("onward", onward)
                   .filter(f"100 * onward >= {SHARE} * n").drop("_n"), "near-prefixes")
    small = placed.filter(f"{100 + SHARE} * onward >= {2 * SHARE} * n").alias("s")
    both = small.join(placed.alias("l"), F.expr(
        "s.gram = l.gram AND s.comp <> l.comp AND (s.n < l.n OR s.n = l.n AND s.doc_id < l.doc_id) "
        f"AND {100 + SHARE} * least(s.onward, l.onward) >= {SHARE} * (s.n + l.n)"))
    return both.select(F.least("s.doc_id", "l.doc_id").alias("a"), F.greatest("s.doc_id", "l.doc_id").alias("b")).distinct()


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per row its ``n_shingles`` and component, and the confirmed links between class representatives."""
    rows = saved(sketches(docs), "sketches")
    some = rows.filter("set_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = saved(some.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"),
                                                F.first("signature").alias("signature")), "classes")
    texts = docs.select(F.col("doc_id").cast("bigint"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    members, size = buckets(classes)
    done = links = placed = None
    turn = linked = 0
    last = False
    while True:
        if last:
            rest = saved(unpaired(members, placed), "rest")
            n_rest = rest.count()
            pairs = possible(rest, texts) if n_rest else rest.select(F.col("doc_id").alias("a"), F.col("comp").alias("b"))
        else:
            held = (members.select("bucket", "doc_id", "weight", F.lit(False).alias("used"), F.col("doc_id").alias("comp"))
                    if placed is None else open_buckets(members, placed))
            pairs, members = pivoted(saved(held, "buckets", enough(size, ROWS_A_FILE)), turn)
        new = saved(agreed(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"), classes), "pairs", enough(size, ROWS_A_TASK))
        n = new.count()
        found = confirmed(new, texts, n) if n else new
        confirms = found.count() if n else 0
        done = new if done is None else done.unionByName(new)
        if confirms:
            links = found if links is None else links.unionByName(found)
            linked += confirms
            placed = components(links, linked)
        if last:
            break
        last = YIELD * confirms < n or not n
        turn += 1
    links = found if links is None else links
    placed = placed if placed is not None else links.select(F.col("a").alias("doc_id"), F.col("b").alias("component_id"))
    tied = (classes.select("set_key", "doc_id").join(placed, "doc_id", "left")
            .select("set_key", F.coalesce("component_id", "doc_id").alias("component_id")))
    out = rows.select("doc_id", "n_shingles", "set_key").join(tied, "set_key", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out, links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document its set's size, its component and whether it is the one kept."""
    out, _ = grouped(docs)
    return out.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component; rows without an id stay."""
    found = saved(near_duplicates(docs), "near")
    gone = saved(found.filter("NOT kept").select("doc_id").distinct(), "gone")
    stay = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    twice = saved(found.filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return stay
    again = stay.join(twice, "doc_id", "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("text")))
    return stay.join(twice, "doc_id", "left_anti").unionByName(again.filter("_n = 1").select(*stay.columns))


def oracle() -> str:
    """All pairs by their common shingles; small tables only."""
    words = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    return f"""
    WITH RECURSIVE d AS (SELECT doc_id, {words} AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(w) < {WORDS} THEN w ELSE w[p:p + {WORDS - 1}] END, ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WORDS - 2}, 2)::BIGINT)) AS p FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {SHARE} * (x.n + y.n - c)),
    r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
    FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1) m USING (doc_id)"""
