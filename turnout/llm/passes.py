"""Near-duplicate vectors by sorted projection passes.

1. Equal vectors are one class, seen through the class's smallest id.
2. A pass gives each vector a key of concatenated random hashes: the nearest of ``DIRECTIONS`` random
   directions and their opposites, ``LABELS`` times.  Vectors are sorted by that key over all
   partitions, and each is compared with the ``WINDOW`` before it; the edges of partitions are compared likewise.
   Pairs of cosine >= ``COSINE`` in double precision are links; of those of a window a spanning forest goes on.
3. Passes follow, with other directions, until a pair just at the bound has met with probability ``RECALL``.
   Their number comes from the table's size: ``AGREE`` of the pairs at the bound share a hash.
4. Links of all passes are united by alternating stars.
5. A bounded window does not see all partners in a crowd, so links are counted inside each component, where
   no pair is lost: small components as a whole.  In large ones the angles to the component's mean decide most
   pairs: two vectors closer to it than the bound together are linked, and their number is a sum over
   a histogram of angles.  Only pairs that this leaves open are compared, block by block; none is written.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing and stand for
themselves.  Vectors of different lengths do not link.  A null ``vec_id`` is its own row without links.  Rows of one id are
one vector, returned once per row; if they differ, the one with the smallest digest stands for the id.
Ties cannot arise: the bound belongs to the links.  Empty tables give empty ones; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from turnout.llm.base import apart, batched, enough, saved
from turnout.llm.near import components
from turnout.llm.trie import groups

COSINE = 0.95
WINDOW = 32
DIRECTIONS = 16
LABELS = 12
#: Of pairs at the bound, this share has the same label (64 dimensions and more; measured on a million pairs).
AGREE = 0.66
RECALL = 0.999
SEED = 20240611
#: Passes that are sorted together, rows that a task sorts and members that are compared as one block.
TOGETHER = 4
ROWS_A_TASK = 50_000
BLOCK = 1024
#: Bins a degree of the angles to a component's mean.
BINS = 4


def passes(n: int) -> int:
    """Passes over ``n`` vectors: a pair meets if it shares the labels that thin a bucket to a window."""
    labels = max(1.0, math.log(max(n, 2) / WINDOW) / math.log(2 * DIRECTIONS))
    return math.ceil(math.log(1 - RECALL) / math.log(1 - AGREE ** labels))


# --- vectors -----------------------------------------------------------------------------
def unit(x: np.ndarray) -> np.ndarray:
    """Rows of double vectors scaled to length 1, without overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def stacked(raw: list[bytes], kind: str) -> np.ndarray:
    return unit(np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64))


def kind_of(vectors: DataFrame) -> str:
    """How components are kept: as given, single or double."""
    return "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"


def valid(vectors: DataFrame, kind: str) -> DataFrame:
    """``vec_id``, ``digest`` and ``raw`` bytes of the vectors that can link."""
    batched(vectors.sparkSession)

    def run(batches):
        for batch in batches:
            ids, digests, raws = [], [], []
            for vec_id, values in zip(batch.column(0).to_pylist(), batch.column(1)):
                if vec_id is None or not values.is_valid or values.values.null_count or not len(values.values):
                    continue
                x = np.asarray(values.values, dtype=np.float64)
                if not np.isfinite(x).all() or not x.any():
                    continue
                raw = (x + 0.0).astype(kind).tobytes()  # no negative zero
                ids.append(vec_id)
                digests.append(hashlib.blake2b(raw, digest_size=16).digest())
                raws.append(raw)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(raws, pa.binary())], ["vec_id", "digest", "raw"])

    return vectors.select(F.col("vec_id").cast("bigint"), "embedding").mapInArrow(run, "vec_id bigint, digest binary, raw binary")


_drawn: dict[tuple[int, int], np.ndarray] = {}


def drawn(turn: int, size: int) -> np.ndarray:
    """The random directions of a pass; a few passes are remembered."""
    if (turn, size) not in _drawn:
        if len(_drawn) > 2 * TOGETHER:
            _drawn.clear()
        _drawn[turn, size] = np.random.default_rng([SEED, turn, size]).normal(size=(size, LABELS * DIRECTIONS))
    return _drawn[turn, size]


def keys(x: np.ndarray, turn: int) -> np.ndarray:
    """A row of label bytes for each vector."""
    seen = (x @ drawn(turn, x.shape[1])).reshape(len(x), LABELS, DIRECTIONS)
    best = np.abs(seen).argmax(axis=2)
    below = np.take_along_axis(seen, best[:, :, None], axis=2)[:, :, 0] < 0
    return (best + DIRECTIONS * below).astype(np.uint8)


def keyed(classes: DataFrame, kind: str, turns: range) -> DataFrame:
    """Each class once a pass, with the ``part`` that it is compared in (pass and vector length) and its ``key``."""
    def run(batches):
        for batch in batches:
            raw = batch.column(1).to_pylist()
            sizes = np.array([len(r) for r in raw], np.int64)
            for size in np.unique(sizes):
                chosen = np.flatnonzero(sizes == size)
                some = batch.take(pa.array(chosen))
                x = stacked([raw[n] for n in chosen], kind)
                for turn in turns:
                    own = keys(x, turn)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(chosen), turn * 2 ** 32 + size)), pa.array([k.tobytes() for k in own], pa.binary()),
                                                      some.column(0), some.column(1)], ["part", "key", "node", "raw"])

    return classes.select("node", "raw").mapInArrow(run, "part bigint, key binary, node bigint, raw binary")


# --- windows -----------------------------------------------------------------------------
def forest(i: Iterable[int], j: Iterable[int]) -> list[tuple[int, int]]:
    """Of the links ``i``, ``j`` as many as connect the same."""
    up: dict[int, int] = {}
    kept = []
    for a, b in zip(i, j):
        x, y = a, b
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        while up.setdefault(y, y) != y:
            up[y] = y = up[up[y]]
        if x != y:
            up[x] = y
            kept.append((a, b))
    return kept


def window_links(x: np.ndarray, part: np.ndarray, new: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked places i > j among rows, of which those from ``new`` on have not been compared; i - j is a window at most."""
    found_i, found_j = [], []
    for start in range(new, len(x), 256):
        rows = np.arange(start, min(start + 256, len(x)))
        low = max(0, start - WINDOW)
        columns = np.arange(low, rows[-1] + 1)
        gap = rows[:, None] - columns[None, :]
        near = (gap > 0) & (gap <= WINDOW) & (part[rows][:, None] == part[columns][None, :])
        hit = near & (x[rows] @ x[low:rows[-1] + 1].T >= COSINE)
        i, j = np.nonzero(hit)
        found_i.append(rows[i])
        found_j.append(columns[j])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_i]), np.concatenate([none, *found_j])


def compared(ordered: DataFrame, kind: str, edges: bool) -> DataFrame:
    """Links ``a``, ``b`` of the windows over sorted partitions, and with ``edges`` the rows at both ends of each partition.

    A row at an end has its vector and, as ``gap``, the number of the boundary that it lies at.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("gap", pa.int64()), ("part", pa.int64()), ("key", pa.binary()), ("node", pa.int64()), ("raw", pa.binary())])

    def ends(rows: list[tuple], gap: int) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[]] * 4
        nothing = [None] * len(rows)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((nothing, nothing, [gap] * len(rows), *columns), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]):
        number = TaskContext.get().partitionId()
        first: list[tuple] = []
        held: list[tuple] = []
        for batch in batches:
            own = list(zip(*(batch.column(c).to_pylist() for c in ("part", "key", "node", "raw"))))
            if edges and len(first) < WINDOW:
                first += own[:WINDOW - len(first)]
            rows, new = held + own, len(held)
            start = 0
            for stop in range(1, len(rows) + 1):  # rows of one part, thus of one length
                if stop < len(rows) and rows[stop][0] == rows[start][0]:
                    continue
                if stop > new:
                    some = rows[start:stop]
                    i, j = window_links(stacked([r[3] for r in some], kind), np.zeros(len(some)), max(0, new - start))
                    links = [(some[a][2], some[b][2]) for a, b in forest(i.tolist(), j.tolist())]
                    empty = [None] * len(links)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(
                        ([a for a, _ in links], [b for _, b in links], empty, empty, empty, empty, empty), schema)], schema=schema)
                start = stop
            held = rows[-WINDOW:]
        if edges and held:
            yield ends(first, number - 1)
            yield ends(held, number)

    return ordered.select("part", "key", "node", "raw").mapInArrow(run, "a bigint, b bigint, gap bigint, part bigint, key binary, node bigint, raw binary")


def links_of(classes: DataFrame, n: int, kind: str, turns: range) -> DataFrame:
    """Links that some passes find, sorted together."""
    order = ["part", "key", "node"]
    tasks = enough(n * len(turns), ROWS_A_TASK)
    ordered = keyed(classes, kind, turns).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    seen = saved(compared(ordered, kind, True), "windows")
    # a window that reaches over a boundary: the last rows before and the first behind it
    gaps = seen.filter("gap >= 0").repartition("gap").sortWithinPartitions("gap", *order)
    over = compared(gaps.withColumn("part", F.xxhash64("gap", "part")), kind, False)
    return saved(seen.filter("a IS NOT NULL").select("a", "b").unionByName(over.select("a", "b")).distinct(), "links")


# --- links inside components ----------------------------------------------------------------
def counted(members: DataFrame, kind: str) -> DataFrame:
    """``node`` and ``links``: the vectors of its component that it is linked with, itself included; components are blocks."""
    def run(batches):
        for group in groups(batches, "comp"):
            x, n = stacked(group.column("raw").to_pylist(), kind), np.asarray(group.column("n"))
            links = ((x @ x.T >= COSINE) | np.eye(len(x), dtype=bool)) @ n
            yield pa.RecordBatch.from_arrays([group.column("node").combine_chunks(), pa.array(links, pa.int64())], ["node", "links"])

    return (members.select("comp", "node", "n", "raw").repartition("comp").sortWithinPartitions("comp")
            .mapInArrow(run, "node bigint, links bigint"))


def means(members: DataFrame, kind: str) -> DataFrame:
    """Per component the sum of its unit vectors, added up in tasks first."""
    def added(totals: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int64()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], ["comp", "total"])

    def partly(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for comp, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = stacked([raw], kind)[0]
                if comp in totals:
                    totals[comp] += own
                else:
                    if len(totals) >= BLOCK:
                        yield added(totals)
                        totals = {}
                    totals[comp] = own
        yield added(totals)

    def wholly(batches):
        comp, total = None, None
        for batch in batches:
            done = {}
            for c, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(raw, "<f8")
                if c == comp:
                    total = total + own
                else:
                    if comp is not None:
                        done[comp] = total
                    comp, total = c, own
            yield added(done)
        if comp is not None:
            yield added({comp: total})

    parts = members.select("comp", "raw").mapInArrow(partly, "comp bigint, total binary")
    return parts.repartition("comp").sortWithinPartitions("comp").mapInArrow(wholly, "comp bigint, total binary")


def binned(members: DataFrame, kind: str) -> DataFrame:
    """Members with the ``bin`` of their angle to the component's mean."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            angles = []
            for raw, total in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                mean = np.frombuffer(total, "<f8")
                size = math.sqrt(float(mean @ mean))
                angles.append(math.degrees(math.acos(max(-1.0, min(1.0, float(stacked([raw], kind)[0] @ mean) / size)))) if size else 90.0)
            bins = pa.array([int(a * BINS) for a in angles], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], bins], ["comp", "node", "n", "raw", "bin"])

    return (members.select("comp", "node", "n", "raw").join(apart(means(members, kind)), "comp")
            .select("comp", "node", "n", "raw", "total").mapInArrow(run, "comp bigint, node bigint, n bigint, raw binary, bin int"))


def counted_by_angles(members: DataFrame, kind: str) -> DataFrame:
    """As ``counted``, for components of any size.

    With the bound's angle of ``limit`` bins, bins x and y together below it are linked, bins further apart than it
    are not.  Bins are taken a step narrower than they are, so rounding decides nothing.
    """
    limit = math.degrees(math.acos(COSINE)) * BINS
    placed = saved(binned(members, kind), "angles")
    sums = placed.groupBy("comp", "bin").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    sums = saved(sums, "bins")
    sure = f"x.comp = y.comp AND x.bin + y.bin + 3 <= {limit}"
    certain = (sums.alias("x").join(sums.alias("y"), F.expr(sure)).groupBy("x.comp", "x.bin").agg(F.sum("y.n").alias("sure")))
    blocks = sums.select("comp", "bin", F.ceil(F.col("rows") / BLOCK).cast("bigint").alias("parts"))
    open_pairs = blocks.alias("x").join(blocks.alias("y"), F.expr(
        f"x.comp = y.comp AND x.bin + y.bin + 3 > {limit} AND abs(x.bin - y.bin) - 2 <= {limit}"))
    pairs = open_pairs.select("x.comp", F.col("x.bin").alias("xb"), F.col("y.bin").alias("yb"), F.explode(F.sequence(F.lit(0), F.col("x.parts") - 1)).alias("xp"),
                              F.col("y.parts").alias("_n")).withColumn("yp", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    pairs = saved(pairs, "block-pairs")
    dealt = placed.join(apart(blocks), ["comp", "bin"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).drop("parts")

    key = ["comp", "xb", "xp", "yb", "yp"]

    def side(bin_: str, part: str, which: int) -> DataFrame:
        met = pairs.withColumns({"bin": F.col(bin_), "part": F.col(part)})
        return dealt.join(met, ["comp", "bin", "part"]).select(*key, F.lit(which).alias("side"), "node", "n", "raw")

    both = side("xb", "xp", 0).unionByName(side("yb", "yp", 1))

    def run(batches):
        for group in groups(batches, "block"):
            sides = np.asarray(group.column("side"))
            x, n = stacked(group.column("raw").to_pylist(), kind), np.asarray(group.column("n"))
            nodes = np.asarray(group.column("node"))
            ours, theirs = sides == 0, sides == 1
            hit = (x[ours] @ x[theirs].T >= COSINE) | (nodes[ours][:, None] == nodes[theirs][None, :])
            yield pa.RecordBatch.from_arrays([pa.array(nodes[ours]), pa.array(hit @ n[theirs], pa.int64())], ["node", "links"])

    ordered = (both.withColumn("block", F.concat_ws(",", *key)).repartition("block").sortWithinPartitions("block")
               .select("block", "side", "node", "n", "raw"))
    seen = ordered.mapInArrow(run, "node bigint, links bigint").groupBy("node").agg(F.sum("links").alias("seen"))
    return (placed.select("comp", "node", "bin").join(apart(certain), ["comp", "bin"], "left").join(seen, "node", "left")
            .select("node", (F.coalesce("sure", F.lit(0)) + F.coalesce("seen", F.lit(0))).alias("links")))


# --- the operator --------------------------------------------------------------------------
def near_vectors(vectors: DataFrame) -> DataFrame:
    """Per row its ``n_links``, its component's smallest id and whether it is that one."""
    kind = kind_of(vectors)
    held = saved(valid(vectors, kind), "vectors")
    own = saved(held.groupBy("vec_id").agg(F.min("digest").alias("digest")), "vector-ids")
    equal = saved(own.groupBy("digest").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("n")), "vector-classes")
    classes = saved(equal.join(held.withColumnRenamed("vec_id", "node"), ["node", "digest"]).dropDuplicates(["node"]).select("node", "n", "raw"), "classes")
    n = classes.count()
    found, last = None, passes(n)
    for start in range(0, last, TOGETHER):
        new = links_of(classes, n, kind, range(start, min(start + TOGETHER, last)))
        found = new if found is None else found.unionByName(new)
    links = saved(found.distinct(), "vector-links")
    comps = saved(components(links, links.count()).select(F.col("doc_id").alias("node"), F.col("component_id").alias("comp")), "vector-components")
    sizes = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    members = saved(classes.join(comps, "node").join(apart(sizes), "comp"), "members")
    counts = counted(members.filter(F.col("size") <= BLOCK), kind)
    large = members.filter(F.col("size") > BLOCK)
    if not large.isEmpty():
        counts = counts.unionByName(counted_by_angles(large, kind))
    told = saved(equal.join(comps, "node", "left").join(counts, "node", "left").select(
        "digest", F.coalesce("links", "n").alias("links"), F.coalesce("comp", "node").alias("comp")), "told")
    ids = own.join(apart(told), "digest").select("vec_id", "links", "comp")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"))
    seen = rows.filter("vec_id IS NOT NULL").join(ids, "vec_id", "left").select(
        "vec_id", F.coalesce(F.col("links") - 1, F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("comp", "vec_id").alias("component_id"))
    lost = rows.filter("vec_id IS NULL").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return seen.unionByName(lost).select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def oracle() -> str:
    """All pairs; small tables of one row an id only."""
    return f"""
    WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    u AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(e, lambda x: x <> 0)) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
        WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
    r AS (SELECT vec_id, vec_id AS root FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.vec_id)
    SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, m.component_id, v.vec_id = m.component_id AS kept
    FROM v JOIN (SELECT vec_id, min(root) AS component_id FROM r GROUP BY 1) m USING (vec_id)"""
