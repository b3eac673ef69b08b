"""Prefix trie of conversations: balanced parentheses per shard, shared spines merged.

1. A conversation becomes a path: one 16-byte key for each of its prefixes, and the words of each
   turn's text.  Texts go no further.
2. Prefixes with more than a shard's conversations form the spine, found by one map-side count.
   Under the spine hang subtrees of at most that many conversations: the shards.  The bound is ``SHARD``,
   or a ``SPREAD``-th of all conversations where that is more, so that the spine stays
   small at any size and no shard is a hot prefix.
3. A shard's paths come sorted, so that its trie is written in one pass as balanced parentheses.
   Blocks of the excess with their minima, in a range min-max tree, find the closing parenthesis of
   every node at once: it delimits the subtree.  Leaves are the pairs "()" counted between, members
   and saved tokens are differences of cumulative arrays.
4. What shards report for their tops is added up per spine node; the spine goes through the same encoding once more.

Turns go by ``turn``, null first, ties by role and text; null role and text are empty.  Rows without a
conv_id belong to no conversation and are left out.  Repeated rows are turns of their own.  An empty table
has no conversation and no node, not even a root.  Other columns are ignored.  Long texts stay where they are read.
A conversation's path is one value of 20 bytes a turn, like a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from turnout.llm.base import apart, enough, saved

#: Conversations of a shard, at least; and the part of all conversations that a shard may hold beyond that.
SHARD = 1000
SPREAD = 10_000
#: Full shards of a task.
SHARDS_A_TASK = 4
#: Ids that go into one piece of a hashed list, as a power of two; parentheses in a block of the excess.
ID_BITS = 10
BLOCK = 64
KEY = 16
WORDS = r"[^\x20\x09-\x0D]+"
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
NODES = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
ARROW = pa.schema([pa.field(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in NODES.split(", ")])


# --- balanced parentheses -------------------------------------------------------------
class Parentheses:
    """A tree as balanced parentheses (1 opens, 0 closes) with block minima of its excess."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(np.where(bits == 1, 1, -1)).astype(np.int64)
        self.opens = np.flatnonzero(bits == 1)
        blocks = -(-len(bits) // BLOCK)
        filled = np.full(blocks * BLOCK, np.iinfo(np.int64).max)
        filled[:len(bits)] = self.excess
        self.rows = filled.reshape(blocks, BLOCK)
        width = 1 << max(0, int(blocks - 1).bit_length())
        # a heap: node k has the minimum of 2k and 2k + 1, blocks are its leaves
        self.least = np.full(2 * width, np.iinfo(np.int64).max)
        self.least[width:width + blocks] = self.rows.min(axis=1)
        while width > 1:
            half = width // 2
            self.least[half:width] = np.minimum(self.least[width:2 * width:2], self.least[width + 1:2 * width:2])
            width = half
        self.pairs = np.r_[0, np.cumsum((bits[:-1] == 1) & (bits[1:] == 0))]

    def closes(self) -> np.ndarray:
        """Where each opening parenthesis, in order, is closed: the first later place whose excess is one less."""
        want = self.excess[self.opens] - 1
        block = self.opens // BLOCK
        out = np.empty(len(self.opens), np.int64)
        inside = np.arange(BLOCK)
        left = np.arange(len(self.opens))
        for part in np.array_split(left, -(-len(left) // 65536) or 1):
            hit = (self.rows[block[part]] == want[part, None]) & (inside > (self.opens[part] % BLOCK)[:, None])
            out[part] = np.where(hit.any(axis=1), block[part] * BLOCK + hit.argmax(axis=1), -1)
        left = np.flatnonzero(out < 0)
        leaf = len(self.least) // 2
        node, aim = block[left] + leaf, want[left]
        climbing = np.arange(len(left))
        while len(climbing):  # up, until the sibling to the right reaches low enough
            here = node[climbing]
            found = (here % 2 == 0) & (self.least[np.minimum(here + 1, len(self.least) - 1)] <= aim[climbing])
            node[climbing] = np.where(found, here + 1, here // 2)
            climbing = climbing[~found]
        while (node < leaf).any():  # down, into the first child that does
            deeper = node < leaf
            child = 2 * node[deeper]
            node[deeper] = np.where(self.least[child] <= aim[deeper], child, child + 1)
        for part in np.array_split(np.arange(len(left)), -(-len(left) // 65536) or 1):
            out[left[part]] = (node[part] - leaf) * BLOCK + (self.rows[node[part] - leaf] == aim[part, None]).argmax(axis=1)
        return out

    def subtrees(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per node in preorder the rank behind its subtree's last node, its childless nodes, and its children."""
        closes = self.closes()
        behind = np.cumsum(self.bits)[closes]
        leaves = self.pairs[closes] - self.pairs[self.opens]
        depth = self.excess[self.opens]
        # the parent is the last node before that lies one less deep
        parent = np.full(len(depth), -1)
        last = np.full(int(depth.max(initial=0)) + 1, -1)
        for n, d in enumerate(depth.tolist()):
            last[d] = n
            parent[n] = last[d - 1] if d > 1 else -1
        return behind, leaves, parent


def between(values: np.ndarray, first: np.ndarray, behind: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(values)]
    return total[behind] - total[first]


# --- shards -----------------------------------------------------------------------------
def digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


NOTHING = digest([])


def shard_nodes(members: list[tuple[int, bytes, list[int]]], above: int, depth: int) -> pa.RecordBatch:
    """Nodes of one shard, its top first.

    ``members`` are (conv_id, keys, words) in the order of their keys, from the shard's top on; ``above`` is the
    parent's conv_id and ``depth`` the top's depth.
    """
    bits: list[int] = []
    first: list[int] = []  # members before the node
    words: list[int] = []
    at: list[int] = []
    ends: dict[int, list[int]] = {}
    path: list[tuple[bytes, int]] = []
    for n, (conv_id, keys, own) in enumerate(members):
        steps = len(keys) // KEY
        same = 0
        while same < min(steps, len(path)) and path[same][0] == keys[KEY * same:KEY * same + KEY]:
            same += 1
        bits += [0] * (len(path) - same)
        del path[same:]
        for k in range(same, steps):
            path.append((keys[KEY * k:KEY * k + KEY], len(first)))
            bits.append(1)
            first.append(n)
            words.append(own[k])
            at.append(depth + k)
        ends.setdefault(path[-1][1], []).append(conv_id)
    bits += [0] * len(path)
    tree = Parentheses(np.array(bits, np.int8))
    behind, leaves, parent = tree.subtrees()
    start = np.array(first)
    rank = np.arange(len(start))
    # members up to the end of a subtree: those before the node that follows it
    upto = np.r_[start, len(members)][behind]
    count = upto - start
    ids = np.array([m[0] for m in members] + [0])
    bounds = np.stack([start, upto], axis=1).ravel()
    smallest = np.minimum.reduceat(ids, bounds)[::2]
    spared = between((count - 1) * np.array(words), rank, behind)
    children = np.bincount(parent[parent >= 0], minlength=len(rank))
    over = np.where(parent < 0, above, smallest[parent])
    hashes = [digest(sorted(ends[n])) if n in ends else NOTHING for n in rank.tolist()]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(
        (smallest, at, over, count, children, leaves, spared, hashes), ARROW)], schema=ARROW)


def groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows of one ``key`` after another; the rows come sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        values = batch.column(key).to_pylist()
        cut = 0
        for n, value in enumerate(values):
            if held or n > cut:
                before = values[n - 1] if n else held[-1].column(key)[-1].as_py()
                if value != before:
                    if n > cut:
                        held.append(batch.slice(cut, n - cut))
                    yield pa.Table.from_batches(held)
                    held, cut = [], n
        if len(values) > cut:
            held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


# --- paths -------------------------------------------------------------------------------
def turns(conversations: DataFrame) -> DataFrame:
    """Per conversation its turns in order: two hashes of role and text, and the text's words."""
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    placed = rows.withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)))
    told = F.struct("at", F.xxhash64("role", "text").alias("a"), F.xxhash64("text", "role", F.lit(1)).alias("b"),
                    F.regexp_count("text", F.lit(WORDS)).alias("words"))
    return placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(told)).alias("own"))


def rebuilt(conversations: DataFrame, family: int = 20, shared: int = 4) -> DataFrame:
    """Conversations with their first turns taken from the first of each ``family`` ids: crc32(id) % ``shared`` of them."""
    own = saved(turns(conversations), "turns")
    heads = own.select(F.col("conv_id").alias("_head"), F.slice("own", 1, shared - 1).alias("_first"))
    taken = F.crc32(F.col("conv_id").cast("string")) % shared
    base = F.col("conv_id") - F.col("conv_id") % family
    return own.withColumn("_base", base).join(heads, F.col("_base") == F.col("_head"), "left").select("conv_id", F.concat(
        F.slice(F.coalesce("_first", F.array().cast(heads.schema["_first"].dataType)), F.lit(1), taken.cast("int")),
        F.slice("own", (taken + 1).cast("int"), F.greatest(F.size("own"), F.lit(1)))).alias("own"))


def paths(held: DataFrame) -> DataFrame:
    """``conv_id``, the ``keys`` of all its prefixes from the root on, and ``words`` of each one's last text."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(1)
            sizes = np.asarray(own.value_lengths().fill_null(0))
            flat = own.flatten()
            first = np.cumsum(sizes) - sizes
            place = (np.arange(len(flat)) - np.repeat(first, sizes)).astype(np.uint64) + np.uint64(1)
            halves = []
            with np.errstate(over="ignore"):
                for name, mix in zip(("a", "b"), MIX):
                    x = np.asarray(flat.field(name)).view(np.uint64) + place * mix
                    x = (x ^ (x >> np.uint64(31))) * mix
                    total = np.r_[np.uint64(0), np.cumsum(x ^ (x >> np.uint64(29)), dtype=np.uint64)]
                    halves.append(total[1:] - np.repeat(total[first], sizes))
            keys = np.stack(halves, axis=1)
            words = np.asarray(flat.field("words")).tolist()
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([bytes(KEY) + keys[a:a + n].tobytes() for a, n in zip(first, sizes)], pa.binary()),
                pa.array([[0] + words[a:a + n] for a, n in zip(first, sizes)], pa.list_(pa.int32()))], ["conv_id", "keys", "words"])

    return held.select("conv_id", "own").mapInArrow(run, "conv_id bigint, keys binary, words array<int>")


def prefixes(held: DataFrame) -> DataFrame:
    """A row for each prefix of each path, with its ``key`` and ``depth``."""
    depths = F.sequence(F.lit(0), (F.length("keys") / KEY).cast("int") - 1)
    return (held.select("conv_id", "keys", F.explode(depths).alias("depth"))
            .select("conv_id", "depth", F.expr(f"substring(keys, depth * {KEY} + 1, {KEY})").alias("key")))


# --- the trie -----------------------------------------------------------------------------
def hashed_lists(ends: DataFrame) -> DataFrame:
    """``key`` and the hash of its ascending ids, joined by commas; ids meet in pieces, and the pieces are read one by one."""
    pieces = (ends.groupBy("key", F.shiftright("conv_id", ID_BITS).alias("piece"))
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")))
    placed = pieces.repartition("key").sortWithinPartitions("key", "piece")

    def run(batches):
        key, running = None, None
        for batch in batches:
            done = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != key:
                    if running:
                        done.append((key, running.hexdigest()))
                    key, running = k, hashlib.sha256(ids.encode())
                else:
                    running.update(b"," + ids.encode())
            yield out(done)
        if running:
            yield out([(key, running.hexdigest())])

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["key", "ends_sha256"])

    return placed.select("key", "ids").mapInArrow(run, "key binary, ends_sha256 string")


def shards(hung: DataFrame, tasks: int) -> DataFrame:
    """Nodes of all shards, some shards a task; a shard's first row also names the spine node it hangs on, in ``top``."""
    placed = (hung.withColumn("root", F.substring("keys", 1, KEY)).repartition(tasks, "root").sortWithinPartitions("root", "keys", "conv_id"))
    fields = ARROW.append(pa.field("top", pa.binary()))

    def run(batches):
        for group in groups(batches, "root"):
            conv_ids, keys, words, tops, above, on = (group.column(c).to_pylist() for c in ("conv_id", "keys", "words", "top", "above", "on"))
            batch = shard_nodes(list(zip(conv_ids, keys, words)), above[0], on[0] + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([tops[0]] + [None] * (batch.num_rows - 1), pa.binary())], schema=fields)

    return placed.select("root", "conv_id", "keys", "words", "top", "above", "on").mapInArrow(run, f"{NODES}, top binary")


def spine_nodes(spine: DataFrame) -> DataFrame:
    """The spine's own nodes, from what hangs on each: one task, at most ``SPREAD`` nodes to a level."""
    def run(batches):
        rows = [r for b in batches for r in b.to_pylist()]
        if not rows:
            return
        below: dict[bytes | None, list[int]] = {}
        for n, r in enumerate(rows):
            below.setdefault(r["parent"], []).append(n)
        bits, order, todo = [], [], [(below[None][0], False)]
        while todo:
            n, done = todo.pop()
            if done:
                bits.append(0)
                continue
            bits.append(1)
            order.append(n)
            todo.append((n, True))
            todo += [(c, False) for c in below.get(rows[n]["key"], [])]
        tree = Parentheses(np.array(bits, np.int8))
        behind, leaves, parent = tree.subtrees()
        rank = np.arange(len(order))
        seen = [rows[n] for n in order]
        count, words, hung, hung_leaves, hung_saved = (np.array([r[c] for r in seen], np.int64) for c in ("n_convs", "words", "hung", "leaves", "saved"))
        children = np.bincount(parent[parent >= 0], minlength=len(rank))
        # a node that is a leaf of the spine is one of the trie only if nothing hangs on it
        covered = between(((children == 0) & (hung > 0)).astype(np.int64), rank, behind)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((
            [r["conv_id"] for r in seen], [r["depth"] for r in seen], [None if p < 0 else seen[p]["conv_id"] for p in parent.tolist()],
            count, children + hung, leaves - covered + between(hung_leaves, rank, behind),
            between((count - 1) * words + hung_saved, rank, behind), [r["ends_sha256"] or NOTHING for r in seen]), ARROW)], schema=ARROW)

    return spine.mapInArrow(run, NODES)


def prefix_trie(held: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row for each node of the trie over conversations (``conv_id``, ``own`` as ``turns`` gives them).

    ``conv_id`` is a node's smallest member, ``parent_conv_id`` its parent's; ``n_convs`` its members, ``n_children``
    its children, ``n_leaves`` the childless nodes of its subtree, ``saved_tokens`` what sharing its subtree's turns
    saves, ``ends_sha256`` a hash of the members that end there.
    """
    way = saved(paths(held), "paths")
    n = way.count()
    size = max(shard, n // SPREAD)
    counted = prefixes(way).groupBy("key").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"))
    large = saved(counted.filter((F.col("n_convs") > size) | (F.col("depth") == 0)), "large")
    spine = saved(large.join(way, "conv_id").select(
        "key", "conv_id", "n_convs", F.col("depth").cast("bigint").alias("depth"), F.expr("words[depth]").cast("bigint").alias("words"),
        F.expr(f"CASE WHEN depth > 0 THEN substring(keys, (depth - 1) * {KEY} + 1, {KEY}) END").alias("parent")), "spine")
    # how far each conversation follows the spine, and the node of it that the rest hangs on
    far = prefixes(way).join(apart(spine.select("key")), "key").groupBy("conv_id").agg(F.max("depth").alias("on"))
    placed = way.join(far, "conv_id").selectExpr(
        "conv_id", "on", f"substring(keys, on * {KEY} + 1, {KEY}) AS top", f"substring(keys, (on + 1) * {KEY} + 1) AS keys",
        "slice(words, on + 2, size(words)) AS words")
    placed = saved(placed.join(apart(spine.select(F.col("key").alias("top"), F.col("conv_id").alias("above"))), "top"), "hung")
    nodes = saved(shards(placed.filter("length(keys) > 0"), enough(n, SHARDS_A_TASK * size)), "shards")
    hung = nodes.filter("top IS NOT NULL").groupBy(F.col("top").alias("key")).agg(
        F.count(F.lit(1)).alias("hung"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    ends = hashed_lists(placed.filter("length(keys) = 0").select(F.col("top").alias("key"), "conv_id"))
    whole = spine.join(hung, "key", "left").join(ends, "key", "left").fillna(0, ["hung", "leaves", "saved"])
    return nodes.drop("top").unionByName(spine_nodes(whole.coalesce(1)))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return prefix_trie(rebuilt(conversations))


def oracle() -> str:
    """Prefixes as strings of hashes; a subtree is what starts with its top's string.  Small tables only."""
    bit = "list_reduce(list_prepend(xor(s, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END))"
    octets = "list_transform(string_split(c::VARCHAR, ''), lambda d: ascii(d)::BIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda s, b: {bit}), 4294967295)"
    return f"""
    WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
        FROM conversations WHERE conv_id IS NOT NULL),
    h AS (SELECT c, {crc} % 4 AS h FROM (SELECT DISTINCT c FROM t)),
    r AS (SELECT h.c, 0 AS part, t.pos, role, text FROM h JOIN t ON t.c = h.c - h.c % 20 AND t.pos <= h.h
        UNION ALL SELECT h.c, 1, t.pos, role, text FROM h JOIN t ON t.c = h.c AND t.pos > h.h),
    p AS (SELECT c, row_number() OVER w AS depth, string_agg(md5(role || chr(0) || text), '') OVER w AS k,
            len(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS words FROM r
        WINDOW w AS (PARTITION BY c ORDER BY part, pos ROWS UNBOUNDED PRECEDING)),
    f AS (SELECT c, depth, k, words FROM p UNION ALL SELECT c, 0, '', 0 FROM h),
    z AS (SELECT c, max(depth) AS depth FROM f GROUP BY c),
    n AS (SELECT f.k, min(f.c) AS conv_id, f.depth, count(*) AS n_convs, any_value(f.words) AS words,
            sha256(coalesce(string_agg(f.c::VARCHAR, ',' ORDER BY f.c) FILTER (WHERE z.depth = f.depth), '')) AS ends_sha256
        FROM f JOIN z USING (c) GROUP BY f.k, f.depth),
    l AS (SELECT n.*, NOT EXISTS (SELECT 1 FROM n x WHERE x.depth = n.depth + 1 AND starts_with(x.k, n.k)) AS leaf FROM n)
    SELECT a.conv_id, a.depth, any_value(u.conv_id) AS parent_conv_id, a.n_convs,
        count(*) FILTER (WHERE b.depth = a.depth + 1) AS n_children, count(*) FILTER (WHERE b.leaf) AS n_leaves,
        sum((b.n_convs - 1) * b.words)::BIGINT AS saved_tokens, a.ends_sha256
    FROM l a JOIN l b ON b.depth >= a.depth AND starts_with(b.k, a.k)
        LEFT JOIN l u ON u.depth = a.depth - 1 AND u.k = left(a.k, 32 * (a.depth - 1)) GROUP BY a.k, a.conv_id, a.depth, a.n_convs, a.ends_sha256"""
