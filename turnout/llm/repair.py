"""Token ids in files compressed by Re-Pair grammars.

Documents are dealt out by ranges of ``doc_id``; each range is a shard and writes blocks of about
``BLOCK`` ids, whole documents each.  Within a block the frequent pairs of neighbouring symbols
are replaced by nonterminals, in rounds: each replaces up to ``RULES_A_ROUND`` pairs, the most frequent of those that
share a hash slot, and the next counts anew, until no pair stands ``FREQUENT`` times or the rules are used up.
Pairs never reach over the end of a document, so a document is a run of whole symbols, and the
expansion length kept with each rule finds any id without decoding what lies before it.

A file has one row per block: ``shard``, ``block``, ``n_ids``; ``doc_ids`` (64-bit),
``doc_lengths`` and ``doc_symbols`` (32-bit, ids and symbols of each document); ``rules`` (pairs of
32-bit symbols; the n-th makes symbol ``base`` + n), ``expansions`` (32-bit, ids that each rule stands
for), ``symbols`` (``width`` bytes each).  All integers are little-endian.  It is Parquet, written by
Spark, so a lost task leaves nothing behind and any store will do.

Null text counts as empty: its document has the end id alone.  Rows without an id come first; rows
of one id follow each other by a hash of their text.  An empty table gives no block.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from turnout.llm.base import batched, enough
from turnout.llm.bpe import shipped
from turnout.llm.pieces import Ragged
from turnout.session import scratch

END = 0
BLOCK = 1 << 19
RULES = 15_000
RULES_A_ROUND = 4_096
FREQUENT = 12
#: Pieces that are encoded in one go, and that are remembered.
TOGETHER = 2000
REMEMBERED = 1_200_000
STARTS_A_FILE = 1_000_000
#: Multiplier that spreads pairs over slots.
HASHED = 2654435761
FILE = ("shard int, block int, n_ids bigint, base int, width int, doc_ids binary, doc_lengths binary, doc_symbols binary, "
        "rules binary, expansions binary, symbols binary")


class Grammar(NamedTuple):
    """Rules as pairs of symbols from ``base`` on, their expansion lengths, symbols, and symbols of each document."""
    base: int
    rules: np.ndarray
    expansions: np.ndarray
    symbols: np.ndarray
    doc_symbols: np.ndarray


def compressed(ids: np.ndarray, doc_lengths: np.ndarray, base: int, most: int = RULES) -> Grammar:
    """The grammar of a block of ids below ``base``."""
    narrow = base + most <= 1 << 16
    kind, shift = (np.uint32, 16) if narrow else (np.uint64, 32)
    symbols = ids.astype(np.uint16 if narrow else np.uint32)
    ends = np.cumsum(doc_lengths)
    rules, lengths = [np.zeros((0, 2), np.uint32)], np.ones(base, np.uint32)
    while True:
        left = most + base - len(lengths)
        if len(symbols) < 2 or left <= 0:
            break
        pairs = symbols[:-1].astype(kind)
        pairs <<= kind(shift)
        pairs |= symbols[1:]
        none = kind(np.iinfo(kind).max)
        pairs[ends[:-1] - 1] = none
        ordered = np.sort(pairs)
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        counts = np.diff(np.append(first, len(ordered)))
        often = np.flatnonzero(counts >= FREQUENT)
        often = often[ordered[first[often]] != none]
        if not len(often):
            break
        best = often[np.argsort(-counts[often], kind="stable")[:min(left, RULES_A_ROUND)]]
        chosen = ordered[first[best]]
        slot = np.full(1 << 18, -1, np.int16)
        own = (chosen * kind(HASHED)).astype(np.uint32) >> np.uint32(14)
        slot[own[::-1]] = np.arange(len(chosen), dtype=np.int16)[::-1]  # of two pairs in a slot the more frequent goes first
        kept = slot[own] == np.arange(len(chosen))
        rule = slot[(pairs * kind(HASHED)).astype(np.uint32) >> np.uint32(14)]
        at = np.flatnonzero(rule >= 0)
        at = at[chosen[rule[at]] == pairs[at]]
        renamed = np.cumsum(kept) - 1
        rule, chosen = renamed[rule[at]], chosen[kept]
        begins = np.append(True, at[1:] != at[:-1] + 1)  # of runs of overlapping pairs, of which every other is taken
        index = np.arange(len(at))
        taken = (index - np.maximum.accumulate(np.where(begins, index, 0))) % 2 == 0
        at, rule = at[taken], rule[taken]
        made = np.stack([chosen >> kind(shift), chosen & kind((1 << shift) - 1)], axis=1).astype(np.uint32)
        symbols[at] = (len(lengths) + rule).astype(symbols.dtype)
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols = symbols[keep]
        ends = ends - np.searchsorted(at, ends)
        lengths = np.append(lengths, lengths[made[:, 0]] + lengths[made[:, 1]])
        rules.append(made)
    return Grammar(base, np.concatenate(rules), lengths[base:], symbols, np.diff(np.append(0, ends)))


class Block(NamedTuple):
    """A block as it is read: symbols are expanded where ids are asked for."""
    grammar: Grammar
    doc_lengths: np.ndarray

    @staticmethod
    def read(base: int, width: int, lengths: bytes, doc_symbols: bytes, rules: bytes, expansions: bytes, symbols: bytes) -> "Block":
        u4 = lambda raw: np.frombuffer(raw, "<u4")
        return Block(Grammar(base, u4(rules).reshape(-1, 2), u4(expansions), np.frombuffer(symbols, f"<u{width}"), u4(doc_symbols)), u4(lengths))

    def expander(self, terminals: list[bytes]) -> list[bytes]:
        """The ids of every symbol as little-endian 32-bit integers; ``terminals`` has those below ``base``."""
        out = list(terminals)
        for a, b in self.grammar.rules.tolist():
            out.append(out[a] + out[b])
        return out

    def documents(self, terminals: list[bytes]) -> Iterator[memoryview]:
        """Each document's ids."""
        made = self.expander(terminals)
        flat = np.frombuffer(b"".join(made), "<u4")
        sizes = np.concatenate([np.ones(self.grammar.base, np.int64), self.grammar.expansions])
        symbols = self.grammar.symbols
        own = sizes[symbols]
        ends = np.cumsum(own)
        at = np.repeat((np.cumsum(sizes) - sizes)[symbols] - ends + own, own)
        at += np.arange(len(at))
        raw = memoryview(flat[at].tobytes())
        stops = 4 * np.append(0, ends)[np.cumsum(self.grammar.doc_symbols)]
        start = 0
        for stop in stops.tolist():
            yield raw[start:stop]
            start = stop

    def ids(self, start: int, stop: int) -> list[int]:
        """Ids ``start`` to ``stop`` of the block; only the symbols that hold them are expanded."""
        g = self.grammar
        lengths = np.concatenate([np.ones(g.base, np.uint32), g.expansions])
        bounds = np.cumsum(lengths[g.symbols], dtype=np.int64)
        at = int(np.searchsorted(bounds, start, "right"))
        out: list[int] = []
        skip = start - (int(bounds[at - 1]) if at else 0)
        while at < len(g.symbols) and len(out) < skip + stop - start:
            stack = [int(g.symbols[at])]
            while stack:
                s = stack.pop()
                if s < g.base:
                    out.append(s)
                else:
                    a, b = g.rules[s - g.base].tolist()
                    stack += [b, a]
            at += 1
        return out[skip:skip + stop - start]


_encoders: dict[str, tuple[Ragged, int]] = {}


def encoder(content: str) -> tuple[Ragged, int]:
    """The tokenizers library behind a memo of pieces, and the number of ids."""
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(content)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        size = tokenizer.get_vocab_size(with_added_tokens=True)
        spaced = np.array([(tokenizer.id_to_token(n) or "").startswith("Ġ") for n in range(size)])

        def alone(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            ids = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array(list(chain.from_iterable(ids)), "<u4"), np.array(list(map(len, ids)), np.int64)

        def together(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """Pieces behind a space, without one themselves, are encoded in one go: an id that begins with a space begins a piece."""
            out = []
            for at in range(0, len(texts), TOGETHER):
                run = texts[at:at + TOGETHER]
                ids = np.array(tokenizer.encode_batch_fast([" " + " ".join(run)], add_special_tokens=False)[0].ids, "<u4")
                sizes = np.diff(np.flatnonzero(spaced[ids]), append=len(ids))
                out.append((ids, sizes) if len(sizes) == len(run) else alone([" " + p for p in run]))
            return np.concatenate([ids for ids, _ in out]), np.concatenate([sizes for _, sizes in out])

        _encoders.clear()
        _encoders[key] = Ragged(alone, together, REMEMBERED), size
    return _encoders[key]


def written(docs: DataFrame, path: str, folder: str) -> DataFrame:
    """Encode every text, append the end id, and write the blocks of all shards to ``folder``."""
    batched(docs.sparkSession)
    content = shipped(docs, path)
    end = np.array([END], "<u4").tobytes()
    # ranges are drawn from a sample that goes to the driver: ids and hashes, not texts
    order = [F.col("doc_id").asc_nulls_first(), F.col("_hash")]
    dealt = (docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("_hash"))
             .repartitionByRange(*order).sortWithinPartitions(*order, "text").drop("_hash"))

    def run(batches):
        shard, block = TaskContext.get().partitionId(), 0
        memo, base = encoder(content.value)
        doc_ids, texts_ids, size = [], [], 0

        def row():
            nonlocal block
            lengths = np.array([len(x) // 4 for x in texts_ids], np.int64)
            g = compressed(np.frombuffer(b"".join(texts_ids), "<u4"), lengths, base)
            known = np.array([d is not None for d in doc_ids], np.int64)
            values = np.array([d or 0 for d in doc_ids], "<i8")
            cells = [shard, block, int(lengths.sum()), g.base, g.symbols.dtype.itemsize, np.where(known, values, np.iinfo(np.int64).min).astype("<i8").tobytes(),
                     lengths.astype("<u4").tobytes(), g.doc_symbols.astype("<u4").tobytes(), g.rules.astype("<u4").tobytes(),
                     g.expansions.astype("<u4").tobytes(), g.symbols.tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 6]
            block += 1
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], [c.split()[0] for c in FILE.split(", ")])

        for batch in batches:
            ids = memo.values([t or "" for t in batch.column(1).to_pylist()])
            for doc_id, own in zip(batch.column(0).to_pylist(), ids):
                doc_ids.append(doc_id)
                texts_ids.append(own + end)
                size += len(own) // 4 + 1
                if size >= BLOCK:
                    yield row()
                    doc_ids, texts_ids, size = [], [], 0
        if doc_ids:
            yield row()

    dealt.mapInArrow(run, FILE).write.parquet(folder)
    return docs.sparkSession.read.schema(FILE).parquet(folder)


def block_starts(spark: SparkSession, folder: str) -> DataFrame:
    """``shard``, ``block`` and the number of ids before the block, from the files' counts alone.

    The sums over shards meet in one task; there are as many as tasks that wrote.
    """
    sizes = spark.read.schema(FILE).parquet(folder).select("shard", "block", "n_ids")
    earlier = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    shards = shards.select("shard", earlier(Window.orderBy("shard")).alias("_before"))
    own = sizes.select("shard", "block", earlier(Window.partitionBy("shard").orderBy("block")).alias("_own"))
    return own.join(shards, "shard").select("shard", "block", (F.col("_before") + F.col("_own")).alias("start"))


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, decoded from the files: ``start``, ``n_tokens`` and the crc32 of its ids."""
    path = scratch(spark, "starts")
    blocks = spark.read.schema(FILE).parquet(folder).count()
    block_starts(spark, folder).coalesce(enough(blocks, STARTS_A_FILE)).write.parquet(path)
    starts = spark.read.schema("shard int, block int, start bigint").parquet(path)
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def run(batches):
        terminals: list[bytes] = []
        for batch in batches:
            for r in batch.to_pylist():
                if len(terminals) != r["base"]:
                    raw = np.arange(r["base"], dtype="<u4").tobytes()
                    terminals = [raw[n:n + 4] for n in range(0, len(raw), 4)]
                block = Block.read(r["base"], r["width"], r["doc_lengths"], r["doc_symbols"], r["rules"], r["expansions"], r["symbols"])
                ids = np.frombuffer(r["doc_ids"], "<i8")
                sums = [(len(x) // 4, zlib.crc32(x)) for x in block.documents(terminals)]
                sizes = np.array([s[0] for s in sums], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64(), mask=ids == np.iinfo(np.int64).min), pa.array(r["start"] + np.cumsum(sizes) - sizes),
                     pa.array(sizes), pa.array([s[1] for s in sums], pa.int64())], names)

    blocks = spark.read.schema(FILE).parquet(folder).join(starts, ["shard", "block"])
    return blocks.select("start", *[c.split()[0] for c in FILE.split(", ")]).mapInArrow(
        run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def packed(docs: DataFrame, path: str) -> DataFrame:
    """Write all documents to the shared folder and return what the files say of each."""
    folder = scratch(docs.sparkSession, "ids")
    written(docs, path, folder)
    return read_back(docs.sparkSession, folder)
