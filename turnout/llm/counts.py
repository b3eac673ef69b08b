"""Token counts by merging all words of a batch at once.

Pre-tokens lie one behind the other in a flat array of symbols.  In each round every word's
lowest-rank pair is found and all its occurrences (left to right, without overlap) are merged at
the same time; words without a mergeable pair leave the array with the number of symbols they
have then.  A pair that a merge creates ranks after that merge, so this equals merging one
occurrence at a time.

Null text counts as empty: no bytes, no tokens.  Repeated rows give repeated results, an empty
table an empty one, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from turnout.llm.base import batched
from turnout.llm.bpe import byte_letters, shipped
from turnout.llm.pieces import Memo, PRETOKEN

LIMIT = 1024
NONE = np.int64(1 << 40)
COUNTS = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


class Counter:
    """Symbol counts under one byte-level vocabulary file's content."""

    def __init__(self, content: str):
        data = json.loads(content)
        vocab = data["model"]["vocab"]
        self.special = [t["content"] for t in data["added_tokens"]]
        self.symbol = np.zeros(256, np.int64)
        for letter, byte in byte_letters().items():
            self.symbol[byte] = vocab[letter]
        merges = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        self.size = 1 + max(vocab.values())
        pairs = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.ranks = pairs[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)[order]
        self.memo = Memo(self.pieces, sum)

    def merged(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Symbols that survive in each word of a ragged array; every word has one at least."""
        out = lengths.copy()
        words = np.arange(len(lengths))
        while len(words):
            word = np.repeat(np.arange(len(words)), lengths)
            starts = np.cumsum(lengths) - lengths
            codes = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
            rank = np.where((self.pairs[at] == codes) & (word[:-1] == word[1:]), self.ranks[at], NONE)
            rank = np.append(rank, NONE)
            least = np.minimum.reduceat(rank, starts)
            hit = (rank == least[word]) & (rank < NONE)
            follows = np.append(False, hit[1:] & hit[:-1])  # only x x x, as the pair is the same
            if follows.any():
                index = np.arange(len(hit))
                first = np.maximum.accumulate(np.where(hit & ~follows, index, 0))
                hit &= (index - first) % 2 == 0
            where = np.flatnonzero(hit)
            symbols = symbols.copy()
            symbols[where] = self.made[at[where]]
            keep = np.ones(len(symbols), bool)
            keep[where + 1] = False
            lengths = lengths - np.bincount(word[where], minlength=len(lengths))
            out[words] = lengths
            going = (least < NONE) & (lengths > 1)
            symbols = symbols[keep & going[word]]
            words, lengths = words[going], lengths[going]
        return out

    def pieces(self, texts: list[str]) -> list[int]:
        totals = np.zeros(len(texts), np.int64)
        owner, words = [], []
        for n, text in enumerate(texts):
            found = self.pretokens(text, totals, n)
            owner += [n] * len(found)
            words += found
        if words:
            raw = [w.encode() for w in words]
            lengths = np.fromiter(map(len, raw), np.int64, len(raw))
            symbols = self.symbol[np.frombuffer(b"".join(raw), np.uint8)]
            np.add.at(totals, np.array(owner), self.merged(symbols, lengths))
        return totals.tolist()

    def pretokens(self, text: str, totals: np.ndarray, n: int) -> list[str]:
        for special in self.special:
            if special in text:
                parts = text.split(special)
                totals[n] += len(parts) - 1
                return [w for part in parts for w in self.pretokens(part, totals, n)]
        return PRETOKEN.findall(text)


_counters: dict[str, Counter] = {}


def counter(content: str) -> Counter:
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(content)
    return _counters[key]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Per document its bytes, its tokens and whether these are over ``limit``."""
    batched(docs.sparkSession)
    content = shipped(docs, path)

    def run(batches):
        own = counter(content.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = [int(n) for n in own.memo.values(texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()),
                 pa.array([n > limit for n in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, COUNTS)
