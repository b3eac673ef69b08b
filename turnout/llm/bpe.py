"""BPE encoding and decoding over a contiguous array of ranks.

A short word keeps its part boundaries and the rank of each adjacent pair in two arrays.  The
smallest rank is scanned for, its boundary deleted and the two neighbouring ranks looked up
anew, until no pair is left that the vocabulary merges.  Words beyond ``SHORT`` bytes, for which
repeated scans would be quadratic, take the same merges from a heap.

Null text counts as empty and gives no ids; special strings inside texts become their own id.
Rows are handled one by one, so repeated rows and ids give repeated results and an empty table
gives an empty one.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from turnout.llm.base import batched
from turnout.llm.pieces import Memo, PRETOKEN

SHORT = 200
NONE = 1 << 30
ENCODED = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Coder:
    """Encoder and decoder of one byte-level vocabulary file's content."""

    def __init__(self, content: str):
        data = json.loads(content)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.ids = {raw(token): n for token, n in data["model"]["vocab"].items() if token not in self.special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        #: merged bytes -> rank and length of the left part
        self.ranks = {raw(a + b): (rank, len(raw(a))) for rank, (a, b) in enumerate(merges)}
        #: splits a text at its special strings, the longest first, and keeps them at odd places
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.bytes_of = [b""] * size
        for token, n in self.ids.items():
            self.bytes_of[n] = token
        for token, n in self.special.items():
            self.bytes_of[n] = token.encode()
        self.words: dict[str, bytes] = {}
        self.memo = Memo(self.pieces, b"".join)

    def parts(self, word: bytes) -> list[bytes]:
        return self._scan(word) if len(word) <= SHORT else self._heap(word)

    def _scan(self, word: bytes) -> list[bytes]:
        known = self.ranks.get
        bounds = list(range(len(word) + 1))

        def rank(i: int) -> int:
            """Of the pair that meets at boundary i + 1."""
            found = known(word[bounds[i]:bounds[i + 2]])
            return found[0] if found and found[1] == bounds[i + 1] - bounds[i] else NONE

        ranks = [rank(i) for i in range(len(word) - 1)]
        while ranks and (least := min(ranks)) < NONE:
            i = ranks.index(least)
            del bounds[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(i - 1)
            if i < len(ranks):
                ranks[i] = rank(i)
        return [word[a:b] for a, b in zip(bounds, bounds[1:])]

    def _heap(self, word: bytes) -> list[bytes]:
        known, n = self.ranks.get, len(word)
        after, before = list(range(1, n + 2)), list(range(-1, n))  # neighbouring part starts
        alive = [True] * n

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j < n:
                found = known(word[i:after[j]])
                if found and found[1] == j - i:
                    heapq.heappush(heap, (found[0], i, j, after[j]))

        heap: list = []
        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, end = heapq.heappop(heap)
            if alive[i] and j < n and alive[j] and after[i] == j and after[j] == end:
                alive[j], after[i] = False, end
                if end < n:
                    before[end] = i
                if before[i] >= 0:
                    offer(before[i])
                offer(i)
        return [word[i:after[i]] for i in range(n) if alive[i]]

    def pieces(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        return [b"".join([self._word(w) for w in self.pretokens(text)]) for text in texts]

    def pretokens(self, text: str) -> Iterator[str]:
        parts = self.specials.split(text) if self.specials else [text]
        for n, part in enumerate(parts):
            if n % 2:
                yield part
            else:
                yield from PRETOKEN.findall(part)

    def _word(self, word: str) -> bytes:
        if (found := self.words.get(word)) is None:
            if len(self.words) > self.memo.limit:
                self.words.clear()
            ids = [self.special[word]] if word in self.special else [self.ids[p] for p in self.parts(word.encode())]
            found = self.words[word] = np.array(ids, "<u4").tobytes()
        return found

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        for ids in self.memo.values(texts):
            yield np.frombuffer(ids, "<u4")

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes_of[n] for n in ids]).decode("utf-8", "replace")


_coders: dict[str, Coder] = {}


def coder(content: str) -> Coder:
    """The process's coder of a vocabulary; building one takes longer than a batch."""
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(content)
    return _coders[key]


def shipped(df: DataFrame, path: str) -> Broadcast:
    """The vocabulary file's content on every executor (a file of one or two MB, whatever the data's size)."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and the ``ids`` of every text of ``docs``."""
    batched(docs.sparkSession)
    content = shipped(docs, path)

    def run(batches):
        own = coder(content.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = [pa.array(x.view("<i4"), pa.int32()) for x in own.encode(texts)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]).astype(np.int32)
            values = pa.concat_arrays(ids) if ids else pa.array([], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document the number of ids, and sha256 of the ids and of the text decoded from them."""
    batched(docs.sparkSession)
    content = shipped(docs, path)

    def run(batches):
        own = coder(content.value)
        names = [str(n) for n in range(len(own.bytes_of))]
        for batch in batches:
            out = ([], [], [])
            for found in own.encode([t or "" for t in batch.column(1).to_pylist()]):
                ids = found.tolist()
                out[0].append(len(ids))
                out[1].append(hashlib.sha256(",".join([names[n] for n in ids]).encode()).hexdigest())
                out[2].append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, ENCODED)
