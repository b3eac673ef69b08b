"""Periodic runs of words: a suffix automaton whose link tree gives access to last occurrences.

1. Words that no repeated stretch of ``GRAM`` words covers cannot lie in a run: a run of period q
   and length >= max(12, 2 q) equals itself q words on for at least six words.  What is left falls
   into islands, and the same test is made inside each island until it takes little away.
2. An island's words are appended to a suffix automaton.  Each state of its link tree has as colour
   the word at which its strings ended last; states of one colour lie on stretches of the way to the
   root, kept as splay trees (link-cut access), so that an appended word recolours its whole way in
   amortised logarithmic time.
3. A stretch whose longest string has L words and that ended last p words ago repeats after p words.
   If p <= L the words from p + L back hold a square of period p.  L is the longest, so the start is
   where a run starts, p is its smallest period, and every later word of the run reports the same
   start and period: the last one reported is the run's end.

Null and empty texts, and texts of white space, have no word and no run.  Words are compared exactly
(by numbers given inside the text); hashes only choose islands, where a collision costs time and loses
nothing.  Repeated rows give repeated rows, ties among longest runs go to the smallest start, then the
smallest period.  Empty tables give empty ones; other columns are ignored.  A text is worked on whole by one
task; an island takes about half a kilobyte a word.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from turnout.llm.base import batched

#: A run has at least so many words; GRAM of them, less than a period, are met again a period on.
LEAST = 12
GRAM = LEAST // 2
#: Islands are looked through again while that takes at least this share of their words away.
FALL = 0.05
MIX = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = ("doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
          "runs_sha256 string, collapsed_sha256 string")


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space."""
    return (text or "").encode().split()


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """One id in ten has its words from a on replaced by repeats of the first p of them; a null id has not."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a:a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[:n - a]


def covered(ids: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Which words lie in a stretch of GRAM words that its own piece holds twice or more; pieces are contiguous."""
    out = np.zeros(len(ids), bool)
    n = len(ids) - GRAM + 1
    if n < 2:
        return out
    rolled = piece[:n].astype(np.uint64) * MIX
    for k in range(GRAM):
        rolled = (rolled ^ ids[k:k + n].astype(np.uint64)) * MIX
        rolled ^= rolled >> np.uint64(29)
    at = np.flatnonzero(piece[:n] == piece[GRAM - 1:])
    rolled = rolled[at]
    ordered = np.sort(rolled)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(again):
        return out
    place = np.minimum(np.searchsorted(again, rolled), len(again) - 1)
    hit = at[again[place] == rolled]
    edges = np.zeros(len(ids) + 1, np.int64)
    edges[hit] += 1
    edges[hit + GRAM] -= 1
    return np.cumsum(edges[:-1]) > 0


def islands(ids: np.ndarray, piece: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of all stretches in which runs may lie.  ``piece`` says what is contiguous, such as a text's number."""
    places = np.arange(len(ids))
    while len(ids):
        keep = covered(ids, piece)
        before = len(ids)
        ids, piece, places = ids[keep], piece[keep], places[keep]
        if not len(ids):
            break
        new = np.r_[True, (np.diff(places) > 1) | (piece[1:] != piece[:-1])]
        piece = np.cumsum(new)
        long = np.bincount(piece)[piece] >= LEAST
        ids, piece, places = ids[long], piece[long], places[long]
        if len(ids) > (1 - FALL) * before:
            break
    if not len(ids):
        return []
    first = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
    last = np.r_[first[1:], len(ids)] - 1
    return list(zip(places[first].tolist(), (places[last] + 1).tolist()))


def runs(word: list[int]) -> list[tuple[int, int, int]]:
    """Start, length and period of each run of length >= max(LEAST, 2 * period), by start and period."""
    # state 0 stands for none, 1 for the root; ``up`` leads to the parent in a splay tree or, from a
    # splay tree's top, to the state above its stretch; the colour is kept at a splay tree's top
    size = 2 * len(word) + 2
    length, link = [0] * size, [0] * size
    less, more, up, colour = [0] * size, [0] * size, [0] * size, [-1] * size
    follow: list = [None] * size
    follow[1] = {}
    used, tail = 1, 1
    found: dict[tuple[int, int], int] = {}

    def splay(x: int) -> None:
        p = up[x]
        if not p or (less[p] != x and more[p] != x):
            return
        top = p
        while True:
            g = up[top]
            if not g or (less[g] != top and more[g] != top):
                break
            top = g
        colour[x] = colour[top]
        over = up[top]
        while p != over:
            g = up[p]
            if p == top:  # one turn
                if less[p] == x:
                    c = less[p] = more[x]
                    more[x] = p
                else:
                    c = more[p] = less[x]
                    less[x] = p
                if c:
                    up[c] = p
                up[p] = x
                up[x] = over
                return
            gg = up[g]
            if less[g] == p:
                if less[p] == x:
                    c = less[g] = more[p]
                    if c:
                        up[c] = g
                    more[p] = g
                    d = less[p] = more[x]
                    if d:
                        up[d] = p
                    more[x] = p
                    up[g], up[p] = p, x
                else:
                    c = more[p] = less[x]
                    if c:
                        up[c] = p
                    d = less[g] = more[x]
                    if d:
                        up[d] = g
                    less[x], more[x] = p, g
                    up[p] = up[g] = x
            elif more[p] == x:
                c = more[g] = less[p]
                if c:
                    up[c] = g
                less[p] = g
                d = more[p] = less[x]
                if d:
                    up[d] = p
                less[x] = p
                up[g], up[p] = p, x
            else:
                c = less[p] = more[x]
                if c:
                    up[c] = p
                d = more[g] = less[x]
                if d:
                    up[d] = g
                more[x], less[x] = p, g
                up[p] = up[g] = x
            up[x] = gg
            if g == top:
                return
            if less[gg] == g:
                less[gg] = x
            else:
                more[gg] = x
            p = gg

    for i, w in enumerate(word):
        used += 1
        new = used
        length[new] = length[tail] + 1
        follow[new] = {}
        state = tail
        while state and w not in follow[state]:
            follow[state][w] = new
            state = link[state]
        if not state:
            above = 1
        else:
            q = follow[state][w]
            if length[q] == length[state] + 1:
                above = q
            else:
                used += 1
                above = used
                length[above] = length[state] + 1
                follow[above] = dict(follow[q])
                while state and follow[state].get(w) == q:
                    follow[state][w] = above
                    state = link[state]
                link[above], link[q] = link[q], above
                # the copy stands right above q on q's stretch and has its colour
                splay(q)
                c = less[above] = less[q]
                if c:
                    up[c] = above
                less[q], up[above] = above, q
        link[new] = up[new] = above
        tail = new
        # access: stretches on the way to the root, the lowest first
        below, x = new, above
        while x:
            splay(x)
            ended = colour[x]
            c = more[x]
            if c:
                colour[c] = ended
            more[x] = below
            most = length[x]
            if 0 <= ended and i - ended <= most:
                found[ended - most + 1, i - ended] = i
            below, x = x, up[x]
        colour[below] = i
        splay(new)
    return sorted((s, e - s + 1, p) for (s, p), e in found.items() if e - s + 1 >= max(LEAST, 2 * p))


def all_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each of some texts' words."""
    numbers, lengths = [], []
    for words in texts:
        table: dict[bytes, int] = {}
        numbers.append(np.fromiter((table.setdefault(w, len(table)) for w in words), np.int64, len(words)))
        lengths.append(len(words))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not sum(lengths):
        return out
    ids = np.concatenate(numbers)
    piece = np.repeat(np.arange(len(texts)), lengths)
    starts = np.r_[0, np.cumsum(lengths)]
    for a, b in islands(ids, piece):
        n = int(piece[a])
        at = a - int(starts[n])
        out[n] += [(at + s, size, p) for s, size, p in runs(ids[a:b].tolist())]
    return out


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run repeats: all but those behind a run's first period."""
    if not found:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for s, size, p in found:
        gone[s + p] += 1
        gone[s + size] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]


def _per_text(docs: DataFrame, shaped, schema: str, plant: bool) -> DataFrame:
    """``shaped`` of each id, its words and runs, in Arrow batches; words are planted first if asked for."""
    batched(docs.sparkSession)
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_pylist()
            texts = [words_of(t) for t in batch.column(1).to_pylist()]
            if plant:
                texts = [planted(words, d) for d, words in zip(ids, texts)]
            rows = [shaped(d, words, found) for d, words, found in zip(ids, texts, all_runs(texts))]
            yield pa.RecordBatch.from_arrays([pa.array(column, pa.string() if name.endswith(("sha256", "text")) else (
                pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])) if name == "runs" else pa.int64()))
                for name, column in zip(names, zip(*rows))], names)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id``, all ``runs`` by start and period, and ``collapsed_text`` without the repeats."""
    def shaped(doc_id, words, found):
        return doc_id, [dict(zip(("start", "length", "period"), r)) for r in found], b" ".join(collapsed(words, found)).decode()

    return _per_text(docs, shaped, "doc_id bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed_text string", False)


def run_digests(docs: DataFrame) -> DataFrame:
    """The contract's columns: the longest run and digests of all runs and of the collapsed words, repeats planted by id."""
    def shaped(doc_id, words, found):
        said = "".join(f"{s},{size},{p}\n" for s, size, p in found)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        return (doc_id, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
                hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest())

    return _per_text(docs, shaped, SCHEMA, True)
