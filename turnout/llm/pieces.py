"""Cut texts where a byte-level vocabulary never joins symbols, and remember what pieces gave.

A single space between two other characters always begins a pre-token, so a text may be cut
there and every piece handled alone.  Pieces repeat, hence the memo, which is bounded.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

SPACED = re.compile(r"(?<=\S) (?=\S)")
#: The pre-token pattern of the byte-level vocabularies (a fixed value of their format).
PRETOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Marks that are a pre-token of their own behind a letter or digit, so a word is the same with and without them.
TAIL = ".,;:!?*#%$&|"
PIECES = 300_000
#: Characters of texts that are worked on at a time.
WINDOW = 4_000_000


def windows(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive runs of texts of about ``WINDOW`` characters; no text is cut."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= WINDOW:
            yield run
            run, size = [], 0
    if run:
        yield run


class Memo:
    """``many`` maps a list of texts to their values, which ``join`` puts together in order."""

    def __init__(self, many: Callable[[list[str]], list], join: Callable[[Iterable], object], limit: int = PIECES):
        self.many, self.join, self.limit, self.known = many, join, limit, {}

    def values(self, texts: list[str]) -> Iterator:
        for run in windows(texts):
            collecting = gc.isenabled()
            gc.disable()  # many lists and no cycles: collections would only walk through them
            try:
                found = list(self._run(run))
            finally:
                if collecting:
                    gc.enable()
            yield from found

    def _run(self, texts: list[str]) -> Iterator:
        if len(self.known) > self.limit:
            self.known = {}
        lists, heads, unknown = [], {}, set()
        for text in texts:
            pieces = text.split(" ")
            values = list(map(self.known.get, pieces))
            gaps = [n for n, value in enumerate(values) if value is None]
            asked = [pieces[n] for n in gaps]
            unknown.update(asked)
            heads[pieces[0]] = None
            lists.append((pieces[0], values, gaps, asked))
        heads = dict(zip(heads, self.many(list(heads)), strict=True))
        new = [p for p in unknown if p not in self.known]
        whole = [p for p in new if p and not p[0].isspace() and not p[-1].isspace()]
        self.known.update(dict.fromkeys(new))  # None: beside white space, not a piece of its own
        fresh, tailed = {}, []
        for piece in whole:
            core = piece.rstrip(TAIL)
            if len(core) == len(piece) or not core or not (core[-1].isalpha() or core[-1] in "0123456789"):
                fresh[piece] = None
            else:
                tailed.append((piece, core, piece[len(core):]))
                if self.known.get(core) is None:
                    fresh[core] = None
        self.known.update(zip(fresh, self.many([" " + p for p in fresh]), strict=True))
        tails = dict.fromkeys(tail for _, _, tail in tailed)
        tails = dict(zip(tails, self.many(list(tails)), strict=True))
        for piece, core, tail in tailed:
            self.known[piece] = self.join([self.known[core], tails[tail]])
        for text, (head, values, gaps, asked) in zip(texts, lists, strict=True):
            for n, piece in zip(gaps, asked):
                values[n] = self.known[piece]
            values[0] = heads[head] if head and not head[-1].isspace() else None
            try:
                joined = self.join(values)
            except TypeError:  # a None among them: white space that a single space does not cut
                first, *rest = SPACED.split(text)
                joined = self.join(self.many([first, *(" " + p for p in rest)]))
            yield joined


class Ragged:
    """Ids of texts as bytes, gathered from the ids of their pieces.

    ``many`` maps texts to all their ids, one after the other, and the number of each text's; ``spaced`` does so for pieces
    behind a space, which is theirs.  Arrow cuts a window's texts and tells its different pieces, so that
    Python handles each of these once; the ids of all that are remembered lie in one array.
    """

    def __init__(self, many: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], spaced: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = PIECES):
        self.many, self.spaced, self.limit = many, spaced, limit
        self._forget()

    def _forget(self) -> None:
        #: places of pieces behind a space, of texts' first pieces and of tails; place 0 is for what is not a piece of its own
        self.known, self.heads, self.tails = {}, {}, {}
        self.ids, self.starts, self.sizes = np.empty(1 << 16, "<u4"), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.used, self.places = 0, 1

    def values(self, texts: list[str]) -> Iterator[bytes]:
        for run in windows(texts):
            collecting = gc.isenabled()
            gc.disable()  # as above
            try:
                found = list(self._run(run))
            finally:
                if collecting:
                    gc.enable()
            yield from found

    def _add(self, where: dict[str, int], pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first, used = self.places, self.used
        self.places, self.used = first + len(sizes), used + len(ids)
        while self.used > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.places > len(self.sizes):
            self.starts, self.sizes = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.sizes))
        self.ids[used:self.used] = ids
        self.sizes[first:self.places] = sizes
        self.starts[first:self.places] = used + np.cumsum(sizes) - sizes
        where.update(zip(pieces, range(first, self.places), strict=True))

    def _gathered(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of those places, one after the other, and where each place's end."""
        sizes = self.sizes[places]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[places] - ends + sizes, sizes)
        at += np.arange(len(at))
        return self.ids[at], ends

    def _learn(self, new: list[str]) -> None:
        """Remember pieces; one with marks behind a letter or digit from its ids without them."""
        fresh, tailed = {}, []
        for piece in new:
            if piece.isalnum():
                fresh[piece] = None
            elif not piece or piece[0].isspace() or piece[-1].isspace():
                self.known[piece] = 0  # beside white space
            else:
                core = piece.rstrip(TAIL)
                if len(core) == len(piece) or not core or not (core[-1].isalpha() or core[-1] in "0123456789"):
                    fresh[piece] = None
                else:
                    tailed.append((piece, core, piece[len(core):]))
                    if core not in self.known:
                        fresh[core] = None
        if fresh:
            self._add(self.known, list(fresh), *self.spaced(list(fresh)))
        tails = list(dict.fromkeys(tail for _, _, tail in tailed if tail not in self.tails))
        if tails:
            self._add(self.tails, tails, *self.many(tails))
        if tailed:
            both = np.empty(2 * len(tailed), np.int64)
            both[::2] = [self.known[core] for _, core, _ in tailed]
            both[1::2] = [self.tails[tail] for _, _, tail in tailed]
            ids, ends = self._gathered(both)
            self._add(self.known, [piece for piece, _, _ in tailed], ids, np.diff(ends[1::2], prepend=0))

    def _run(self, texts: list[str]) -> Iterator[bytes]:
        if len(self.known) + len(self.heads) > self.limit:
            self._forget()
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        bounds = cut.offsets.to_numpy()
        coded = cut.values.dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        which = coded.indices.to_numpy()
        heads = which[bounds[:-1]]
        behind = np.ones(len(which), bool)
        behind[bounds[:-1]] = False
        asked = np.zeros(len(pieces), bool)
        asked[which[behind]] = True
        found = np.array(list(map(self.known.get, pieces, repeat(-1))), np.int64)
        new = np.flatnonzero((found < 0) & asked)
        unknown = [pieces[n] for n in new.tolist()]
        self._learn(unknown)
        found[new] = list(map(self.known.__getitem__, unknown))
        firsts = [p for p in (pieces[n] for n in np.unique(heads).tolist()) if p not in self.heads]
        self.heads.update((p, 0) for p in firsts if not p or p[-1].isspace())
        firsts = [p for p in firsts if p not in self.heads]
        if firsts:
            self._add(self.heads, firsts, *self.many(firsts))
        places = found[which]
        places[bounds[:-1]] = [self.heads[pieces[n]] for n in heads.tolist()]
        ids, ends = self._gathered(places)
        stops = ends[bounds[1:] - 1].tolist()
        loose = np.zeros(len(texts), bool)
        loose[np.searchsorted(bounds, np.flatnonzero(places == 0), "right") - 1] = True
        raw = ids.tobytes()
        start = 0
        for text, stop, apart in zip(texts, stops, loose.tolist(), strict=True):
            if apart:  # white space that a single space does not cut
                first, *others = SPACED.split(text)
                yield self.many([first, *(" " + p for p in others)])[0].tobytes()
            else:
                yield raw[4 * start:4 * stop]
            start = stop
