"""String similarity in Arrow batches, and native bounds that avoid calling it.

The ratio is the matching-blocks ratio of the Python standard library; it is
not symmetric, so argument order is kept: (row, primary), (registrant, contact),
(quote, window).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from turnout.functions import fixed


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a.lower(), b.lower()).ratio()


@F.pandas_udf(DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Case-insensitive ratio; NULL in, NULL out."""
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def word_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio over word lists instead of characters."""
    return pd.Series([SequenceMatcher(None, x.split(), y.split()).ratio() for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def person_score(gate: pd.Series, floor: pd.Series, first_a: pd.Series, first_b: pd.Series, local_a: pd.Series,
                 local_b: pd.Series, ident_a: pd.Series, ident_b: pd.Series) -> pd.Series:
    """Weighted mailbox and identity ratio; NULL where the first names miss the gate or
    the character counts already keep the score below ``floor``."""
    names: dict[tuple, float] = {}
    out = []
    for g, least, fa, fb, la, lb, ia, ib in zip(gate, floor, first_a, first_b, local_a, local_b, ident_a, ident_b):
        if ia is None or ib is None:
            out.append(None)
            continue
        if g > 0:
            if (fa, fb) not in names:
                names[fa, fb] = ratio(fa, fb)
            if names[fa, fb] < g:
                out.append(None)
                continue
        mail, person = SequenceMatcher(None, la.lower(), lb.lower()), SequenceMatcher(None, ia.lower(), ib.lower())
        if least > 0 and (fixed.LOCAL_WEIGHT * mail.quick_ratio() + fixed.IDENTITY_WEIGHT * person.quick_ratio() < least - 1e-9):
            out.append(None)
            continue
        out.append(fixed.LOCAL_WEIGHT * mail.ratio() + fixed.IDENTITY_WEIGHT * person.ratio())
    return pd.Series(out, dtype="float64")


def common_subsequence(a: str, b: str) -> int:
    """Longest common subsequence length, bit-parallel; no ratio can match more characters."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        hit = state & masks.get(ch, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


# --- bounds for many pairs at once ------------------------------------------------------
class Letters:
    """Texts as rows of numbered characters over the alphabet of ``texts`` and ``others``.

    Two texts have in common, order aside, as many characters as their rows have ones at the same
    places, so one matrix product bounds the ratios of all pairs.
    """

    def __init__(self, texts: list[str], others: list[str]):
        codes = [np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32) for part in (texts, others)]
        alphabet = np.intersect1d(*codes)
        self.sizes = [np.array([len(t) for t in part], np.int64) for part in (texts, others)]
        counts = []
        for own, sizes in zip(codes, self.sizes):
            place = np.minimum(np.searchsorted(alphabet, own), max(len(alphabet) - 1, 0))
            known = alphabet[place] == own if len(alphabet) else np.zeros(len(own), bool)
            row = np.repeat(np.arange(len(sizes)), sizes)
            flat = np.bincount(row[known] * len(alphabet) + place[known], minlength=len(sizes) * len(alphabet))
            counts.append(flat.reshape(len(sizes), len(alphabet)))
        self.ones = [[], []]
        for level in range(1, 1 + min((int(c.max(initial=0)) for c in counts))):
            used = (counts[0] >= level).any(axis=0) & (counts[1] >= level).any(axis=0)
            for part, own in zip(self.ones, counts):
                part.append((own[:, used] >= level).astype(np.float32))
        self.ones = [np.concatenate(part, axis=1) if part else np.zeros((len(c), 0), np.float32) for part, c in zip(self.ones, counts)]

    def bound(self, rows: slice | np.ndarray, others: slice | np.ndarray = slice(None)) -> np.ndarray:
        """No ratio of these texts with the others is higher."""
        total = self.sizes[0][rows][:, None] + self.sizes[1][others][None, :]
        return np.where(total == 0, 1, 2 * (self.ones[0][rows] @ self.ones[1][others].T) / np.maximum(total, 1)).astype(np.float32)


    def reaching(self, rows: np.ndarray, others: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``rows`` and ``others`` of the pairs whose bound is ``least`` of the row or more, from one product."""
        half = (least / 2).astype(np.float32)
        ours = np.concatenate([self.ones[0][rows], -half[:, None]], axis=1)
        theirs = np.concatenate([self.ones[1][others], self.sizes[1][others].astype(np.float32)[:, None]], axis=1)
        bar = half * self.sizes[0][rows].astype(np.float32)
        return np.nonzero((ours @ theirs.T) >= bar[:, None] - 1e-4)

    def of_pairs(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """No ratio of these pairs is higher."""
        total = self.sizes[0][i] + self.sizes[1][j]
        common = np.einsum("ij,ij->i", self.ones[0][i], self.ones[1][j])
        return np.where(total == 0, 1, 2 * common / np.maximum(total, 1))


class Orders:
    """Longest common subsequences of many pairs, bit-parallel over pairs; texts of up to ``MOST`` characters."""

    MOST = 63

    def __init__(self, texts: list[str], others: list[str]):
        alphabet: dict[str, int] = {}
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.lengths = np.array([len(t) for t in others], np.int64)
        for text in texts:
            for ch in text:
                alphabet.setdefault(ch, len(alphabet) + 1)
        self.masks = np.zeros((len(texts), len(alphabet) + 1), np.uint64)
        for n, text in enumerate(texts):
            for k, ch in enumerate(text[:self.MOST]):
                self.masks[n, alphabet[ch]] |= np.uint64(1 << k)
        self.codes = np.zeros((len(others), int(self.lengths.max(initial=0))), np.int32)
        for n, text in enumerate(others):
            self.codes[n, :len(text)] = [alphabet.get(ch, 0) for ch in text]

    def bound(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """No ratio of these pairs is higher; what lies behind ``MOST`` characters of a text counts as common."""
        size = np.minimum(self.sizes[i], self.MOST).astype(np.uint64)
        full = (np.uint64(1) << size) - np.uint64(1)
        state = full.copy()
        for k in range(int(self.lengths[j].max(initial=0))):
            hit = state & self.masks[i, self.codes[j, k]]
            state = ((state + hit) | (state & ~hit)) & full
        common = size.astype(np.int64) - np.bitwise_count(state) + np.maximum(self.sizes[i] - self.MOST, 0)
        total = self.sizes[i] + self.lengths[j]
        return np.where(total == 0, 1.0, 2.0 * np.minimum(common, np.minimum(self.sizes[i], self.lengths[j])) / np.maximum(total, 1))


PAIRS = 100_000
ROWS = 512


def closest_people(asked: pd.DataFrame, known: pd.DataFrame, gate: float) -> Iterator[tuple[int, float, int]]:
    """Per asked person the best known one at or above the person's ``floor``: place in ``asked``, score, ``vid``.

    Both have ``local``, ``first`` and ``ident``; equal scores go to the smallest vid.  Every pair is bounded by its
    characters, the few that are left by their order, and what still may win is scored, best bound first.
    """
    def low(df, c):
        return [x.lower() for x in df[c].tolist()]

    mails, people, firsts = ((low(asked, c), low(known, c)) for c in ("local", "ident", "first"))
    names = [sorted(set(part)) for part in firsts]
    at = [np.searchsorted(np.array(own, object), np.array(part, object)) for own, part in zip(names, firsts)]
    near = Letters(*names)
    passed: dict[tuple[int, int], bool] = {}
    by_mail, by_person, floors, vids = Letters(*mails), Letters(*people), asked["floor"].to_numpy(float), known["vid"].tolist()
    least = (floors - fixed.LOCAL_WEIGHT) / fixed.IDENTITY_WEIGHT  # of the identities, if the mailboxes are equal
    by_name = np.argsort(at[0], kind="stable")  # so that a run of rows has few first names, and meets only names they pass with
    for start in range(0, len(asked), ROWS):
        rows = by_name[start:start + ROWS]
        own, place = np.unique(at[0][rows], return_inverse=True)
        may = near.bound(own) >= gate - 1e-4
        there = np.flatnonzero(may.any(axis=0)[at[1]])
        i, j = by_person.reaching(rows, there, least[rows] - 1e-4)
        fit = may[place[i], at[1][there[j]]]
        i, j = rows[i[fit]], there[j[fit]]
        keep, tight = [], []
        for k in range(0, len(i), PAIRS):
            a, b = i[k:k + PAIRS], j[k:k + PAIRS]
            t = fixed.LOCAL_WEIGHT * by_mail.of_pairs(a, b) + fixed.IDENTITY_WEIGHT * by_person.of_pairs(a, b)
            left = np.flatnonzero(t >= floors[a] - 1e-4)
            if not len(left):
                continue
            (ours, a), (theirs, b) = (np.unique(x[left], return_inverse=True) for x in (a, b))
            t = sum(weight * Orders([own[n] for n in ours.tolist()], [held[n] for n in theirs.tolist()]).bound(a, b)
                    for weight, (own, held) in ((fixed.LOCAL_WEIGHT, mails), (fixed.IDENTITY_WEIGHT, people)))
            fit = t >= floors[ours[a]] - 1e-9
            keep.append(left[fit] + k)
            tight.append(t[fit])
        if not keep:
            continue
        kept, tight = np.concatenate(keep), np.concatenate(tight)
        i, j = i[kept], j[kept]
        order = np.lexsort((-tight, i))
        row, best, who = -1, 0.0, None
        for a, b, t in zip(i[order].tolist(), j[order].tolist(), tight[order].tolist()):
            if a != row:
                if who is not None:
                    yield row, best, who
                row, best, who = a, floors[a] - 1e-12, None
            if t < best - 1e-9:
                continue
            pair = int(at[0][a]), int(at[1][b])
            if pair not in passed:
                passed[pair] = ratio(names[0][pair[0]], names[1][pair[1]]) >= gate
            if not passed[pair]:
                continue
            score = (fixed.LOCAL_WEIGHT * SequenceMatcher(None, mails[0][a], mails[1][b]).ratio()
                     + fixed.IDENTITY_WEIGHT * SequenceMatcher(None, people[0][a], people[1][b]).ratio())
            if score > best or score == best and who is not None and vids[b] < who:
                best, who = score, vids[b]
        if who is not None:
            yield row, best, who


#: Fewer pairs of names are bounded one by one.
FEW_NAMES = 64


def closest_names(asked: list[str], known: list[str], least: float) -> Iterator[tuple[int, float, int]]:
    """Per asked name the closest known one from ``least`` up: place in ``asked``, ratio, place in ``known``.

    Equal ratios go to the first known name.  As in ``closest_people``: all pairs are bounded by their letters, the few
    that are left by their order, and what still may win is scored, best bound first.
    """
    ours, theirs = [x.lower() for x in asked], [x.lower() for x in known]
    if not ours or not theirs:
        return
    if len(ours) * len(theirs) <= FEW_NAMES:
        bounds = [(a, 2.0 * common_subsequence(x, y) / max(len(x) + len(y), 1), b) for a, x in enumerate(ours) for b, y in enumerate(theirs)]
        yield from _closest(ours, theirs, sorted((a, -t, b) for a, t, b in bounds if t >= least - 1e-9), least)
        return
    letters, order = Letters(ours, theirs), Orders(ours, theirs)
    for start in range(0, len(ours), ROWS):
        i, j = np.nonzero(letters.bound(slice(start, start + ROWS)) >= least - 1e-4)
        i += start
        kept = []
        for k in range(0, len(i), PAIRS):
            a, b = i[k:k + PAIRS], j[k:k + PAIRS]
            t = order.bound(a, b)
            may = t >= least - 1e-9
            kept += zip(a[may].tolist(), (-t[may]).tolist(), b[may].tolist())
        yield from _closest(ours, theirs, sorted(kept), least)


def _closest(ours: list[str], theirs: list[str], bounds: list[tuple[int, float, int]], least: float) -> Iterator[tuple[int, float, int]]:
    """The winners among pairs that come sorted by asked name and falling bound."""
    row, best, who = -1, 0.0, None
    for a, t, b in bounds:
        if a != row:
            if who is not None:
                yield row, best, who
            row, best, who = a, least, None
        if -t < best - 1e-9:
            continue
        r = SequenceMatcher(None, ours[a], theirs[b]).ratio()
        if r > best or r == best and (who is None or b < who):
            best, who = r, b
    if who is not None:
        yield row, best, who


@F.pandas_udf(StringType())
def lowered(text: pd.Series) -> pd.Series:
    """Lower case as the ratio has it."""
    return text.str.lower()


def best_slice(quote: str, text: str, floor: float) -> tuple[float, str]:
    """Best ratio of a quote against one window, with the matching part; (0, '') below ``floor``.

    A window much longer than the quote is probed with quote-sized slices: every
    ``max(4, len/6)`` characters and once at the very end.
    """
    low, n, size = quote.lower(), len(quote), len(text)
    if not n or not size:
        return 0.0, ""
    whole = size <= 1.4 * n
    if floor > 0 and 2 * common_subsequence(low, text.lower()) < floor * (n + (size if whole else n)):
        return 0.0, ""
    spans = [(0, size)] if whole else [(s, s + n) for s in range(0, size - n + 1, max(4, n // 6))] + [(size - n, size)]
    best, at = 0.0, None
    for lo, hi in spans:
        matcher = SequenceMatcher(None, low, text[lo:hi].lower())
        bar = max(best, floor - 1e-12)
        if matcher.real_quick_ratio() < bar or matcher.quick_ratio() < bar:
            continue
        r = matcher.ratio()
        if r > best:
            best, at = r, (lo, hi)
    return (best, text[at[0]:at[1]]) if at and best >= floor else (0.0, "")


#: Pieces that are compared at once.
MOST_PIECES = 4000
#: Letters of pieces, and cells of a quote and its pieces, from which on they are walked by run lengths.
MANY_LETTERS, CELLS = 8000, 8_000_000
#: Fewer pieces are compared one by one.
FEW_PIECES = 4
#: From so many characters on, the library's ratio leaves out frequent ones of the second text.
POPULAR = 200


def matched(low: str, pieces: list[str], least: float) -> np.ndarray:
    """Characters that the library's ratio matches between ``low`` and each piece of under ``POPULAR`` characters.

    All pieces go through the recursion together: the longest common run of every open rectangle (the first
    one of equals) splits it in two, and the runs of the rest are cut to the halves.  -1 where the halves have
    no room for a ratio of ``least``.
    """
    n, sizes = len(low), np.array([len(p) for p in pieces], np.int64)
    m = int(sizes.max(initial=0))
    codes = np.frombuffer("".join(p.ljust(m) for p in pieces).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(pieces), m)
    inside = np.arange(m) < sizes[:, None]
    equal = {ch: (codes == ord(ch)) & inside for ch in set(low)}
    run = np.zeros((len(pieces), n + 1, m + 1), np.uint8)  # length of the common run that ends here
    for i in range(n):
        np.multiply(run[:, i, :-1] + np.uint8(1), equal[low[i]], out=run[:, i + 1, 1:])
    last = run > 0
    last[:, :-1, :-1] &= run[:, 1:, 1:] == 0
    at = np.flatnonzero(last)
    size = run.ravel()[at].astype(np.int32)
    at, j = np.divmod(at.astype(np.int32 if run.size < 2**31 else np.int64), m + 1)
    rect, i = np.divmod(at, n + 1)
    i, j = i - size, j - size
    total, dead = recursion(n, m, sizes, least, rect, i, j, size)
    return np.where(dead, -1, total)


#: Common runs from which on a slice is left to ``matching``, and what stands for its count.
LONG_RUN, NEAR = 12, -2


def matched_slices(low: str, codes: np.ndarray, places: dict[str, np.ndarray], start: np.ndarray, end: np.ndarray, least: float) -> np.ndarray:
    """``matched`` for many slices of one text, of which ``places`` has the letters; ``NEAR`` where a run of ``LONG_RUN`` is common.

    The library takes the longest common run of an open rectangle, the first one of equals, and goes on with what is before
    and behind it.  So all rectangles of all slices go through the run lengths together, from the longest down: where no longer
    run is left, the first place of ``low`` whose run stands in the rectangle is taken with its first place there, what is
    before it has shorter runs only, and the walk goes on behind it.
    """
    ours, n = [ord(ch) for ch in low], len(low)
    levels: list[list[tuple[int, np.ndarray]]] = [[(i, places[ch]) for i, ch in enumerate(low) if len(places[ch])]]
    while levels[-1] and len(levels) < LONG_RUN:
        size, longer = len(levels), []
        for i, at in levels[-1]:
            if i + size < n:
                at = at[:at.searchsorted(len(codes) - size)]
                at = at[codes[at + size] == ours[i + size]]
                if len(at):
                    longer.append((i, at))
        levels.append(longer)
    near = np.zeros(len(start), bool)
    if len(levels) == LONG_RUN and levels[-1]:
        at = np.unique(np.concatenate([at for _, at in levels[-1]]))
        near = at.searchsorted(end - LONG_RUN, "right") > at.searchsorted(start)
    piece, total = np.arange(len(start)), np.zeros(len(start), np.int64)
    a0, a1, b0, b1 = np.zeros(len(start), np.int64), np.full(len(start), n), start.astype(np.int64), end.astype(np.int64)
    bar, dead = (least - 1e-9) * (n + end - start) / 2, near.copy()
    for size in range(len(levels), 0, -1):
        room = np.minimum(a1 - a0, b1 - b0)
        dead |= total + np.bincount(piece, room, len(start)) < bar
        open_ = (room >= 1) & ~dead[piece]
        piece, a0, a1, b0, b1 = (x[open_] for x in (piece, a0, a1, b0, b1))
        before, last_a, last_b = [], a1 - size, b1 - size
        for i, at in levels[size - 1]:
            times, runs = np.empty(len(at) + 1, np.int64), np.empty(len(at) + 1, np.int64)
            times[0], times[1:-1], times[-1] = at[0] + 1, at[1:] - at[:-1], len(codes) - at[-1]
            runs[:-1], runs[-1] = at, 2 * len(codes)
            # the next run from each place on, by a table of all places or by search
            j = np.repeat(runs, times)[b0] if 24 * len(b0) > len(codes) else runs[at.searchsorted(b0)]
            hit = np.flatnonzero((j <= last_b) & (a0 <= i) & (i <= last_a))
            if len(hit):
                j = j[hit]
                total += size * np.bincount(piece[hit], minlength=len(start))
                if size > 1:
                    before.append((piece[hit], a0[hit], np.full(len(hit), i), b0[hit], j))
                a0[hit], b0[hit] = i + size, j + size
        if size > 1 and before:
            piece, a0, a1, b0, b1 = (np.concatenate([x, *more]) for x, *more in zip((piece, a0, a1, b0, b1), *before))
    return np.where(near, NEAR, np.where(dead, -1, total))


def recursion(n: int, m: int, sizes: np.ndarray, least: float, rect: np.ndarray, i: np.ndarray, j: np.ndarray, size: np.ndarray,
              longer: Callable | None = None, corner: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Matched characters of each piece from its common runs (``rect``: the piece, in order), and which have no room for ``least``.

    ``longer`` tells by how many characters a chosen run goes on to either side in its open rectangle, ``corner`` how many are
    equal from the start on, which count where no run is left before the first one chosen.
    """
    first_a, first_b = np.full(len(sizes), n, np.int64), sizes.copy()
    owner = np.arange(len(sizes))
    a0, a1, b0, b1 = (np.full(len(sizes), x, np.int32) for x in (0, n, 0, m))
    b1[:] = sizes
    total, dead = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), bool)
    bar = (least - 1e-9) * (n + sizes) / 2
    while len(rect):
        starts = np.flatnonzero(np.r_[True, rect[1:] != rect[:-1]])
        here = rect[starts]
        owner, a0, a1, b0, b1 = owner[here], a0[here], a1[here], b0[here], b1[here]
        rect = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(np.r_[starts, len(rect)]))
        first = np.maximum.reduceat((size * np.int64(n + 1) + n - i) * (m + 1) + m - j, starts)
        bj, first = m - first % (m + 1), first // (m + 1)
        bi, most = n - first % (n + 1), first // (n + 1)
        bi, bj, most = (x.astype(np.int32) for x in (bi, bj, most))
        if longer:
            before, after = longer(owner, bi, bj, most, a0, a1, b0, b1)
            bi, bj, most = bi - before, bj - before, most + before + after
        total += np.bincount(owner, most, len(sizes)).astype(np.int64)
        ai, aj = bi + most, bj + most
        at_start = (a0 == 0) & (b0 == 0)
        first_a[owner[at_start]], first_b[owner[at_start]] = bi[at_start], bj[at_start]
        room = np.minimum(bi - a0, bj - b0) + np.minimum(a1 - ai, b1 - aj)
        dead |= total + np.bincount(owner, room, len(sizes)) + np.minimum(corner, np.minimum(first_a, first_b)) < bar
        open_ = ~dead[owner][rect]
        before = np.minimum(size, np.minimum(bi[rect] - i, bj[rect] - j))
        skip = np.maximum(0, np.maximum(ai[rect] - i, aj[rect] - j))
        left, right = open_ & (before > 0), open_ & (size - skip > 0)
        rect, i, j, size = (np.concatenate(part) for part in (
            (rect[left], rect[right] + len(starts)), (i[left], (i + skip)[right]), (j[left], (j + skip)[right]), (before[left], (size - skip)[right])))
        owner, a0, a1, b0, b1 = np.r_[owner, owner], np.r_[a0, ai], np.r_[bi, a1], np.r_[b0, aj], np.r_[bj, b1]
    return total + np.minimum(corner, np.minimum(first_a, first_b)), dead


def equal_ahead(a: str, i: int, b: str, j: int, most: int) -> int:
    """Equal characters from ``i`` and ``j`` on, at most so many."""
    done, step = 0, 16
    while done < most:
        step = min(step, most - done)
        if a[i + done:i + done + step] == b[j + done:j + done + step]:
            done, step = done + step, 2 * step
        elif step == 1:
            break
        else:
            step //= 2
    return done


def equal_behind(a: str, i: int, b: str, j: int, most: int) -> int:
    """Equal characters that end before ``i`` and ``j``, at most so many."""
    done, step = 0, 16
    while done < most:
        step = min(step, most - done)
        if a[i - done - step:i - done] == b[j - done - step:j - done]:
            done, step = done + step, 2 * step
        elif step == 1:
            break
        else:
            step //= 2
    return done


#: Shorter common runs are left to the library.
SHORT_RUN = 5


def longest_run(a: str, b: str) -> tuple[int, int, int] | None:
    """The longest common run, the first one of equals: place in ``a``, in ``b``, length; None where it is a short one.

    A run of 2k - 1 characters holds one of the grams of k that ``a`` is cut into.
    """
    k = max(SHORT_RUN, min(len(a), len(b)) // 2)
    while min(len(a), len(b)) >= k:
        best = (0, 0, 0)
        for i in range(0, len(a) - k + 1, k):
            gram = a[i:i + k]
            j = b.find(gram)
            while j >= 0:
                back = equal_behind(a, i, b, j, min(i, j))
                size = back + k + equal_ahead(a, i + k, b, j + k, min(len(a) - i, len(b) - j) - k)
                best = max(best, (size, back - i, back - j))
                j = b.find(gram, j + 1)
        size, i, j = best
        if size >= 2 * k - 1:
            return -i, -j, size
        if k == SHORT_RUN:
            return None
        k = max(SHORT_RUN, (size + 1) // 2 if size else k // 4)
    return None


def matching(a: str, b: str) -> int:
    """Characters that the library's ratio matches, quickly where long runs are common to both."""
    if len(b) >= POPULAR:
        return matching_rare(a, b)
    total, open_ = 0, [(a, b)]
    while open_:
        x, y = open_.pop()
        if not x or not y:
            continue
        run = longest_run(x, y)
        if run is None:
            total += sum(part.size for part in SequenceMatcher(None, x, y, False).get_matching_blocks())
            continue
        i, j, size = run
        total += size
        open_ += (x[:i], y[:j]), (x[i + size:], y[j + size:])
    return total


def matching_rare(a: str, b: str) -> int:
    """The same where frequent characters of ``b`` begin no run: only the others are walked, runs grow by any."""
    most, where = len(b) // 100 + 1, {}
    for ch, times in Counter(b).items():
        if times <= most:
            at = [b.find(ch)]
            while len(at) < times:
                at.append(b.find(ch, at[-1] + 1))
            where[ch] = at
    held = [(i, where[ch]) for i, ch in enumerate(a) if ch in where]
    places = [i for i, _ in held]
    total, open_ = 0, [(0, len(a), 0, len(b))]
    while open_:
        a0, a1, b0, b1 = open_.pop()
        best, bi, bj, runs, last = 0, 0, 0, {}, -2
        for i, at in held[bisect_left(places, a0):bisect_left(places, a1)]:
            before, runs = runs if i == last + 1 else {}, {}
            last = i
            for j in at:
                if b0 <= j < b1:
                    size = runs[j] = before.get(j - 1, 0) + 1
                    if size > best:
                        best, bi, bj = size, i - size + 1, j - size + 1
        if best:
            back = equal_behind(a, bi, b, bj, min(bi - a0, bj - b0))
            ai, aj = bi + best, bj + best
            on = equal_ahead(a, ai, b, aj, min(a1 - ai, b1 - aj))
            total += back + best + on
            open_ += (a0, bi - back, b0, bj - back), (ai + on, a1, aj + on, b1)
        else:  # the library then takes what is equal from the corner on
            total += equal_ahead(a, a0, b, b0, min(a1 - a0, b1 - b0))
    return total


class Slices:
    """Windows in their order of preference, ready to be searched for the best slice of a quote at any ratio.

    A window much longer than the quote is probed as in ``best_slice``.  A quote is first held against the place that
    shares most of its parts.  What it reaches there leaves so few characters unmatched that a better or equal slice has to
    hold one of that many parts whole, near the same place: mostly few slices do.  Else every slice is bounded by the letters it
    shares with the quote, from running counts over all windows; the best bounds are scored first, until
    none that is left can win or tie.
    """

    #: Parts that tell where to begin, the shortest part that tells places apart, and how many slices and places are few.
    PARTS, SHORTEST, FEW, PLACES = 6, 4, 60, 300

    def __init__(self, texts: list[str]):
        self.texts = texts
        low = [t.lower() for t in texts]
        self.sizes = np.array([len(t) for t in texts], np.int64)
        # a few capitals grow when lowered, or by what stands around them; their windows are not bounded
        self.odd = np.array([len(a) != len(b) or "\u03a3" in b for a, b in zip(low, texts)], bool)
        self.odd_at = np.flatnonzero(self.odd).tolist()
        self.sizes_at = self.sizes.tolist()
        self.starts = np.r_[0, np.cumsum(self.sizes)]
        self.starts_at = self.starts.tolist()
        self.whole = "".join(b if len(a) != len(b) else a for a, b in zip(low, texts))
        self.codes = np.frombuffer(self.whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.running: dict[str, np.ndarray] = {}
        self.places: dict[str, np.ndarray] = {}

    def count(self, letter: str, at: np.ndarray) -> np.ndarray:
        if letter not in self.running:
            self.running[letter] = np.r_[0, np.cumsum(self.codes == ord(letter), dtype=np.int32)]
        return self.running[letter][at]

    def place(self, letter: str) -> np.ndarray:
        if letter not in self.places:
            self.places[letter] = np.flatnonzero(self.codes == ord(letter))
        return self.places[letter]

    def slices(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window, start and end of each slice to be compared with a quote of ``n`` characters."""
        window = np.flatnonzero(self.sizes > 0)
        whole = window[self.sizes[window] <= 1.4 * n]
        long = window[self.sizes[window] > 1.4 * n]
        step = max(4, n // 6)
        probes = (self.sizes[long] - n) // step + 1
        owner = np.repeat(long, probes)
        at = (np.arange(len(owner)) - np.repeat(np.cumsum(probes) - probes, probes)) * step
        return (np.concatenate([whole, owner, long]), np.concatenate([0 * whole, at, self.sizes[long] - n]),
                np.concatenate([self.sizes[whole], at + n, self.sizes[long]]))

    def holding(self, low: str, parts: int, most: int) -> list[tuple[int, int]] | None:
        """Where windows hold one of so many parts of a quote whole: window and where in it the quote would begin; None beyond ``most``."""
        found, cuts = [], [len(low) * k // parts for k in range(parts + 1)]
        for a, b in zip(cuts, cuts[1:]):
            part = low[a:b]
            at = self.whole.find(part)
            while at >= 0:
                window = bisect_right(self.starts_at, at) - 1
                if at + b - a <= self.starts_at[window + 1]:
                    if len(found) == most:
                        return None
                    found.append((window, at - self.starts_at[window] - a))
                at = self.whole.find(part, at + 1)
        return found

    def probes(self, n: int, window: int, first: int, last: int) -> Iterator[tuple[int, int, int]]:
        """Slices of a window that begin from ``first`` to ``last``, in that window's order (see ``slices``)."""
        size = self.sizes_at[window]
        if size <= 1.4 * n:
            yield window, 0, size
            return
        step = max(4, n // 6)
        for k in range(max(0, -(-first // step)), min(last, size - n) // step + 1):
            yield window, k * step, k * step + n
        if first <= size - n <= last:
            yield window, size - n, size

    def best(self, quote: str) -> tuple[float, int, str] | None:
        """Ratio, window and slice of the best match; of equal ones the earliest.  None where nothing matches."""
        low, n = quote.lower(), len(quote)
        if not n:
            return None
        scored: dict[str, float] = {}
        if len(low) >= self.PARTS * self.SHORTEST and not self.odd_at:
            likely = self.holding(low, self.PARTS, self.PLACES)
            if likely:
                (window, begin), _ = Counter(likely).most_common(1)[0]
                step = max(4, n // 6)
                hit = self.best_in({*self.probes(n, window, begin - step, begin + step)}, low, scored)
                lost = (1 - hit[0]) * 2 * len(low) / hit[0] if hit else len(low)
                parts = int(lost + 1e-6) + 1
                if parts * self.SHORTEST <= len(low):
                    # what a slice has before a part and the quote has not is unmatched too: it begins near by
                    there = self.holding(low, parts, self.PLACES)
                    if there is not None:
                        near = {probe for w, at in there for probe in self.probes(n, w, at - parts, at + parts)}
                        if len(near) <= self.FEW:
                            return self.best_in(near | {hit[1:]}, low, scored, True)
        return self.best_of(low, n, scored)

    def best_in(self, slices: set[tuple[int, int, int]], low: str, scored: dict[str, float], told: bool = False):
        """The best of a few slices, one by one: ratio and slice, or as ``best`` has it."""
        best, at = 0.0, None
        for window, lo, hi in sorted(slices):
            piece = self.texts[window][lo:hi].lower()
            if piece not in scored:
                scored[piece] = 2.0 * matching(low, piece) / (len(low) + len(piece))
            if scored[piece] > best:
                best, at = scored[piece], (window, lo, hi)
        if at is None:
            return None
        return (best, at[0], self.texts[at[0]][at[1]:at[2]]) if told else (best, *at)

    def best_of(self, low: str, n: int, scored: dict[str, float]) -> tuple[float, int, str] | None:
        """The best match of all slices; ``scored`` keeps the ratios of those that were scored before."""
        window, lo, hi = self.slices(n)
        start, end = self.starts[window] + lo, self.starts[window] + hi
        common = np.zeros(len(window), np.int64)
        for letter in set(low):
            common += np.minimum(low.count(letter), self.count(letter, end) - self.count(letter, start))
        bound = np.where(self.odd[window], 1.0, 2.0 * common / (len(low) + hi - lo))
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best, at, done, many = 0.0, None, 0, 1  # the first alone: a close one ends the search
        while done < len(order) and bound[order[done]] >= best - 1e-9:
            some = order[done:done + many]
            done, many = done + many, MOST_PIECES
            pieces = [self.texts[w][a:b].lower() for w, a, b in zip(window[some].tolist(), lo[some].tolist(), hi[some].tolist())]
            new = {p: k for k, p in zip(some.tolist(), pieces) if p not in scored}
            even = [(p, k) for p, k in new.items() if not self.odd[window[k]]]
            for part, way in (([x for x in even if len(x[0]) < POPULAR], self.matched), ([x for x in even if len(x[0]) >= POPULAR], self.matched_rare)):
                if len(part) >= FEW_PIECES:
                    own = np.array([k for _, k in part])
                    for (p, _), same in zip(part, way(low, start[own], end[own], best).tolist()):
                        if same != NEAR:
                            scored[p] = 2.0 * same / (len(low) + len(p)) if same >= 0 else -1.0
            for k, piece in zip(some.tolist(), pieces):
                if bound[k] < best - 1e-9:
                    break
                if piece not in scored:
                    scored[piece] = 2.0 * matching(low, piece) / (len(low) + len(piece))
                r = scored[piece]
                if r > best or r == best and at is not None and (window[k], lo[k]) < at[:2]:
                    best, at = r, (window[k], lo[k], hi[k])
        return (best, int(at[0]), self.texts[at[0]][at[1]:at[2]]) if at else None

    def matched(self, low: str, start: np.ndarray, end: np.ndarray, least: float) -> np.ndarray:
        letters = int((end - start).sum())
        if letters < MANY_LETTERS and letters * len(low) < CELLS:
            return matched(low, [self.whole[a:b] for a, b in zip(start.tolist(), end.tolist())], least)
        return matched_slices(low, self.codes, {ch: self.place(ch) for ch in set(low)}, start, end, least)

    def matched_rare(self, low: str, start: np.ndarray, end: np.ndarray, least: float) -> np.ndarray:
        """What the library's ratio matches between ``low`` and slices of ``POPULAR`` characters or more, as ``matched``.

        Runs begin at characters that are rare in a slice only, which are few: their places are paired, and
        runs grow by whatever is equal around them.
        """
        n, sizes = len(low), end - start
        m = int(sizes.max())
        ours = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
        keys = []
        for letter in set(low):
            before, times = self.count(letter, start), self.count(letter, end)
            times = times - before
            rare = np.flatnonzero((times > 0) & (times <= sizes // 100 + 1))
            if not len(rare):
                continue
            i, times = np.flatnonzero(ours == ord(letter)), times[rare]
            piece = np.repeat(rare, times)
            nth = np.arange(len(piece)) - np.repeat(np.cumsum(times) - times, times)
            j = self.place(letter)[before[piece] + nth] - start[piece]
            # pieces, diagonals and places on them in one number, so that a run is a run of numbers
            keys.append((((piece * (n + m + 1) + (j + n)) * (n + 2))[:, None] + (1 - i * (n + 1))[None, :]).ravel())
        key = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1] + 1]) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, len(key)]).astype(np.int32)
        rect, place = np.divmod(key[first], (n + m + 1) * (n + 2))
        along, i = np.divmod(place, n + 2)
        i = i - 1
        j = along - n + i

        def steps(piece, i, j, most, way):
            """Equal characters from there on, one by one for all that still go on."""
            done, going = np.zeros(len(i), np.int32), np.flatnonzero(most > 0)
            while len(going):
                at = done[going] * way
                going = going[ours[i[going] + at] == self.codes[start[piece[going]] + j[going] + at]]
                done[going] += 1
                going = going[done[going] < most[going]]
            return done

        def longer(piece, i, j, size, a0, a1, b0, b1):
            return (steps(piece, i - 1, j - 1, np.minimum(i - a0, j - b0), -1),
                    steps(piece, i + size, j + size, np.minimum(a1 - i - size, b1 - j - size), 1))

        pieces = np.arange(len(start))
        corner = steps(pieces, 0 * pieces, 0 * pieces, np.minimum(n, sizes), 1)
        total, dead = recursion(n, m, sizes, least, rect, i.astype(np.int32), j.astype(np.int32), size, longer, corner)
        return np.where(dead, -1, total)


@F.pandas_udf(StructType([StructField("ratio", DoubleType()), StructField("snippet", StringType())]))
def window_ratio(quote: pd.Series, text: pd.Series, floor: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([best_slice(q or "", t or "", f) for q, t, f in zip(quote, text, floor)], columns=["ratio", "snippet"])


def length_bound(a: Column, b: Column) -> Column:
    """Upper bound of the ratio from lengths alone: 2 min / sum (1 when both are empty)."""
    la, lb = F.length(a), F.length(b)
    return F.when(la + lb == 0, 1.0).otherwise(2.0 * F.least(la, lb) / F.greatest(la + lb, F.lit(1)))


def grams(text: Column, n: int) -> Column:
    """Distinct character n-grams of a text (empty when it is shorter than n)."""
    last = F.length(text) - n + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))))


def numbered_pairs(text: Column) -> Column:
    """Character pairs of a short text, repeated ones numbered, so a set join counts multiplicity."""
    last = F.length(text) - 1
    pairs = F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.transform(pairs, lambda p, i: F.concat(p, F.size(F.filter(F.slice(pairs, F.lit(1), i + 1), lambda x: x == p)).cast("string")))


def substrings(text: Column) -> Column:
    """All distinct non-empty substrings of a short text (a mailbox, a company name)."""
    n = F.length(text)
    starts = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(
        F.sequence(F.lit(1), n - i + 1), lambda k: F.substring(text, i, k)))))
