import random
import re

import pytest
from hypothesis import given, settings, strategies as st

from llm.tables import AWKWARD, documents, prose
from turnout.llm import near

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(words[n:n + 5]) for n in range(max(1, len(words) - 4))) if words else frozenset()


def components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows):
    """Sizes and components by comparing all pairs."""
    sets = {d: shingles(t) for d, t, *_ in rows if d is not None}
    ids = sorted(sets)
    pairs = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:]
             if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {d: (len(sets[d]), c) for d, c in components(pairs, ids).items()}


def changed(text, seed, n):
    own, words = random.Random(seed), text.split()
    for at in own.sample(range(len(words)), n):
        words[at] = f"new{seed}y{at}"
    return " ".join(words)


def rows_with_copies():
    rows, at = list(AWKWARD), 100
    for group in range(12):
        text = prose(1000 + group, 300)
        rows.append((at, text))
        for k in range(group):  # chains: each copy is changed from the one before
            text = changed(text, at + k, 6)
            rows.append((at + 1 + k, text.upper() if k % 3 == 0 else text))
        rows.append((at + 50, rows[-1][1]))  # an exact copy
        at += 100
    passage = prose(7, 150)
    rows += [(5000 + n, passage + " " + prose(6000 + n, 150)) for n in range(40)]  # a shared passage links nothing
    base = prose(8, 400)
    rows += [(7000 + n, changed(base, n, 4)) for n in range(60)]  # a large group of near copies
    return rows


def test_components_equal_all_pairs(spark):
    rows = rows_with_copies()
    out, links = near.grouped(documents(spark, rows))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()}
    want = brute(rows)
    assert {d: c for d, c in got.items() if d is not None} == want
    assert got[None] == (1, None)
    assert links.count() < 60 * 59 / 2  # no pairs of all with all
    kept = near.near_duplicates(documents(spark, rows))
    assert kept.count() == len(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in kept.collect() if r["doc_id"] is not None)


def crowd_with_pairs():
    """Documents that share a passage just under the bound, and pairs among them just over it; no text is a pivot's copy."""
    passage, rows = prose(21, 170), []
    for n in range(300):
        rows.append((n, passage + " " + " ".join(f"own{n}x{k}" for k in range(31))))
    for n in range(25):  # a pair shares a few words more
        more = " ".join(f"pair{n}x{k}" for k in range(7))
        rows += [(1000 + 2 * n + side, f"{passage} {more} " + " ".join(f"own{1000 + 2 * n + side}x{k}" for k in range(26))) for side in (0, 1)]
    return rows


def test_pairs_in_a_crowd_are_found(spark):
    rows = crowd_with_pairs()
    want = brute(rows)
    assert sorted(c for d, (_, c) in want.items() if c != d) == [1000 + 2 * n for n in range(25)]
    out, links = near.grouped(documents(spark, rows))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()} == want
    assert links.count() == 25


def test_one_row_of_each_component_stays(spark):
    docs = documents(spark, rows_with_copies())
    left = near.one_of_each(docs)
    assert left.columns == docs.columns
    ids = [r["doc_id"] for r in left.collect()]
    want = brute(rows_with_copies())
    assert sorted(d for d in ids if d is not None) == sorted({c for _, c in want.values()})
    assert ids.count(None) == 1


def test_empty_table(spark):
    docs = documents(spark, AWKWARD).limit(0)
    assert near.near_duplicates(docs).count() == near.one_of_each(docs).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_stars_equal_union_find(spark, seed):
    own = random.Random(seed)
    pairs = [(own.randrange(60), own.randrange(60)) for _ in range(45)] + [(n, n + 1) for n in range(100, 130)] + [(200, 200 + n) for n in range(1, 30)]
    want = components(pairs, {x for a, b in pairs if a != b for x in (a, b)})
    got = near.components(spark.createDataFrame(pairs, "a bigint, b bigint"), len(pairs))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10 ** 6), st.integers(60, 300))
def test_signatures_estimate_similarity(seed, n):
    text = prose(seed, n)
    other = changed(text, seed, max(1, n // 40))
    one, two = (near.Shingler().shingles(t) for t in (text, other))
    real = len(set(one.tolist()) & set(two.tolist())) / len(set(one.tolist()) | set(two.tolist()))
    assert abs((near.minima(one) == near.minima(two)).mean() - real) < 0.2
    assert len(one) == len(shingles(text))
