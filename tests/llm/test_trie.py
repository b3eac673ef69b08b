import hashlib
import random
import zlib

import numpy as np
import pytest

from turnout.llm import trie

COLUMNS = "conv_id bigint, turn bigint, role string, text string, key string, depth int, top string, words string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "k", 7, "t", "w") for r in rows], COLUMNS)


def plain(rows, rebuild=True):
    """Nodes by dictionaries of prefixes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    if rebuild:
        held = {}
        for c, v in own.items():
            h = zlib.crc32(str(c).encode()) % 4
            base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
            held[c] = own.get(base, [])[:h] + v[h:]
        own = held
    members, ends = {}, {}
    for c, v in own.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
        ends.setdefault(tuple(v), []).append(c)
    out = []
    below = {}
    for k in members:
        for d in range(len(k) + 1):
            below.setdefault(k[:d], []).append(k)
    parents = {k[:-1] for k in members if k}
    for k, m in members.items():
        tree = below[k]
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), sum(len(x) == len(k) + 1 for x in tree),
                    sum(x not in parents for x in tree), sum((len(members[x]) - 1) * len(x[-1][1].split()) for x in tree if x),
                    hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def talk(own, n, letters=3, most=6):
    return [(c, t, own.choice(["user", "assistant"]), " ".join(["x"] * own.randrange(letters))) for c in range(n) for t in range(own.randrange(1, most))]


def test_closing_parentheses():
    own = random.Random(3)
    for n in (1, 2, 50, 700, 5000):
        bits, stack, want, opened = [], [], {}, 0
        while opened < n or stack:
            if opened < n and (not stack or own.random() < 0.55):
                stack.append(len(bits))
                bits.append(1)
                opened += 1
            else:
                want[stack.pop()] = len(bits)
                bits.append(0)
        bits = [1] + bits + [0]
        want = {k + 1: v + 1 for k, v in want.items()} | {0: len(bits) - 1}
        tree = trie.Parentheses(np.array(bits, np.int8))
        assert tree.closes().tolist() == [want[k] for k in sorted(want)]
    deep = trie.Parentheses(np.array([1] * 100_000 + [0] * 100_000, np.int8))
    assert (deep.closes() == 199_999 - np.arange(100_000)).all()


@pytest.mark.parametrize("shard", [1, 3, 20, 1000])
def test_spine_and_shards_equal_plain_trie(spark, shard):
    rows = talk(random.Random(shard), 150) + [(500 + n, t, "user", "hot first turn") for n in range(60) for t in range(1 + n % 4)]
    nodes = trie.prefix_trie(trie.turns(conversations(spark, rows)), shard)
    assert got(nodes) == plain(rows, rebuild=False)


def test_rebuilt_trie_with_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(trie, "SHARD", 5)
    rows = talk(random.Random(1), 130) + [(None, 1, "user", "lost"), (7, None, None, None), (7, 0, "user", "ü 漢字 \x1c y"), (40, 3, "user", "same"), (40, 3, "user", "same"),
                                           (41, 3, "b", "tie"), (41, 3, "a", "tie"), (1005, 1, "user", "no head"), (-7, 1, "user", "below zero"), (2001, 0, "user", "z"),
                                           (300, 0, "user", "long " * 20_000)]
    rows += [(600, t, "user", f"turn {t}") for t in range(400)] + [(601, t, "user", f"turn {t}") for t in range(400)]
    assert got(trie.conversation_trie(conversations(spark, rows))) == plain(rows)


def test_copies_end_in_the_spine(spark, monkeypatch):
    monkeypatch.setattr(trie, "ID_BITS", 2)
    rows = [(c * 20, t, "user", f"t{t}") for c in range(-40, 40) for t in range(3)]
    assert got(trie.prefix_trie(trie.rebuilt(conversations(spark, rows)), 4)) == plain(rows)


def test_empty_table(spark):
    assert trie.conversation_trie(conversations(spark, [])).count() == 0
    assert trie.conversation_trie(conversations(spark, [(None, 1, "user", "lost")])).count() == 0
