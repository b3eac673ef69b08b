import math
import random

import numpy as np
import pytest

from turnout.llm import passes

SCHEMA = "vec_id bigint, embedding array<float>, label int, node string, comp string, n string, raw string"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "a", "b", "c", "d") for i, v in rows], schema)


def plain(rows, kind=np.float32):
    """All pairs, in double precision."""
    able, first = {}, {}
    for i, v in rows:
        x = None if v is None or any(c is None for c in v) else np.array(v, kind).astype(float)
        if i is not None and x is not None and len(x) and np.isfinite(x).all() and x.any():
            able[i] = x / np.linalg.norm(x)
    ids = sorted(able)
    links = {i: set() for i, _ in rows}
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if len(able[a]) == len(able[b]) and able[a] @ able[b] >= passes.COSINE:
                links[a].add(b)
                links[b].add(a)
    for i in sorted(k for k in links if k is not None):
        if i in first:
            continue
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in first:
                first[x] = i
                todo += links[x]
    return sorted(((i, len(links[i]), first.get(i), i is None or first[i] == i) for i, _ in rows), key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def crowd(own, size, spread, dim=24):
    centre = own.normal(size=dim)
    centre /= np.linalg.norm(centre)
    return [centre + spread * own.normal(size=dim) / math.sqrt(dim) for _ in range(size)]


def test_links_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(passes, "ROWS_A_TASK", 700)  # several sorted partitions, thus windows over their edges
    own = np.random.default_rng(4)
    vectors = [v for n in range(60) for v in crowd(own, int(own.integers(1, 7)), float(own.uniform(0.05, 0.4)))] + list(own.normal(size=(150, 24)))
    rows = list(enumerate(vectors))
    random.Random(1).shuffle(rows)
    rows = [(10 * n + i % 10, v) for n, (i, v) in enumerate(rows)]
    assert got(passes.near_vectors(table(spark, rows))) == plain(rows)


@pytest.mark.parametrize("spread", [0.1, 0.22, 0.3])
def test_crowds_keep_all_links(spark, monkeypatch, spread):
    """Crowds far beyond a window and a block: tight ones are decided by angles, loose ones block by block."""
    monkeypatch.setattr(passes, "BLOCK", 16)
    own = np.random.default_rng(int(100 * spread))
    rows = list(enumerate(crowd(own, 250, spread) + list(own.normal(size=(60, 24)))))
    want = plain(rows)
    assert max(r[1] for r in want) > 2 * passes.BLOCK
    assert got(passes.near_vectors(table(spark, rows))) == want


def test_awkward_vectors(spark):
    own = np.random.default_rng(1)
    a, b = own.normal(size=8), own.normal(size=8)
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0] * 8), (4, [nan] + [1.0] * 7), (5, [inf] + [1.0] * 7), (6, [None] + [1.0] * 7), (7, a), (8, a), (9, 3 * a), (10, -a),
            (11, b), (11, b), (None, b), (12, b), (13, list(b) + [0.0]), (14, [1e30] * 8), (15, [1e-30] * 8), (16, [-0.0] * 7 + [1.0]), (17, [0.0] * 7 + [2.0])]
    assert got(passes.near_vectors(table(spark, rows))) == plain(rows)
    doubles = SCHEMA.replace("float", "double")
    wide = [(1, [1e200, 1.0]), (2, [1e-200, 0.0]), (3, [1.0, 0.33]), (4, [1.0, 0.32])]
    assert [r[1] for r in got(passes.near_vectors(table(spark, wide, doubles)))] == [2, 2, 1, 3]


def test_empty_table(spark):
    assert passes.near_vectors(table(spark, [])).count() == 0
    assert got(passes.near_vectors(table(spark, [(3, None)]))) == [(3, 0, 3, True)]


def test_passes_grow_with_the_table():
    assert passes.passes(2) <= passes.passes(10 ** 5) < passes.passes(10 ** 9)
    own = np.random.default_rng(5)
    a = passes.unit(own.normal(size=(4000, 64)))
    b = own.normal(size=a.shape)
    b = passes.unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    same = [(passes.keys(a, t)[:, 0] == passes.keys(passes.COSINE * a + math.sqrt(1 - passes.COSINE ** 2) * b, t)[:, 0]).mean() for t in range(10)]
    assert abs(np.mean(same) - passes.AGREE) < 0.02
