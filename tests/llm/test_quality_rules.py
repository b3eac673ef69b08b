import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from llm.tables import AWKWARD, documents, prose
from turnout.llm import rules


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[n:n + 5]) for n in range(len(words) - 4)]
    often, hit = Counter(grams), set()
    for n, g in enumerate(grams):
        if often[g] > 1:
            hit.update(range(n, n + 5))
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit),
            n < 10 or 100 * len(hit) > 20 * n)


def sentence(own, n):
    return " ".join("".join(own.choice("abcdefghij") for _ in range(own.randint(3, 8))) for _ in range(n))


def test_base_statistics(spark):
    own = random.Random(1)
    few = [" ".join(own.choice("abcd") for _ in range(own.randint(0, 60))) for _ in range(60)]
    lines = ["\n".join(own.choice(["x y", " ", "", "z", "#a|b"]) for _ in range(12)) for _ in range(20)]
    rows = [*AWKWARD, *enumerate(few + lines, 100), (900, "a b c d e " * 300), (901, "same " * 5000)]
    got = sorted(((r["doc_id"] or -1, *(r[c] for c in (*rules.BASE, "base_failed"))) for r in rules.quality(documents(spark, rows)).collect()))
    assert got == sorted((d or -1, *plain(t)) for d, t in rows)


def test_sweeping_inverts(spark):
    own = np.random.default_rng(3)
    a = own.normal(size=(rules.P, rules.P))
    cov = a @ a.T
    row = {f"c{i}{j}": float(cov[i, j]) for i, j in rules.CELLS}
    got = rules.inverted(spark.createDataFrame([{"g": 1, **row}]).select("g", *row), 2.0).first()
    full = 2 * cov + np.diag(np.square(rules.NOISE))
    want = np.linalg.inv(full)
    assert np.allclose([got[f"i{i}{j}"] for i, j in rules.CELLS], [want[i, j] for i, j in rules.CELLS])
    assert np.isclose(got["det"], np.linalg.det(full))


def test_estimate_ignores_outliers(spark):
    """A fifth of far rows moves the classical estimate, not this one; it agrees with concentration in numpy."""
    own = np.random.default_rng(5)
    clean = own.normal(size=(800, rules.P)) * 0.2 + 1
    far = own.normal(size=(200, rules.P)) * 0.1 + 4
    x = np.round(np.vstack([clean, far]), 6)
    table = spark.createDataFrame([("en", "s", *map(float, r)) for r in x], "lang string, source string, " + ", ".join(f"{c} double" for c in rules.X))
    best = {r["level"]: r for r in rules.estimates(table).collect()}[0]
    centre = np.array([best[f"m{n}"] for n in range(rules.P)])
    assert np.allclose(centre, clean.mean(axis=0), atol=0.06)
    m, c = np.median(x, axis=0), np.diag(((np.quantile(x, .75, axis=0) - np.quantile(x, .25, axis=0)) / 1.349) ** 2)
    for n in range(rules.STEPS):
        d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c + np.diag(np.square(rules.NOISE))), x - m)
        core = x[np.argsort(d)[:750]]
        m, c = core.mean(axis=0), np.cov(core.T, bias=True)
    assert np.allclose(centre, m, atol=0.03)


def test_outliers_go_and_others_stay(spark):
    own = random.Random(9)
    rows = [(n, sentence(own, own.randint(15, 400)), "en", f"s{n % 3}") for n in range(400)]
    rows += [(n, sentence(own, own.randint(15, 400)), None, None) for n in range(400, 420)]
    bad = [(1000 + n, " ### ".join(sentence(own, 60).split()), "en", "s0") for n in range(20)]
    bad += [(1100 + n, sentence(own, 60).replace(" ", ""), "en", "s1") for n in range(2)]
    bad += [(1200 + n, " ".join(w * 20 for w in sentence(own, 40).split()), "en", "s1") for n in range(10)]
    docs = documents(spark, rows + bad)
    kept = {r["doc_id"] for r in rules.quality(docs).filter("kept").collect()}
    assert kept == {r[0] for r in rows}
    stay = rules.good(docs)
    assert stay.columns == docs.columns and {r["doc_id"] for r in stay.collect()} == kept


def test_few_and_no_rows(spark):
    docs = documents(spark, [(1, prose(1, 50)), (1, prose(1, 50)), (2, None), (3, prose(2, 30), None, None)])
    assert sorted((r["doc_id"], r["kept"]) for r in rules.quality(docs).collect()) == [(1, True), (1, True), (2, False), (3, True)]
    assert rules.good(docs).count() == 3
    assert rules.quality(docs.limit(0)).count() == rules.good(docs.limit(0)).count() == 0


def test_no_python_on_the_main_path(spark):
    plan = rules.statistics(documents(spark, AWKWARD))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_clean_labelled_documents_stay(spark):
    folder = "/root/testdata/sf0.01"
    verdicts = rules.quality(spark.read.parquet(f"{folder}/documents.parquet"))
    clean = spark.read.parquet(f"{folder}/labels.parquet").filter("quality = 1")
    gone = verdicts.join(clean, "doc_id").filter(~F.col("base_failed") & ~F.col("kept"))
    assert gone.count() == 0
