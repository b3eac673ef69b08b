import zlib

import numpy as np

from llm.tables import AWKWARD, documents
from turnout.llm import language


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = language.languages(docs).collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97


def test_labels_of_held_out_rows_are_not_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from pyspark.sql import functions as F
    other = docs.withColumn("lang", F.when(language.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    a, b = ({r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.languages(d).collect()} for d in (docs, other))
    assert a == b


def test_awkward_rows(spark):
    rows = [(d, t, "en" if n % 3 else None, None) for n, (d, t) in enumerate(AWKWARD)] + [(90, "漢字 かな", "ja", "s"), (91, "漢字 字", "ja", "s"), (95, "123 456 --", "en", "s")]
    got = {r["doc_id"]: r for r in language.languages(documents(spark, rows)).collect()}
    assert language.languages(documents(spark, rows)).count() == len(rows)
    for doc_id in (1, 2, 3, 4, 18, 95):
        assert (got[doc_id]["lang_pred"], got[doc_id]["score"]) == ("und", 0.0)
    assert got[90]["lang_pred"] == "ja" and got[5]["lang_pred"] in ("en", "ja")
    assert language.languages(documents(spark, rows).limit(0)).count() == 0
    none = documents(spark, [(d, t, None, None) for d, t in AWKWARD])
    assert {(r["lang_pred"], r["score"]) for r in language.languages(none).collect()} == {("und", 0.0)}


def orders(codes, n):
    """Counts of all orders by numpy."""
    out = {4: (codes, n.astype(float))}
    for k in (3, 2, 1):
        below, kinds = np.unique(out[k + 1][0] & language.Model.mask(k), return_counts=True)
        out[k] = below, kinds.astype(float)
    return out


def discount_of(counts):
    once, twice = ((counts == v).sum() for v in (1, 2))
    return min(0.9, max(0.1, once / max(1, once + 2 * twice)))


def test_probabilities_are_kneser_ney():
    """Against the textbook recursion over dictionaries, and they sum to one."""
    text = "abracadabra alakazam abra"
    codes, n = np.unique(language.grams(language.symbols(text)), return_counts=True)
    other, m = np.unique(language.grams(language.symbols("zyx wvu zyx")), return_counts=True)
    every = {"a": orders(codes, n), "z": orders(other, m)}
    discounts = {(lang, k): discount_of(own[k][1]) for lang, own in every.items() for k in (1, 2, 3)} | {("a", 4): 0.6, ("z", 4): 0.7}
    model = language.Model(every, discounts, 1 / (1 + max(len(own[1][0]) for own in every.values())))
    unpack = lambda c, k: tuple((int(c) >> 16 * (k - 1 - i)) & 0xFFFF for i in range(k))
    counts = {4: {unpack(c, 4): float(x) for c, x in zip(codes, n)}}
    for k in (3, 2, 1):
        counts[k] = {}
        for g in counts[k + 1]:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1.0

    def discount(k):
        if k == 4:
            return 0.6
        once, twice = (sum(c == v for c in counts[k].values()) for v in (1, 2))
        return min(0.9, max(0.1, once / max(1, once + 2 * twice)))

    def p(gram):
        k = len(gram)
        if k == 0:
            return model.floor
        own = {g: c for g, c in counts[k].items() if g[:-1] == gram[:-1]}
        if not own:
            return p(gram[1:])
        total = sum(own.values())
        return (max(own.get(gram, 0) - discount(k), 0) + discount(k) * len(own) * p(gram[1:])) / total

    letters = sorted(counts[1])
    for context in ((0, 0, 0), tuple(map(ord, "abr")), tuple(map(ord, "bra")), tuple(map(ord, "xqy"))):
        asked = [context + c for c in letters]
        got = model.of(4, np.array([sum(x << 16 * (3 - i) for i, x in enumerate(g)) for g in asked], np.uint64))[:, 0]
        assert np.allclose(got, [p(g) for g in asked])
        assert abs(got.sum() - 1) < 0.05


def test_unseen_planes_and_long_texts():
    assert language.symbols("😀 1") is None
    assert len(language.symbols("𐐀𐐁 x " * 1000)) > 3000


def entropy(counts, floor, text):
    """Cross-entropy of a text by dictionaries of one language: ``counts[k][gram]``."""
    totals, kinds = {}, {}
    for k, own in counts.items():
        for g, c in own.items():
            totals[g[:-1]] = totals.get(g[:-1], 0) + c
            kinds[g[:-1]] = kinds.get(g[:-1], 0) + 1
    d = {k: discount_of(np.array(list(own.values()))) for k, own in counts.items()}

    def p(g):
        if not g:
            return floor
        if g[:-1] not in totals:
            return p(g[1:])
        k = len(g)
        c = counts[k].get(g, 0)
        return (max(c - d[k], 0) + d[k] * kinds[g[:-1]] * p(g[1:])) / totals[g[:-1]] if c else d[k] * kinds[g[:-1]] * p(g[1:]) / totals[g[:-1]]

    s = [int(x) for x in language.symbols(text)]
    return -sum(np.log(p(tuple(s[i:i + 4]))) for i in range(len(s) - 3)) / (len(s) - 3)


def brute_force(rows):
    """Predicted language, score and cross-entropy of every text, by dictionaries over all that may be learned."""
    grams = {}
    for doc_id, text, lang in rows:
        s = language.symbols(text or "")
        if lang is not None and s is not None and zlib.crc32(str(doc_id).encode()) % 4 != 2:
            own = grams.setdefault(lang, {})
            for i in range(len(s) - 3):
                g = tuple(int(x) for x in s[i:i + 4])
                own[g] = own.get(g, 0) + 1
    models = {}
    for lang, own in grams.items():
        counts = {4: own}
        for k in (3, 2, 1):
            counts[k] = {}
            for g in counts[k + 1]:
                counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1
        models[lang] = counts
    floor = 1 / (1 + max(len(c[1]) for c in models.values()))
    out = {}
    for doc_id, text, _ in rows:
        if language.symbols(text or "") is None:
            out[doc_id] = "und", 0.0, None
            continue
        e = {lang: entropy(c, floor, text) for lang, c in models.items()}
        best = min(e, key=lambda lang: (e[lang], lang))
        out[doc_id] = best, 1 / sum(np.exp(-language.EVIDENCE * (v - e[best])) for v in e.values()), e[best]
    return out


def test_every_language_and_gram_counts(spark):
    """120 languages, one of them with far more grams than a part holds: equal to dictionaries, in one part or in many."""
    own = np.random.default_rng(7)
    letters = [chr(c) for c in range(0x61, 0x7B)] + [chr(c) for c in range(0x4E00, 0x4E80)]
    rows = []
    for n in range(120):
        alphabet = own.permutation(letters)[:12]
        for m in range(3):
            words = ["".join(own.choice(alphabet, 4)) for _ in range(6)]
            rows.append((n * 10 + m, " ".join(words), f"l{n:03d}"))
    rows += [(2000 + n, "".join(own.choice(letters[26:], 150)), "wide") for n in range(12)]
    rows += [(3000, None, "l001"), (3001, "12 34", "l001"), (3002, "zzz \u6f22", None)]
    docs = documents(spark, [(d, t, lang, "s") for d, t, lang in rows])
    want = brute_force(rows)
    assert len({w[0] for w in want.values()}) > 115
    parts = language.Fitted(language.order_counts(language.calibrates(language.asked(docs)).filter("learned")), 400).parts
    assert len(parts) > 10 and max(p.slices[1] for p in parts) > 2
    for cells in (language.CELLS, 400):
        got = language.languages(docs, cells=cells).collect()
        assert len(got) == len(rows)
        for r in got:
            lang, score, e = want[r["doc_id"]]
            assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-3
            assert (r["cross_entropy"] is None) == (e is None) and (e is None or abs(r["cross_entropy"] - e) < 1e-4)


def test_calibration_is_not_learned(spark, monkeypatch):
    monkeypatch.setattr(language, "ENOUGH", 20)
    monkeypatch.setattr(language, "CALIBRATING", 4)
    docs = documents(spark, [(d, f"word{d}", "en" if d < 100 else "de", "s") for d in range(110)])
    rows = language.calibrates(language.asked(docs)).collect()
    few = [r for r in rows if r["lang"] == "de" and not r["held_out"]]
    many = [r for r in rows if r["lang"] == "en" and not r["held_out"]]
    assert all(r["learned"] and r["calibrating"] for r in few)
    assert all(r["learned"] != r["calibrating"] for r in many) and 5 < sum(r["calibrating"] for r in many) < 40
    assert not any(r["learned"] or r["calibrating"] for r in rows if r["held_out"])
