import hashlib
import random
import re
import zlib

from llm.tables import AWKWARD, CLASH, SCHEMA, documents, prose
from turnout.llm import periodic


def brute(w):
    """Every period, every stretch that repeats by it, and whether a smaller one does."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if size >= max(12, 2 * q) and all(any(w[k] != w[k + p] for k in range(i, i + size - p)) for p in range(1, q)):
                out.append((i, size, q))
            i = j
    return sorted(out)


def row(doc_id, text):
    """The contract's row by loops."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0 and n:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    gone = {k for s, size, q in found for k in range(s + q, s + size)}
    best = sorted((-size, s, q) for s, size, q in found)
    longest = (best[0][1], -best[0][0], best[0][2], 1000 * -best[0][0] // best[0][2]) if best else (None,) * 4
    return (doc_id, len(found), *longest, hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in found).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest())


def by_text(rows):
    return sorted(map(str, map(tuple, rows)))


def noisy(own, n, letters):
    w = [own.randrange(letters) for _ in range(n)]
    for _ in range(own.randrange(4)):
        a, p, size = own.randrange(n), own.randrange(1, 30), own.randrange(1, 90)
        for i in range(max(a, p), min(n, a + size)):
            w[i] = w[i - p]
    return w


def test_runs_equal_brute_force():
    own = random.Random(1)
    for _ in range(400):
        w = noisy(own, own.randrange(1, 120), own.choice([1, 2, 3, 5, 200]))
        assert periodic.runs(w) == brute(w)


def test_islands_lose_no_run_and_mix_no_texts():
    own = random.Random(2)
    for _ in range(30):
        texts = [noisy(own, own.randrange(1, 400), own.choice([2, 5, 50, 5000])) for _ in range(own.randrange(1, 6))]
        assert periodic.all_runs([[b"%d" % x for x in w] for w in texts]) == [brute(w) for w in texts]


def test_digests_equal_brute_force(spark):
    rows = AWKWARD + [(1000 + n, prose(n, 5 + 7 * n)) for n in range(60)]
    rows += [(2000, "a " * 500), (2001, "a b " * 11), (2002, "a b c d e f " * 2), (2003, "a b c d e " * 2 + "a"), (2004, "x " * 11), (2005, "x " * 12), (2006, prose(9, 30) + " " + prose(9, 30))]
    assert by_text(periodic.run_digests(documents(spark, rows)).collect()) == by_text(row(d, t) for d, t in rows)


def test_given_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    short = [(r["doc_id"], r["text"]) for r in docs.collect() if len(r["text"] or "") < 6000]
    got = {r["doc_id"]: tuple(r) for r in periodic.run_digests(docs).collect()}
    assert len(got) == docs.count() and len(short) > 100
    assert all(got[d] == row(d, t) for d, t in short)
    assert any(r[1] for r in got.values())


def test_runs_and_collapsed_texts(spark):
    rows = [(1, "say it again " * 5 + "and stop"), (2, None), (3, "no run here")]
    got = {r["doc_id"]: r for r in periodic.periodic_runs(documents(spark, rows)).collect()}
    assert [tuple(r) for r in got[1]["runs"]] == [(0, 15, 3)] and got[1]["collapsed_text"] == "say it again and stop"
    assert got[2]["runs"] == [] and got[2]["collapsed_text"] == "" and got[3]["collapsed_text"] == "no run here"


def test_long_texts_take_little_more_than_linear_time():
    for w in ([b"a"] * 200_000, [b"a", b"b"] * 100_000, [b"%d" % n for n in range(20_000)] * 10):
        (s, size, p), = periodic.all_runs([w])[0]
        assert (s, size) == (0, 200_000) and p in (1, 2, 20_000)


def test_empty_table_and_clashing_columns(spark):
    assert periodic.run_digests(spark.createDataFrame([], SCHEMA)).count() == 0
    wide = documents(spark, [(1, "a " * 20)]).selectExpr("*", "'z' AS runs", "1 AS n_runs", "2 AS length")
    assert len(CLASH) and periodic.run_digests(wide).first()["n_runs"] == 1
