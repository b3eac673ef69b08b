import hashlib
import random
import re

from llm.tables import AWKWARD, documents, prose
from turnout.llm import leaks

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def plain(docs, items):
    out = []
    for doc_id, text, *_ in docs:
        own, hit, found = words(text), set(), set()
        for item_id, said in items:
            w = words(said)
            size = min(13, len(w))
            for first in range(len(w) - size + 1 if w else 0):
                for at in range(len(own) - size + 1):
                    if own[at:at + size] == w[first:first + size]:
                        hit.update(range(at, at + size))
                        found.add(str(item_id) if item_id is not None else "")
        out.append((doc_id, len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(own)))
    return sorted(out, key=str)


def benchmark(spark, items):
    return spark.createDataFrame([(*i, "c", "c") for i in items], "item_id bigint, text string, term string, delta string")


def cases():
    own = random.Random(4)
    items = [(n, " ".join(own.choice(["the", "of", "cat", "dog", "sat", "ran", "é"]) for _ in range(own.randint(1, 30)))) for n in range(25)]
    items += [(100 + n, prose(500 + n, 30, "q")) for n in range(10)] + [(200, None), (201, "..."), (202, "one-word"), (203, "lone"), (100, "lone"), (None, "nameless item"), (101, prose(501, 30, "q"))]
    docs = list(AWKWARD)
    for n in range(120):
        text = [own.choice(["the", "of", "cat", "dog", "sat", "ran", "é", "lone"]) for _ in range(own.randint(0, 50))]
        said = words(own.choice(items)[1])
        if n % 3 == 0 and said:
            a = own.randrange(len(said))
            text[5:5] = said[a:a + own.randint(1, 30)]
        if n % 5 == 0:
            text = (prose(900 + n, 200) + " " + " ".join(text)).split()
        docs.append((1000 + n, own.choice([" ", ", ", "\n"]).join(text).upper() if n % 4 == 0 else " ".join(text)))
    docs += [(3000, prose(500, 30, "q")), (3001, prose(500, 30, "q") + " " + prose(77, 2000)), (3002, " ".join(prose(501, 30, "q").split()[:12])),
             (3003, " ".join(prose(501, 30, "q").split()[3:17])), (3004, "one one word nameless item")]
    return docs, items


def test_hits_equal_plain_search(spark):
    docs, items = cases()
    got = leaks.contamination(documents(spark, docs), benchmark(spark, items))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(docs, items)


def test_clean_documents_stay(spark):
    docs, items = cases()
    table = documents(spark, docs)
    left = leaks.clean(table, benchmark(spark, items))
    assert left.columns == table.columns
    want = sorted((r[0] for r in plain(docs, items) if not r[-1]), key=str)
    assert sorted((r["doc_id"] for r in left.collect()), key=str) == want


def test_rows_that_share_an_id_are_told_apart(spark):
    docs = [(1, prose(500, 30, "q")), (1, prose(2, 50)), (1, prose(500, 30, "q")), (None, prose(500, 30, "q")), (None, None)]
    items = [(7, prose(500, 30, "q"))]
    got = leaks.contamination(documents(spark, docs), benchmark(spark, items))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(docs, items)


def test_empty_sides(spark):
    docs, items = cases()
    none = leaks.contamination(documents(spark, docs), benchmark(spark, items).limit(0))
    assert none.count() == len(docs) and none.filter("n_hit > 0 OR contaminated").count() == 0
    assert leaks.contamination(documents(spark, docs).limit(0), benchmark(spark, items)).count() == 0


def test_proximity(spark):
    item = prose(42, 13, "q").split()
    loose = [*item[:6], "extra", "words", *item[6:]]
    far = [*item[:6], *prose(3, 40).split(), *item[6:]]
    docs = [(1, " ".join(item)), (2, " ".join(loose)), (3, " ".join(far)), (4, prose(6, 60))]
    got = {r["doc_id"]: r["gap"] for r in leaks.proximity(documents(spark, docs), benchmark(spark, [(9, " ".join(item))]), 5).collect()}
    assert got[1] == 0 and got.get(2, 2) <= 2 and 4 not in got
    rarest = leaks.windows(leaks.items_of(benchmark(spark, [(9, " ".join(item))])),
                           leaks.index(leaks.keyed(documents(spark, docs)), spark.createDataFrame([(w,) for w in item], "term string"))).first()["rarest"]
    split = {r["p"] < 6 for r in rarest}
    assert (3 in got) == (len(split) == 1)


def test_no_python_on_the_main_path(spark):
    docs, items = cases()
    plan = leaks.contamination(documents(spark, docs), benchmark(spark, items))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_long_item(spark):
    """An item of 50,000 words, of which a document holds the end and another one nothing."""
    own = random.Random(5)
    said = [f"w{own.randrange(20_000)}" for _ in range(50_000)]
    docs = documents(spark, [(1, " ".join(said[-40:])), (2, prose(9, 60)), (3, " ".join(said[100:112]))])
    items = spark.createDataFrame([("long", " ".join(said)), ("short", "nothing of it")], "item_id string, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["contaminated"]) for r in leaks.contamination(docs, items).collect()}
    assert got == {1: (40, 1, True), 2: (0, 0, False), 3: (0, 0, False)}
