import itertools
import random
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from turnout.functions import similarity
from turnout.functions.similarity import Letters, Orders, common_subsequence, length_bound, ratio
from turnout.operators import resolve as R, speakers as S

FIRST, LAST = ["Ana", "Raj", "Lee"], ["Verma", "Kim"]
COMPANY = ["", "Acme Systems", "Acme", "Globex Corporation", "Initech Analytics"]


def people(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        f, l = ("Ana", "Verma") if r.random() < 0.4 else (r.choice(FIRST), r.choice(LAST))
        c = r.choice(COMPANY)
        local = r.choice([f"{f}.{l}", f"{f[0]}{l}", f"{l}{r.randint(0, 3)}", "zq"]).lower()
        rows.append((i, "e", f"{local}@x{r.randint(0, 2)}.com", local, f, l, c, c.lower(), r.choice(["", "CFO", "Analyst"]), r.random() < 0.5))
    return rows


COLS = "row_idx long, event_slug string, email string, local string, firstname string, lastname string, company_raw string, company_key string, jobtitle_raw string, attended boolean"


def score(a, b, ca, cb):
    ident = lambda p, c: f"{p[4]} {p[5]} {c}".strip()
    return 0.25 * ratio(a[3], b[3]) + 0.75 * ratio(ident(a, ca), ident(b, cb))


def walk(rows):
    """The order-dependent definition: one block after the other, primary filled on the way."""
    out, fills = {}, {}
    for _, block in itertools.groupby(sorted(rows, key=lambda x: (x[4], x[5], x[0])), key=lambda x: (x[4], x[5])):
        block = list(block)
        if len(block) < 2:
            continue
        main = max(block, key=lambda x: (x[9], x[6] != "", x[8] != "", -x[0]))
        company, title = main[7], main[8]
        for x in block:
            if x is main:
                continue
            s = score(x, main, x[7] or company, company or x[7])
            out[x[0]] = (main[0], round(s, 9))
            if s >= 0.8:
                company, title = company or x[7], title or x[8]
        fills[main[0]] = (company, title)
    return out, fills


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_duplicates_equal_the_sequential_walk(spark, seed):
    rows = people(60, seed)
    df = spark.createDataFrame(rows, COLS).withColumns({"title_source": F.lit(""), "company_source": F.lit("")}).repartition(5)
    pairs = R.duplicate_pairs(df)
    want, fills = walk(rows)
    assert {p.row_idx: (p.primary_idx, round(p.score, 9)) for p in pairs.collect()} == want
    left = {x.row_idx: x for x in R.survivors(df, pairs).collect()}
    assert set(left) == {x[0] for x in rows} - {i for i, (_, s) in want.items() if s >= 0.8}
    for i, (company, title) in fills.items():
        assert (left[i].company_key, left[i].jobtitle_raw) == (company, title)


def test_same_address_twice_keeps_one_person(spark):
    rows = [(0, "e", "a@x.com", "a", "Ana", "Kim", "Acme", "acme", "CFO", True), (1, "e", "a@x.com", "a", "ana", "KIM", "", "", "", False)]
    df = spark.createDataFrame(rows, COLS).withColumns({"title_source": F.lit(""), "company_source": F.lit("")})
    assert [x.row_idx for x in R.survivors(df, R.duplicate_pairs(df)).collect()] == [0]


CRM = "vid long, event_slug string, email string, firstname string, lastname string, company string"


def every_pair(rows, crm):
    """Each row scored against every contact whose first name passes the gate."""
    want = {}
    for a in rows:
        best, who = 0.0, None
        for vid, b in crm:
            if ratio(a[4], b[4]) < 0.5:
                continue
            s = score(a, b, a[7], b[7])
            if s > best + 1e-12:
                best, who = s, vid
        if who is not None and best >= 0.65:
            want[a[0]] = (who, round(best, 6))
    return want


def altered(person, seed):
    """The same person under another last name, company or mailbox."""
    own = random.Random(seed)
    idx, event, mail, local, first, last, company, key, title, there = person
    spoilt = lambda x: "".join(own.choice([c, c, c, c, c, "", c + own.choice("aeinrst")]) for c in x)
    local, first, last = (own.choice([x, x, spoilt(x)]) for x in (local, first, last))
    last = own.choice([last, last + " Lopez", last[:3], last])
    key = own.choice([key, key + " systems", spoilt(key), ""])
    key = " ".join(key.split())
    return (idx, event, f"{local}@other.org", local, first, last, key.title(), key, title, there)


def in_spark(spark, rows, crm):
    left = spark.createDataFrame(rows, COLS)
    right = spark.createDataFrame([(vid, "e", x[2], x[4], x[5], x[6]) for vid, x in crm], CRM).repartition(3)
    return {m.row_idx: (m.vid, round(m.score, 6)) for m in R.crm_matches(left, right).collect()}


@pytest.mark.parametrize("seed", [8, 18, 28])
def test_crm_match_equals_every_pair(spark, seed, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 40)  # several blocks a side
    rows = people(120, seed)
    crm = [(100 + n, altered(x, seed * 1000 + n)) for n, x in enumerate(people(120, seed + 1) + rows)]
    want = every_pair(rows, crm)
    assert len(want) > 80
    assert in_spark(spark, rows, crm) == want


def test_crm_match_by_shared_grams_equals_every_pair(spark, monkeypatch):
    for name, few in {"FEW_PAIRS": 0, "HELD": 30, "BLOCK": 25, "PAIRS": 600, "TOGETHER": 20}.items():
        monkeypatch.setattr(R, name, few)  # looked up, cut to pieces and put together
    rows = people(120, 38)
    crm = [(100 + n, altered(x, 38000 + n)) for n, x in enumerate(people(120, 39) + rows)]
    want = every_pair(rows, crm)
    assert len(want) > 80
    assert in_spark(spark, rows, crm) == want


def test_close_identities_meet_few_others(spark, monkeypatch):
    """Identities that a contact matches closely are not held against all contacts, however many there are."""
    monkeypatch.setattr(R, "FEW_PAIRS", 0)
    own = random.Random(7)
    word = lambda n: "".join(own.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    firms = [word(12) for _ in range(20)]
    idents = [f"{word(5)} {word(7)} {own.choice(firms)}" for _ in range(400)]
    asked = spark.createDataFrame([(n, x[:4] + x[5:], 0.95) for n, x in enumerate(idents)] + [(400, "dora", 0.65)], "_id long, ident string, floor double")
    known = spark.createDataFrame(list(enumerate(idents)), "vid long, ident string")
    ours, theirs = R.looked_up(asked, known, [], 401, 400)
    met = {(x._id, x.vid) for x in ours.join(theirs, "_g").collect()}
    assert {(n, n) for n in range(400)} <= met and {(400, n) for n in range(400)} <= met
    assert len(met) < 0.2 * 400 * 400


def test_other_last_names_and_companies_together_are_found(spark):
    rows = [(0, "e", "anna.garcia@acme.com", "anna.garcia", "Anna", "Garcia", "Acme Corporation", "acme corporation", "", True),
            (1, "e", "bob.miller@x.org", "bob.miller", "Bob", "Miller", "Initech Systems", "initech systems", "", True)]
    right = spark.createDataFrame([(5, "e", "anna.garcialopez@acme.org", "Anna", "Garcia Lopez", "Acme Corporation Ltd"),
                                   (6, "e", "rob.millar@x.org", "Rob", "Millar", "Initech Systems"), (7, "e", None, None, None, None)], CRM)
    assert {m.row_idx: (m.vid, m.verdict) for m in R.crm_matches(spark.createDataFrame(rows, COLS), right).collect()} == {0: (5, "merge"), 1: (6, "merge")}


def test_bounds_of_many_pairs_hold():
    own = random.Random(6)
    words = ["".join(own.choice("abcd é漢") for _ in range(own.choice([0, 1, 5, 12, 62, 63, 64, 90]))) for _ in range(60)]
    i, j = (x.ravel() for x in np.indices((60, 60)))
    loose, tight = Letters(words, words[::-1]).bound(slice(0, 60)), Orders(words, words[::-1]).bound(i, j).reshape(60, 60)
    for a in range(60):
        for b in range(60):
            r = ratio(words[a], words[59 - b])
            assert r <= tight[a, b] + 1e-9 and r <= loose[a, b] + 1e-5
            if len(words[a]) <= 63 and words[a] + words[59 - b]:
                assert abs(tight[a, b] - 2 * common_subsequence(words[a], words[59 - b]) / (len(words[a]) + len(words[59 - b]))) < 1e-9


def test_people_of_an_earlier_event_are_updated(spark):
    """The CRM after one event is searched at the next: exact addresses, new addresses, other spellings; strangers are created."""
    crm = [(n, "e1", f"person{n}@corp{n}.com", f"First{n}name", f"Last{n}name", f"Corp {n}") for n in range(10)]
    crm += [(50, "e1", "Rana.Haddad@acme.com", "Rana", "Haddad", "Acme Ltd"), (51, "e1", "y.f@air.com", "Yousef", "Farsi", "Air"), (52, "e0", None, "Mei", "Tanaka", None)]
    right = spark.createDataFrame(crm, "vid long, event_slug string, email string, firstname string, lastname string, company string")
    rows = [(n, "e2", f"person{n}@corp{n}.com", f"person{n}", f"First{n}name", f"Last{n}name", f"Corp {n}", f"corp {n}", "", True) for n in range(10)]
    rows += [(20, "e2", "rana.hadad@acme.com", "rana.hadad", "Rana", "Hadad", "Acme", "acme", "", True),
             (21, "e2", "yousef.farsi@air.com", "yousef.farsi", "Yousef", "Farsi", "Air", "air", "", True),
             (22, "e2", "new@else.org", "new", "Nadia", "Olsen", "Else", "else", "", True)]
    got = {m.row_idx: (m.vid, m.verdict) for m in R.crm_matches(spark.createDataFrame(rows, COLS), right).collect()}
    assert got == {**{n: (n, "merge") for n in range(10)}, 20: (50, "merge"), 21: (51, "merge")}
    assert R.crm_matches(spark.createDataFrame(rows, COLS), right, scope=("event_slug",)).count() == 0


def test_review_pairs_are_whole_and_decisions_agree(spark):
    pairs = spark.createDataFrame([("e", 1, "p@x", i, f"d{i}@x", 0.66 + i / 1000, "review") for i in range(30)],
                                  "event_slug string, primary_idx long, primary_email string, row_idx long, email string, score double, verdict string")
    none = spark.createDataFrame([], "event_slug string, row_idx long, email string, vid long, score double, verdict string")
    kept = R.review_pairs(pairs, none)
    assert kept.count() == 30 and {(x.right_id, x.rank) for x in kept.collect()} == {(29 - i, i + 1) for i in range(30)}
    assert R.review_overflow(kept).first()[1:] == (30, 20, 10)
    answers = spark.createDataFrame([("e", "wb:p@x|d29@x", "merge"), ("e", "wb:p@x|d28@x", "perhaps"), ("e", "wb:p@x|d29@x", "merge"),
                                     ("e", "wb:p@x|d27@x", "merge"), ("e", "wb:p@x|d27@x", "no_merge")], "event_slug string, pair_id string, decision string")
    by = {x.right_id: x.decision for x in R.adjudicated(kept, answers).collect()}
    assert by[29] == "merge" and by[28] == by[27] == by[15] == "no_merge"


def test_ratio_is_not_symmetric_and_bounds_hold(spark):
    assert ratio("tide", "diet") != ratio("diet", "tide")
    r = random.Random(4)
    words = [("".join(r.choice("abcd ") for _ in range(r.randint(0, 14))), "".join(r.choice("abcd ") for _ in range(r.randint(0, 14)))) for _ in range(300)]
    for a, b in words:
        if a or b:
            assert ratio(a, b) <= 2 * common_subsequence(a, b) / (len(a) + len(b)) + 1e-12
    df = spark.createDataFrame(words, "a string, b string").withColumn("u", length_bound(F.col("a"), F.col("b")))
    assert all(ratio(x.a, x.b) <= x.u + 1e-12 for x in df.collect())


def test_incremental_run_updates_known_people(spark):
    crm = spark.createDataFrame([(1, "ana.kim@x.com", "Ana", "Kim", "", "Acme", "lead")],
                                "vid long, email string, firstname string, lastname string, jobtitle string, company string, lifecyclestage string")
    out = spark.createDataFrame([(1, "ana.kim@x.com", "Ana", "Kim", "CFO", "Acme", "opportunity"), (2, "new@x.com", "New", "One", "", "", "lead")], crm.schema)
    state = {x.email: (x.vid, x.jobtitle, x.lifecyclestage) for x in R.crm_state(crm, out).collect()}
    assert state == {"ana.kim@x.com": (1, "CFO", "opportunity"), "new@x.com": (2, "", "lead")}


def test_roster_match_equals_brute_force(spark):
    r = random.Random(11)
    names = ["Daniel Kim", "Sara Alvarez", "Q", "Jo", "Al-Sayed Noor", "Danielle Kimm", "sara alvares"]
    cited = names + ["Daniel Kims", "Sarah Alvarez", "Jon", "q", "Nobody Known"] + ["".join(r.sample("daniel kim", 9)) for _ in range(5)]
    a = spark.createDataFrame([("e", c) for c in cited], "event_slug string, cited string")
    b = spark.createDataFrame([("e", n) for n in names], "event_slug string, name string")
    got = {x.cited: round(x.ratio, 9) for x in S.roster_match(a, b).collect()}
    want = {}
    for c in cited:
        best = max(ratio(c, n) for n in names)
        if best >= 0.85:
            want[c] = round(best, 9)
    assert got == want


def test_people_meet_only_names_that_may_pass(monkeypatch):
    met = []
    whole = similarity.Letters.bound

    def counted(self, rows, others=slice(None)):
        out = whole(self, rows, others)
        met.append(out.size)
        return out
    monkeypatch.setattr(similarity.Letters, "bound", counted)
    names = ["bbbb", "cccc", "dddd", "ffff"]
    known = pd.DataFrame([(f"{n}.{k}", n, f"{n} smith{k} acme", 100 * i + k) for i, n in enumerate(names) for k in range(50)], columns=["local", "first", "ident", "vid"])
    asked = known.iloc[[120, 3, 77]].drop(columns="vid").assign(floor=0.65).reset_index(drop=True)
    assert sorted(similarity.closest_people(asked.iloc[:1], known, 0.5)) == [(0, 1.0, 220)]
    assert max(met) == 50  # the other 150 have first names without a common letter
    assert sorted(similarity.closest_people(asked, known, 0.5)) == [(0, 1.0, 220), (1, 1.0, 3), (2, 1.0, 127)]


def test_closest_names_equal_brute_force_and_score_few_pairs(monkeypatch):
    r = random.Random(5)
    known = sorted({f"{r.choice(['Aisha', 'Rohan', 'Mei', 'Ingrid'])} {r.choice(['Haddad', 'Kim', 'Al-Sayed'])}{r.randint(0, 99)}" for _ in range(200)})
    asked = [n[:3] + n[n.index(" "):] for n in known] + ["", "Q", "Aisha Hadad7", "nobody of these"]
    scored = []
    monkeypatch.setattr(similarity, "SequenceMatcher", lambda *a: scored.append(a) or SequenceMatcher(*a))
    for some in (asked, asked[:3]):  # few pairs go one by one
        there = known if some is asked else known[:9]
        want = {}
        for i, a in enumerate(some):
            best = max(ratio(a, b) for b in there)
            if best >= 0.85:
                want[i] = (best, min(j for j, b in enumerate(there) if ratio(a, b) == best))
        scored.clear()
        assert {i: (x, j) for i, x, j in similarity.closest_names(some, there, 0.85)} == want
        assert len(scored) < 0.05 * len(some) * len(there) or some is not asked


def test_loose_pairing_keeps_one_inbox_of_a_text_before_the_join(spark):
    """Many inboxes hold the same name and one domain lies in many companies: the first is picked from one row for each text."""
    speakers = spark.createDataFrame([("e", k, "Ana Kim", "Acme Works", "") for k in range(40)] + [("e", 99, "Zed", "Globex", ""), ("e", 100, "Zed", "None", "")],
                                     "event_slug string, speaker_no long, name string, company string, email string")
    boxes = spark.createDataFrame([("e", 1000 - k, f"ana{k}@acme.com") for k in range(200)] + [("e", 5, "info@globex.com"), ("e", 3, "post@globex.org")],
                                  "event_slug string, inbox_no long, email string")
    paired = S.paired_loosely(speakers, boxes)
    assert {(x.speaker_no, x.email, x.rule) for x in paired.collect()} == {
        *((k, "ana199@acme.com", 2) for k in range(40)), (99, "post@globex.org", 3), (100, "", 0)}
    plan = paired._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("min_by") >= 4  # of a local part, of a domain, of a company, and of the speaker
