import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnout.functions.layout import fold
from turnout.functions import similarity
from turnout.functions.similarity import Slices, best_slice, matched, matching
from turnout.operators import grounding as G, transcript as X

WORDS = "speed routing lead score signal buyer pipeline meeting revenue answer minutes quarter because nobody waits for the follow up call".split()


def text(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def plain_best(quote, windows):
    """Unbounded definition: slide over every window, keep the first best."""
    best, at = 0.0, None
    for span, seq, body in sorted(windows):
        low, q = body.lower(), quote.lower()
        n, size = len(q), len(low)
        if size <= 1.4 * n:
            cuts = [low]
        else:
            cuts = [low[s:s + n] for s in range(0, size - n + 1, max(4, n // 6))] + [low[-n:]]
        for cut in cuts:
            v = SequenceMatcher(None, q, cut).ratio()
            if v > best:
                best, at = v, (span, seq)
    return best, at


def noisy(r, s, rate):
    out = []
    for ch in s:
        x = r.random()
        out.append("" if x < rate / 2 else ch + r.choice("xyz") if x < rate else ch)
    return "".join(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_fuzzy_search_loses_nothing_from_ninety(spark, seed):
    r = random.Random(seed)
    turns = [text(r, r.randint(6, 60)) for _ in range(25)]
    windows = [(1, i, t) for i, t in enumerate(turns)] + [(2, i, f"{a} {b}") for i, (a, b) in enumerate(zip(turns, turns[1:]))]
    quotes = []
    for rate in (0.0, 0.04, 0.08, 0.11, 0.16, 0.25):
        for _ in range(6):
            body = r.choice(windows)[2]
            a = r.randint(0, max(0, len(body) - 60))
            quotes.append(noisy(r, body[a:a + r.randint(26, 120)], rate))
    quotes += ["ha ha ha ha ha ha ha ha ha ha ha", "zq" * 20]
    quotes = sorted({q for q in quotes if len(q) >= 25})
    q = spark.createDataFrame([("e", x) for x in quotes], "event_slug string, quote string")
    w = spark.createDataFrame([("e", s, i, "x", t) for s, i, t in windows], "event_slug string, span int, seq long, label string, text string")
    want = {}
    for x in quotes:
        best, _ = plain_best(x, windows)
        if best >= 0.9:
            want[x] = round(best, 9)
    assert want and len(want) < len(quotes)
    assert {x.quote: round(x.ratio, 9) for x in G.best_windows(q, w, ["event_slug"]).collect()} == want
    every = {x.quote: (round(x.ratio, 9), x.seq) for x in G.matched_windows(q, w, ["event_slug"]).collect()}
    assert every == {x: (round(best, 9), at and at[1]) for x in quotes for best, at in [plain_best(x, windows)]}


def test_hopeless_quotes_have_their_best_window(spark, monkeypatch):
    monkeypatch.setattr(G, "SEARCHED", 900)  # several blocks a transcript
    r = random.Random(5)
    turns = [text(r, r.randint(1, 50)) for _ in range(30)] + ["", "ÉCOLE İstanbul straße", "ab"]
    windows = [(1, i, t) for i, t in enumerate(turns)] + [(2, i, f"{a} {b}") for i, (a, b) in enumerate(zip(turns, turns[1:]))]
    quotes = [text(r, 9)[::-1] for _ in range(4)] + ["0123456789" * 3, "école istanbul and far more than that", "Speed Routing", "q", "ab"]
    q = spark.createDataFrame([("e", x) for x in quotes] + [("none", "no transcript at all")], "event_slug string, quote string")
    w = spark.createDataFrame([("e", s, i, f"{s}-{i}", t) for s, i, t in windows], "event_slug string, span int, seq long, label string, text string")
    got = {x.quote: (round(x.ratio, 9), x.label) for x in G.any_window(q, w, ["event_slug"]).collect()}
    want = {x: (round(best, 9), at and f"{at[0]}-{at[1]}") for x in quotes for best, at in [plain_best(x, windows)]}
    assert got == want | {"no transcript at all": (0.0, None)}


def test_many_pieces_match_as_the_library_says():
    r = random.Random(3)
    for letters in ("ab ", "etaoin shrdlu", "abcdéfghij xyz"):
        for _ in range(20):
            quote = "".join(r.choice(letters) for _ in range(r.randint(1, 110)))
            pieces = ["".join(r.choice(letters) for _ in range(r.randint(0, 199))) for _ in range(6)] + [quote, quote[::-1], quote[5:40]]
            want = [sum(b.size for b in SequenceMatcher(None, quote, p).get_matching_blocks()) for p in pieces]
            assert matched(quote, pieces, 0.0).tolist() == want
            assert all(g == w or g == -1 and 2 * w < 0.5 * (len(quote) + len(p)) for g, w, p in zip(matched(quote, pieces, 0.5).tolist(), want, pieces))


def plain_match(a, b):
    return sum(x.size for x in SequenceMatcher(None, a, b).get_matching_blocks())


def test_long_and_near_texts_match_as_the_library_says():
    r = random.Random(4)
    for letters in ("ab ", "etaoin shrdlu", "abcdefghijklmnopqrstuvwxyz .,;é", "aaaaaaaabcdefghijklmnopqrstuvwxyz      "):
        for n in (0, 3, 60, 199, 200, 230, 450):
            a = "".join(r.choice(letters) for _ in range(n))
            near = [a]
            for times in (1, 3, 30):
                b = a
                for _ in range(times):
                    k = r.randint(0, len(b))
                    b = b[:k] + r.choice(["", "zz ", r.choice(letters)]) + b[k + r.choice([0, 1, 5]):]
                near.append(b)
            others = near + ["".join(r.choice(letters) for _ in range(k)) for k in (0, 5, 199, 200, 260, 320)]
            assert [matching(a, b) for b in others] == [plain_match(a, b) for b in others]
            long = [b for b in others if len(b) >= 200]
            if a and long:
                s = Slices(long)
                for least in (0.0, 0.5):
                    got = s.matched_rare(a, s.starts[:-1], s.starts[1:], least).tolist()
                    assert all(g == plain_match(a, b) or g == -1 and 2 * plain_match(a, b) < least * (len(a) + len(b)) for g, b in zip(got, long))


def test_a_near_quote_is_held_against_the_windows_that_share_its_parts(monkeypatch):
    """A line of 400 characters with one word more: no other line is scored, nor is the library asked for the long one."""
    r = random.Random(12)
    lines = ["".join(r.choice("etaoinshrdlu  ,.") for _ in range(400)) + "Qx" for _ in range(40)]
    asked = []
    monkeypatch.setattr(similarity, "SequenceMatcher", lambda junk, a, b, *rest: asked.append(len(a) + len(b)) or SequenceMatcher(junk, a, b, *rest))
    s = Slices(lines)
    for k in (3, 17):
        quote = lines[k][:20] + "zz " + lines[k][20:]
        assert s.best(quote) == (SequenceMatcher(None, quote.lower(), lines[k].lower()).ratio(), k, lines[k])
    assert sum(asked) < 100


def test_equal_windows_and_odd_letters_keep_their_order():
    r = random.Random(13)
    base = text(r, 50)
    lines = [text(r, 60), base + " ΟΔΟΣ", base, "İ" + base, base, noisy(r, base, 0.02), text(r, 12)]
    for quote in (base[:30] + "zz " + base[30:], base + " οδος", "İ" + base, base[5:90], lines[-1], base[::-1]):
        best, at = plain_best(quote, [(1, i, t) for i, t in enumerate(lines)])
        got = Slices(lines).best(quote)
        assert (round(got[0], 12), got[1]) == (round(best, 12), at[1])


def test_quotes_of_a_long_transcript_are_joined_by_grams_first(spark, monkeypatch):
    monkeypatch.setattr(G, "SEARCHED", 300)
    monkeypatch.setattr(G, "ASKED", 2)  # several parts of quotes
    r = random.Random(6)
    turns = [text(r, 20) for _ in range(30)]
    quotes = [noisy(r, t, 0.05) for t in turns[:6]] + [text(r, 9)[::-1] for _ in range(3)]
    q = spark.createDataFrame([(e, x) for e in ("long", "few") for x in quotes], "event_slug string, quote string")
    w = spark.createDataFrame([("long", 1, i, "x", t) for i, t in enumerate(turns)] + [("few", 1, i, "x", t) for i, t in enumerate(turns[:4])],
                              "event_slug string, span int, seq long, label string, text string")
    got = {(x.event_slug, x.quote): (round(x.ratio, 9), x.seq) for x in G.closest_windows(q, w, ["event_slug"]).collect()}
    here = {"long": [(1, i, t) for i, t in enumerate(turns)], "few": [(1, i, t) for i, t in enumerate(turns[:4])]}
    assert got == {(e, x): (round(best, 9), at and at[1]) for e in here for x in quotes for best, at in [plain_best(x, here[e])]}


def test_a_quote_that_shares_no_letter_is_dropped(spark):
    turns = spark.createDataFrame([("e", 0, 30, "Dana Cole", "leads go cold in five minutes"), ("f", 0, 30, "Bob Ray", "speed is what wins the deal")],
                                  "event_slug string, seq long, sec int, speaker string, text string")
    windows = X.windows(turns.withColumnRenamed("event_slug", "recording_id")).withColumnRenamed("recording_id", "event_slug")
    strange = spark.createDataFrame([("e", "q" * 40), ("f", "q" * 40)], "event_slug string, quote string")
    assert [(x.ratio, x.snippet, x.seq) for x in G.any_window(strange, windows, ["event_slug"]).collect()] == [(0.0, None, None)] * 2
    raw = strange.selectExpr("event_slug", "1 AS quote_no", "quote", "'t' AS topic")
    parts = spark.createDataFrame([("e", 1, 0.0, 99.0), ("f", 1, 0.0, 99.0)], "event_slug string, chapter int, start_abs double, end_abs double")
    kept, dropped = G.normalised_quotes(raw, turns, windows, parts)
    assert kept.count() == 0 and [x.reason for x in dropped.collect()] == ["no window reaches 0.90"] * 2


def test_containment_equals_a_scan_for_every_length(spark):
    r = random.Random(9)
    texts = [text(r, 30) for _ in range(40)] + ["ab", "a"] + [text(r, 30)] * 3
    quotes = {"a", "ab", "zz", "speed zz"}
    for n in (1, 2, 3, 6, 7, 8, 10, 11, 12, 24, 25, 26, 60):
        for _ in range(4):
            t = r.choice(texts[:40])
            a = r.randint(0, len(t) - n)
            quotes.add(t[a:a + n])
    q = spark.createDataFrame([("e", x) for x in quotes], "k string, q string")
    t = spark.createDataFrame([("e", i, x) for i, x in enumerate(texts)], "k string, i long, t string")
    got = {x.q: x.i for x in G.contained(q, t, ["k"], "q", "t", "i").collect()}
    want = {x: min(i for i, b in enumerate(texts) if x in b) for x in quotes if any(x in b for b in texts)}
    assert got == want


def test_grams_of_texts_are_never_sent_to_the_driver(spark):
    r = random.Random(4)
    t = spark.createDataFrame([("e", i, text(r, 30)) for i in range(20)], "k string, i long, t string")
    q = spark.range(8000).selectExpr("'e' AS k", "concat('speed routing lead number ', id) AS q").unionByName(t.selectExpr("k", "substr(t, 5, 40) AS q"))
    hits = G.contained(q, t, ["k"], "q", "t", "i")
    assert "Broadcast" not in hits._jdf.queryExecution().executedPlan().toString()
    assert hits.count() == 20


def test_claims_and_verdicts(spark):
    body = ("<!-- x -->\n## Headline Options\n\"This creative line is never a claim\" Dana Cole\n## Story\n"
            "As Dana explained, \"leads go cold in five minutes flat\" [00:30]. Dana Cole, Acme [00:30] and Bob Ray, Beta [00:30].\n"
            "-- Nobody Known, Elsewhere\n" + "filler " * 40 + "The caption \"eighteen hours to under two hours\" stands alone far away from any person" + " filler" * 40 + "\n"
            "Dana said \"leads go cold ... and nobody calls them back today\" [09:59]\n")
    assets = spark.createDataFrame([("e", "a1", body)], "event_slug string, asset_id string, text string")
    turns = spark.createDataFrame([("e", 0, 30, "Dana Cole", "Honestly leads go cold in five minutes flat and then nobody calls them back today"), ("e", 1, 60, "Bob Ray", "Right you are, it is all about routing")],
                                  "event_slug string, seq long, sec int, speaker string, text string")
    windows = X.windows(turns.withColumnRenamed("event_slug", "recording_id")).withColumnRenamed("recording_id", "event_slug")
    roster = turns.select("event_slug", F.col("speaker").alias("name"))
    marks = X.valid_stamps(turns.select("event_slug", "sec"))
    got = [(x.type, x.raw, x.verified) for x in G.verified_claims(G.claims(assets), turns, windows, marks, roster).collect()]
    assert ("quote", "leads go cold in five minutes flat", True) in got
    assert not any("creative" in x[1] or "eighteen" in x[1] for x in got)
    assert ("timestamp", "[00:30]", True) in got and ("timestamp", "[09:59]", False) in got
    assert ("speaker_at", "Dana Cole @ [00:30]", True) in got and ("speaker_at", "Bob Ray @ [00:30]", False) in got
    assert ("attribution", "Nobody Known", False) in got
    elided = next(x for x in got if x[0] == "quote" and "..." in x[1])
    assert elided[2] is False  # its only span long enough was never said that way as a whole
    told = {x.raw: x for x in G.verified_claims(G.claims(assets), turns, windows, marks, roster).collect()}
    assert told["Bob Ray @ [00:30]"].reason == "Bob Ray is cited at 00:30, where Dana Cole speaks"
    assert told["[09:59]"].reason.endswith("09:59") and told["Nobody Known"].reason.startswith("Nobody Known is not")
    assert told["leads go cold in five minutes flat"][6:] == (1.0, "leads go cold in five minutes flat", "Dana Cole", None) or told["leads go cold in five minutes flat"].reason is None
    assert 0 < told[elided[1]].ratio < 0.9 and f"{told[elided[1]].ratio:.3f} of 0.90" in told[elided[1]].reason and told[elided[1]].window


def test_every_fragment_of_an_elided_quote_is_told(spark):
    turns = spark.createDataFrame([("e", 0, 30, "Dana Cole", "we always said that leads go cold in five minutes"), ("e", 1, 60, "Bob Ray", "the cost of waiting is simply too high for us")],
                                  "event_slug string, seq long, sec int, speaker string, text string")
    windows = X.windows(turns.withColumnRenamed("event_slug", "recording_id")).withColumnRenamed("recording_id", "event_slug")
    quotes = spark.createDataFrame([("e", "a", 0, "leads go cold in five minutes ... the cost of weighting is simply too high for us ... our rockets fly to the moon tomorrow")],
                                   "event_slug string, asset_id string, claim_no int, raw string")
    rows = G.verified_fragments(G.fragments(quotes), windows)
    parts = {x.fragment_no: x for x in rows.collect()}
    assert [parts[n].verified for n in range(3)] == [True, True, False]
    assert [parts[n].place for n in range(2)] == ["Dana Cole", "Bob Ray"]
    (one,) = G.of_fragments(rows).collect()
    assert not one.verified and one.ratio == parts[2].ratio and one.window == parts[2].window and 'for the part "our rockets' in one.reason


def test_loose_grounding_also_takes_allowed_names(spark):
    texts = spark.createDataFrame([("e", "s", 'We heard "The People Summit live" and "never said at all" [01:00]')], "event_slug string, scope string, text string")
    lines = spark.createDataFrame([("e", 1, "[01:00] hello there")], "event_slug string, line_no long, line string")
    names = spark.createDataFrame([("e", "People Summit")], "event_slug string, name string")
    run = lambda strict: {x.value: x.passed for x in G.strict_checks(texts, lines, names, strict).collect()}
    assert run(True) == {"The People Summit live": False, "never said at all": False, "01:00": True}
    assert run(False)["The People Summit live"] is True and run(False)["never said at all"] is False


def test_captions_share_time_by_characters(spark):
    assert fold("aa bb  cc", 5) == ["aa bb", "cc"] and fold("x" * 50 + " y", 42) == ["x" * 50, "y"]
    turns = spark.createDataFrame([("r", 0, 10.0, 20.0, "a" * 30 + " " + "b" * 30)], "recording_id string, seq long, start_sec double, end_sec double, text string")
    got = [(x.line_no, x.line_start, x.line_end) for x in X.caption_lines(turns).orderBy("line_no").collect()]
    assert got == [(0, 10.0, 15.0), (1, 15.0, 20.0)]
    clips = spark.createDataFrame([("r", 1, 14.9, 17.0)], "recording_id string, clip_id int, clip_start double, clip_end double")
    assert [(x.from_sec, x.to_sec) for x in X.captions(X.caption_lines(turns), clips).collect()] == [(0.1, 2.1)]  # 0.1 s of the first line is too short to show


def test_gap_is_start_to_start(spark):
    rows = [("r", 0, 0.0, "A", "x"), ("r", 1, 1.5, "A", "y"), ("r", 2, 3.4, "A", "z"), ("r", 3, 6.0, "A", "w"), ("r", 4, 6.5, "B", "v")]
    df = spark.createDataFrame(rows, "recording_id string, seq long, start_sec double, speaker string, text string")
    assert [x.text for x in X.merged_turns(df).orderBy("island").collect()] == ["x y z", "w", "v"]


def test_a_banner_stands_behind_a_leading_comment(spark):
    assets = spark.createDataFrame([("e", "a", "<!-- c -->\nBody"), ("e", "b", "Body"), ("e", "c", "Fine")], "event_slug string, asset_id string, text string")
    digest = spark.createDataFrame([("e", "a", "> B"), ("e", "b", "> B")], "event_slug string, asset_id string, banner string")
    got = {x.asset_id: x.text for x in G.flagged_text(assets, digest).collect()}
    assert got == {"a": "<!-- c -->\n\n> B\n\nBody", "b": "> B\n\nBody", "c": "Fine"}


def test_floor_changes_nothing_above_it():
    r = random.Random(2)
    for _ in range(60):
        t = text(r, 40)
        q = noisy(r, t[20:20 + r.randint(26, 90)], 0.08)
        free, bound = best_slice(q, t, 0.0), best_slice(q, t, 0.9)
        assert bound == (free if free[0] >= 0.9 else (0.0, ""))


def test_many_slices_are_walked_together(monkeypatch):
    """A hopeless quote has its best slice from a walk by run lengths over all slices, as from each one alone."""
    r = random.Random(21)
    turns = [text(r, r.randint(20, 60)) for _ in range(8)]
    windows = list(dict.fromkeys(turns + [f"{a} {b}" for a, b in zip(turns, turns[1:])]))
    walked = []
    plain = similarity.matched_slices
    monkeypatch.setattr(similarity, "matched_slices", lambda *a: walked.append(len(a[3])) or plain(*a))
    for quote in (turns[2][:90][::-1], text(r, 14)[::-1], "abcdefghij" * 6, "lead lead lead lead lead"):
        best, at = plain_best(quote, [(1, i, t) for i, t in enumerate(windows)])
        got = Slices(windows).best(quote)
        assert (round(got[0], 12), got[1]) == (round(best, 12), at[1])
    assert max(walked) > 100
    starts = np.arange(0, 900, 7)
    whole = Slices([" ".join(turns)])
    for quote in (turns[1][30:100], turns[0][::-1][:120], "e" * 20):
        got = whole.matched(quote, starts, starts + 95, 0.0)
        want = np.array([plain_match(quote, whole.whole[a:a + 95]) for a in starts])
        assert ((got == want) | (got == similarity.NEAR) & (want >= similarity.LONG_RUN)).all()
