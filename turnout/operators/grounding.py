"""Verification of generated text against the transcript it cites."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from turnout.functions import fixed, text as T
from turnout.functions.claims import claims_in, gram_tokens
from turnout.functions.similarity import Slices, seq_ratio, window_ratio
from turnout.operators.ordered import attach, spread, tasks, top_k
from turnout.operators.speakers import roster_match
from turnout.operators.transcript import clip_ends, in_chapter, snapped, true_speaker
from turnout.session import settled

EV = "event_slug"
GRAM_SIZES = ((25, 13), (11, 6), (7, 4), (3, 2))  # (shortest text served, gram length)
WORD = r"[\p{L}\p{Nd}_]+"
#: Quote grams, two numbers each, that go to every task; more are joined by shuffle.
GRAMS_SENT = 100_000


# --- locating quotes -----------------------------------------------------------------
def contained(quotes: DataFrame, texts: DataFrame, keys: list[str], quote: str, text: str, order: str,
              every: bool = False) -> DataFrame:
    """First text (by ``order``) that contains each quote, or every one, as an equi-join.

    Texts are cut into consecutive grams of k characters and quotes offer every
    gram of their first 2k-1 characters: wherever a quote sits, one of its
    grams lines up with a cut.  Equal texts are folded into their first copy
    before anything is cut.  k shrinks for short quotes; only sizes that occur
    are cut.  Quotes of one or two characters are looked up among all pieces of
    their length, which for a first place are reduced to one row each.

    Grams meet as two numbers a row, the gram's hash and that of its text or quote; texts are fetched for the
    pairs that met and compared whole, so equal hashes of different grams do no harm.  Spark would guess the
    size of the grams from that of the files, so the join is never left to that guess.
    """
    q = quotes.select(*keys, F.col(quote).alias("_q")).filter("_q <> ''").distinct()
    size = F
    for shortest, k in GRAM_SIZES:
        size = size.when(F.length("_q") >= shortest, k)
    q = settled(q.withColumn("_k", size))
    t = texts.groupBy(*keys, F.col(text).alias("_t")).agg(F.min(order).alias("_o"))
    qid, tid = F.xxhash64(*keys, "_q").alias("_qid"), F.xxhash64(*keys, "_t").alias("_tid")
    found = None
    for k, many in q.groupBy("_k").count().collect():  # at most four gram sizes, or none for short quotes
        if k is None:
            short = q.filter("_k IS NULL").drop("_k")
            pieces = t.select(*keys, "_o", F.explode(F.array_distinct(F.concat(*[F.when(F.length("_t") >= n, F.transform(
                F.sequence(F.lit(1), F.length("_t") - (n - 1)), lambda i: F.substring("_t", i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
                for n in (1, 2)]))).alias("_q"))
            pieces = pieces if every else pieces.groupBy(*keys, "_q").agg(F.min("_o").alias("_o"))
            hit = short.join(pieces.hint("merge"), keys + ["_q"]).select(*keys, "_q", "_o")
            found = hit if found is None else found.unionByName(hit)
            continue
        asked = q.filter(F.col("_k") == k).drop("_k")
        cut = t.select(*keys, tid, F.explode(F.array_distinct(F.regexp_extract_all("_t", F.lit(f"(?s).{{{k}}}"), F.lit(0)))).alias("_g"))
        offered = asked.select(*keys, qid, F.explode(F.array_distinct(
            F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.substring(F.col("_q"), i, F.lit(k))))).alias("_g"))
        gram = F.xxhash64(*keys, "_g").alias("_h")
        cut, offered = cut.select(gram, "_tid"), offered.select(gram, "_qid")
        met = F.broadcast(offered).join(cut, "_h") if many * k <= GRAMS_SENT else offered.join(cut.hint("merge"), "_h")
        told = asked.withColumn("_qid", qid)
        met = met.select("_qid", "_tid").distinct().join(F.broadcast(told) if many * k <= GRAMS_SENT else told.hint("merge"), "_qid")
        there = t.withColumn("_tid", tid)
        hit = met.join(there.hint("merge"), keys + ["_tid"]).filter(F.col("_t").contains(F.col("_q")))
        hit = hit.select(*keys, "_q", "_o").distinct() if every else hit.groupBy(*keys, "_q").agg(F.min("_o").alias("_o"))
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        found = q.drop("_k").join(t.select(*keys, "_o"), keys).limit(0)
    return found.select(*keys, F.col("_q").alias(quote), F.col("_o").alias(order))


def _folded(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct window texts with their first place."""
    first = F.struct("span", "seq")
    w = windows.groupBy(*keys, "text").agg(F.min(first).alias("_o"), F.min_by("label", first).alias("label"))
    return w.withColumn("_wid", F.xxhash64(*keys, "text"))


def _scored(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Best window per quote from 0.90 on; equal ratios go to the earlier, shorter window."""
    scored = spread(pairs).withColumn("_m", window_ratio("_q", "text", F.lit(fixed.QUOTE_RATIO))).filter(F.col("_m.ratio") > 0)
    order = F.struct(F.col("_m.ratio"), -F.col("_o.span"), -F.col("_o.seq"))
    best = scored.groupBy(*keys, "_q").agg(F.max_by(F.struct(
        F.col("_m.ratio").alias("ratio"), F.col("_m.snippet").alias("snippet"), "label", F.col("_o.seq").alias("seq")), order).alias("b"))
    return best.select(*keys, "_q", "b.*")


def best_windows(quotes: DataFrame, windows: DataFrame, keys: list[str], quote: str = "quote") -> DataFrame:
    """Best-matching transcript window of every quote that reaches 0.90.

    A quote of n characters and a window at 0.90 share at least
    n - 3 - 0.7273 n of the quote's 4-grams: 4 are lost per unmatched quote
    character and 3 per unmatched window character, and the ratio bounds both.
    Asking for half of that share needs only the rarest part of the grams, so
    the common grams that would pair everything are never joined, and what is
    asked for loses no match.  Surviving pairs are bounded by their common
    subsequence before any ratio is computed.
    ``windows``: keys, seq, span, label, text.
    """
    w = settled(_folded(windows, keys))
    gram = F.xxhash64(*keys, "_g").alias("_g")
    wg = settled(w.select(*keys, "_wid", F.explode(F.array_distinct(gram_tokens("text"))).alias("_g")).select("_wid", gram))
    q = quotes.select(*keys, F.col(quote).alias("_q")).filter("_q <> ''").distinct()
    n = F.length("_q")
    lost = F.floor(n * 0.7273)
    need = F.greatest(F.lit(1), F.floor((n - 3 - lost) / 2))
    qg = settled(q.select(*keys, "_q", (lost + need).alias("_keep"), need.alias("_need"), F.xxhash64(*keys, "_q").alias("_qid"),
                          F.explode(F.array_distinct(gram_tokens("_q"))).alias("_g")).withColumn("_g", gram))
    often = wg.join(qg.select("_g").distinct(), "_g", "left_semi").groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    ranked = qg.join(often, "_g", "left").withColumn("_rank", F.row_number().over(
        Window.partitionBy(*keys, "_qid").orderBy(F.coalesce("_n", F.lit(0)), "_g")))
    rare = ranked.filter((F.col("_rank") <= F.col("_keep")) & F.col("_n").isNotNull()).select(*keys, "_qid", "_need", "_g")
    pairs = rare.join(wg.hint("merge"), "_g").groupBy(*keys, "_qid", "_wid").agg(F.count(F.lit(1)).alias("_hits"), F.min("_need").alias("_need"))
    pairs = pairs.filter("_hits >= _need").select(*keys, "_qid", "_wid")
    texts = pairs.join(q.withColumn("_qid", F.xxhash64(*keys, "_q")), keys + ["_qid"]).join(w, keys + ["_wid"])
    shorter = F.length("text") * 11 >= n * 9  # below 9/11 of the quote no window reaches 0.90
    return _scored(texts.filter(shorter), keys).withColumnRenamed("_q", quote)


#: Characters of transcript, and quotes, that are searched for at once.
SEARCHED, ASKED = 200_000, 500
#: Blocks up to which a transcript is searched without joining grams first.
FEW_BLOCKS = 4


def _blocks(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks that the windows of each transcript are dealt into."""
    return windows.filter("text <> ''").groupBy(*keys).agg(F.ceil(F.sum(F.length("text")) / SEARCHED).cast("int").alias("_blocks"))


def any_window(quotes: DataFrame, windows: DataFrame, keys: list[str], quote: str = "quote") -> DataFrame:
    """Best window of every quote, however far off: ``ratio``, ``snippet``, ``label`` and ``seq``; equal ratios go to the
    earlier, shorter window.

    Windows and quotes of a transcript are dealt into blocks of bounded size, every two blocks meet once
    (see ``Slices``), and the best of the blocks stands.  A quote of which no letter is in the
    transcript has ratio 0 and no place.
    """
    w = _folded(windows, keys).filter("text <> ''")
    q = quotes.select(*keys, F.col(quote).alias("_q")).filter("_q <> ''").distinct()
    asked = q.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("_parts"))
    sizes = _blocks(w, keys).join(asked, keys)
    block = lambda c, blocks: F.pmod(F.xxhash64(c), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    nothing = {c: F.lit(None) for c in ("_q", "text", "label", "_span", "_seq")}
    placed = attach(w, sizes, keys, "inner").select(*keys, block("text", "_blocks").alias("_block"), every("_parts").alias("_part"), nothing["_q"].cast("string").alias("_q"), "text", "label",
                                                    F.col("_o.span").cast("long").alias("_span"), F.col("_o.seq").cast("long").alias("_seq"))
    wanted = attach(q, sizes, keys, "inner").select(*keys, every("_blocks").alias("_block"), block("_q", "_parts").alias("_part"), "_q",
                                                    nothing["text"].cast("string").alias("text"), nothing["label"].cast("string").alias("label"),
                                                    nothing["_span"].cast("long").alias("_span"), nothing["_seq"].cast("long").alias("_seq"))
    group = [*keys, "_block", "_part"]
    # few bytes but much computing: as many tasks as stated
    both = placed.unionByName(wanted).repartition(tasks(q.sparkSession), *group).sortWithinPartitions(*group)

    out = [*keys, "_q", "ratio", "snippet", "label", "span", "seq"]

    def found(key, held, wanted):
        held.sort(key=lambda window: window[:2])
        slices = Slices([text for *_, text in held]) if held and wanted else None
        for one in wanted if slices else ():
            hit = slices.best(one)
            if hit:
                span, seq, label, _ = held[hit[1]]
                yield (*key[:len(keys)], one, hit[0], hit[2], label, span, seq)

    def run(frames):
        key, held, wanted = None, [], []  # of one transcript: as plain lists, since most are short
        for frame in frames:
            hits = []
            columns = [frame[c].tolist() for c in ("_q", "text", "label", "_span", "_seq")]
            for here, one, text, label, span, seq in zip(zip(*[frame[c].tolist() for c in group]), *columns):
                if here != key:
                    hits += found(key, held, wanted)
                    key, held, wanted = here, [], []
                if one is None:
                    held.append((int(span), int(seq), label, text))
                else:
                    wanted.append(one)
            if hits:  # columns made from empty lists have no type that Arrow could take
                yield pd.DataFrame(hits, columns=out)
        hits = list(found(key, held, wanted))
        if hits:
            yield pd.DataFrame(hits, columns=out)

    kinds = ", ".join(f"{k} {dict(q.dtypes)[k]}" for k in keys)
    hits = both.mapInPandas(run, f"{kinds}, _q string, ratio double, snippet string, label string, span long, seq long")
    order = F.struct(F.col("ratio"), -F.col("span"), -F.col("seq"))
    best = hits.groupBy(*keys, "_q").agg(F.max_by(F.struct("ratio", "snippet", "label", "seq"), order).alias("b"))
    return q.join(best, keys + ["_q"], "left").select(
        *keys, F.col("_q").alias(quote), F.coalesce("b.ratio", F.lit(0.0)).alias("ratio"), "b.snippet", "b.label", "b.seq")


def matched_windows(quotes: DataFrame, windows: DataFrame, keys: list[str], quote: str = "quote") -> DataFrame:
    """Best window of every quote: a whole window scores 1 and is settled, then the rest by search."""
    q = quotes.select(*keys, quote).filter(F.col(quote) != "").distinct()
    w = _folded(windows, keys)
    same = q.select(*keys, F.col(quote).alias("_q"), F.lower(quote).alias("_low")).join(w.withColumn("_low", F.lower("text")).hint("merge"), keys + ["_low"])
    sure = settled(_scored(same.filter(F.length("text") == F.length("_q")), keys).filter("ratio = 1").withColumnRenamed("_q", quote))
    rest = settled(q.join(sure, keys + [quote], "left_anti").select(*keys, quote))
    return sure.unionByName(closest_windows(rest, windows, keys, quote))


def closest_windows(quotes: DataFrame, windows: DataFrame, keys: list[str], quote: str = "quote") -> DataFrame:
    """Best window of every quote at any ratio.

    A transcript of a few blocks is searched as it is.  In a longer one, quotes from 0.90 on are found by shared grams and
    only the others searched for.
    """
    q = quotes.select(*keys, quote).filter(F.col(quote) != "").distinct()
    long = settled(_blocks(windows, keys).filter(F.col("_blocks") > FEW_BLOCKS).select(*keys))
    if long.isEmpty():
        return any_window(q, windows, keys, quote)
    near = settled(best_windows(q.join(long, keys, "left_semi"), windows.join(long, keys, "left_semi"), keys, quote))
    far = q.join(near, keys + [quote], "left_anti")
    return near.unionByName(any_window(far, windows, keys, quote).select(*near.columns))


def located_quotes(quotes: DataFrame, turns: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Where a quote was said: verbatim turn first, else the best window from 0.90.

    ``quotes``: keys, quote_no, quote.  A fuzzy hit takes its window's first
    speaker and that speaker's first second.  The ratio is that of the best
    window; below 0.90 no speaker and second are given.
    """
    q = quotes.withColumn("_norm", T.spaced(F.col("quote")))
    t = turns.withColumn("_norm", T.spaced(F.col("text")))
    verbatim = contained(q, t, keys, "_norm", "_norm", "seq").join(
        t.select(*keys, "seq", F.col("speaker").alias("said_by"), "sec"), keys + ["seq"])
    q1 = q.join(verbatim.select(*keys, "_norm", "said_by", "sec").withColumn("ratio", F.lit(1.0)), keys + ["_norm"])
    rest = settled(q.join(verbatim, keys + ["_norm"], "left_anti"))
    near = closest_windows(rest, windows, keys).withColumn("said_by", F.trim(F.split_part("label", F.lit("->"), F.lit(1))))
    first = turns.groupBy(*keys, F.col("speaker").alias("said_by")).agg(F.min_by("sec", "seq").alias("sec"))
    near = near.join(first, keys + ["said_by"], "left")
    q2 = rest.join(near.select(*keys, "quote", "said_by", "sec", "ratio"), keys + ["quote"], "left")
    good = F.coalesce(F.col("ratio") >= fixed.QUOTE_RATIO, F.lit(False))
    q2 = q2.withColumns({"said_by": F.when(good, F.col("said_by")), "sec": F.when(good, F.col("sec"))})
    cols = [*quotes.columns, "said_by", "sec", "ratio"]
    return q1.select(*cols).unionByName(q2.select(*cols))


# --- claims ---------------------------------------------------------------------------
def claims(assets: DataFrame) -> DataFrame:
    """Every claim of every asset with a running number, in text order of its kind."""
    return assets.select(EV, "asset_id", F.posexplode(claims_in("text")).alias("claim_no", "c")).select(EV, "asset_id", "claim_no", "c.*")


def attributed(quote_claims: DataFrame, roster: DataFrame) -> DataFrame:
    """Quotes that stand near a named speaker; the others are not claims about speech.

    A speaker is named by the full name anywhere, or by any part of it as a word.
    Parts join on their first run of letters, which is then a word of the
    context too, and are checked whole; full names are found as verbatim quotes are.
    """
    key = [EV, "asset_id", "claim_no"]
    names = roster.select(EV, "name").filter("name <> ''").distinct()
    sides = quote_claims.select(*key, F.explode(F.array_distinct(F.array("before", "after"))).alias("context")).filter("context <> ''")
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)))
    parts = names.select(EV, F.explode(F.split("name", r"\s+")).alias("part")).distinct().withColumn("word", F.regexp_extract("part", WORD, 0)).filter("word <> ''")
    by_word = sides.select(*key, "context", F.explode(words("context")).alias("word")).join(parts, [EV, "word"]).filter(
        F.regexp_like("context", F.concat(F.lit(r"\b\Q"), F.col("part"), F.lit(r"\E\b")))).select(*key)
    contexts = sides.select(EV, "context").distinct()
    whole = contained(names, contexts.withColumn("_at", F.col("context")), [EV], "name", "context", "_at", every=True)
    by_name = sides.join(whole.select(EV, F.col("_at").alias("context")).distinct(), [EV, "context"], "left_semi").select(*key)
    return quote_claims.join(by_word.unionByName(by_name).distinct(), key, "left_semi")


def fragments(quote_claims: DataFrame) -> DataFrame:
    """An elided quote is one claim of several spans; short tails are not spans."""
    parts = F.filter(F.transform(F.split("raw", r"\s*(?:\x{2026}|\.\.\.)\s*"), lambda p: F.btrim(p, F.lit(" ,;:"))),
                     lambda p: F.length(p) >= fixed.QUOTE_MIN)
    return quote_claims.select(EV, "asset_id", "claim_no", "raw", F.posexplode(
        F.when(F.size(parts) > 1, parts).otherwise(F.array("raw"))).alias("fragment_no", "quote"))


def verified_fragments(spans: DataFrame, windows: DataFrame) -> DataFrame:
    """Each span of each quote with the ratio, text (``window``) and speakers (``place``) of its best window."""
    hits = matched_windows(spans, windows, [EV]).select(EV, "quote", "ratio", F.col("snippet").alias("window"), F.col("label").alias("place"))
    return attach(spans, hits, [EV, "quote"]).fillna(0.0, ["ratio"]).select(
        EV, "asset_id", "claim_no", "raw", "fragment_no", "quote", "ratio", "window", "place", (F.col("ratio") >= fixed.QUOTE_RATIO).alias("verified"))


def of_fragments(parts: DataFrame) -> DataFrame:
    """One verdict per quote: all spans must hold, the worst one (the first of equals) is told."""
    worst = F.min_by(F.struct("ratio", "window", "place", "quote"), F.struct("ratio", "fragment_no")).alias("w")
    told = parts.groupBy(EV, "asset_id", "claim_no", "raw").agg(worst, F.bool_and("verified").alias("verified"), F.count(F.lit(1)).alias("_n"))
    short = F.format_string("the closest window reaches %.3f of %.2f", F.col("w.ratio"), F.lit(fixed.QUOTE_RATIO))
    reason = F.when(F.col("_n") > 1, F.concat(F.lit("for the part \""), F.col("w.quote"), F.lit("\" "), short)).otherwise(short)
    return told.select(EV, "asset_id", "claim_no", F.lit("quote").alias("type"), "raw", "verified", F.col("w.ratio").alias("ratio"),
                       F.col("w.window").alias("window"), F.col("w.place").alias("place"), F.when(~F.col("verified"), reason).alias("reason"))


def quotes_of_speakers(found: DataFrame, roster: DataFrame) -> DataFrame:
    """Spans of the quotes among claims that stand near a named speaker."""
    return fragments(attributed(found.filter("type = 'quote'"), roster))


def verified_claims(found: DataFrame, turns: DataFrame, windows: DataFrame, stamps: DataFrame, roster: DataFrame) -> DataFrame:
    """Each claim with its verdict: stamps by semi-join, speakers and quotes by bounded joins.

    ``ratio``, ``window`` and ``place`` are those of the best match, ``reason`` says what a failed claim lacks.
    """
    key = [EV, "asset_id", "claim_no"]
    found = settled(found.withColumn("sec", T.seconds_of(F.col("stamp"))))
    none = F.lit(None).cast("string")

    def told(df: DataFrame, verified: Column, ratio: Column, reason: Column, place: Column = none) -> DataFrame:
        return df.select(*key, "type", "raw", verified.alias("verified"), ratio.alias("ratio"), none.alias("window"), place.alias("place"),
                         F.when(~verified, reason).alias("reason"))

    ok = stamps.select(EV, F.col("sec").cast("int").alias("sec")).distinct().withColumn("_ok", F.lit(True))
    stamped = told(found.filter("type = 'timestamp'").join(ok, [EV, "sec"], "left"), F.coalesce("_ok", F.lit(False)), F.lit(None).cast("double"),
                   F.concat(F.lit("no turn, segment or chapter is marked at "), F.col("stamp")))

    names = found.filter("name IS NOT NULL").select(EV, F.col("name").alias("cited"))
    who = settled(roster_match(names, roster))
    first = turns.groupBy(EV, F.col("sec").cast("int").alias("sec")).agg(F.min_by("speaker", "seq").alias("_said"))
    at = found.filter("type = 'speaker_at'").join(who.select(EV, F.col("cited").alias("name"), "matched"), [EV, "name"]).join(first, [EV, "sec"])
    at = told(at.withColumn("_r", seq_ratio("_said", "matched")), F.col("_r") >= fixed.NAME_RATIO, F.col("_r"),
              F.concat("name", F.lit(" is cited at "), "stamp", F.lit(", where "), "_said", F.lit(" speaks")), F.col("_said"))
    said = found.filter("type = 'attribution'").join(who.select(EV, F.col("cited").alias("name"), "matched", F.col("ratio").alias("_r")), [EV, "name"], "left")
    said = told(said, F.col("_r").isNotNull(), F.col("_r"), F.concat("name", F.lit(" is not a speaker of this event")), F.col("matched"))

    spans = settled(quotes_of_speakers(found, roster))
    return stamped.unionByName(at).unionByName(said).unionByName(of_fragments(verified_fragments(spans, windows)))


def grounding_totals(verdicts: DataFrame) -> DataFrame:
    """Checked, verified and failed per asset and per event, in one rollup."""
    return verdicts.rollup(EV, "asset_id").agg(
        F.count(F.lit(1)).alias("checked"), F.count_if("verified").alias("verified"), F.count_if(~F.col("verified")).alias("failed"),
        F.bool_and("verified").alias("passed")).filter(F.col(EV).isNotNull())


def failure_digest(verdicts: DataFrame, k: int = 5) -> DataFrame:
    """Banner text per asset that failed: counts and the first ``k`` failures with their reasons."""
    n = verdicts.groupBy(EV, "asset_id").agg(F.count(F.lit(1)).alias("checked"), F.count_if(~F.col("verified")).alias("failed"))
    few = top_k(verdicts.filter(~F.col("verified")), [EV, "asset_id"], [F.asc("claim_no"), F.asc("type")], k)
    most = fixed.SHOWN_CLAIM
    text = F.when(F.length("raw") <= most, F.col("raw")).otherwise(F.concat(F.substring("raw", 1, most - 3), F.lit("...")))
    lines = few.withColumn("_l", F.format_string("> - [%s] %s: %s", F.col("type"), text, F.coalesce("reason", F.lit("")))).groupBy(EV, "asset_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_l"))), lambda s: s["_l"]), "\n").alias("_lines"))
    more = F.when(F.col("failed") > k, F.format_string("\n> - ...and %d more", F.col("failed") - k)).otherwise("")
    return n.filter("failed > 0").join(lines, [EV, "asset_id"]).select(
        EV, "asset_id", "checked", "failed", F.concat(F.format_string("> %d of %d claims did not verify\n", "failed", "checked"), "_lines", more).alias("banner"))


def flagged_text(assets: DataFrame, digest: DataFrame) -> DataFrame:
    """Assets with their banner in front, behind a leading comment line if there is one."""
    j = assets.join(digest.select(EV, "asset_id", "banner"), [EV, "asset_id"], "left")
    head = F.regexp_extract("text", r"(?s)^(<!--[^\n]*\n)", 1)
    put = F.concat(head, F.when(head != "", "\n").otherwise(""), "banner", F.lit("\n\n"), F.substring(F.col("text"), F.length(head) + 1, F.length("text")))
    return j.withColumn("text", F.when(F.col("banner").isNull(), F.col("text")).otherwise(put)).drop("banner")


def undefined_stats(assets: DataFrame) -> DataFrame:
    """Ordinals the layout cites beyond the data points that exist."""
    both = r"(?ms)^##\s*Data Points\s*?$(.*?)^##\s*Layout\s*?$(.*)\z"
    n = F.regexp_count(F.regexp_extract("text", both, 1), F.lit(r"(?m)^\s*(?:\d+\.\s*)?\*\*"))
    refs = F.regexp_extract_all(F.regexp_extract("text", both, 2), F.lit(fixed.STAT), F.lit(1))
    rows = assets.filter(F.col("text").rlike(both)).select(EV, "asset_id", n.alias("points"), F.explode(F.array_distinct(refs)).alias("_n"))
    return rows.select(EV, "asset_id", "points", F.col("_n").try_cast("int").alias("stat")).filter("stat > points").distinct()


# --- strict grounding --------------------------------------------------------------------
def quoted_spans(texts: DataFrame) -> DataFrame:
    """Quoted spans (8-400 characters) and [MM:SS] anchors of rendered text."""
    spans = F.regexp_extract_all("text", F.lit(fixed.QUOTED), F.lit(1))
    anchors = F.regexp_extract_all("text", F.lit(rf"\[({fixed.TS})\]"), F.lit(1))
    rows = lambda c, kind: texts.select(EV, "scope", F.lit(kind).alias("kind"), F.posexplode(c).alias("no", "value"))
    return rows(spans, "quote").unionByName(rows(anchors, "timestamp"))


def strict_checks(texts: DataFrame, lines: DataFrame, allowed: DataFrame, strict: bool = True) -> DataFrame:
    """Quotes have to occur in the source word for word, anchors have to exist there.

    ``strict=False`` also passes a quote that contains, or is part of, an allowed
    proper noun.  ``lines``: (event_slug, line_no, line) of the source.
    """
    spans = settled(quoted_spans(texts).withColumn("_norm", T.match_key(F.col("value"))))
    src = lines.withColumn("_norm", T.match_key(F.col("line")))
    quotes = spans.filter("kind = 'quote'")
    there = contained(quotes, src, [EV], "_norm", "_norm", "line_no").select(EV, "_norm").withColumn("_in", F.lit(True))
    if not strict:
        nouns = allowed.select(EV, T.match_key(F.col("name")).alias("name")).filter("name <> ''").distinct()
        open_ = settled(quotes.select(EV, "_norm").filter("_norm <> ''").distinct().join(there, [EV, "_norm"], "left_anti"))
        holding = contained(nouns, open_.withColumn("_at", F.col("_norm")), [EV], "name", "_norm", "_at", every=True).select(EV, F.col("_at").alias("_norm"))
        inside = contained(open_, nouns.withColumn("_at", F.col("name")), [EV], "_norm", "name", "_at").select(EV, "_norm")
        there = there.select(EV, "_norm").unionByName(holding).unionByName(inside).distinct().withColumn("_in", F.lit(True))
    q = quotes.join(there, [EV, "_norm"], "left").withColumn("passed", F.coalesce("_in", F.lit(False))).drop("_in")
    marks = lines.select(EV, F.explode(F.regexp_extract_all("line", F.lit(rf"\[({fixed.TS})\]"), F.lit(1))).alias("value")).distinct().withColumn("_in", F.lit(True))
    t = spans.filter("kind = 'timestamp'").join(marks, [EV, "value"], "left").withColumn("passed", F.coalesce("_in", F.lit(False))).drop("_in")
    both = q.unionByName(t)
    reason = F.when(F.col("passed"), "").when((F.col("kind") == "quote") & (F.col("_norm") == ""), "nothing to look for").when(
        F.col("kind") == "quote", "no line holds it").otherwise("no line bears it")
    return both.select(EV, "scope", "kind", "no", "value", "passed", reason.alias("reason"))


# --- asset specification -------------------------------------------------------------------
def social_posts(assets: DataFrame) -> DataFrame:
    """One row per post of a social asset with platform and hook style."""
    body = F.regexp_extract_all("text", F.lit(fixed.POST), F.lit(1))
    rows = assets.select(EV, "asset_id", F.posexplode(body).alias("no", "post"))
    platform = F.btrim(F.lower(F.regexp_extract("post", r"(?i)(?:\*\*|\*)?Platform:(?:\*\*|\*)?\s*(\S+)", 1)), F.lit("*"))
    hook = F.lower(F.btrim(F.trim(F.regexp_extract("post", r"(?i)(?:\*\*|\*)?Hook style:(?:\*\*|\*)?\s*(.+)", 1)), F.lit("*")))
    return rows.withColumns({"platform": F.when(platform.isin("linkedin", "x"), platform).otherwise("other"), "hook": hook})


def post_counts(assets: DataFrame) -> DataFrame:
    """Posts by platform, and whether every post has its own hook, in one row per asset.

    A single text holds its posts, so the hooks of an asset are a bounded list.
    """
    p = F.col("platform")
    return social_posts(assets).groupBy(EV, "asset_id").agg(
        F.count(F.lit(1)).alias("posts"), F.count_if(p == "linkedin").alias("linkedin"), F.count_if(p == "x").alias("x"),
        F.count_if(p == "other").alias("other"), F.count_if(F.col("hook") != "").alias("hooks"),
        F.count_distinct(F.when(F.col("hook") != "", F.col("hook"))).alias("distinct_hooks"))


def spec_problems(assets: DataFrame, stamps: DataFrame) -> DataFrame:
    """First rule each asset breaks for its kind ('blog.md', 'social.md', ...), '' when in spec."""
    kind, text = F.col("kind"), F.col("text")
    n = T.words(text)
    lo, hi = fixed.BLOG_WORDS
    blog = F.when(n < lo, F.format_string(f"%d words, add %d", n, lo - n)).when(n > hi, F.format_string(f"%d words, cut %d", n, n - hi)).otherwise("")

    posts = post_counts(assets.filter("kind = 'social.md'"))
    j = assets.join(posts, [EV, "asset_id"], "left").fillna(0, ["posts", "linkedin", "x", "other", "hooks", "distinct_hooks"])
    few, many = fixed.SOCIAL_POSTS
    c = F.col
    social = (
        F.when(c("posts") < few, F.format_string("%d posts, add %d", c("posts"), few - c("posts")))
        .when(c("posts") > many, F.format_string("%d posts, cut %d", c("posts"), c("posts") - many))
        .when((c("linkedin") < fixed.MIN_LINKEDIN) | (c("x") < fixed.MIN_X), F.format_string("mix linkedin=%d x=%d other=%d", c("linkedin"), c("x"), c("other")))
        .when(c("hooks") < c("posts"), F.format_string("hooks on %d of %d posts", c("hooks"), c("posts")))
        .when(c("distinct_hooks") < c("hooks"), "hook styles repeat").otherwise(""))

    def missing(name):
        gaps = [F.when(~text.contains(h), F.lit(h)) for h in fixed.REQUIRED_SECTIONS[name]]
        return F.concat_ws(", ", *gaps)
    head = F.split_part(text, F.lit("## Description"), F.lit(1))
    marks = F.regexp_extract_all(head, F.lit(rf"(?m)^({fixed.TS})\s+\S"), F.lit(1))
    chapters = F.when(missing("youtube.md") != "", F.concat(F.lit("missing "), missing("youtube.md"))).when(
        F.size(marks) < fixed.MIN_CHAPTERS, F.format_string("%d chapter markers", F.size(marks))).when(
        ~F.try_element_at(marks, F.lit(1)).isin("00:00", "0:00"), "chapters do not start at 00:00").otherwise("")
    data = F.split_part(F.element_at(F.split(text, "## Data Points", 2), -1), F.lit("## Layout"), F.lit(1))
    points = F.regexp_count(data, F.lit(r"(?m)^\s*(?:[-*]\s*|\d+\.\s*)?\*\*.+?\*\*\s*[—–:-]"))
    info = F.when(missing("infographic.md") != "", F.concat(F.lit("missing "), missing("infographic.md"))).when(
        points < fixed.MIN_POINTS, F.format_string("%d data points", points)).otherwise("")
    j = j.withColumn("problem", F.when(kind == "blog.md", blog).when(kind == "social.md", social).when(
        kind == "youtube.md", chapters).when(kind == "infographic.md", info).otherwise(""))

    cited = j.filter((kind == "youtube.md") & (c("problem") == "")).select(EV, "asset_id", F.explode(marks).alias("_m")).withColumn(
        "sec", T.seconds_of(c("_m")).cast("bigint")).filter("sec <> 0")
    bad = cited.join(stamps.select(EV, c("sec").cast("bigint").alias("sec")).distinct(), [EV, "sec"], "left_anti").groupBy(EV, "asset_id").agg(
        F.count(F.lit(1)).alias("_bad"))
    j = j.join(bad, [EV, "asset_id"], "left")
    return j.select(EV, "asset_id", "kind", F.when(c("_bad").isNotNull(), F.format_string("%d chapter marks not in the transcript", c("_bad"))).otherwise(
        c("problem")).alias("problem"))


def tagged_assets(assets: DataFrame, events: DataFrame) -> DataFrame:
    """Campaign-tagged recording links per channel: blog, video description, each social post."""
    dim = events.select(EV, "recording_url", T.event_tag(F.col("event_name"), F.col("date")).alias("_camp"))
    j = attach(assets, dim, [EV]).filter(F.coalesce("recording_url", F.lit("")) != "")
    url, camp, text, kind = F.col("recording_url"), F.col("_camp"), F.col("text"), F.col("kind")

    def tag(name):
        s, m, c = fixed.CHANNEL_UTM[name]
        return T.with_utm(url, F.lit(s), F.lit(m), camp, F.lit(c))
    blog = F.replace(text, F.concat(F.lit("("), url, F.lit(")")), F.concat(F.lit("("), tag("blog.md"), F.lit(")")))
    mark = F.concat(F.lit("**Recording link:** [Watch the full session]("), tag("youtube.md"), F.lit(")"))
    at = F.instr(text, "## Thumbnail Brief")
    video = F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), mark, F.lit("\n\n"), F.substring(text, at, F.length(text)))).otherwise(
        F.concat(F.rtrim(text, F.lit("\n")), F.lit("\n\n"), mark, F.lit("\n")))
    # every post is rewritten in place: split in front of the post headings, fill, join again
    parts = F.split(text, r"(?=### Post \d)")

    def post(p):
        no = F.regexp_extract(p, r"^### Post (\d+)", 1)
        name = F.btrim(F.lower(F.regexp_extract(p, r"(?i)(?:\*\*|\*)?Platform:(?:\*\*|\*)?\s*(\S+)", 1)), F.lit("*"))
        source = F.when(name == "x", "x").otherwise("linkedin")
        link = T.with_utm(url, source, F.lit("social"), camp, F.concat(F.lit("social-post-"), no))
        return F.when(no == "", p).otherwise(F.replace(p, F.lit("[link]"), F.concat(F.lit("[recording]("), link, F.lit(")"))))
    social = F.array_join(F.transform(parts, post), "")
    return j.select(*[c for c in assets.columns if c != "text"], F.when(kind == "blog.md", blog).when(kind == "youtube.md", video).when(
        kind == "social.md", social).otherwise(text).alias("text"))


# --- extraction ------------------------------------------------------------------------------
def normalised_moments(raw: DataFrame, stamps: DataFrame, chapter_rows: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Model moments on real stamps: accepted rows and dropped rows with a reason.

    ``raw``: event_slug, moment_id, title, sec, end_sec, worth, claimed.
    """
    j = snapped(raw, stamps).withColumnRenamed("snapped", "start").drop("drift")
    j = snapped(j, stamps, "end_sec").withColumnRenamed("snapped", "proposed").drop("drift")
    j = in_chapter(j, chapter_rows, "start")
    j = settled(j.withColumn("upper", F.floor("chapter_end")))
    late = F.col("start") >= F.col("chapter_end") - fixed.CLIP_MIN
    reason = F.when(F.col("start").isNull(), "start bears on no mark").when(late, "too close to the chapter's end")
    open_ = clip_ends(j.filter(reason.isNull()), stamps)
    ok = open_.filter(F.col("end").isNotNull())
    dropped = j.filter(reason.isNotNull()).select(EV, "moment_id", reason.alias("reason")).unionByName(
        open_.filter(F.col("end").isNull()).select(EV, "moment_id", F.lit("no end within reach").alias("reason")))
    spoken = true_speaker(ok.withColumn("sec", F.col("start")), turns, EV)
    worth = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("worth").try_cast("double"), F.lit(0.5)))), 2)
    return spoken.select(EV, "moment_id", F.substring("title", 1, fixed.SHOWN_TITLE).alias("title"), "speaker", "corrected", "start", "end",
                         (F.col("end") - F.col("start")).alias("duration"), worth.alias("worth"), "chapter"), dropped


def normalised_quotes(raw: DataFrame, turns: DataFrame, windows: DataFrame, chapter_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Model quotes with speaker, second and chapter: accepted rows, and dropped rows with a reason.

    ``raw``: event_slug, quote_no, quote, topic.  Quotes too short to verify, and those that no turn
    holds and no window reaches, are dropped; the ratio is named where it was reached.
    """
    q = raw.withColumn("quote", F.btrim(F.trim(F.coalesce("quote", F.lit(""))), F.lit("\"“”")))
    short = F.length("quote") < fixed.QUOTE_MIN
    found = settled(located_quotes(q.filter(~short), turns, windows, [EV]))
    ok = in_chapter(found.filter("sec IS NOT NULL"), chapter_rows)
    why = F.when(F.col("ratio") >= fixed.QUOTE_RATIO, F.format_string("heard at %.2f, but no second is known", "ratio")).otherwise(
        F.lit(f"no window reaches {fixed.QUOTE_RATIO:.2f}"))
    cut = F.substring("quote", 1, fixed.SHOWN_QUOTE).alias("quote")
    dropped = q.filter(short).select(EV, "quote_no", cut, F.lit("too short to verify").alias("reason")).unionByName(
        found.filter("sec IS NULL").select(EV, "quote_no", cut, why.alias("reason")))
    return ok.select(EV, "quote_no", "quote", F.col("said_by").alias("speaker"), "sec", "topic", "chapter", F.round("ratio", 3).alias("ratio")), dropped


def normalised_points(raw: DataFrame, stamps: DataFrame, chapter_rows: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Data points on real stamps with their true speaker; those whose second bears on no mark are dropped.

    ``raw``: event_slug, point_no, value, what, sec, claimed.
    """
    j = snapped(raw, stamps).drop("sec", "drift").withColumnRenamed("snapped", "sec")
    ok = true_speaker(in_chapter(j.filter("sec IS NOT NULL"), chapter_rows), turns, EV)
    dropped = j.filter("sec IS NULL").select(EV, "point_no", F.substring("value", 1, fixed.SHOWN_VALUE).alias("value"), F.lit("second bears on no mark").alias("reason"))
    return ok.select(EV, "point_no", F.trim("value").alias("value"), "what", "speaker", "sec", "chapter"), dropped


def normalised_insights(raw: DataFrame, stamps: DataFrame, chapter_rows: DataFrame, turns: DataFrame) -> DataFrame:
    """Insights, all kept: with a mark they get its second, chapter and true speaker, else what the model said.

    ``raw``: event_slug, insight_no, insight, so_what, sec, claimed.
    """
    j = snapped(raw, stamps).drop("sec", "drift").withColumnRenamed("snapped", "sec")
    placed = true_speaker(in_chapter(j.filter("sec IS NOT NULL"), chapter_rows), turns, EV).select(
        EV, "insight_no", "insight", "so_what", "speaker", "sec", "chapter")
    loose = j.filter("sec IS NULL").select(EV, "insight_no", "insight", "so_what", F.coalesce("claimed", F.lit("")).alias("speaker"), "sec")
    return placed.unionByName(loose, allowMissingColumns=True)


def fingerprints(sources: DataFrame, key: str, text: str) -> DataFrame:
    """Content fingerprint per source."""
    return sources.select(key, F.sha2(F.col(text), 256).alias("sha256"))


def drifted(now: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Sources to recompute: new, or different from the stored fingerprint."""
    j = now.join(stored.select(key, F.col("sha256").alias("_old")), key, "left")
    return j.filter(F.col("_old").isNull() | (F.col("_old") != F.col("sha256"))).select(
        key, F.when(F.col("_old").isNull(), "new").otherwise("changed").alias("state"))
