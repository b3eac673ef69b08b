"""Turns, captions, chapters and clip windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from turnout.functions import fixed, text as T
from turnout.functions.layout import caption_layout
from turnout.operators.ordered import around, attach, in_order, top_k

REC = "recording_id"


# --- turns --------------------------------------------------------------------
def turns_of(lines: DataFrame) -> DataFrame:
    """``[MM:SS] **Speaker:** text`` lines to turns; other lines are not turns."""
    line = F.trim("line")
    part = lambda i: F.regexp_extract(line, fixed.TURN_LINE, i)
    return lines.filter(line.rlike(fixed.TURN_LINE)).select(
        REC, F.col("line_no").alias("seq"), T.seconds_of(part(1)).alias("sec"), F.trim(part(2)).alias("speaker"),
        F.trim(part(3)).alias("text"))


def cue_lines_of(lines: DataFrame) -> DataFrame:
    """Looser parse for captions: a bold mark without colon is a SYSTEM line."""
    line = F.trim("line")
    part = lambda i: F.regexp_extract(line, fixed.CUE_LINE, i)
    bold, tail = F.trim(part(3)), F.trim(part(4))
    named = bold.endswith(":")
    return lines.filter(line.rlike(fixed.CUE_LINE)).select(
        REC, F.col("line_no").alias("seq"), (part(1).cast("int") * 60 + part(2).cast("int")).alias("sec"),
        F.when(named, F.trim(F.regexp_replace(bold, ":$", ""))).otherwise("SYSTEM").alias("speaker"),
        F.when(named, tail).otherwise(F.trim(F.concat_ws(" ", bold, tail))).alias("text"))


def islands(pieces: DataFrame, gap: float = fixed.MERGE_GAP) -> DataFrame:
    """Number runs of one speaker whose starts are less than ``gap`` apart, start to start."""
    seen = in_order(pieces, [REC], ["start_sec", "seq"], lags={"_speaker": "speaker", "_start": "start_sec"})
    joins = (F.col("speaker") == F.col("_speaker")) & (F.col("start_sec") - F.col("_start") < gap)
    flagged = seen.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).drop("_speaker", "_start")
    counted = in_order(flagged, [REC], ["start_sec", "seq"], running={"_before": "_new"})
    return counted.withColumn("island", F.col("_before") + F.col("_new")).drop("_before", "_new")


def merged_turns(pieces: DataFrame, gap: float = fixed.MERGE_GAP, fixes=()) -> DataFrame:
    """One turn per island with the pieces' text in order; blank pieces are left out.

    The joined text is one output value, so only an island's own pieces meet in a
    task; ``islands`` gives the same grouping row by row.
    """
    said = pieces.withColumn("text", T.replaced(F.trim("text"), list(fixes))).filter("text <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_sec", "seq", "text"))), lambda s: s["text"]), " ")
    return islands(said, gap).groupBy(REC, "island").agg(
        F.min("start_sec").alias("start_sec"), F.min("speaker").alias("speaker"), F.count(F.lit(1)).alias("pieces"), joined.alias("text"))


def cues(turns: DataFrame) -> DataFrame:
    """Caption cues: end at the next start, the last one 20 s on, never empty."""
    seen = in_order(turns, [REC], ["seq"], position="_pos", leads={"_next": "sec"})
    end = F.coalesce("_next", F.col("sec") + fixed.LAST_CUE)
    end = F.when(end <= F.col("sec"), F.col("sec") + 1).otherwise(end)
    safe = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return seen.select(REC, "seq", (F.col("_pos") + 1).alias("cue_no"), F.col("sec").alias("start_sec"), end.alias("end_sec"),
                       F.concat(F.lit("<v "), F.col("speaker"), F.lit(">"), safe).alias("cue"))


def cue_text(cue_rows: DataFrame) -> DataFrame:
    """Each cue as its block of caption-file text, ready for an ordered text sink."""
    return cue_rows.select(REC, "cue_no", F.concat_ws("\n", F.col("cue_no").cast("string"), F.concat_ws(
        " --> ", T.vtt_clock(F.col("start_sec")), T.vtt_clock(F.col("end_sec"))), "cue", F.lit("")).alias("value"))


def windows(turns: DataFrame) -> DataFrame:
    """Single turns and adjacent pairs, so a quote across a turn boundary has a home."""
    seen = in_order(turns, [REC], ["seq"], leads={"_text": "text", "_speaker": "speaker"})
    base = [REC, "seq", "sec"]
    single = seen.select(*base, F.lit(1).alias("span"), F.col("speaker").alias("label"), "text")
    pair = seen.filter(F.col("_text").isNotNull()).select(
        *base, F.lit(2).alias("span"), F.concat_ws(" -> ", "speaker", "_speaker").alias("label"),
        F.concat_ws(" ", "text", "_text").alias("text"))
    return single.unionByName(pair)


# --- chapters and stamps --------------------------------------------------------
def chapters(files: DataFrame) -> DataFrame:
    """Absolute start and end of every recording chapter: running sum of the ones before."""
    seen = in_order(files, ["event_slug"], ["chapter"], running={"start_abs": "duration_sec"})
    return seen.withColumn("end_abs", F.col("start_abs") + F.col("duration_sec"))


def boundary_seconds(chapter_rows: DataFrame) -> DataFrame:
    """Every chapter start, and the end of each recording."""
    start = chapter_rows.select("event_slug", F.bround("start_abs").cast("bigint").alias("sec"))
    end = chapter_rows.groupBy("event_slug").agg(F.bround(F.max("end_abs")).cast("bigint").alias("sec"))
    return start.union(end).distinct()


def segment_seconds(lines: DataFrame, key: str = REC) -> DataFrame:
    """Both ends of every '(MM:SS-MM:SS)' header."""
    pair = lambda i: F.regexp_extract_all("line", F.lit(fixed.SEGMENT_BOUNDS), F.lit(i))
    return lines.select(key, F.explode(F.concat(pair(1), pair(2))).alias("_t")).select(
        key, T.seconds_of(F.col("_t")).cast("bigint").alias("sec")).distinct()


def valid_stamps(*tables: DataFrame) -> DataFrame:
    """Every citable second, once per key (first column is the key)."""
    out = tables[0].select(tables[0].columns[0], F.col("sec").cast("bigint").alias("sec"))
    for t in tables[1:]:
        out = out.union(t.select(t.columns[0], F.col("sec").cast("bigint").alias("sec")))
    return out.distinct()


def snapped(requests: DataFrame, stamps: DataFrame, at: str = "sec", drift: int = fixed.SNAP_DRIFT) -> DataFrame:
    """Nearest valid stamp within ``drift`` seconds (ties to the earlier one), else NULL.

    Stamps are folded into one short array per bucket of ``drift`` seconds, so a
    request reads three arrays: linear in requests and without an ordering.
    """
    bucket = lambda c: F.floor(c / drift)
    packed = stamps.select("event_slug", "sec").distinct().groupBy("event_slug", bucket(F.col("sec")).alias("_b")).agg(
        F.collect_list("sec").alias("_s"))
    asked = requests.select("event_slug", F.col(at).alias("_at")).filter(F.col("_at").isNotNull()).distinct()
    near = asked.withColumn("_b", F.explode(F.sequence(bucket(F.col("_at")) - 1, bucket(F.col("_at")) + 1)))
    near = near.join(packed, ["event_slug", "_b"])
    best = F.array_min(F.transform("_s", lambda s: F.struct(F.abs(s - F.col("_at")).alias("d"), s.alias("s"))))
    best = near.groupBy("event_slug", "_at").agg(F.min(best).alias("m")).filter(F.col("m.d") <= drift)
    return requests.withColumn("_at", F.col(at)).join(
        best.select("event_slug", "_at", F.col("m.s").alias("snapped"), F.col("m.d").alias("drift")), ["event_slug", "_at"], "left").drop("_at")


def in_chapter(requests: DataFrame, chapter_rows: DataFrame, at: str = "sec", width: int = 600) -> DataFrame:
    """Range join second -> chapter, the last chapter for anything outside.

    Chapters are spread over the buckets they touch, which turns the range
    into an equi-join on (event, bucket).
    """
    spread = chapter_rows.withColumn("_b", F.explode(F.sequence(
        F.floor(F.col("start_abs") / width), F.floor(F.col("end_abs") / width)))).select(
            "event_slug", "_b", "chapter", "start_abs", "end_abs")
    last = chapter_rows.groupBy("event_slug").agg(F.max_by(F.struct("chapter", "start_abs", "end_abs"), "chapter").alias("_last"))
    asked = requests.select("event_slug", F.col(at).alias("_at")).distinct()
    hit = asked.withColumn("_b", F.floor(F.col("_at") / width)).join(spread, ["event_slug", "_b"]).filter(
        (F.col("start_abs") <= F.col("_at")) & (F.col("_at") < F.col("end_abs"))).groupBy("event_slug", "_at").agg(
            F.min_by(F.struct("chapter", "start_abs", "end_abs"), "chapter").alias("_hit"))
    j = attach(requests.withColumn("_at", F.col(at)).join(hit, ["event_slug", "_at"], "left"), last, ["event_slug"])
    pick = F.coalesce("_hit", "_last")
    return j.withColumns({"chapter": pick["chapter"], "chapter_start": pick["start_abs"], "chapter_end": pick["end_abs"]}).drop(
        "_at", "_hit", "_last")


def true_speaker(cited: DataFrame, turns: DataFrame, key: str = REC) -> DataFrame:
    """Speaker at the exact second wins over the claimed one; differences are marked."""
    at = turns.groupBy(key, "sec").agg(F.max_by("speaker", "seq").alias("_actual"))
    j = cited.join(at, [key, "sec"], "left")
    wrong = F.col("_actual").isNotNull() & (F.coalesce("claimed", F.lit("")) != "") & (F.lower("_actual") != F.lower("claimed"))
    return j.withColumns({"speaker": F.coalesce("_actual", "claimed", F.lit("")), "corrected": wrong}).drop("_actual")


# --- clips --------------------------------------------------------------------------
def clip_ends(moments: DataFrame, stamps: DataFrame, width: int = 60) -> DataFrame:
    """End of a clip: a valid stamp 30-60 s after its start inside the chapter.

    The proposal if it qualifies, else the qualifying stamp closest to it, else
    the later stamp closest to 45 s.  A chapter bounds the search, so each
    distinct request reads the buckets up to its chapter's end.
    """
    ask = ["event_slug", "start", "proposed", "upper"]
    lo, hi = F.col("start") + fixed.CLIP_MIN, F.least(F.col("start") + fixed.CLIP_MAX, F.col("upper"))
    asked = moments.select(*ask).distinct().filter(F.col("upper") > F.col("start"))
    packed = stamps.select("event_slug", "sec").distinct().groupBy("event_slug", F.floor(F.col("sec") / width).alias("_b")).agg(
        F.collect_list("sec").alias("_s"))
    near = asked.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("upper") / width))))
    near = near.join(packed, ["event_slug", "_b"])
    aim, middle = F.coalesce("proposed", F.col("start") + 45), F.col("start") + 45
    ahead = F.filter("_s", lambda s: (s > F.col("start")) & (s <= F.col("upper")))
    ranked = F.array_min(F.transform(ahead, lambda s: F.struct(
        F.when(s.between(lo, hi), 0).otherwise(1).alias("rule"),
        F.when(s.between(lo, hi), F.abs(s - aim)).otherwise(F.abs(s - middle)).alias("d"), s.alias("s"))))
    best = near.groupBy(*ask).agg(F.min(ranked).alias("m"))
    same = [moments[c].eqNullSafe(best[c]) for c in ask]
    return moments.join(best, same, "left").select(moments["*"], F.col("m.s").alias("end"))


def clip_windows(wanted: DataFrame, turns: DataFrame) -> DataFrame:
    """Snap a requested start to the nearest turn start and close on a turn end 30-60 s on.

    The first turn, in start order, that ends late enough is always one whose end
    exceeds every earlier end, so the search runs on those record ends only.
    ``wanted``: (recording_id, want_start, length); ``turns``: start_sec, end_sec, seq.
    """
    starts = turns.select(REC, "start_sec").distinct()
    near = around(wanted, starts, [REC], "want_start", "start_sec")
    before, after, want = F.col("at_or_before"), F.col("at_or_after"), F.col("want_start")
    nearest = F.when(before.isNull(), after).when(after.isNull(), before).when(want - before <= after - want, before).otherwise(after)
    near = near.withColumn("_start", nearest).withColumn("_need", F.col("_start") + fixed.CLIP_MIN).drop("at_or_before", "at_or_after")
    seen = in_order(turns.select(REC, "start_sec", "seq", "end_sec"), [REC], ["start_sec", "seq"], highest={"_top": "end_sec"})
    records = seen.filter(F.col("_top").isNull() | (F.col("end_sec") > F.col("_top"))).select(REC, "end_sec")
    close = around(near, records, [REC], "_need", "end_sec")
    last = turns.groupBy(REC).agg(F.max_by("end_sec", F.struct("start_sec", "seq")).alias("_last"))
    close = close.join(last, REC, "left")
    end = F.least(F.coalesce("at_or_after", "_last"), F.col("_start") + fixed.CLIP_MAX)
    short = end - F.col("_start") < fixed.CLIP_MIN
    stretched = F.least(F.col("_start") + fixed.CLIP_MIN + 5, F.col("length"))
    start = F.when(short, F.greatest(F.lit(0.0), F.least(F.col("_start"), stretched - fixed.CLIP_MIN))).otherwise(F.col("_start"))
    final = F.least(F.when(short, stretched).otherwise(end), F.col("length"))
    return close.select(*wanted.columns, F.bround(start, 2).alias("clip_start"), F.bround(final, 2).alias("clip_end"))


def caption_lines(turns: DataFrame) -> DataFrame:
    """Wrapped lines of every turn, each holding the share of time its characters take."""
    rows = turns.select(REC, "seq", "start_sec", "end_sec", F.explode(caption_layout("text")).alias("l")).select(
        REC, "seq", "start_sec", "end_sec", "l.*")
    span = F.greatest(F.lit(0.4), F.col("end_sec") - F.col("start_sec"))
    at = lambda n: F.col("start_sec") + span * n / F.col("total")
    return rows.withColumns({"line_start": at(F.col("before")), "line_end": at(F.col("before") + F.length("line"))}).drop("before", "total")


def captions(lines: DataFrame, clips: DataFrame, width: int = 30) -> DataFrame:
    """Interval-overlap join of caption lines and clip windows, relative to the clip.

    Both sides are spread over time buckets for an equi-join; a pair is kept only
    in the first bucket both touch, so it appears once.
    """
    b = lambda c: F.floor(c / width)
    left = lines.withColumn("_lo", b(F.col("line_start"))).withColumn("_b", F.explode(F.sequence(F.col("_lo"), b(F.col("line_end")))))
    right = clips.withColumn("_clo", b(F.col("clip_start"))).withColumn("_b", F.explode(F.sequence(F.col("_clo"), b(F.col("clip_end")))))
    from_, to = F.greatest("line_start", "clip_start"), F.least("line_end", "clip_end")
    j = left.join(right, [REC, "_b"]).filter(
        (F.col("_b") == F.greatest("_lo", "_clo")) & (F.col("end_sec") > F.col("clip_start")) & (F.col("start_sec") < F.col("clip_end"))
        & (to - from_ >= fixed.CAPTION_VISIBLE))
    return j.select(REC, "clip_id", "seq", "line_no", F.bround(from_ - F.col("clip_start"), 3).alias("from_sec"),
                    F.bround(to - F.col("clip_start"), 3).alias("to_sec"), F.col("line").alias("text"))


def caption_text(rows: DataFrame) -> DataFrame:
    """Caption lines of a clip as subtitle blocks, numbered in order."""
    placed = in_order(rows, [REC, "clip_id"], ["from_sec", "seq", "line_no"], position="_pos")
    return placed.select(REC, "clip_id", (F.col("_pos") + 1).alias("block_no"), F.concat_ws(
        "\n", (F.col("_pos") + 1).cast("string"), F.concat_ws(" --> ", T.srt_clock(F.col("from_sec")), T.srt_clock(F.col("to_sec"))),
        "text", F.lit("")).alias("value"))


def work_windows(files: DataFrame, size: float) -> DataFrame:
    """Fixed-length work windows over each duration; the last one is short."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("duration_sec") / size).cast("int") - 1, F.lit(0)))
    out = files.filter("duration_sec > 0").withColumn("_i", F.explode(starts))
    return out.withColumns({"from_sec": F.round(F.col("_i") * size, 2), "to_sec": F.round(F.least((F.col("_i") + 1) * size, F.col("duration_sec")), 2)}).drop("_i")


def best_moments(moments: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` most clip-worthy moments per event."""
    return top_k(moments, ["event_slug"], [F.desc("worth"), F.asc("moment_id")], k)
