"""Lifecycle change log: final stage, history, trailing windows, disclosure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from turnout.functions import contact as C, fixed
from turnout.operators.ordered import attach, in_order


def changes(lifecycle: DataFrame) -> DataFrame:
    """Usable change rows: known contact, moment and (normalised) stage."""
    rows = lifecycle.select("event_slug", "row_idx", C.email_key(F.col("email")).alias("email"),
                            C.stage_name(F.col("raw_stage")).alias("stage"), "ts", "source")
    return rows.filter((F.col("email") != "") & F.col("ts").isNotNull() & (F.col("stage") != ""))


def final_stages(log: DataFrame) -> DataFrame:
    """Latest stage per contact; of equal moments the first row wins."""
    best = F.struct("ts", (-F.col("row_idx")).alias("o"))
    return log.groupBy("event_slug", "email").agg(
        F.max_by("stage", best).alias("stage"), F.max("ts").alias("ts"), F.count(F.lit(1)).alias("changes"))


def history(log: DataFrame) -> DataFrame:
    """Ordered history in long form: one row per change with its position."""
    return in_order(log, ["event_slug", "email"], ["ts", "row_idx"], position="step")


def seed_labelled(log: DataFrame, runs: DataFrame) -> DataFrame:
    """Changes at or after a run's start were written by it, earlier ones are the CRM's own."""
    joined = attach(log.drop("source"), runs.select("event_slug", "seed_started"), ["event_slug"])
    own = F.col("seed_started").isNotNull() & (F.col("ts") >= F.col("seed_started"))
    return joined.withColumn("source", F.when(own, "seeded").otherwise("crm_history")).drop("seed_started")


def as_of(*stamped: DataFrame) -> DataFrame:
    """Newest moment per event over any number of (event_slug, ts) tables."""
    parts = [t.select("event_slug", "ts").groupBy("event_slug").agg(F.max("ts").alias("ts")) for t in stamped]
    both = reduce(DataFrame.unionByName, parts)
    return both.groupBy("event_slug").agg(F.max("ts").alias("as_of"))


def _in_windows(log: DataFrame, now: DataFrame, days) -> DataFrame:
    """Each change once per trailing window it falls into (closed at both ends)."""
    dated = attach(log, now, ["event_slug"], "inner")
    recent = dated.filter((F.col("ts") <= F.col("as_of"))
                          & (F.col("ts") >= F.col("as_of") - F.make_dt_interval(F.lit(max(days)))))
    rows = recent.withColumn("days", F.explode(F.array(*[F.lit(d) for d in days])))
    return rows.filter(F.col("ts") >= F.col("as_of") - F.make_dt_interval(F.col("days")))


def windows(log: DataFrame, now: DataFrame, days=fixed.MOVEMENT_DAYS) -> DataFrame:
    """Transitions and distinct contacts per event and window; empty windows are zero rows."""
    hits = _in_windows(log, now, days).groupBy("event_slug", "days", "email").agg(F.count(F.lit(1)).alias("n"))
    sums = hits.groupBy("event_slug", "days").agg(F.sum("n").alias("transitions"), F.count(F.lit(1)).alias("contacts"))
    frame = now.withColumn("days", F.explode(F.array(*[F.lit(d) for d in days])))
    zero = F.lit(0).cast("bigint")
    return frame.join(sums, ["event_slug", "days"], "left").select(
        "event_slug", "days", F.coalesce("transitions", zero).alias("transitions"),
        F.coalesce("contacts", zero).alias("contacts"),
        (F.col("as_of") - F.make_dt_interval(F.col("days"))).alias("window_start"), F.col("as_of").alias("window_end"))


def breakdown(log: DataFrame, now: DataFrame, days=fixed.MOVEMENT_DAYS) -> DataFrame:
    """By stage, by source and by date inside every window, in one grouping-sets pass."""
    rows = _in_windows(log, now, days).select(
        "event_slug", "days", "stage", "source", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    sets = rows.groupingSets(
        [[F.col("event_slug"), F.col("days"), F.col("stage")], [F.col("event_slug"), F.col("days"), F.col("source")],
         [F.col("event_slug"), F.col("days"), F.col("day")]], "event_slug", "days", "stage", "source", "day").agg(F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("stage").isNotNull(), "stage").when(F.col("source").isNotNull(), "source").otherwise("day")
    return sets.select("event_slug", "days", kind.alias("kind"), F.coalesce("stage", "source", "day").alias("value"), "n")


def disclosure(log: DataFrame, now: DataFrame, days=fixed.MOVEMENT_DAYS) -> DataFrame:
    """What a reader must know about a window: seeded share, and bunching on one day."""
    daily = _in_windows(log, now, days).groupBy("event_slug", "days", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("source") == "seeded").alias("s"), F.min("ts").alias("_at"))
    facts = daily.groupBy("event_slug", "days").agg(
        F.sum("n").alias("total"), F.sum("s").alias("seeded"), F.count(F.lit(1)).alias("dates"),
        F.max_by("day", F.struct(F.col("n"), (-F.unix_micros(F.col("_at").cast("timestamp"))).alias("o"))).alias("peak_day"),
        F.max("n").alias("peak"))
    bunched = (F.col("peak") > F.col("total") / 2) & (F.col("dates") <= 2)
    text = F.concat_ws(
        "; ",
        F.when(F.col("seeded") > 0, F.format_string("%d of %d moves stem from seeding", "seeded", "total")),
        F.when((F.col("seeded") > 0) & (F.col("total") > F.col("seeded")),
               F.format_string("%d are recorded by the CRM", F.col("total") - F.col("seeded"))),
        F.when(bunched, F.format_string("%d of %d fall on %s", "peak", "total", F.col("peak_day").cast("string"))))
    plain = F.format_string("all %d moves are recorded by the CRM", "total")
    return facts.select("event_slug", "days", "total", "seeded", "dates", F.col("peak_day").cast("string").alias("peak_day"), "peak",
                        bunched.alias("bunched"), F.when(text == "", plain).otherwise(text).alias("disclosure"))


def timeline(log: DataFrame) -> DataFrame:
    return log.groupBy("event_slug", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
