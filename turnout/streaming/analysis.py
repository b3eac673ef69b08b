"""The analysis kept up to date: every batch adds small partial aggregates, and all reports come from these.

A batch's rows are read once.  What they add to each partial is a numbered part of a log, so a replayed batch
replaces its own part; after every ``FOLD`` batches the parts are folded into one.  Partials grow with
contacts and days, not with events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnout.functions import fixed
from turnout.operators import engagement as E, movement as M
from turnout.operators.ordered import attach, top_k
from turnout.plans.analytics import analyse_from
from turnout.sources.versions import Log
from turnout.streaming.jobs import each_batch

EV = "event_slug"
FOLD = 20
#: Events kept of each contact: as many as the evidence of an anomaly shows.
SHOWN = 8


def first_events(engagement: DataFrame) -> DataFrame:
    return top_k(engagement, [EV, "email"], [F.asc("event_id")], SHOWN, "_no").drop("_no")


def newest(rows: DataFrame) -> DataFrame:
    return rows.groupBy(EV).agg(F.max("ts").alias("ts"))


def added_totals(totals: DataFrame) -> DataFrame:
    return totals.groupBy(EV, "email").agg(*[F.sum(c).alias(c) for c in E.COUNTERS], F.max("last_engaged").alias("last_engaged"))


def added_days(days: DataFrame) -> DataFrame:
    return days.groupBy(EV, "day").agg(F.sum("n").alias("n"))


def latest(stages: DataFrame) -> DataFrame:
    """Each contact's last stage; of equal moments the first row wins."""
    best = F.struct("ts", -F.col("row_idx"))
    return stages.groupBy(EV, "email").agg(F.max_by("stage", best).alias("stage"), F.max("ts").alias("ts"),
                                           F.max_by("row_idx", best).alias("row_idx"), F.sum("changes").alias("changes"))


def still_seen(changes: DataFrame) -> DataFrame:
    """Changes that a window may yet hold: an event's newest moment only moves on, and so does the longest window behind it."""
    now = newest(changes).withColumnRenamed("ts", "_now")
    return attach(changes, now, [EV], "inner").filter(
        F.col("ts") >= F.col("_now") - F.make_dt_interval(F.lit(max(fixed.MOVEMENT_DAYS)))).select(*changes.columns)


#: Partial aggregates of engagement and of changes: what a batch's rows add, and how parts are put together.
OF_ENGAGEMENT = {"totals": (E.counters, added_totals), "newest": (newest, newest), "first": (first_events, first_events)}
OF_CHANGES = {
    "days": (M.timeline, added_days), "newest_change": (newest, newest), "recent": (still_seen, still_seen),
    "stages": (lambda log: latest(log.withColumn("changes", F.lit(1).cast("bigint"))), latest),
}


class Analysis:
    """Partials under ``path`` and the reports that they give."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def log(self, name: str) -> Log:
        return Log(self.spark, f"{self.path}/{name}")

    def add(self, batch: DataFrame, number: int, partials: dict) -> None:
        """What one batch adds, and after some batches one part in place of many."""
        batch = batch.persist()
        for name, (of_rows, put_together) in partials.items():
            log = self.log(name)
            log.append(number, of_rows(batch))
            if number % FOLD == FOLD - 1:
                log.fold(number, put_together(log.read()))
        batch.unpersist()

    def refresh(self, engagement: DataFrame, lifecycle: DataFrame) -> None:
        """Read what is new in both streams."""
        each_batch(engagement, lambda batch, n: self.add(batch, n, OF_ENGAGEMENT), state=f"{self.path}/engagement-state")
        each_batch(lifecycle, lambda batch, n: self.add(M.changes(batch), n, OF_CHANGES), state=f"{self.path}/changes-state")

    def held(self, name: str, partials: dict) -> DataFrame:
        return partials[name][1](self.log(name).read())

    def reports(self, contacts: DataFrame, mails: DataFrame) -> dict[str, DataFrame]:
        """Every report of ``plans.analytics.analyse`` over all rows so far; both streams must have had a batch."""
        totals, first = (self.held(n, OF_ENGAGEMENT) for n in ("totals", "first"))
        days, recent, stages = (self.held(n, OF_CHANGES) for n in ("days", "recent", "stages"))
        moments = [self.held("newest", OF_ENGAGEMENT), self.held("newest_change", OF_CHANGES), mails.select(EV, "ts")]
        return analyse_from(contacts, totals, recent, stages, days, first, M.as_of(*moments), mails)
