"""Event streams: ingest, live counters, windows, sessions, vendor callbacks, dispatch log.

Every function takes and returns streaming DataFrames; ``settle`` runs one to
the end of its input into a table, which is also how a scheduled refresh works
(``availableNow``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from turnout.functions import contact as C, fixed
from turnout.operators import engagement as E
from turnout.session import file_system, folders, scratch, settled
from turnout.streaming import release

EV = "event_slug"
BASE_EVERY = 20
LOG_BUCKETS = 64


# --- sources and runs -----------------------------------------------------------------
def file_stream(spark: SparkSession, folder: str, schema: StructType, fmt: str = "parquet", glob: str | None = None, **options) -> DataFrame:
    """New files of a folder as they land."""
    reader = spark.readStream.schema(schema).format(fmt).options(**options)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)


def settle(stream: DataFrame, mode: str = "append", path: str | None = None) -> DataFrame:
    """Process everything available into Parquet and read it back (append output only)."""
    spark = stream.sparkSession
    path = path or scratch(spark, "stream")
    (stream.writeStream.outputMode(mode).format("parquet").option("path", path)
        .option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(path)


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], mode: str = "append", state: str | None = None) -> None:
    """Run ``write`` on every micro-batch until the input is used up."""
    state = state or scratch(stream.sparkSession, "state")
    (stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", state)
        .trigger(availableNow=True).start().awaitTermination())


def newest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame | None:
    """The newest row per key with its ``_batch``: the last base and the batches since."""
    bases = folders(spark, path, "base")
    since = [n for n in folders(spark, path, "batch") if not bases or n > bases[-1]]
    parts = [f"{path}/base={n}" for n in bases[-1:]] + [f"{path}/batch={n}" for n in since]
    if not parts:
        return None
    rows = spark.read.parquet(*parts)
    values = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_v")).select(*keys, "_v.*")


def upsert(stream: DataFrame, keys: list[str], path: str | None = None, mode: str = "update") -> DataFrame:
    """Keep the newest row per key.

    A batch writes its own folder, so a replayed batch overwrites itself and
    totals are set, never added up twice.  After every ``BASE_EVERY`` batches
    what they hold is folded into a base, and folders that it covers go.
    """
    spark = stream.sparkSession
    path = path or scratch(spark, "upsert")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if number % BASE_EVERY == BASE_EVERY - 1:
            spark = batch.sparkSession
            newest(spark, path, keys).write.mode("overwrite").parquet(f"{path}/base={number}")
            old = [f"{path}/batch={n}" for n in folders(spark, path, "batch") if n <= number]
            for folder in old + [f"{path}/base={n}" for n in folders(spark, path, "base") if n < number]:
                fs, there = file_system(spark, folder)
                fs.delete(there, True)
    each_batch(stream, write, mode)
    kept = newest(spark, path, keys)
    return spark.createDataFrame([], stream.schema) if kept is None else kept.drop("_batch")


def with_open(closed: DataFrame, all_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Closed windows, and as ``provisional`` those that the watermark has not passed yet.

    ``all_rows`` is the same aggregate over the rows read so far.  It is written
    first: joined on their start while they are still being merged, sessions
    come out in pieces.
    """
    still = settled(all_rows).join(closed.select(*keys), keys, "left_anti")
    return closed.withColumn("provisional", F.lit(False)).unionByName(still.withColumn("provisional", F.lit(True)))


def refresh(stream: DataFrame, path: str, analyse: Callable[[DataFrame], dict[str, DataFrame]], reports: list[str]) -> None:
    """Bring a whole analysis up to date with all that has arrived.

    New rows are added to ``path/rows``; the named reports are then computed
    over all rows so far and replace ``path/<report>``.  A replayed batch
    overwrites itself.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        out = analyse(spark.read.schema(stream.schema).parquet(f"{path}/rows"))
        for name in reports:
            out[name].write.mode("overwrite").parquet(f"{path}/{name}")
    each_batch(stream, write, state=f"{path}/state")


# --- engagement ------------------------------------------------------------------------
def live_counters(engagement: DataFrame) -> DataFrame:
    """Counters per contact in update mode; the same aggregate as in batch."""
    return E.counters(engagement)


def daily_timeline(changes: DataFrame, late: str = "1 day") -> DataFrame:
    """Tumbling days, emitted once the watermark has passed them; later rows are dropped."""
    return changes.withWatermark("ts", late).groupBy(EV, F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(
        EV, F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n")


def trailing_movement(changes: DataFrame, days: int, late: str = "1 day") -> DataFrame:
    """Trailing window that slides by a day; the exact data-driven as-of stays with the batch job."""
    return changes.withWatermark("ts", late).groupBy(EV, F.window("ts", f"{days} days", "1 day").alias("w")).agg(
        F.count(F.lit(1)).alias("transitions")).select(EV, F.date_format("w.end", "yyyy-MM-dd").alias("until"), "transitions")


def visits(engagement: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Visits per contact: runs of events less than ``gap`` apart."""
    return engagement.withWatermark("ts", late).groupBy(EV, "email", F.session_window("ts", gap).alias("s")).agg(
        F.count(F.lit(1)).alias("events")).select(EV, "email", F.col("s.start").alias("started"), "events")


def seed_labels(changes: DataFrame, runs: DataFrame) -> DataFrame:
    """Stream-static join that labels changes written at or after a run's start."""
    joined = changes.join(runs, EV, "left")
    own = F.coalesce(F.col("ts") >= F.col("seed_started"), F.lit(False))
    return joined.withColumn("source", F.when(own, "seeded").otherwise("crm_history")).drop("seed_started")


# --- registrants ---------------------------------------------------------------------------
def ingest(drops: DataFrame, handle: Callable[[DataFrame, int], None]) -> None:
    """Hand every drop of registrants to a batch plan."""
    each_batch(drops, handle)


# --- vendor callbacks -------------------------------------------------------------------------
def assembled_answers(requests: DataFrame, answers: DataFrame, wait_minutes: int = 10) -> DataFrame:
    """Each request with its answers, or without one once the wait is over.

    An outer join of the two streams by (run, company) and time, so a run with very many requests is spread like any
    other; the watermark releases the unanswered and clears the state.  Spark's own join makes some entries of its state
    store for each row; the rows are held in cells instead (``release.Answers``).  ``requests``: run_id, company_id,
    asked_at; ``answers``: run_id, company_id, answered_at, payload.
    """
    return release.assembled(requests, answers, wait_minutes)


def newest_answer(assembled: DataFrame) -> DataFrame:
    """A vendor may answer twice; a company's latest payload stands (batch side)."""
    return assembled.groupBy("run_id", "company_id").agg(F.max_by("payload", F.struct("answered_at", "payload")).alias("payload"))


# --- dispatch -------------------------------------------------------------------------------------
def unique_sends(results: DataFrame, late: str = "7 days") -> DataFrame:
    """First result per message id within the watermark."""
    sent = results.filter((F.col("status") == "sent") & F.col("message_id").isNotNull())
    return sent.withWatermark("sent_at", late).dropDuplicatesWithinWatermark([EV, "message_id"])


def log_sends(results: DataFrame, path: str) -> None:
    """Append sends the log does not hold yet; safe to replay."""
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("bucket", F.pmod(F.xxhash64(EV, "message_id"), F.lit(LOG_BUCKETS)).cast("int"))
        fs, there = file_system(spark, path)
        if fs.exists(there):  # only the buckets of new messages are read
            held = spark.read.parquet(path).select("bucket", EV, "message_id")
            batch = batch.join(held, ["bucket", EV, "message_id"], "left_anti")
        batch.write.mode("append").partitionBy("bucket").parquet(path)
    each_batch(unique_sends(results), write)


def sla(sends: DataFrame, closes: DataFrame, hours: int = 24, late: str = "2 days") -> DataFrame:
    """Sends that left within ``hours`` of their event's close (interval join).

    Time is cut into spans of that length: a close meets the sends of its own span and of the next, so
    the join state is spread over spans and no send is held against every close of its event.
    """
    span = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / (hours * 3600))
    s = sends.withWatermark("sent_at", late).withColumn("_span", span("sent_at")).alias("s")
    c = closes.withWatermark("closed_at", late).withColumn("_span", F.explode(F.array(span("closed_at"), span("closed_at") + 1))).alias("c")
    on = F.expr(f"""s.event_slug = c.event_slug AND s._span = c._span
        AND s.sent_at >= c.closed_at AND s.sent_at <= c.closed_at + INTERVAL {hours} HOURS""")
    return s.join(c, on, "inner").select("s.event_slug", "s.row_idx", "s.email", "s.sent_at", "c.closed_at")
