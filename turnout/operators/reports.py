"""Run reports: validator, KPI row, dashboard rows, call logs and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

EV = "event_slug"


def compared(computed: DataFrame, answered: DataFrame) -> DataFrame:
    """Field by field: 'agree', 'disagree' or 'silent' (the model said nothing).

    Both sides are long tables (event_slug, field, value); a computed number is
    never replaced.
    """
    j = computed.select(EV, "field", F.col("value").alias("computed")).join(
        answered.select(EV, "field", F.col("value").alias("answered")), [EV, "field"], "full_outer")
    verdict = F.when(F.col("answered").isNull(), "silent").when(F.col("computed").eqNullSafe(F.col("answered")), "agree").otherwise("disagree")
    return j.select(EV, "field", F.coalesce("computed", F.lit("")).alias("computed"),
                    F.coalesce("answered", F.lit("")).alias("answered"), verdict.alias("verdict"))


def ungrounded(scored: DataFrame, known: DataFrame) -> DataFrame:
    """Model-scored contacts nobody has heard of."""
    ids = scored.select(EV, F.lower(F.trim("email")).alias("email")).filter("email <> ''").distinct()
    return ids.join(known.select(EV, "email").distinct(), [EV, "email"], "left_anti")


def ranked_text(ranked: DataFrame, column: str, field: str, k: int = 5) -> DataFrame:
    """The first ``k`` values of a ranked report as one comparable string."""
    few = ranked.filter(F.col("rank") <= k)
    return few.groupBy(EV).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(column).alias("_v")))),
                                                        lambda s: s["_v"]), "|").alias("value")).withColumn("field", F.lit(field))


def kpis(funnel: DataFrame, accounts: DataFrame, committees: DataFrame, anomalies: DataFrame, mails: DataFrame,
         movement: DataFrame) -> DataFrame:
    """The KPI row of each event, from one-row-per-event aggregates."""
    def n(df, name):
        return df.groupBy(EV).agg(F.count(F.lit(1)).alias(name))
    j = funnel
    for part in (n(accounts, "companies"), n(committees, "committees"), n(anomalies, "anomalies"), n(mails, "email_engagements"),
                 movement.filter("days = 30").select(EV, F.col("transitions").alias("movement_30d"))):
        j = j.join(part, EV, "left")
    return j.fillna(0, ["companies", "committees", "anomalies", "email_engagements", "movement_30d"]).withColumn(
        "mql_rate_pct", F.bround(F.col("mql_rate") * 100, 1))


def dashboard_contacts(top: DataFrame, interest: DataFrame, answers: DataFrame) -> DataFrame:
    """Ranked contacts with the rule score and the model's score and reason beside it."""
    return top.join(interest.select(EV, "email", F.col("interest").alias("rules_score")), [EV, "email"], "left").join(
        answers.select(EV, F.lower(F.trim("email")).alias("email"), "model_score", "model_reason"), [EV, "email"], "left")


def dashboard_committees(committees: DataFrame, answers: DataFrame) -> DataFrame:
    """The model's reason where it gave one, the rule's otherwise, and which it is."""
    j = committees.join(answers.select(EV, F.trim("company").alias("company"), "model_why"), [EV, "company"], "left")
    said = F.coalesce("model_why", F.lit("")) != ""
    return j.withColumn("why_source", F.when(said, "model").otherwise("rules")).withColumn(
        "why", F.when(said, F.col("model_why")).otherwise(F.col("why"))).drop("model_why")


def call_summary(log: DataFrame) -> DataFrame:
    """Attempts, completions, failures and time per event, purpose and model."""
    return log.groupBy(EV, "purpose", "model").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if("ok").alias("completed"), F.count_if(~F.col("ok")).alias("failed"),
        F.sum("seconds").cast("bigint").alias("seconds"), F.max("seconds").alias("slowest"))


def lanes(batches: DataFrame) -> DataFrame:
    """'degraded' when batches ran but nothing landed or every batch failed to parse, or none is known."""
    ran, bad = F.col("batches"), F.col("parse_failures")
    dead = ran.isNull() | ((ran > 0) & ((F.col("rows_patched") == 0) | (bad >= ran)))
    return batches.withColumn("lane", F.when(dead, "degraded").otherwise("live"))


def summary(receipts: DataFrame, counted: DataFrame) -> DataFrame:
    """Per measure: the receipt's own count, else the counted rows, else NULL; never 0 for missing.

    Both sides are long tables (event_slug, measure, n); ``n`` may be NULL.
    """
    j = receipts.select(EV, "measure", F.col("n").alias("_r")).join(
        counted.select(EV, "measure", F.col("n").alias("_c")), [EV, "measure"], "full_outer")
    return j.select(EV, "measure", F.coalesce("_r", "_c").alias("n"), F.when(F.col("_r").isNotNull(), "receipt").when(
        F.col("_c").isNotNull(), "rows").otherwise("unknown").alias("origin"))
