"""The analytics run: snapshot, events and change log in, report tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from turnout.operators import engagement as E, movement as M, reports as P
from turnout.session import settled

EV = "event_slug"


def analyse(contacts: DataFrame, engagement: DataFrame, lifecycle: DataFrame, mails: DataFrame) -> dict[str, DataFrame]:
    """Every deterministic report of an event.

    ``contacts``: event_slug, email, firstname, lastname, company, lifecyclestage,
    attendance_status.  One materialised metrics table feeds all reports.
    """
    log = settled(M.changes(lifecycle))
    return analyse_from(contacts, E.counters(engagement), log, log, M.timeline(log), engagement, M.as_of(log, engagement, mails), mails)


def analyse_from(contacts: DataFrame, totals: DataFrame, recent: DataFrame, moved: DataFrame, timeline: DataFrame, first: DataFrame,
                 now: DataFrame, mails: DataFrame) -> dict[str, DataFrame]:
    """The reports from what can be kept up to date: counters per contact (``totals``), the changes of the longest
    window (``recent``), contacts with any change (``moved``), changes by day, each contact's ``first`` events and the
    newest moment of each event (``now``)."""
    metrics = settled(E.contact_metrics(contacts, totals))
    accounts = settled(E.accounts(metrics))
    committees, anomalies = E.committees(accounts), settled(E.anomalies(metrics, moved))
    funnel, windows = E.funnel(metrics), M.windows(recent, now)
    return {
        "metrics": metrics, "accounts": accounts, "top_accounts": E.top_accounts(accounts), "committees": committees,
        "account_contacts": E.account_contacts(metrics), "top_contacts": E.top_contacts(metrics),
        "interest": E.interest_scores(metrics), "fence": E.fence(metrics), "anomalies": anomalies,
        "evidence": E.evidence(anomalies, first), "funnel": funnel, "funnel_steps": E.funnel_steps(funnel),
        "movement": windows, "breakdown": M.breakdown(recent, now), "disclosure": M.disclosure(recent, now), "timeline": timeline,
        "kpis": P.kpis(funnel, accounts, committees, anomalies, mails, windows),
    }


def comparable(reports: dict[str, DataFrame]) -> DataFrame:
    """The computed values a model's answer is graded against, as (event_slug, field, value)."""
    def joined(df, column, field):
        return df.groupBy(EV).agg(F.array_join(F.array_sort(F.collect_set(column)), "|").alias("value")).withColumn("field", F.lit(field))
    moves = reports["movement"].select(EV, F.col("transitions").cast("string").alias("value"),
                                       F.concat(F.lit("movement_"), F.col("days").cast("string"), F.lit("d")).alias("field"))
    return (P.ranked_text(reports["top_contacts"], "email", "top_contacts_top5")
            .unionByName(P.ranked_text(reports["top_accounts"], "company", "top_accounts_top5"))
            .unionByName(joined(reports["committees"], "company", "committee_companies"))  # at most ten per event
            .unionByName(joined(reports["anomalies"], "email", "anomaly_contacts"))  # at most twelve
            .unionByName(moves))
