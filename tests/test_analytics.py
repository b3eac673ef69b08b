from datetime import datetime, timedelta

from pyspark.sql import functions as F

from turnout.operators import engagement as E, movement as M, reports as P

NOW = datetime(2026, 9, 12, 12, 0, 0)


def contacts(spark, rows):
    """(email, company, stage, attendance, opens, clicks, pageviews, form_fills)"""
    base = spark.createDataFrame([("e", *r) for r in rows], "event_slug string, email string, company string, lifecyclestage string, attendance_status string, "
                                 "opens long, clicks long, pageviews long, form_fills long")
    totals = base.select("event_slug", "email", "opens", "clicks", "pageviews", "form_fills", F.lit(None).cast("timestamp").alias("last_engaged"))
    return E.contact_metrics(base.drop("opens", "clicks", "pageviews", "form_fills").withColumns({"firstname": F.lit(""), "lastname": F.lit("")}), totals)


def c(email, company="", stage="lead", attendance="attended", opens=0, clicks=0, pageviews=0, form_fills=0):
    return (email, company, stage, attendance, opens, clicks, pageviews, form_fills)


def log(spark, rows):
    return spark.createDataFrame([("e", i, *r) for i, r in enumerate(rows)], "event_slug string, row_idx long, email string, stage string, ts timestamp, source string")


def mover(spark):
    at = lambda **k: NOW - timedelta(**k)
    return log(spark, [("m@x.com", "lead", at(days=1), "seeded"), ("m@x.com", "marketingqualifiedlead", at(days=7), "crm_history"),
                       ("m@x.com", "salesqualifiedlead", at(days=7, seconds=1), "seeded"), ("m@x.com", "opportunity", at(days=14), "seeded"),
                       ("m@x.com", "customer", at(days=30, seconds=1), "seeded")])


def test_windows_are_closed_at_both_ends_and_nested(spark):
    now = spark.createDataFrame([("e", NOW)], "event_slug string, as_of timestamp")
    got = {x.days: (x.transitions, x.contacts) for x in M.windows(mover(spark), now).collect()}
    assert got == {7: (2, 1), 14: (4, 1), 30: (4, 1)}
    parts = {(x.days, x.kind, x.value): x.n for x in M.breakdown(mover(spark), now).collect()}
    assert parts[(7, "stage", "marketingqualifiedlead")] == 1 and (30, "stage", "customer") not in parts
    assert parts[(30, "source", "seeded")] == 3 and parts[(30, "source", "crm_history")] == 1


def test_empty_log_gives_zero_rows_not_none(spark):
    now = spark.createDataFrame([("e", NOW)], "event_slug string, as_of timestamp")
    got = M.windows(log(spark, []), now).collect()
    assert sorted((x.days, x.transitions) for x in got) == [(7, 0), (14, 0), (30, 0)]


def test_disclosure_names_seeded_and_bunched(spark):
    now = spark.createDataFrame([("e", NOW)], "event_slug string, as_of timestamp")
    day = [(f"p{i}@x.com", "lead", NOW - timedelta(hours=1 + i / 10), "seeded") for i in range(4)] + [("q@x.com", "lead", NOW - timedelta(days=2), "crm_history")]
    row = M.disclosure(log(spark, day), now, (7,)).first()
    assert row.bunched and "4 of 5 moves stem from seeding" in row.disclosure and "4 of 5 fall on" in row.disclosure


def test_committee_needs_two_engaged_and_no_freemail(spark):
    m = contacts(spark, [c("a@committee.com", "Committee Co", clicks=2), c("b@committee.com", "Committee Co", form_fills=1),
                         c("c@single.com", "Single Co", clicks=3), c("d@single.com", "Single Co"), c("e@gmail.com", clicks=9)])
    acc = E.accounts(m)
    assert [x.company for x in E.committees(acc).collect()] == ["Committee Co"]
    single = acc.filter("domain = 'single.com'").first()
    assert (single.engaged_contacts, single.known_contacts, single.coverage_pct) == (1, 2, 50.0)
    assert acc.filter("domain = 'gmail.com'").count() == 0


def test_rate_counts_attendees_only(spark):
    m = contacts(spark, [c("1@x.com", stage="marketingqualifiedlead"), c("2@x.com", stage="salesqualifiedlead"), c("3@x.com"),
                         c("4@x.com", stage="subscriber"), c("5@y.com", stage="opportunity", attendance="no_show")])
    f = E.funnel(m).first()
    assert (f.attendees, f.mqls, f.sqls, f.mql_rate) == (4, 2, 1, 0.5)


def test_without_attendees_everyone_counts(spark):
    m = contacts(spark, [c("1@x.com", stage="opportunity", attendance=""), c("2@x.com", attendance="no_show")])
    f = E.funnel(m).first()
    assert (f.attendees, f.mqls, f.mql_rate) == (2, 1, 0.5)


def test_fence_moves_with_the_data_and_stalled_rows_are_twins(spark):
    m = contacts(spark, [c(f"q{i}@x.com", opens=1) for i in range(20)] + [c("loud@x.com", opens=20, clicks=20, form_fills=5), c("stalled@x.com", clicks=12, form_fills=4)])
    moved = spark.createDataFrame([("e", "loud@x.com")], "event_slug string, email string")
    got = {(x.email, x.metric) for x in E.anomalies(m, moved).collect()}
    assert got == {("loud@x.com", "engagement_interactions"), ("stalled@x.com", "engagement_interactions"), ("stalled@x.com", "stalled_high_engagement")}
    few = contacts(spark, [c("a@x.com", opens=9), c("b@x.com", opens=4)])
    assert E.fence(few).first().threshold == 5


def test_anomaly_rows_are_capped_after_twins(spark):
    m = contacts(spark, [c(f"q{i:03d}@x.com", opens=1) for i in range(100)] + [c(f"z{i:02d}@x.com", opens=100 + i) for i in range(20)])
    none = spark.createDataFrame([], "event_slug string, email string")
    got = E.anomalies(m, none).orderBy("rank").collect()
    assert len(got) == 12 and len({x.email for x in got}) == 6 and got[0].email == "z19@x.com"


def test_validator_records_and_never_overwrites(spark):
    s = "event_slug string, field string, value string"
    computed = spark.createDataFrame([("e", "movement_7", "2"), ("e", "top", "a|b"), ("e", "quiet", "1")], s)
    said = spark.createDataFrame([("e", "movement_7", "99"), ("e", "top", "a|b")], s)
    got = {x.field: (x.computed, x.answered, x.verdict) for x in P.compared(computed, said).collect()}
    assert got == {"movement_7": ("2", "99", "disagree"), "top": ("a|b", "a|b", "agree"), "quiet": ("1", "", "silent")}


def test_summary_never_invents_zero(spark):
    s = "event_slug string, measure string, n long"
    got = {x.measure: (x.n, x.origin) for x in P.summary(spark.createDataFrame([("e", "a", 5), ("e", "b", None), ("e", "c", None)], s),
                                                         spark.createDataFrame([("e", "a", 9), ("e", "b", 7)], s)).collect()}
    assert got == {"a": (5, "receipt"), "b": (7, "rows"), "c": (None, "unknown")}
