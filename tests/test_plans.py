import json

from pyspark.sql import functions as F

from turnout.__main__ import main
from turnout.functions.contact import Rules
from turnout.operators import enrich as N
from turnout.plans.analytics import analyse, comparable
from turnout.plans.content import check_assets
from turnout.plans.enrichment import enrich
from turnout.plans.messages import plan_dispatch

REG = "row_idx long, event_slug string, first_name string, last_name string, email string, job_title string, company string, country string, attended string, minutes string"
CRM = "vid long, event_slug string, email string, firstname string, lastname string, jobtitle string, company string, lifecyclestage string"


def registrants(spark):
    return spark.createDataFrame([
        (0, "e", "ana", "kim", "ana.kim@acme.com", "CHRO", "ACME SYSTEMS", "India", "Yes", "40"),
        (1, "e", "ANA", "KIM", "ANA.KIM@acme.com", "", "", "India", "No", ""),
        (2, "e", "Raj", "Verma", "raj@acme.com", "", "", "IN", "No", ""),
        (3, "e", "Lee", "Mbeki", "lee@acme.com", "Analyst", "Acme Systems", "US", "Yes", "n/a"),
        (4, "e", "Test", "Fake", "x@y.com", "", "", "", "No", ""),
        (5, "e", "Mia", "Roe", "mia@gmail.com", "", "", "Brazil", "No", "")], REG)


def crm(spark):
    return spark.createDataFrame([(7, "e", "ana.kim@acme.com", "Ana", "Kim", "", "Acme Systems", "customer"),
                                  (8, "e", "other@z.com", "Zed", "Zed", "", "Z", "lead")], CRM)


def test_enrichment_end_to_end(spark):
    out = enrich(registrants(spark), crm(spark), Rules())
    rows = {x.email: x for x in out["contacts"].collect()}
    assert set(rows) == {"ana.kim@acme.com", "raj@acme.com", "lee@acme.com", "mia@gmail.com"}
    ana, raj, mia = rows["ana.kim@acme.com"], rows["raj@acme.com"], rows["mia@gmail.com"]
    assert (ana.company, ana.merge_action, ana.lifecyclestage) == ("Acme Systems", "update_existing:7", "customer")
    assert (raj.company, raj.jobtitle, raj.merge_action, raj.industry) == ("Acme Systems", "CHRO", "create_new", "IT Services")
    assert (mia.company, mia.jobtitle, mia.numemployees, mia.region, mia.company_domain) == ("Unknown", "Attendee", 10, "AMER", "")
    assert raj.confidence == 0.7 and mia.confidence == 0.55
    assert [x.reject_reason for x in out["rejected"].collect()] == ["placeholder_name"]
    assert [(x.domain, x.name) for x in out["companies"].collect()] == [("acme.com", "Acme Systems")]


def test_reviewers_can_merge_a_pair_in_the_band(spark):
    rows = spark.createDataFrame([(0, "e", "Ana", "Kim", "ana.kim@acme.com", "CFO", "Acme Systems", "", "Yes", ""),
                                  (1, "e", "Ana", "Kim", "zzzz@other.org", "", "Acme Systemz", "", "No", "")], REG)
    plain = enrich(rows, crm(spark).limit(0), Rules())
    assert plain["review"].count() == 1 and plain["contacts"].count() == 2
    yes = lambda s: s.select("event_slug", "pair_id", F.lit("merge").alias("decision"))
    assert enrich(rows, crm(spark).limit(0), Rules(), decisions=yes)["contacts"].count() == 1


def test_second_event_keeps_the_first_and_meets_known_people(spark, tmp_path):
    head = "First Name,Last Name,E-mail,Title,Organization,Country,Attended,Time in Session (minutes)\n"
    (tmp_path / "one.csv").write_text(head + "Ana,Kim,ana.kim@acme.com,CHRO,Acme Systems,India,Yes,40\nNew,Person,new.person@q.com,,,US,No,\n")
    (tmp_path / "crm.json").write_text(json.dumps([{"vid": 7, "email": "ana.kim@acme.com", "firstname": "Ana", "lastname": "Kim",
                                                    "company": "Acme Systems", "lifecyclestage": "opportunity"}]))
    out = str(tmp_path / "out")
    for event in ("first", "second"):
        main(["enrich", "--event", event, "--registrants", str(tmp_path / "one.csv"), "--crm", str(tmp_path / "crm.json"), "--out", out])
    rows = spark.read.csv(f"{out}/contacts", header=True)
    assert {(x.event_slug, x.email, x.lifecyclestage) for x in rows.collect()} == {
        (e, m, s) for e in ("first", "second") for m, s in (("ana.kim@acme.com", "opportunity"), ("new.person@q.com", "subscriber"))}
    actions = spark.read.csv(f"{out}/analyst", header=True)
    assert {x.email: x.merge_action for x in actions.collect()} == {"ana.kim@acme.com": "update_existing:7", "new.person@q.com": "create_new"}


def test_analytics_reports_reconcile(spark):
    people = spark.createDataFrame([("e", f"p{i}@acme.com", "P", str(i), "Acme", "lead", "attended") for i in range(6)],
                                   "event_slug string, email string, firstname string, lastname string, company string, lifecyclestage string, attendance_status string")
    events = spark.sql("SELECT id AS event_id, 'e' AS event_slug, 'p' || (id % 3) || '@acme.com' AS email, 'click' AS type, timestamp'2026-01-01' + make_dt_interval(0, id) AS ts, '' AS asset FROM range(30)")
    log = spark.sql("SELECT id AS row_idx, 'e' AS event_slug, 'p0@acme.com' AS email, 'lead_new' AS raw_stage, timestamp'2026-01-02' AS ts, 'seeded' AS source FROM range(2)")
    r = analyse(people, events, log, events.select("event_slug", "ts"))
    k = r["kpis"].first()
    assert (k.contacts, k.engaged_contacts, k.companies, k.committees, k.movement_30d) == (6, 3, 1, 1, 2)
    assert k.anomalies == r["anomalies"].count() and r["metrics"].agg(F.sum("score")).first()[0] == 90.0
    fields = {x.field: x.value for x in comparable(r).collect()}
    assert fields["movement_7d"] == "2" and fields["top_contacts_top5"].startswith("p0@acme.com|p1@acme.com")


def test_content_check(spark):
    lines = spark.createDataFrame([("e", 0, "## Part one (00:00-01:00)"), ("e", 1, "[00:10] **Dana Cole:** leads go cold in five minutes flat"), ("e", 2, "[01:00] **[Session ends]**")],
                                  "event_slug string, line_no long, line string")
    files = spark.createDataFrame([("e", 1, 75.0)], "event_slug string, chapter int, duration_sec double")
    text = 'As Dana put it, "leads go cold in five minutes flat" [00:10]. Ends [01:15], not [00:11].'
    assets = spark.createDataFrame([("e", "a", "blog.md", text)], "event_slug string, asset_id string, kind string, text string")
    roster = spark.createDataFrame([("e", "Dana Cole")], "event_slug string, name string")
    r = check_assets(lines, files, assets, roster)
    total = r["totals"].filter("asset_id = 'a'").first()
    assert (total.checked, total.verified, total.failed) == (4, 3, 1)
    assert r["flagged"].first().text.startswith("> 1 of 4 claims did not verify")
    assert r["spec"].first().problem.startswith("16 words")


def test_dispatch_plan(spark):
    enriched = spark.createDataFrame([("e", i, f"p{i}@x.com", f"P{i}", "K", "CFO", "Acme", "general", "tier2", "SaaS", "attended" if i < 3 else "no_show", "", "10")
                                      for i in range(5)] + [("e", 9, "s@x.com", "S", "S", "", "", "", "", "", "attended", "competitor", "")],
                                     "event_slug string, row_idx long, email string, firstname string, lastname string, jobtitle string, company string, function string, "
                                     "icp_tier string, industry string, attendance_status string, suppression_reason string, minutes string")
    events = spark.createDataFrame([("e", "AI: Live", "2026-01-01", "https://w.example/v", "https://j.example/r")],
                                   "event_slug string, event_name string, date string, recording_url string, registration_page string")
    matrix = spark.createDataFrame([("e", "general", "H", "B.")], "event_slug string, function string, headline string, body string")
    angles = spark.createDataFrame([("e", "other_commercial", "Angle.")], "event_slug string, bucket string, angle string")
    variants = spark.createDataFrame([("attendee", "A", "B", "Hi {{firstname}} {{takeaway_body}} {{cta_link}}"), ("no_show", "A", "B", "{{oops}} {{cta_link}}")],
                                     "segment string, subject_a string, subject_b string, body_md string")
    p = plan_dispatch(enriched, registrants(spark), events, matrix, angles, variants, Rules())
    got = {x.email: (x.subject, x.body_text) for x in p["recipients"].collect()}
    assert [got[f"p{i}@x.com"][0] for i in range(3)] == ["A", "B", "A"]
    assert got["p1@x.com"][1] == "Hi P1 B. Angle. https://w.example/v?utm_source=webinar&utm_medium=email&utm_campaign=ai-2026-01-01&utm_content=attendee-b"
    assert {x.leftover for x in p["unfilled"].collect()} == {"oops"} and "https://j.example/r?" in p["unfilled"].first().cta_link
    assert [x.email for x in p["suppressed"].collect()] == ["s@x.com"]


def test_rules_run_on_dealt_out_rows_and_not_in_the_scan(spark):
    """One scan task must not hold all the rules, nor a filter on their outcome."""
    rows = spark.range(40, numPartitions=1).selectExpr(
        "id AS row_idx", "'e' AS event_slug", "concat('p', id, '@x.com') AS email", "IF(id % 4 = 0, 'Test', 'Ana') AS first_name", "IF(id % 4 = 0, 'sample', 'Kim') AS last_name",
        "'' AS company", "'CFO' AS job_title", "'IN' AS country", "'Yes' AS attended", "'3' AS minutes")
    kept = N.people(N.prepared(rows))
    assert kept.count() == 30 and kept.rdd.getNumPartitions() > 1
    assert "Range" not in kept._jdf.queryExecution().optimizedPlan().toString()
