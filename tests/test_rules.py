import json
from urllib.parse import parse_qsl, urlencode, urlparse, urlunparse

import pytest
from pyspark.sql import functions as F

from turnout.functions import contact as C, text as T
from turnout.operators import enrich as N, messages as G
from turnout.sources import readers as R


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(build(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("raw, want", [("al-sayed", "Al-Sayed"), ("  MARIA de  silva ", "Maria De  Silva"), ("o'neil", "O'neil"), ("", "")])
def test_person_name(spark, raw, want):
    assert one(spark, raw, C.person_name) == want


@pytest.mark.parametrize("title, keyword, pattern, senior", [
    ("CHRO", "general", "executive", "unknown"), ("Founder", "executive", "executive", "c_suite"), ("VP People", "general", "general", "vp"),
    ("Sales Development Rep", "sales", "sales", "individual_contributor"), ("Customer Success Manager", "customer_success", "customer_success", "manager"),
    ("People Analytics Lead", "general", "revops", "unknown"), ("Marketing Director", "marketing", "marketing", "director"),
    ("HR Intern", "general", "general", "intern"), ("Account Executive", "sales", "sales", "individual_contributor")])
def test_two_function_rule_sets_disagree_on_purpose(spark, title, keyword, pattern, senior):
    assert one(spark, title, lambda c: F.concat_ws("/", C.function_by_keyword(c), C.function_by_pattern(c), C.seniority(c))) == f"{keyword}/{pattern}/{senior}"


@pytest.mark.parametrize("country, region, owner, plain", [
    ("India", "INDIA", "sdr.india@host.example", ""), ("IN", "INDIA", "sdr.india@host.example", "INDIA"), ("Qatar", "UNASSIGNED", "", ""),
    ("QA", "MENA", "sdr.mena@host.example", "MENA"), ("Brazil", "AMER", "", ""), ("", "UNASSIGNED", "", ""), ("u.s.a.", "NA", "sdr.na@host.example", "")])
def test_routing(spark, country, region, owner, plain):
    rules = C.Rules()
    df = spark.createDataFrame([(country,)], "v string").withColumn("region", rules.region(F.col("v")))
    row = df.select("region", rules.owner(F.col("region")).alias("o"), rules.region_plain(F.col("v")).alias("p")).first()
    assert tuple(row) == (region, owner, plain)


@pytest.mark.parametrize("title, size, industry, tier", [
    ("CHRO", 500, "SaaS", "tier1"), ("chro", 499, "SaaS", "unqualified"), ("CHRO", 150, "SaaS", "tier3"), ("CFO", 300, "Fitness", "tier2"),
    ("CHRO", 600, "Other", "unqualified"), ("Nobody", 5000, "SaaS", "unqualified"), ("Nobody", 0, "SaaS", "unqualified"), ("Nobody", 200, "Other", "tier3")])
def test_tiers(spark, title, size, industry, tier):
    t, why = C.Rules().tier_rule(F.col("t"), F.col("s"), F.col("i"))
    row = spark.createDataFrame([(title, size, industry)], "t string, s long, i string").select(t.alias("t"), why.alias("w")).first()
    assert row.t == tier and row.w.startswith(tier) and title in row.w


@pytest.mark.parametrize("existing, want, stage", [(None, "lead", "lead"), ("customer", "lead", "customer"), ("subscriber", "lead", "lead"), ("lead", "lead", "lead"), ("", "subscriber", "")])
def test_stage_never_moves_back(spark, existing, want, stage):
    row = spark.createDataFrame([(existing, want)], "e string, w string").select(C.guarded_stage(F.col("e"), F.col("w")).alias("r")).first()
    assert row.r == stage


def test_target_stage_survives_bad_minutes(spark):
    df = spark.createDataFrame([("tier1", True, "25"), ("tier1", True, "n/a"), ("tier1", False, "40"), ("tier3", True, "40")], "t string, a boolean, m string")
    assert [x.r for x in df.select(C.target_stage(F.col("t"), F.col("a"), F.col("m")).alias("r")).collect()] == ["marketingqualifiedlead", "lead", "lead", "subscriber"]


@pytest.mark.parametrize("first, last, email, reason", [
    ("Test", "SAMPLE", "t@x.com", "placeholder_name"), ("Test", "Kim", "t@x.com", ""), ("A", "B", "no-reply@x.com", "placeholder_mailbox"), ("A", "B", "acme@acme.com", "mirrors_domain")])
def test_placeholders(spark, first, last, email, reason):
    df = spark.createDataFrame([(first, last, email)], "f string, l string, e string")
    assert df.select(C.placeholder_reason(F.col("f"), F.col("l"), C.local_part(F.col("e")), C.mail_domain(F.col("e"))).alias("r")).first().r == reason


@pytest.mark.parametrize("c, flag", [("Компания", True), ("ABcd Ко", False), ("123", False), ("日本株式会社 KK", True)])
def test_non_ascii(spark, c, flag):
    assert one(spark, c, C.mostly_non_ascii) is flag


@pytest.mark.parametrize("url", [
    "https://x.com/a", "https://x.com/a?b=1&c=&b=2", "https://x.com/a?utm_source=old&z=9#top", "https://x.com/?q=a%20b+c&utm_content=y&utm_content=z",
    "https://x.com/a?=x&k=v", "https://x.com/a?flag&k=%C3%A9~*", "https://x.com/a#only"])
def test_links_equal_the_url_library(spark, url):
    parts = urlparse(url)
    q = dict(parse_qsl(parts.query))
    q.update(utm_source="webinar", utm_medium="email", utm_campaign="fall 26", utm_content="a&b")
    want = urlunparse(parts._replace(query=urlencode(q)))
    assert one(spark, url, lambda c: T.with_utm(c, F.lit("webinar"), F.lit("email"), F.lit("fall 26"), F.lit("a&b"))) == want


def test_render_absorbs_a_second_percent(spark):
    body = F.lit("{{rate}}% of {{who}}, {{rate}} again, {{gone}}")
    row = spark.range(1).select(T.render(body, {"rate": F.lit("55%"), "who": F.lit("us")}).alias("r"), T.tokens(T.render(body, {"rate": F.lit("5%")})).alias("t")).first()
    assert row.r == "55% of us, 55% again, {{gone}}" and row.t == ["who", "gone"]


@pytest.mark.parametrize("raw, want", [('{"a": 1}', 1), ('Sure:\n```json\n{"a": 2}\n```\nbye', 2), ('well {"a": 3} ok', 3), ("nothing {", None)])
def test_json_part(spark, raw, want):
    got = one(spark, raw, T.json_part)
    assert (json.loads(got)["a"] if got else None) == want


@pytest.mark.parametrize("raw, sec", [("01:30", 90), ("1:00:05", 3605), ("5", None), ("1:2", None), (" 00:00 ", 0)])
def test_seconds(spark, raw, sec):
    assert one(spark, raw, T.seconds_of) == sec


def test_clocks_and_slugs(spark):
    row = spark.range(1).select(T.srt_clock(F.lit(3661.5)).alias("a"), T.vtt_clock(F.lit(75)).alias("b"), T.mm_ss(F.lit(605)).alias("c"),
                                T.event_tag(F.lit("AI in HR: Part 2"), F.lit("2026-08-13")).alias("d"), T.slug_or_event(F.lit("!!")).alias("e"),
                                T.match_key(F.lit("It’s — “Fine”")).alias("f")).first()
    assert tuple(row) == ("01:01:01,500", "00:01:15.000", "10:05", "ai-in-hr-2026-08-13", "event", "it s fine")


def test_headers(spark):
    assert R.canonical_headers(["E-mail", "SURNAME", "Badge", "Country/Region"]) == ["email", "last_name", "Badge", "country"]
    with pytest.raises(ValueError):
        R.canonical_headers(["First Name", "Badge"])


def test_crm_array_file(spark, tmp_path):
    (tmp_path / "crm.json").write_text(json.dumps([{"vid": 1, "email": "a@x.com"}, {"vid": 2, "email": None, "extra": 1}]))
    assert [(x.vid, x.email) for x in R.crm_contacts(spark, str(tmp_path / "crm.json")).orderBy("vid").collect()] == [(1, "a@x.com"), (2, None)]


def test_stt_entries_at_any_depth(spark):
    deep = {"x": [{"y": {"entries": [{"speaker_id": 1, "start_time_seconds": 2, "end_time_seconds": 3, "transcript": " hi "}, {"speaker_id": 2, "start_time_seconds": 4, "transcript": ""}]}}]}
    df = spark.createDataFrame([("a", json.dumps(deep)), ("b", json.dumps({"transcript": "plain"}))], "id string, value string")
    got = {x.id: (x.start_sec, x.speaker, x.text) for x in R.stt_turns(df).collect()}
    assert got == {"a": (2.0, "1", "hi"), "b": (0.0, "Unknown", "plain")}


def test_dispatch_triage(spark):
    plan = spark.createDataFrame([("e", "a@x.com"), ("e", "b@x.com"), ("e", "c@x.com")], "event_slug string, email string")
    res = spark.createDataFrame([("e", 1, "a@x.com", "sent", "m1", None), ("e", 2, "b@x.com", "sent", None, None), ("e", 3, "c@x.com", "failed", "m3", None),
                                 ("e", 4, "z@x.com", "sent", "m4", None), ("e", 5, "a@x.com", "sent", "m1", None)],
                                "event_slug string, row_idx long, email string, status string, message_id string, sent_at timestamp")
    tri = G.dispatch_triage(res, plan)
    assert {x.row_idx: (x.outcome, x.reason) for x in tri.collect()} == {
        1: ("logged", ""), 2: ("skipped", "missing message_id"), 3: ("skipped", "status=failed"), 4: ("error", "recipient not planned"), 5: ("logged", "")}
    first = G.new_log_rows(tri)
    assert [x.message_id for x in first.collect()] == ["m1"] and G.new_log_rows(tri, first).count() == 0


def test_weaker_source_never_overwrites(spark):
    rows = spark.createDataFrame([("e", "d.com", "Energy", 10, "vendor", "model", 0.9, False)],
                                 "event_slug string, company_id string, industry string, numemployees long, industry_source string, numemployees_source string, firmographics_confidence double, needs_review boolean")
    ans = spark.createDataFrame([("e", "d.com", "SaaS", 99, 0.4)], "event_slug string, company_id string, new_industry string, new_size long, new_confidence double")
    r = N.apply_firmographics(rows, ans, "model").first()
    assert (r.industry, r.industry_source, r.numemployees, r.numemployees_source, r.firmographics_confidence) == ("Energy", "vendor", 99, "model", 0.9)


def test_vendor_answers_fall_back_to_the_company_name(spark):
    rows = spark.createDataFrame([("e", "name:acme corp"), ("e", "d.com")], "event_slug string, company_id string")
    raw = spark.createDataFrame([("e", "Acme  Corp", "Energy", "50"), ("e", "d.com", "", "n/a"), ("e", "x.com", "Energy", "5")],
                                "event_slug string, company_id string, industry string, employee_count string")
    assert [(x.company_id, x.new_size) for x in N.vendor_firmographics(raw, rows).collect()] == [("name:acme corp", 50)]


def test_unreadable_speech_answers_are_set_aside(spark):
    good = '{"a": [[], {"b": [{"speaker": "x", "start": "2", "text": " hi "}, 7, {"speaker": "y", "start": null}]}]}'
    rows = [(1, good), (2, "{broken"), (3, "[]"), (4, None), (5, ""), (6, '"text"'), (7, '{"transcript": " whole "}'), (8, "[" * 200 + "]" * 200)]
    df = spark.createDataFrame(rows, "id int, value string")
    assert [tuple(r) for r in R.stt_turns(df).orderBy("id").collect()] == [(1, 0, 2.0, 0.0, "x", "hi"), (7, 0, 0.0, None, "Unknown", "whole")]
    assert {r["id"]: r["reason"] for r in R.stt_rejects(df).collect()} == {2: "not JSON", 4: "empty", 5: "empty"}


@pytest.mark.parametrize("text", ["", "acme", "3com", "o'neil works", "a-b_c d1e", "ÉCOLE du 5e", "x y  z", "4"])
def test_title_words_equal_python(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(C.title_words(F.col("t"))).first()[0] == text.title()
