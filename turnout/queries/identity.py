"""Identity resolution and speaker queries."""

from pyspark.sql import functions as F

from turnout.functions import contact as C
from turnout.operators import enrich as N, quality as Q, resolve as R, speakers as S
from turnout.queries.registry import query
from turnout.queries.rows import PREP, named
from turnout.plans.enrichment import enrich, enrich_event
from turnout.session import scratch
from turnout.sources.versions import Snapshots


@query("name_primaries", "WIN1 JN1", f"""WITH {PREP} SELECT event_slug, lower(firstname) AS block_first, lower(lastname) AS block_last, row_idx AS primary_idx FROM (
  SELECT *, count(*) OVER (PARTITION BY event_slug, lower(firstname), lower(lastname)) AS n,
    row_number() OVER (PARTITION BY event_slug, lower(firstname), lower(lastname) ORDER BY attended DESC, company_raw <> '' DESC, jobtitle_raw <> '' DESC, row_idx) AS rn
  FROM kept) WHERE rn = 1 AND n > 1""")
def _(v):
    return R.name_primaries(N.people(N.prepared(v("registrants")))).select(
        "event_slug", "block_first", "block_last", F.col("p.row_idx").alias("primary_idx"))


@query("duplicate_pairs", "JN1 WIN1 UDF1 UDF3 STR3")
def _(v):
    return R.duplicate_pairs(named(v)).select("event_slug", "primary_idx", "row_idx", F.round("score", 6).alias("score"), "verdict")


@query("surviving_rows", "JN1")
def _(v):
    rows = named(v)
    return R.survivors(rows, R.duplicate_pairs(rows)).select(
        "event_slug", "row_idx", "company_raw", "jobtitle_raw", "company_source", "title_source")


@query("crm_candidates", "JN3 SET6", """WITH r AS (SELECT lower(trim(email)) AS email, last_name FROM {registrants})
SELECT vid, email, lastname FROM {crm} WHERE email IN (SELECT email FROM r) OR lastname IN (SELECT last_name FROM r)""")
def _(v):
    rows = v("registrants").select(C.email_key(F.col("email")).alias("email"), F.col("last_name").alias("lastname"))
    return R.crm_candidates(rows, v("crm")).select("vid", "email", "lastname")


@query("crm_matches", "JN2 WIN2 JN3 UDF1")
def _(v):
    return R.crm_matches(named(v), v("crm")).select("event_slug", "row_idx", "vid", F.round("score", 6).alias("score"), "verdict")


@query("review_pairs", "TOP6")
def _(v):
    rows = named(v)
    return R.review_pairs(R.duplicate_pairs(rows), R.crm_matches(rows, v("crm"))).select(
        "event_slug", "kind", "pair_id", F.round("score", 6).alias("score"), "rank")


@query("review_overflow", "TOP6")
def _(v):
    rows = named(v)
    return R.review_overflow(R.review_pairs(R.duplicate_pairs(rows), R.crm_matches(rows, v("crm"))))


def decisions(selected):
    """Reviewers' answers, derived from the pairs: longer ids merge, odd ones are unreadable."""
    return selected.select("event_slug", "pair_id", F.when(F.length("pair_id") > 50, "merge").otherwise("unsure").alias("decision"))


@query("adjudicated_pairs", "JN12 PRJ31")
def _(v):
    rows = named(v)
    selected = R.review_pairs(R.duplicate_pairs(rows), R.crm_matches(rows, v("crm")))
    return R.adjudicated(selected, decisions(selected)).select("event_slug", "kind", "pair_id", "decision")


@query("enriched_contacts", "JN12 JN30 PRJ17 SET1 SNK1")
def _(v):
    return enrich(v("registrants"), v("crm"), C.Rules(), speakers=v("speakers"), inboxes=v("speaker_inboxes"),
                  model=v("model_replies"), vendor=v("vendor_replies"), patches=v("patch_replies"),
                  tiers=v("tier_replies"), decisions=decisions)["contacts"].drop("notes")


@query("dedupe_report", "AGG14")
def _(v):
    out = enrich(v("registrants"), v("crm"), C.Rules())
    return Q.dedupe_counts(v("registrants"), out["rejected"], out["pairs"].filter("verdict = 'merge'"), out["matches"], out["contacts"])


@query("crm_after_run", "JN30", """WITH o AS (SELECT id AS vid, email, upper(firstname) AS firstname, lastname, jobtitle, company, 'lead' AS lifecyclestage FROM {contacts}),
b AS (SELECT vid, email, firstname, lastname, jobtitle, company, lifecyclestage, 0 AS age FROM {crm} UNION ALL SELECT *, 1 FROM o)
SELECT * EXCLUDE (age, rn) FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY age DESC, vid) AS rn FROM b) WHERE rn = 1""")
def _(v):
    out = v("contacts").select(F.col("id").alias("vid"), "email", F.upper("firstname").alias("firstname"), "lastname", "jobtitle",
                               "company", F.lit("lead").alias("lifecyclestage"))
    return R.crm_state(v("crm"), out)


@query("crm_versions", "JN30", """WITH s1 AS (SELECT vid, email, firstname, jobtitle FROM {crm}),
u AS (SELECT id + 100000 AS vid, upper(firstname) AS firstname, jobtitle FROM {contacts} WHERE id % 3 = 0),
s2 AS (SELECT s1.vid, email, coalesce(nullif(u.firstname, ''), s1.firstname) AS firstname, coalesce(nullif(u.jobtitle, ''), s1.jobtitle) AS jobtitle FROM s1 LEFT JOIN u USING (vid)
  UNION ALL SELECT (SELECT max(vid) FROM s1) + row_number() OVER (ORDER BY email), email, firstname, jobtitle FROM (SELECT 'new.' || email AS email, min(firstname) AS firstname, min(jobtitle) AS jobtitle FROM {contacts} WHERE id % 7 = 0 GROUP BY 1))
SELECT 1 AS version, * FROM s1 UNION ALL SELECT 2, * FROM s2 UNION ALL SELECT 3, * FROM s2""")
def _(v):
    store = Snapshots(v.spark, scratch(v.spark, "crm"))
    store.commit("seed", v("crm").select("vid", "event_slug", *R.STATE))
    known = v("contacts").filter("id % 3 = 0").select(F.lit("e2").alias("event_slug"), F.lit("").alias("email"), F.upper("firstname").alias("firstname"), F.lit("").alias("lastname"),
                                                      "jobtitle", F.lit("").alias("company"), F.lit("").alias("lifecyclestage"),
                                                      F.concat(F.lit("update_existing:"), (F.col("id") + 100000).cast("string")).alias("merge_action"))
    new = v("contacts").filter("id % 7 = 0").groupBy(F.concat(F.lit("new."), F.col("email")).alias("email")).agg(
        F.min("firstname").alias("firstname"), F.min("jobtitle").alias("jobtitle")).select(
        F.lit("e2").alias("event_slug"), "email", "firstname", F.lit("").alias("lastname"), "jobtitle", F.lit("").alias("company"), F.lit("").alias("lifecyclestage"),
        F.lit("create_new").alias("merge_action"))
    for _ in range(2):  # the run is repeated; both of its snapshots can be read and hold the same
        store.commit("e2", R.merged_state(store.before("e2"), known.unionByName(new)))
    states = [store.read(n).select(F.lit(n).alias("version"), "vid", "email", "firstname", "jobtitle") for n in (1, 2, 3)]
    return states[0].unionByName(states[1]).unionByName(states[2])


@query("second_event", "JN30")
def _(v):
    """Event 1 runs against the CRM, then a third of its people come again, written otherwise, and some strangers."""
    store = Snapshots(v.spark, scratch(v.spark, "crm"))
    store.commit("seed", v("crm").filter("event_slug <> 'ev0'").select("vid", "event_slug", *R.STATE))
    first = v("registrants").filter("event_slug = 'ev0'")
    enrich_event(store, "ev0", first, C.Rules())
    again = first.filter("row_idx % 3 = 0").withColumns({"event_slug": F.lit("second"), "email": F.upper("email"), "first_name": F.upper("first_name")})
    out = enrich_event(store, "second", again, C.Rules())["contacts"]
    return out.select("email", F.split_part("merge_action", F.lit(":"), F.lit(1)).alias("action"))


PAIRED = """s AS (SELECT event_slug, speaker_no, lower(email) AS mail, lower(split_part(name, ' ', 1) || '.' || split_part(name, ' ', 2)) AS want FROM {speakers}),
b AS (SELECT event_slug, inbox_no, lower(email) AS inbox, split_part(lower(email), '@', 1) AS local FROM {speaker_inboxes}),
hits AS (SELECT s.event_slug, speaker_no, inbox, inbox_no, 1 AS rule FROM s JOIN b ON s.event_slug = b.event_slug AND s.mail = b.inbox
  UNION ALL SELECT s.event_slug, speaker_no, inbox, inbox_no, 2 FROM s JOIN b ON s.event_slug = b.event_slug AND s.want = b.local),
pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_slug, speaker_no ORDER BY rule, inbox_no) AS rn FROM hits) WHERE rn = 1),
paired AS (SELECT s.event_slug, s.speaker_no, coalesce(p.inbox, '') AS email, coalesce(p.rule, 0) AS rule FROM s LEFT JOIN pick p USING (event_slug, speaker_no))"""


@query("speaker_inboxes", "JN7", f"WITH {PAIRED} SELECT * FROM paired")
def _(v):
    return S.paired_by_local(v("speakers"), v("speaker_inboxes")).select("event_slug", "speaker_no", "email", "rule")


@query("speaker_inboxes_loose", "JN7", """WITH s AS (SELECT event_slug, speaker_no, email AS own, string_split(name, ' ') AS parts, regexp_replace(lower(company), '[^a-z0-9]', '', 'g') AS ck FROM {speakers}),
b AS (SELECT event_slug, inbox_no, email AS inbox, regexp_replace(lower(split_part(email, '@', 1)), '[^a-z0-9]', '', 'g') AS lk,
  regexp_replace(lower(split_part(split_part(email, '@', 2), '.', 1)), '[^a-z0-9]', '', 'g') AS dk FROM {speaker_inboxes}),
hits AS (SELECT event_slug, speaker_no, own AS inbox, 0 AS inbox_no, 1 AS rule FROM s WHERE own <> ''
  UNION ALL SELECT s.event_slug, speaker_no, inbox, inbox_no, 2 FROM s JOIN b ON s.event_slug = b.event_slug AND own = ''
    AND len(list_filter(parts, lambda p: regexp_replace(lower(p), '[^a-z0-9]', '', 'g') <> '' AND contains(lk, regexp_replace(lower(p), '[^a-z0-9]', '', 'g')))) > 0
  UNION ALL SELECT s.event_slug, speaker_no, inbox, inbox_no, 3 FROM s JOIN b ON s.event_slug = b.event_slug AND own = '' AND ck <> '' AND dk <> '' AND contains(ck, dk)),
pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_slug, speaker_no ORDER BY rule, inbox_no) AS rn FROM hits) WHERE rn = 1)
SELECT s.event_slug, s.speaker_no, coalesce(p.inbox, '') AS email, coalesce(p.rule, 0) AS rule FROM s LEFT JOIN pick p USING (event_slug, speaker_no)""")
def _(v):
    return S.paired_loosely(v("speakers"), v("speaker_inboxes")).select("event_slug", "speaker_no", "email", "rule")


@query("bulk_segment", "JN19", f"""WITH {PAIRED} SELECT c.event_slug, c.email FROM {{contacts}} c WHERE (c.event_slug, c.email) NOT IN (SELECT event_slug, email FROM paired WHERE email <> '')""")
def _(v):
    return S.without_speakers(v("contacts"), S.paired_by_local(v("speakers"), v("speaker_inboxes"))).select("event_slug", "email")


@query("roster_match", "JN26 UDF1")
def _(v):
    cited = v("crm").select("event_slug", F.concat_ws(" ", "firstname", "lastname").alias("cited"))
    roster = v("contacts").select("event_slug", F.concat_ws(" ", "firstname", "lastname").alias("name"))
    return S.roster_match(cited, roster).select("event_slug", "cited", "matched", F.round("ratio", 6).alias("ratio"))
