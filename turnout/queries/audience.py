"""Segments, messages, recipients, links and dispatch queries."""

from pyspark.sql import functions as F

from turnout.functions import contact as C, fixed, text as T
from turnout.operators import messages as G, speakers as S
from turnout.queries.identity import PAIRED
from turnout.queries.registry import query
from turnout.queries.rows import RULES, by_pattern, cased, inlist

SEG = """seg AS (SELECT *, CASE WHEN suppression_reason <> '' THEN 'suppressed' WHEN attendance_status = 'attended' THEN 'attendee' ELSE 'no_show' END AS segment FROM {enriched})"""


@query("segments", "PRJ30", f"WITH {SEG} SELECT event_slug, email, segment FROM seg")
def _(v):
    return G.segments(v("enriched")).select("event_slug", "email", "segment")


VIEW = f"""reg AS (SELECT event_slug, mail AS email, arg_max(first_name, row_idx) AS rf, arg_max(job_title, row_idx) AS rt, arg_max(company, row_idx) AS rc
  FROM (SELECT * EXCLUDE (email), lower(trim(email)) AS mail FROM {{registrants}}) GROUP BY 1, 2),
base AS (SELECT r.event_slug, r.email, CASE WHEN e.email IS NOT NULL THEN e.jobtitle ELSE r.rt END AS job_title,
  CASE WHEN e.email IS NOT NULL THEN e.company ELSE r.rc END AS company, CASE WHEN e.email IS NOT NULL THEN e.firstname ELSE r.rf END AS fn,
  e.function AS ef, e.icp_tier AS et, coalesce(e.industry, '') AS industry FROM reg r LEFT JOIN {{enriched}} e ON e.event_slug = r.event_slug AND e.email = r.email),
vw AS (SELECT event_slug, email, CASE WHEN fn <> '' THEN fn ELSE upper(left(split_part(split_part(email, '@', 1), '.', 1), 1)) || substr(split_part(split_part(email, '@', 1), '.', 1), 2) END AS first_name,
  company, job_title, coalesce(nullif(ef, ''), {by_pattern('trim(job_title)', fixed.FUNCTION_PATTERNS, 'general')}) AS function,
  coalesce(et, CASE WHEN lower(trim(job_title)) IN {inlist(x.lower() for x in RULES.tiers[0].titles)} THEN 'tier1' WHEN lower(trim(job_title)) IN {inlist(x.lower() for x in RULES.tiers[1].titles)} THEN 'tier2' ELSE 'tier3' END) AS icp_tier,
  {by_pattern('trim(industry)', fixed.BUCKET_PATTERNS, 'other_commercial')} AS bucket FROM base)"""


def view(v):
    emails = v("registrants").select("event_slug", C.email_key(F.col("email")).alias("email")).distinct()
    return G.contact_view(emails, v("enriched"), v("registrants"), RULES)


@query("mailing_contacts", "JN15 SRC3", f"WITH {VIEW} SELECT * FROM vw")
def _(v):
    return view(v)


SNAP = """n AS (SELECT event_slug, count(*) AS registrants, count(*) FILTER (WHERE attendance_status = 'attended') AS attendees,
  coalesce(round_even(avg(try_cast(nullif(minutes, '') AS DOUBLE)) FILTER (WHERE attendance_status = 'attended'), 1), 0.0) AS avg_minutes,
  coalesce(round_even(quantile_cont(try_cast(nullif(minutes, '') AS DOUBLE), 0.5) FILTER (WHERE attendance_status = 'attended'), 1), 0.0) AS median_minutes FROM {enriched} GROUP BY 1),
acc AS (SELECT event_slug, company, count(*) AS k, row_number() OVER (PARTITION BY event_slug ORDER BY count(*) DESC, min(row_idx)) AS rn
  FROM {enriched} WHERE attendance_status = 'attended' GROUP BY 1, 2),
tops AS (SELECT event_slug, string_agg(company || ' (' || k || ')', ', ' ORDER BY rn) AS top_accounts FROM acc WHERE rn <= 5 GROUP BY 1),
snap AS (SELECT n.event_slug, registrants, attendees, registrants - attendees AS no_shows, round_even(attendees / registrants, 3) AS attendance_rate,
  avg_minutes, median_minutes, coalesce(top_accounts, 'n/a') AS top_accounts FROM n LEFT JOIN tops USING (event_slug))"""


@query("attendance_snapshot", "AGG15 TOP8 MTH2", f"WITH {SNAP} SELECT * FROM snap")
def _(v):
    return G.attendance_snapshot(v("enriched"))


@query("attendance_fallback", "AGG15", "WITH rows AS (SELECT event_slug, row_idx, attendance_status, minutes, company FROM {enriched} WHERE event_slug <> 'ev1' " +
       "UNION ALL SELECT event_slug, row_idx, CASE WHEN lower(attended) = 'yes' THEN 'attended' ELSE 'no_show' END, minutes, trim(company) FROM {registrants} WHERE event_slug = 'ev1'), " +
       SNAP.replace("{enriched}", "rows").replace("attendance_status = 'attended' GROUP BY 1, 2", "attendance_status = 'attended' AND company <> '' GROUP BY 1, 2") + " SELECT * FROM snap")
def _(v):
    return G.attendance_snapshot(G.with_fallback(v("enriched").filter("event_slug <> 'ev1'"), v("registrants")))


@query("attendance_lists", "AGG15", "WITH own AS (SELECT event_slug, lower(trim(email)) AS email, max_by(minutes, row_idx) AS minutes, max_by(company, row_idx) AS company FROM {registrants} GROUP BY 1, 2), " +
       "lists AS (SELECT event_slug, min(id) AS no, email, min(id) % 3 = 0 AS missed FROM {contacts} WHERE event_slug = 'ev1' GROUP BY 1, 3 UNION ALL SELECT 'ev2', 1, 'nobody@known.org', false), " +
       "rows AS (SELECT event_slug, row_idx, attendance_status, minutes, company FROM {enriched} WHERE event_slug NOT IN ('ev1', 'ev2') " +
       "UNION ALL SELECT event_slug, no, CASE WHEN missed THEN 'no_show' ELSE 'attended' END, coalesce(minutes, ''), coalesce(trim(company), '') FROM lists LEFT JOIN own USING (event_slug, email)), " +
       SNAP.replace("{enriched}", "rows").replace("attendance_status = 'attended' GROUP BY 1, 2", "attendance_status = 'attended' AND company <> '' GROUP BY 1, 2") + " SELECT * FROM snap")
def _(v):
    lists = v("contacts").filter("event_slug = 'ev1'").groupBy("event_slug", F.upper("email").alias("email")).agg(F.min("id").alias("no")).withColumn(
        "segment", F.when(F.col("no") % 3 == 0, "no_show").otherwise("attendee"))
    odd = v.spark.createDataFrame([("ev2", "nobody@known.org", 1, "attendee"), ("ev2", "s@x.org", 2, "suppressed")], "event_slug string, email string, no long, segment string")
    return G.attendance_snapshot(G.with_fallback(v("enriched").filter("event_slug NOT IN ('ev1', 'ev2')"), v("registrants"), lists.unionByName(odd)))


@query("snapshot_fields", "STR12", f"""WITH {SNAP} SELECT event_slug, registrants::VARCHAR AS snapshot_registrants, attendees::VARCHAR AS snapshot_attendees, no_shows::VARCHAR AS snapshot_no_shows,
  avg_minutes::VARCHAR AS snapshot_avg_minutes, median_minutes::VARCHAR AS snapshot_median_minutes, top_accounts AS snapshot_top_accounts,
  round_even(100 * attendance_rate, 0)::INTEGER || '%' AS snapshot_attendance_rate FROM snap""")
def _(v):
    return G.snapshot_fields(G.attendance_snapshot(v("enriched")))


@query("audience_mix", "AGG23", f"""WITH {VIEW} SELECT event_slug, coalesce(function, '*') AS function, coalesce(bucket, '*') AS bucket, count(*) AS n FROM vw
  GROUP BY GROUPING SETS ((event_slug), (event_slug, function), (event_slug, bucket), (event_slug, function, bucket))""")
def _(v):
    return G.audience_mix(view(v))


TAKE = VIEW + """, tk AS (SELECT w.*, coalesce(m.headline, g.headline, '') AS takeaway_headline,
  trim(coalesce(m.body, g.body, '') || ' ' || coalesce(a.angle, o.angle, '')) AS takeaway_body FROM vw w
  LEFT JOIN {message_matrix} m ON m.event_slug = w.event_slug AND m.function = w.function
  LEFT JOIN {message_matrix} g ON g.event_slug = w.event_slug AND g.function = 'general'
  LEFT JOIN {angle_matrix} a ON a.event_slug = w.event_slug AND a.bucket = w.bucket
  LEFT JOIN {angle_matrix} o ON o.event_slug = w.event_slug AND o.bucket = 'other_commercial')"""


@query("takeaways", "MAP1", f"WITH {TAKE} SELECT event_slug, email, function, bucket, takeaway_headline, takeaway_body FROM tk")
def _(v):
    return G.takeaways(view(v), v("message_matrix"), v("angle_matrix")).select(
        "event_slug", "email", "function", "bucket", "takeaway_headline", "takeaway_body")


ARMS = SEG + """, arm AS (SELECT *, row_number() OVER (PARTITION BY event_slug, segment ORDER BY email) - 1 AS position FROM seg)"""


@query("ab_arms", "WIN7", f"WITH {ARMS} SELECT event_slug, segment, email, position, CASE WHEN position % 2 = 0 THEN 'a' ELSE 'b' END AS arm FROM arm")
def _(v):
    return G.arms(G.segments(v("enriched"))).select("event_slug", "segment", "email", "position", "arm")


@query("demo_redirect", "WIN8", f"""WITH {SEG} SELECT event_slug, segment, email AS selected, icp_tier AS tier_used, icp_tier <> 'tier1' AS fallback FROM (
  SELECT *, row_number() OVER (PARTITION BY event_slug, segment ORDER BY CASE icp_tier WHEN 'tier1' THEN 0 WHEN 'tier2' THEN 1 WHEN 'tier3' THEN 2 ELSE 3 END, email) AS rn FROM seg) WHERE rn = 1""")
def _(v):
    return G.demo_redirect(G.segments(v("enriched")))


def utm(url, src, med, camp, cont):
    new = f"['utm_source={src}', 'utm_medium={med}', 'utm_campaign=' || {camp}, 'utm_content=' || {cont}]"
    base = f"split_part(split_part({url}, '#', 1), '?', 1)"
    q = f"list_filter(string_split(split_part(split_part({url}, '#', 1), '?', 2), '&'), lambda p: split_part(p, '=', 2) <> '')"
    keep = (f"list_transform({q}, lambda p: CASE WHEN list_contains(['utm_source','utm_medium','utm_campaign','utm_content'], split_part(p, '=', 1)) "
            f"THEN list_filter({new}, lambda n: split_part(n, '=', 1) = split_part(p, '=', 1))[1] ELSE p END)")
    rest = f"list_filter({new}, lambda n: NOT list_contains(list_transform({q}, lambda p: split_part(p, '=', 1)), split_part(n, '=', 1)))"
    frag = f"CASE WHEN contains({url}, '#') AND split_part({url}, '#', 2) <> '' THEN '#' || split_part({url}, '#', 2) ELSE '' END"
    return f"{base} || '?' || array_to_string(list_concat({keep}, {rest}), '&') || {frag}"


@query("tagged_links", "STR6", f"SELECT page_id, {utm('url', 'webinar', 'email', chr(39) + 'fall-26' + chr(39), chr(39) + 'attendee-a' + chr(39))} AS url FROM {{links}}")
def _(v):
    return v("links").select("page_id", T.with_utm(F.col("url"), F.lit("webinar"), F.lit("email"), F.lit("fall-26"), F.lit("attendee-a")).alias("url"))


BODY = "Hi {{firstname}},\n\n**{{takeaway_headline}}** {{takeaway_body}}\n\n> [Watch]({{recording_link}}) or *go* [next]({{cta_link}})"
DUCK_BODY = BODY.replace("{{", "<<").replace("}}", ">>")


def variants(v):
    """Message variants per segment, carried on the region table so they are data of the run."""
    first = v("region").groupBy().agg(F.min("r_name").alias("r"))
    return first.select(F.explode(F.array(F.lit("attendee"), F.lit("no_show"))).alias("segment"),
                        F.concat(F.lit("Recap "), F.col("r")).alias("subject_a"), F.concat(F.lit("Your notes "), F.col("r")).alias("subject_b"),
                        F.lit(BODY).alias("body_md"))


def recipients(v):
    rows = G.segments(v("enriched")).filter("segment <> 'suppressed'").select("event_slug", "email", "segment", "icp_tier")
    rows = rows.join(view(v).drop("icp_tier"), ["event_slug", "email"])
    rows = G.takeaways(rows, v("message_matrix"), v("angle_matrix"))
    rows = G.links(G.arms(rows), v("event_dim"))
    return G.recipients(rows, variants(v))


RECIP = SEG + ", " + TAKE + f""", placed AS (SELECT s.segment, s.icp_tier AS st, t.*, CASE WHEN (row_number() OVER (PARTITION BY s.event_slug, s.segment ORDER BY s.email) - 1) % 2 = 0 THEN 'a' ELSE 'b' END AS arm
  FROM seg s JOIN tk t ON t.event_slug = s.event_slug AND t.email = s.email WHERE s.segment <> 'suppressed'),
lk AS (SELECT p.*, trim(regexp_replace(lower(trim(split_part(e.event_name, ':', 1))), '[^a-z0-9]+', '-', 'g'), '-') || '-' || e.date AS campaign, e.recording_url,
  CASE WHEN p.segment = 'no_show' THEN e.registration_page ELSE e.recording_url END AS goal FROM placed p JOIN {{event_dim}} e ON e.event_slug = p.event_slug),
out AS (SELECT *, {utm('recording_url', 'webinar', 'email', 'campaign', "(segment || '-' || arm)")} AS recording_link, {utm('goal', 'webinar', 'email', 'campaign', "(segment || '-' || arm)")} AS cta_link FROM lk)"""


@query("recipients", "TXT12 STR4 STR5 STR1", f"""WITH {RECIP}, nm AS (SELECT min(r_name) AS r FROM {{region}})
SELECT event_slug, email, segment, arm, CASE WHEN arm = 'a' THEN 'Recap ' ELSE 'Your notes ' END || r AS subject, recording_link, cta_link,
  'Hi ' || first_name || ',' || chr(10) || chr(10) || takeaway_headline || ' ' || takeaway_body || chr(10) || chr(10) || 'Watch (' || recording_link || ') or go next (' || cta_link || ')' AS body_text, '' AS leftover
FROM out, nm""")
def _(v):
    return recipients(v).select("event_slug", "email", "segment", "arm", "subject", "recording_link", "cta_link", "body_text", "leftover")


@query("message_sample", "TOP10", f"""WITH {RECIP} SELECT * FROM (SELECT event_slug, segment, email, takeaway_body, row_number() OVER (PARTITION BY event_slug, segment ORDER BY email) AS rank FROM out) WHERE rank <= 5""")
def _(v):
    return G.sample(recipients(v)).select("event_slug", "segment", "email", "takeaway_body", "rank")


@query("approved_recipients", "PRJ28", f"""WITH {SEG}, pick AS (SELECT event_slug, segment, email, row_number() OVER (PARTITION BY event_slug, segment ORDER BY CASE icp_tier WHEN 'tier1' THEN 0 WHEN 'tier2' THEN 1 WHEN 'tier3' THEN 2 ELSE 3 END, email) = 1 AS redirected FROM seg)
SELECT event_slug, segment, email, 'demo' AS mode FROM pick WHERE redirected UNION ALL SELECT event_slug, segment, email, 'full' FROM pick""")
def _(v):
    seg = G.segments(v("enriched")).select("event_slug", "segment", "email", "icp_tier")
    first = G.demo_redirect(seg).select("event_slug", "segment", F.col("selected").alias("email"), F.lit(True).alias("redirected"))
    rows = seg.join(first, ["event_slug", "segment", "email"], "left").withColumn("redirected", F.coalesce("redirected", F.lit(False)))
    cols = ["event_slug", "segment", "email"]
    return G.approved(rows, "demo").select(*cols, F.lit("demo").alias("mode")).unionByName(
        G.approved(rows, "full").select(*cols, F.lit("full").alias("mode")))


TRIAGE = """plan AS (SELECT DISTINCT event_slug, email FROM {enriched} WHERE suppression_reason = ''),
tri AS (SELECT d.*, CASE WHEN status <> 'sent' OR message_id IS NULL THEN 'skipped' WHEN p.email IS NULL THEN 'error' ELSE 'logged' END AS outcome,
  CASE WHEN status = 'failed' THEN 'status=failed' WHEN status <> 'sent' OR message_id IS NULL THEN 'missing message_id' WHEN p.email IS NULL THEN 'recipient not planned' ELSE '' END AS reason
  FROM {dispatch_results} d LEFT JOIN plan p USING (event_slug, email))"""


def triage(v):
    return G.dispatch_triage(v("dispatch_results"), v("enriched").filter("suppression_reason = ''"))


@query("dispatch_triage", "PRJ29 JN27", f"WITH {TRIAGE} SELECT event_slug, row_idx, email, outcome, reason FROM tri")
def _(v):
    return triage(v).select("event_slug", "row_idx", "email", "outcome", "reason")


@query("dispatch_log_rows", "JN27 SNK5", f"""WITH {TRIAGE} SELECT event_slug, message_id, email, row_idx FROM (
  SELECT *, row_number() OVER (PARTITION BY event_slug, message_id ORDER BY row_idx) AS rn FROM tri WHERE outcome = 'logged') WHERE rn = 1
  AND (event_slug, message_id) NOT IN (SELECT event_slug, message_id FROM {{dispatch_results}} WHERE status = 'failed' AND message_id IS NOT NULL)""")
def _(v):
    log = v("dispatch_results").filter("status = 'failed' AND message_id IS NOT NULL")
    return G.new_log_rows(triage(v), log).select("event_slug", "message_id", "email", "row_idx")


@query("event_calendar", "DT3 STR1 SRC4", """SELECT event_slug, trim(regexp_replace(lower(event_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
  trim(regexp_replace(lower(split_part(event_name, ':', 1)), '[^a-z0-9]+', '-', 'g'), '-') || '-' || date AS tag,
  strftime((date || ' ' || start_time_local || ':00')::TIMESTAMP + to_minutes(CASE timezone WHEN 'Asia/Kolkata' THEN -330 ELSE 240 END + duration_min), '%Y-%m-%d %H:%M') AS closes_utc FROM {event_dim}""")
def _(v):
    c = F.col
    return v("event_dim").select(
        "event_slug", T.slug_or_event(c("event_name")).alias("slug"), T.event_tag(c("event_name"), c("date")).alias("tag"),
        F.date_format(T.local_close(c("date"), c("start_time_local"), c("timezone"), c("duration_min")), "yyyy-MM-dd HH:mm").alias("closes_utc"))


@query("variant_lint", "TXT10", """WITH p AS (SELECT page_id AS variant_id, CASE page_id % 3 WHEN 0 THEN 'attendee' WHEN 1 THEN 'no_show' ELSE 'speaker' END AS segment, html FROM {pages})
SELECT variant_id, segment, problem FROM (
  SELECT variant_id, segment, 'takeaways: 2' AS problem FROM p
  UNION ALL SELECT variant_id, segment, 'missing tokens: ' || CASE WHEN segment = 'speaker' THEN 'cta_link,recording_link,snapshot_your_quotes' ELSE 'cta_link,recording_link,takeaway_body,takeaway_headline' END FROM p
  UNION ALL SELECT variant_id, segment, 'unknown tokens: coupon' FROM p
  UNION ALL SELECT variant_id, segment, 'snapshot tokens: 0' FROM p WHERE segment = 'speaker'
  UNION ALL SELECT variant_id, segment, 'words: ' || len(regexp_extract_all(html, '\\w+')) + 2 FROM p WHERE len(regexp_extract_all(html, '\\w+')) + 2 > 400) """)
def _(v):
    c = F.col("page_id")
    rows = v("pages").select(
        c.alias("variant_id"), F.when(c % 3 == 0, "attendee").when(c % 3 == 1, "no_show").otherwise("speaker").alias("segment"),
        F.lit("A").alias("subject_a"), F.lit("B").alias("subject_b"), F.col("url").alias("preheader"),
        F.concat(F.lit("{{firstname}} {{coupon}} "), F.regexp_replace("html", r"\{\{", "")).alias("body_md"),
        F.array(F.lit("one"), F.lit("two"), F.lit(" ")).alias("takeaways"))
    return G.variant_problems(rows)


@query("self_reference_lint", "TXT10", """SELECT speaker_no, event_slug, regexp_matches(lower(name || ' ' || title), '\\b' || lower(split_part(name, ' ', 1)) || '\\s+(made|shared|said)\\b') AS flagged FROM (
  SELECT speaker_no, event_slug, name, CASE WHEN speaker_no % 2 = 0 THEN split_part(name, ' ', 1) || ' shared the point' ELSE 'you shared' END AS title FROM {speakers})""")
def _(v):
    first = F.split_part(F.col("name"), F.lit(" "), F.lit(1))
    body = F.when(F.col("speaker_no") % 2 == 0, F.concat(first, F.lit(" shared the point"))).otherwise("you shared")
    return v("speakers").select("speaker_no", "event_slug", G.talks_about_self(F.col("name"), F.concat_ws(" ", "name", body)).alias("flagged"))


@query("extraction_rules", "TXT11", """WITH n AS (SELECT DISTINCT event_slug FROM {speakers}),
t AS (SELECT event_slug, count(*) AS n FROM {message_matrix} GROUP BY 1), q AS (SELECT event_slug, count(*) AS n FROM {speakers} WHERE email <> '' GROUP BY 1),
m AS (SELECT event_slug, count(*) AS n FROM {angle_matrix} GROUP BY 1)
SELECT n.event_slug, 'takeaways: ' || coalesce(t.n, 0) || ', need 5-7' AS problem FROM n LEFT JOIN t USING (event_slug) WHERE coalesce(t.n, 0) NOT BETWEEN 5 AND 7
UNION ALL SELECT n.event_slug, 'quotes: ' || coalesce(q.n, 0) || ', need 4-6' FROM n LEFT JOIN q USING (event_slug) WHERE coalesce(q.n, 0) NOT BETWEEN 4 AND 6
UNION ALL SELECT n.event_slug, 'moments: ' || coalesce(m.n, 0) || ', need 3-3' FROM n LEFT JOIN m USING (event_slug) WHERE coalesce(m.n, 0) NOT BETWEEN 3 AND 3
UNION ALL SELECT event_slug, 'no quote from ' || name FROM {speakers} s WHERE (event_slug, lower(name)) NOT IN (SELECT event_slug, lower(name) FROM {speakers} WHERE email <> '')""")
def _(v):
    stamp = F.lit("01:30").alias("stamp")
    take = v("message_matrix").select("event_slug", F.col("headline").alias("text"), stamp)
    quotes = v("speakers").filter("email <> ''").select("event_slug", F.col("name").alias("text"), F.col("name").alias("speaker"), stamp)
    moments = v("angle_matrix").select("event_slug", F.col("angle").alias("text"), stamp)
    return G.extraction_problems(take, quotes, moments, v("speakers"))


@query("speaker_quotes", "WIN14", """WITH q AS (SELECT 'all' AS event_slug, role AS speaker, conv_id * 1000 + turn AS quote_no, text, printf('%02d:%02d', turn * 30 // 60, turn * 30 % 60) AS stamp, turn <> 1 AS verified FROM {conversations}),
r AS (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY quote_no) AS rn FROM q WHERE verified)
SELECT event_slug, speaker, string_agg('> "' || text || '" -- [' || stamp || ']', chr(10) ORDER BY rn) AS quotes FROM r WHERE rn <= 3 GROUP BY 1, 2""")
def _(v):
    q = v("conversations").select(F.lit("all").alias("event_slug"), F.col("role").alias("speaker"), (F.col("conv_id") * 1000 + F.col("turn")).alias("quote_no"),
                                  "text", T.mm_ss(F.col("turn") * 30).alias("stamp"), (F.col("turn") != 1).alias("verified"))
    return G.speaker_quotes(q)
