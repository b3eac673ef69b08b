"""Engagement, movement and report queries with their oracles."""

from pyspark.sql import functions as F

from turnout.functions import contact as C
from turnout.operators import engagement as E, movement as M
from turnout.queries.registry import query

COUNTERS = """counts AS (
  SELECT event_slug, lower(trim(email)) AS email,
         count(*) FILTER (WHERE type = 'open') AS opens, count(*) FILTER (WHERE type = 'click') AS clicks,
         count(*) FILTER (WHERE type = 'pageview') AS pageviews, count(*) FILTER (WHERE type = 'form_fill') AS form_fills,
         max(ts) AS last_engaged
  FROM {engagement} WHERE type IN ('open', 'click', 'pageview', 'form_fill') GROUP BY 1, 2)"""
METRICS = COUNTERS + """,
freemail AS (SELECT unnest(['gmail.com','yahoo.com','hotmail.com','outlook.com','aol.com','icloud.com','protonmail.com',
  'live.com','msn.com','rediffmail.com','rediff.com','ymail.com','mail.com','gmx.com','yandex.com']) AS d),
metrics AS (
  SELECT c.*, coalesce(opens, 0) AS opens, coalesce(clicks, 0) AS clicks, coalesce(pageviews, 0) AS pageviews,
         coalesce(form_fills, 0) AS form_fills, last_engaged, l.stage AS lifecyclestage,
         CASE WHEN attended = 'Yes' THEN 'attended' ELSE 'no_show' END AS attendance_status,
         coalesce(opens, 0) * 0.5 + coalesce(clicks, 0) * 3 + coalesce(pageviews, 0) + coalesce(form_fills, 0) * 10.0 AS score,
         coalesce(opens, 0) + coalesce(clicks, 0) + coalesce(pageviews, 0) + coalesce(form_fills, 0) AS interactions,
         CASE WHEN domain NOT IN (SELECT d FROM freemail) THEN domain END AS account
  FROM {contacts} c LEFT JOIN counts e ON e.event_slug = c.event_slug AND e.email = c.email
  LEFT JOIN {latest_stage} l ON l.contact_id = c.id)"""
ACCOUNTS = METRICS + """,
accounts AS (
  SELECT event_slug, account AS domain,
         coalesce(arg_min(CASE WHEN company <> '' THEN company END, CASE WHEN company <> '' THEN email END),
                  upper(left(split_part(account, '.', 1), 1)) || replace(substr(split_part(account, '.', 1), 2), '-', ' ')) AS company,
         round_even(sum(score)::DOUBLE, 1) AS score, count(*) AS known_contacts,
         count(*) FILTER (WHERE interactions > 0) AS engaged_contacts,
         round_even(100.0 * count(*) FILTER (WHERE interactions > 0) / count(*), 1) AS coverage_pct,
         count(*) FILTER (WHERE interactions > 0) >= 2 AS is_committee
  FROM metrics WHERE account IS NOT NULL GROUP BY 1, 2)"""
FENCE = """fence AS (
  SELECT event_slug, count(*) FILTER (WHERE interactions > 0) AS engaged,
         quantile_cont(interactions, 0.25) FILTER (WHERE interactions > 0) AS a,
         quantile_cont(interactions, 0.5) FILTER (WHERE interactions > 0) AS b,
         quantile_cont(interactions, 0.75) FILTER (WHERE interactions > 0) AS c
  FROM metrics GROUP BY 1),
fences AS (
  SELECT event_slug, engaged, CASE WHEN engaged < 4 THEN 0.0 ELSE a END AS q1, CASE WHEN engaged < 4 THEN 0.0 ELSE b END AS median,
         CASE WHEN engaged < 4 THEN 0.0 ELSE c END AS q3,
         CASE WHEN engaged < 4 THEN 5 ELSE greatest(3, ceil(c + 1.5 * (c - a))) END::BIGINT AS threshold
  FROM fence)"""
CHANGES = """changes AS (
  SELECT event_slug, row_idx, email, regexp_replace(lower(raw_stage), '(_pending|_new)$', '') AS stage, ts, source FROM {lifecycle})"""
ASOF = CHANGES + """,
newest AS (SELECT event_slug, max(ts) AS as_of FROM (
  SELECT event_slug, ts FROM changes UNION ALL SELECT event_slug, ts FROM {engagement} UNION ALL SELECT event_slug, ts FROM {mail_touches}) GROUP BY 1),
hits AS (SELECT c.*, w.days, a.as_of FROM changes c JOIN newest a USING (event_slug), (SELECT unnest([7, 14, 30]) AS days) w
  WHERE c.ts <= a.as_of AND c.ts >= a.as_of - to_days(w.days::INTEGER))"""


def attending(v):
    """Contacts with their stage and whether they came."""
    stages = v("latest_stage").select(F.col("contact_id").alias("id"), F.col("stage").alias("lifecyclestage"))
    return v("contacts").join(stages, "id", "left").withColumn(
        "attendance_status", F.when(F.col("attended") == "Yes", "attended").otherwise("no_show"))


def metrics(v):
    return E.contact_metrics(attending(v), E.counters(v("engagement")))


def now(v):
    return M.as_of(v("lifecycle"), v("engagement"), v("mail_touches"))


@query("engagement_counters", "AGG1 MAP1", f"""WITH {COUNTERS}
SELECT event_slug, email, opens, clicks, pageviews, form_fills, strftime(last_engaged, '%Y-%m-%d %H:%M:%S') AS last_engaged FROM counts""")
def _(v):
    return E.counters(v("engagement")).withColumn("last_engaged", F.date_format("last_engaged", "yyyy-MM-dd HH:mm:ss"))


@query("counter_payload", "PRJ34", f"""WITH {COUNTERS}
SELECT event_slug, email, opens::VARCHAR AS opens, clicks::VARCHAR AS clicks, pageviews::VARCHAR AS pageviews, form_fills::VARCHAR AS form_fills,
       strftime(last_engaged, '%Y-%m-%dT%H:%M:%SZ') AS last_engaged FROM counts""")
def _(v):
    return E.counter_payload(E.counters(v("engagement")))


@query("weighted_scores", "PRJ26 MTH1", f"""WITH {COUNTERS}
SELECT event_slug, email, round_even(opens * 0.5 + clicks * 3.0 + pageviews + form_fills * 10.0, 1)::DOUBLE AS score,
       opens + clicks + pageviews + form_fills AS interactions FROM counts""")
def _(v):
    return E.scored(E.counters(v("engagement"))).select("event_slug", "email", "score", "interactions")


@query("contact_metrics", "JN15 PRJ1", f"""WITH {METRICS}
SELECT event_slug, email, opens, clicks, pageviews, form_fills, score::DOUBLE AS score, interactions, coalesce(account, '') AS account FROM metrics""")
def _(v):
    return metrics(v).select("event_slug", "email", *E.COUNTERS, "score", "interactions",
                             F.coalesce("account", F.lit("")).alias("account"))


@query("final_stages", "AGG2", f"""WITH {CHANGES}
SELECT event_slug, email, stage, strftime(ts, '%Y-%m-%d') AS day, n AS changes FROM (
  SELECT *, row_number() OVER (PARTITION BY event_slug, email ORDER BY ts DESC, row_idx) AS rn,
         count(*) OVER (PARTITION BY event_slug, email) AS n FROM changes) WHERE rn = 1""")
def _(v):
    return M.final_stages(M.changes(v("lifecycle"))).select(
        "event_slug", "email", "stage", F.date_format("ts", "yyyy-MM-dd").alias("day"), "changes")


@query("stage_history", "AGG3", f"""WITH {CHANGES}
SELECT event_slug, email, stage, source, strftime(ts, '%Y-%m-%d') AS day,
       row_number() OVER (PARTITION BY event_slug, email ORDER BY ts, row_idx) - 1 AS step FROM changes""")
def _(v):
    return M.history(M.changes(v("lifecycle"))).select(
        "event_slug", "email", "stage", "source", F.date_format("ts", "yyyy-MM-dd").alias("day"), "step")


@query("outlier_fence", "AGG16 MTH2", f"""WITH {METRICS}, {FENCE} SELECT event_slug, engaged, q1::DOUBLE AS q1, median::DOUBLE AS median, q3::DOUBLE AS q3, threshold FROM fences""")
def _(v):
    return E.fence(metrics(v))


FUNNEL = METRICS + """, ranked AS (SELECT *, CASE lifecyclestage WHEN 'subscriber' THEN 0 WHEN 'lead' THEN 1 WHEN 'marketingqualifiedlead' THEN 2
    WHEN 'salesqualifiedlead' THEN 3 WHEN 'opportunity' THEN 4 ELSE -1 END AS r,
    max(CASE WHEN attendance_status = 'attended' THEN 1 ELSE 0 END) OVER (PARTITION BY event_slug) AS has_any FROM metrics),
steps AS (SELECT event_slug, count(*) AS contacts, count(*) FILTER (WHERE has_any = 0 OR attendance_status = 'attended') AS attendees,
    count(*) FILTER (WHERE interactions > 0) AS engaged_contacts,
    count(*) FILTER (WHERE (has_any = 0 OR attendance_status = 'attended') AND r >= 2) AS mqls,
    count(*) FILTER (WHERE (has_any = 0 OR attendance_status = 'attended') AND r >= 3) AS sqls FROM ranked GROUP BY 1)"""


@query("attendee_funnel", "AGG17", f"""WITH {FUNNEL} SELECT *, round_even(mqls / attendees, 4) AS mql_rate FROM steps""")
def _(v):
    return E.funnel(metrics(v))


@query("funnel_steps", "AGG17 JN29", f"""WITH {FUNNEL}
SELECT event_slug, 1 AS step, 'Tagged contacts' AS stage, contacts AS n FROM steps
UNION ALL SELECT event_slug, 2, 'Attendees', attendees FROM steps UNION ALL SELECT event_slug, 3, 'Engaged post-event', engaged_contacts FROM steps
UNION ALL SELECT event_slug, 4, 'MQL+', mqls FROM steps UNION ALL SELECT event_slug, 5, 'SQL+', sqls FROM steps""")
def _(v):
    return E.funnel_steps(E.funnel(metrics(v)))


@query("account_rollup", "AGG18 AGG28 PRJ4", f"WITH {ACCOUNTS} SELECT * FROM accounts")
def _(v):
    return E.accounts(metrics(v))


@query("top_accounts", "TOP1", f"""WITH {ACCOUNTS} SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY event_slug ORDER BY score DESC, company, domain) AS rank FROM accounts) WHERE rank <= 10""")
def _(v):
    return E.top_accounts(E.accounts(metrics(v)))


@query("buying_committees", "AGG19 TOP4", f"""WITH {ACCOUNTS} SELECT event_slug, domain, company, engaged_contacts, rank, engaged_contacts || ' people engaged, ' ||
  coverage_pct || '% of those known, weight ' || score AS why FROM (
  SELECT *, row_number() OVER (PARTITION BY event_slug ORDER BY engaged_contacts DESC, score DESC, domain) AS rank FROM accounts WHERE is_committee) WHERE rank <= 10""")
def _(v):
    return E.committees(E.accounts(metrics(v))).select("event_slug", "domain", "company", "engaged_contacts", "rank", "why")


@query("account_contacts", "WIN10", f"""WITH {METRICS} SELECT * FROM (
  SELECT event_slug, account AS domain, email, score::DOUBLE AS score, lifecyclestage,
         row_number() OVER (PARTITION BY event_slug, account ORDER BY score DESC, email) AS rank
  FROM metrics WHERE interactions > 0 AND account IS NOT NULL) WHERE rank <= 6""")
def _(v):
    return E.account_contacts(metrics(v))


TOPC = """top AS (SELECT *, row_number() OVER (PARTITION BY event_slug ORDER BY score DESC, email) AS rank FROM metrics WHERE interactions > 0)"""


@query("top_contacts", "TOP2", f"""WITH {METRICS}, {TOPC}
SELECT event_slug, email, firstname || ' ' || lastname AS name, score::DOUBLE AS score, interactions, rank FROM top WHERE rank <= 10""")
def _(v):
    return E.top_contacts(metrics(v)).select(
        "event_slug", "email", C.display_name(F.col("firstname"), F.col("lastname"), F.col("email")).alias("name"),
        "score", "interactions", "rank")


@query("interest_scores", "TOP3 WIN9", f"""WITH {METRICS}, {TOPC}
SELECT event_slug, email, rank, round_even(100.0 * score / max(score) OVER (PARTITION BY event_slug), 0)::BIGINT AS interest FROM top WHERE rank <= 25""")
def _(v):
    return E.interest_scores(metrics(v)).select("event_slug", "email", "rank", "interest")


ANOMALY = METRICS + ", " + FENCE + """,
quiet AS (SELECT c.event_slug, c.email FROM (SELECT DISTINCT event_slug, email FROM {engagement}) c
  LEFT JOIN (SELECT DISTINCT event_slug, email FROM {lifecycle} WHERE source = 'seeded') l USING (event_slug, email) WHERE l.email IS NULL),
flagged AS (
  SELECT m.event_slug, m.email, m.company, m.interactions AS value, f.threshold, k.kind,
         CASE k.kind WHEN 0 THEN 'engagement_interactions' ELSE 'stalled_high_engagement' END AS metric
  FROM metrics m JOIN fences f USING (event_slug) LEFT JOIN quiet q ON q.event_slug = m.event_slug AND q.email = m.email,
       (SELECT unnest([0, 1]) AS kind) k
  WHERE m.interactions > 0 AND m.interactions >= f.threshold AND (k.kind = 0 OR q.email IS NOT NULL)),
listed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_slug ORDER BY value DESC, email, kind) AS rank FROM flagged) WHERE rank <= 12)"""


def _anomalies(v):
    seeded = M.changes(v("lifecycle")).filter("source = 'seeded'")
    return E.anomalies(metrics(v), seeded)


@query("engagement_anomalies", "TOP5", f"WITH {ANOMALY} SELECT event_slug, email, company, value, threshold, metric, rank FROM listed")
def _(v):
    return _anomalies(v).select("event_slug", "email", "company", "value", "threshold", "metric", "rank")


@query("anomaly_evidence", "WIN10 TOP5", f"""WITH {ANOMALY} SELECT event_slug, email, event_id, type, asset, evidence_no FROM (
  SELECT e.*, row_number() OVER (PARTITION BY e.event_slug, e.email ORDER BY e.event_id) AS evidence_no
  FROM {{engagement}} e WHERE (e.event_slug, e.email) IN (SELECT event_slug, email FROM listed)) WHERE evidence_no <= 8""")
def _(v):
    return E.evidence(_anomalies(v), v("engagement")).select("event_slug", "email", "event_id", "type", "asset", "evidence_no")


@query("anomaly_evidence_rows", "TOP5", f"""WITH {ANOMALY}, h AS (SELECT event_slug, email, count(*) AS n FROM {{lifecycle}} WHERE source = 'seeded' GROUP BY 1, 2),
f AS (SELECT l.event_slug, l.email, l.metric AS anomaly, m.opens, m.clicks, m.pageviews, m.form_fills, m.last_engaged, coalesce(h.n, 0) AS n FROM listed l JOIN metrics m USING (event_slug, email) LEFT JOIN h USING (event_slug, email))
SELECT event_slug, email, anomaly, unnest([0, 1, 2, 3, 4, 5]) AS no, unnest(['opens', 'clicks', 'pageviews', 'form_fills', 'last_engaged', 'lifecycle_history']) AS metric,
  unnest([opens::VARCHAR, clicks::VARCHAR, pageviews::VARCHAR, form_fills::VARCHAR, strftime(last_engaged, '%Y-%m-%d %H:%M'), n::VARCHAR]) AS value FROM f
UNION ALL SELECT f.event_slug, f.email, anomaly, 5 + rn, 'event:' || type, asset FROM f JOIN (SELECT *, row_number() OVER (PARTITION BY event_slug, email ORDER BY event_id) AS rn FROM {{engagement}}) e USING (event_slug, email) WHERE rn <= 8
UNION ALL SELECT event_slug, email, anomaly, 14, 'stage_transitions', '0' FROM f WHERE anomaly = 'stalled_high_engagement'""")
def _(v):
    rows = E.evidence_rows(_anomalies(v), E.counters(v("engagement")), M.changes(v("lifecycle")).filter("source = 'seeded'"), v("engagement"))
    minute = F.when(F.col("metric") == "last_engaged", F.substring("value", 1, 16)).otherwise(F.col("value"))
    return rows.select("event_slug", "email", "anomaly", "no", "metric", minute.alias("value"))


@query("movement_windows", "AGG20 DT4", f"""WITH {ASOF}
SELECT a.event_slug, w.days, count(h.email) AS transitions, count(DISTINCT h.email) AS contacts,
       strftime(a.as_of - to_days(w.days::INTEGER), '%Y-%m-%d %H:%M:%S') AS window_start, strftime(a.as_of, '%Y-%m-%d %H:%M:%S') AS window_end
FROM newest a CROSS JOIN (SELECT unnest([7, 14, 30]) AS days) w LEFT JOIN hits h ON h.event_slug = a.event_slug AND h.days = w.days
GROUP BY 1, 2, a.as_of""")
def _(v):
    f = "yyyy-MM-dd HH:mm:ss"
    return M.windows(M.changes(v("lifecycle")), now(v)).select(
        "event_slug", "days", "transitions", "contacts", F.date_format("window_start", f).alias("window_start"),
        F.date_format("window_end", f).alias("window_end"))


@query("movement_breakdown", "AGG20", f"""WITH {ASOF}
SELECT event_slug, days, 'stage' AS kind, stage AS value, count(*) AS n FROM hits GROUP BY ALL
UNION ALL SELECT event_slug, days, 'source', source, count(*) FROM hits GROUP BY ALL
UNION ALL SELECT event_slug, days, 'day', strftime(ts, '%Y-%m-%d'), count(*) FROM hits GROUP BY ALL""")
def _(v):
    return M.breakdown(M.changes(v("lifecycle")), now(v))


@query("movement_disclosure", "AGG21", f"""WITH {ASOF},
daily AS (SELECT event_slug, days, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (WHERE source = 'seeded') AS s FROM hits GROUP BY 1, 2, 3),
facts AS (SELECT event_slug, days, sum(n)::BIGINT AS total, sum(s)::BIGINT AS seeded, count(*) AS dates, max(n) AS peak FROM daily GROUP BY 1, 2),
told AS (SELECT f.event_slug, f.days, total, seeded, dates, peak,
       (SELECT min(day) FROM daily d WHERE d.event_slug = f.event_slug AND d.days = f.days AND d.n = f.peak) AS peak_day,
       (peak > total / 2 AND dates <= 2) AS bunched FROM facts f)
SELECT *, coalesce(nullif(concat_ws('; ', CASE WHEN seeded > 0 THEN seeded || ' of ' || total || ' moves stem from seeding' END,
  CASE WHEN seeded > 0 AND total > seeded THEN (total - seeded) || ' are recorded by the CRM' END,
  CASE WHEN bunched THEN peak || ' of ' || total || ' fall on ' || peak_day END), ''), 'all ' || total || ' moves are recorded by the CRM') AS disclosure FROM told""")
def _(v):
    return M.disclosure(M.changes(v("lifecycle")), now(v))


@query("movement_timeline", "AGG22", f"WITH {CHANGES} SELECT event_slug, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM changes GROUP BY 1, 2")
def _(v):
    return M.timeline(M.changes(v("lifecycle")))


@query("data_as_of", "AGG20", f"WITH {ASOF} SELECT event_slug, strftime(as_of, '%Y-%m-%d %H:%M:%S') AS as_of FROM newest")
def _(v):
    return now(v).withColumn("as_of", F.date_format("as_of", "yyyy-MM-dd HH:mm:ss"))


@query("stream_coverage", "AGG33 SET5", f"""WITH {COUNTERS},
keys AS (SELECT event_slug, email FROM counts UNION SELECT event_slug, email FROM {{lifecycle}}),
moved AS (SELECT DISTINCT event_slug, email FROM {{lifecycle}})
SELECT k.event_slug, count(*) AS contacts_matched, sum(coalesce(opens + clicks + pageviews + form_fills, 0))::BIGINT AS events_written,
       count(m.email) AS stage_updates
FROM keys k LEFT JOIN counts c USING (event_slug, email) LEFT JOIN moved m USING (event_slug, email)
WHERE (k.event_slug, k.email) IN (SELECT event_slug, email FROM {{crm}}) GROUP BY 1""")
def _(v):
    return E.stream_coverage(E.counters(v("engagement")), M.final_stages(M.changes(v("lifecycle"))), v("crm"))


@query("seed_cut_labels", "STM8", f"""WITH {CHANGES}
SELECT c.event_slug, CASE WHEN c.ts >= r.cut THEN 'seeded' ELSE 'crm_history' END AS source, count(*) AS n
FROM changes c LEFT JOIN (SELECT event_slug, min(ts) AS cut FROM {{engagement}} GROUP BY 1) r USING (event_slug) GROUP BY 1, 2""")
def _(v):
    runs = v("engagement").groupBy("event_slug").agg(F.min("ts").alias("seed_started"))
    return M.seed_labelled(M.changes(v("lifecycle")), runs).groupBy("event_slug", "source").agg(F.count(F.lit(1)).alias("n"))
