"""CRM payload, plan, snapshot and report queries."""

from pyspark.sql import functions as F

from turnout.functions import contact as C, fixed
from turnout.operators import crm as K, engagement as E, messages as G, movement as M, reports as P, speakers as S
from turnout.queries.analytics import ACCOUNTS, ANOMALY, ASOF, CHANGES, COUNTERS, FUNNEL, METRICS, TOPC, _anomalies, metrics, now
from turnout.queries.audience import SEG
from turnout.queries.identity import PAIRED
from turnout.queries.registry import query
from turnout.queries.rows import RULES, inlist, table


def directory(v):
    """Owner directory: every supplier is an owner; the first one holds the mapped address."""
    return v.sql("""SELECT CASE WHEN s_suppkey = (SELECT min(s_suppkey) FROM {supplier}) THEN 'crm.owner@host.example'
                    ELSE lower(s_name) END AS owner_email, s_suppkey + 7000 AS owner_id FROM {supplier}""")


@query("owner_routing", "JN18", f"""WITH {table('om', RULES.owner_map)}, d AS (SELECT CASE WHEN s_suppkey = (SELECT min(s_suppkey) FROM {{supplier}}) THEN 'crm.owner@host.example' ELSE lower(s_name) END AS m, s_suppkey + 7000 AS i FROM {{supplier}})
SELECT row_idx, coalesce(d.i, -1) AS owner_id, CASE WHEN om.v IS NULL THEN 'no owner for region ''' || e.region || '''' WHEN d.i IS NULL THEN 'owner ''' || om.v || ''' not in the directory' ELSE '' END AS owner_skip
FROM {{enriched}} e LEFT JOIN om ON om.k = upper(trim(e.region)) LEFT JOIN d ON d.m = om.v""")
def _(v):
    return K.owner_ids(v("enriched"), RULES, directory(v)).select("row_idx", F.coalesce("owner_id", F.lit(-1)).alias("owner_id"), "owner_skip")


@query("contact_payload", "PRJ32", """SELECT event_slug, email, firstname, lastname, jobtitle, company, country, icp_tier, attendance_status,
  CASE WHEN needs_review THEN 'true' ELSE 'false' END AS needs_review, 'run-1' AS event_tag, nullif(lifecyclestage, '') AS lifecyclestage FROM {enriched}""")
def _(v):
    return K.contact_payload(v("enriched"), "run-1")


@query("speaker_payload", "PRJ32", f"""WITH {PAIRED} SELECT p.event_slug, p.email, split_part(name, ' ', 1) AS firstname, split_part(name, ' ', 2) AS lastname, trim(title) AS jobtitle,
  trim(company) AS company, 'evangelist' AS lifecyclestage, 'run-1' AS event_tag FROM paired p JOIN {{speakers}} s USING (event_slug, speaker_no) WHERE p.email <> ''""")
def _(v):
    return K.speaker_payload(S.paired_by_local(v("speakers"), v("speaker_inboxes")), "run-1")


@query("quarantine", "PRJ33", """SELECT row_idx, concat_ws('; ', CASE WHEN contains(trim(email), ' ') OR trim(email) NOT LIKE '%@%.%' THEN 'invalid address' END,
  CASE WHEN trim(first_name) = 'Test' THEN 'test record' END, CASE WHEN trim(minutes) <> '' AND try_cast(trim(minutes) AS DOUBLE) IS NULL THEN 'minutes not a number' END) AS reason
  FROM {registrants} WHERE trim(first_name) = 'Test' OR (trim(minutes) <> '' AND try_cast(trim(minutes) AS DOUBLE) IS NULL)""")
def _(v):
    mail, minutes = F.trim("email"), F.trim("minutes")
    _ok, bad = K.quarantined(v("registrants"), {
        "invalid address": mail.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "test record": F.trim("first_name") != "Test",
        "minutes not a number": (minutes == "") | minutes.try_cast("double").isNotNull()})
    return bad.select("row_idx", "reason")


COMPANIES = """co AS (SELECT event_slug, company_domain AS domain, arg_min(company, row_idx) AS name, arg_min(industry, row_idx) AS industry,
  arg_min(numemployees, row_idx) AS numemployees FROM {enriched} WHERE company_domain <> '' GROUP BY 1, 2),
held AS (SELECT lower(domain) AS domain, min(vid) AS id FROM (SELECT split_part(email, '@', 2) AS domain, vid FROM {crm} WHERE lead_status = 'OPEN') GROUP BY 1)"""


def company_rows(v):
    return v("enriched").filter("company_domain <> ''").groupBy("event_slug", F.col("company_domain").alias("domain")).agg(
        *[F.min_by(c, "row_idx").alias(a) for c, a in (("company", "name"), ("industry", "industry"), ("numemployees", "numemployees"))])


def portal_ids(v):
    return v("crm").filter("lead_status = 'OPEN'").select(F.upper(C.mail_domain(F.col("email"))).alias("domain"), F.col("vid").alias("id"))


@query("company_upsert_plan", "JN16 PRJ27", f"""WITH {COMPANIES}, {table('ci', fixed.CRM_INDUSTRY)}
SELECT c.event_slug, c.domain, c.name, c.numemployees, coalesce(ci.v, '') AS industry, coalesce(h.id, -1) AS id, CASE WHEN h.id IS NULL THEN 'create' ELSE 'update' END AS action
FROM co c LEFT JOIN held h USING (domain) LEFT JOIN ci ON ci.k = lower(trim(c.industry))""")
def _(v):
    plan = K.upsert_plan(K.company_payload(company_rows(v), "run-1"), portal_ids(v), "domain")
    return plan.select("event_slug", "domain", "name", "numemployees", F.coalesce("industry", F.lit("")).alias("industry"),
                       F.coalesce("id", F.lit(-1)).alias("id"), "action")


def write_results(v):
    """Write answers as a CRM returns them: an array of (id, email, domain) per order-sized call."""
    rows = v("crm").select(F.floor(F.col("vid") / 50).alias("call_no"), "vid", "email", C.mail_domain(F.col("email")).alias("domain"))
    return rows.groupBy("call_no").agg(F.array_sort(F.collect_list(F.struct(F.col("vid").alias("id"), "email", "domain"))).alias("results"))


@query("written_ids", "JN35", "SELECT split_part(email, '@', 2) AS domain, max(vid) AS id FROM {crm} GROUP BY 1")
def _(v):
    return K.id_map(write_results(v), "domain")


LINKED = """ids AS (SELECT split_part(email, '@', 2) AS domain, max(vid) AS id FROM {crm} GROUP BY 1), cids AS (SELECT email, max(vid) AS id FROM {crm} GROUP BY 1),
lk AS (SELECT e.event_slug, c.id AS contact_id, d.id AS company_id FROM {enriched} e LEFT JOIN cids c ON c.email = e.email LEFT JOIN ids d ON d.domain = e.company_domain)"""


@query("associations", "JN17 JN35", f"WITH {LINKED} SELECT * FROM lk WHERE contact_id IS NOT NULL AND company_id IS NOT NULL")
def _(v):
    res = write_results(v)
    return K.associations(v("enriched"), K.id_map(res, "domain"), K.id_map(res, "email"))[0]


@query("association_counts", "JN17", f"WITH {LINKED} SELECT event_slug, count(*) FILTER (WHERE contact_id IS NOT NULL AND company_id IS NOT NULL) AS linked, count(*) FILTER (WHERE contact_id IS NULL OR company_id IS NULL) AS skipped FROM lk GROUP BY 1")
def _(v):
    res = write_results(v)
    return K.associations(v("enriched"), K.id_map(res, "domain"), K.id_map(res, "email"))[1]


@query("email_log_entries", "JN32", """WITH s AS (SELECT event_slug, CAST(floor(event_id / 25) AS BIGINT) AS batch_no, email, asset FROM {engagement} WHERE event_slug <> 'ev2'), c AS (SELECT email, max(vid) AS id FROM {crm} GROUP BY 1)
SELECT event_slug, batch_no, s.email, c.id AS contact_id, count(*) AS n FROM s JOIN c USING (email) GROUP BY 1, 2, 3, 4""")
def _(v):
    batches = v("engagement").groupBy("event_slug", F.floor(F.col("event_id") / 25).alias("batch_no")).agg(
        F.lit("Recap").alias("subject"), F.array_sort(F.collect_list(F.struct(F.col("email").alias("to")))).alias("sends"))
    gates = v("event_dim").select("event_slug", (F.col("event_slug") != "ev2").alias("approved"))
    entries, _n = K.email_log(batches, K.id_map(write_results(v), "email"), gates)
    return entries.groupBy("event_slug", "batch_no", "email", "contact_id").agg(F.count(F.lit(1)).alias("n"))


@query("write_reconciliation", "AGG32", """WITH w AS (SELECT event_slug AS event_tag, count(*) AS written FROM {enriched} GROUP BY 1), f AS (SELECT event_slug AS event_tag, count(*) AS found FROM {crm} WHERE lead_status = 'OPEN' GROUP BY 1)
SELECT coalesce(w.event_tag, f.event_tag) AS event_tag, coalesce(written, 0) AS written, coalesce(found, 0) AS found, coalesce(written, 0) - coalesce(found, 0) AS missing FROM w FULL JOIN f USING (event_tag)""")
def _(v):
    tag = F.col("event_slug").alias("event_tag")
    return K.reconciled(v("enriched").select(tag), v("crm").filter("lead_status = 'OPEN'").select(tag))


# --- snapshot -----------------------------------------------------------------------
def segment_list(v):
    return G.segments(v("enriched")).select("event_slug", "segment", F.upper("email").alias("email"))


@query("no_shows", "SET3", f"WITH {SEG} SELECT event_slug, email FROM seg WHERE segment = 'no_show' EXCEPT SELECT event_slug, email FROM seg WHERE segment = 'attendee'")
def _(v):
    return K.no_shows(segment_list(v))


UNION = SEG + """, keys AS (SELECT event_slug, email FROM {crm} UNION SELECT event_slug, email FROM {engagement} WHERE type <> 'error' UNION SELECT event_slug, email FROM {lifecycle} UNION SELECT event_slug, email FROM seg)"""


@query("snapshot_keys", "SET2", f"WITH {UNION} SELECT * FROM keys")
def _(v):
    return K.key_union(v("crm"), E.counters(v("engagement")), M.final_stages(M.changes(v("lifecycle"))), segment_list(v))


@query("matched_keys", "SET5", "SELECT event_slug, email FROM {engagement} INTERSECT SELECT event_slug, email FROM {crm}")
def _(v):
    return K.matched_keys(v("engagement"), v("crm"))


FREE = inlist(fixed.FREEMAIL_WIDE)
DOMCO = f"""domco AS (SELECT event_slug, split_part(email, '@', 2) AS domain, arg_min(company, vid) AS dc FROM {{crm}} WHERE company <> '' AND split_part(email, '@', 2) NOT IN {FREE} GROUP BY 1, 2)"""


@query("domain_company", "JN14", f"WITH {DOMCO} SELECT event_slug, domain, dc AS domain_company FROM domco")
def _(v):
    return K.company_of_domain(v("crm"))


PRETTY = "array_to_string(list_transform(string_split(replace(split_part({d}, '.', 1), '-', ' '), ' '), lambda q: upper(left(q, 1)) || substr(q, 2)), ' ')"


@query("contact_snapshot", "JN13 JN14 SET2 SRC7 SET3", f"""WITH {UNION}, {DOMCO}, {COUNTERS}, {CHANGES}, {table('rg', {c: r for r, cs in RULES.regions.items() for c in cs})}, {table('ow', RULES.owners)},
fin AS (SELECT event_slug, email, stage FROM (SELECT *, row_number() OVER (PARTITION BY event_slug, email ORDER BY ts DESC, row_idx) AS rn FROM changes) WHERE rn = 1),
c AS (SELECT event_slug, email, vid, firstname, lastname, company, jobtitle, lifecyclestage FROM (SELECT *, row_number() OVER (PARTITION BY event_slug, email ORDER BY vid DESC) AS rn FROM {{crm}}) WHERE rn = 1),
geo AS (SELECT id + 100000 AS vid, country FROM {{contacts}}),
j AS (SELECT k.event_slug, k.email, c.* EXCLUDE (event_slug, email), coalesce(rg.v, '') AS region, CASE WHEN split_part(k.email, '@', 2) IN {FREE} THEN NULL ELSE split_part(k.email, '@', 2) END AS domain
  FROM keys k LEFT JOIN c USING (event_slug, email) LEFT JOIN geo ON geo.vid = c.vid LEFT JOIN rg ON rg.k = upper(trim(geo.country)))
SELECT j.event_slug, j.email, coalesce(vid::VARCHAR, '') AS contact_id, coalesce(nullif(company, ''), dc, {PRETTY.format(d='j.domain')}, '') AS company, coalesce(f.stage, lifecyclestage, '') AS lifecyclestage,
  coalesce(opens, 0) AS opens, coalesce(form_fills, 0) AS form_fills, region, coalesce(ow.v, '') AS owner,
  CASE WHEN (j.event_slug, j.email) IN (SELECT event_slug, email FROM seg WHERE segment = 'attendee') THEN 'attended' WHEN (j.event_slug, j.email) IN (SELECT event_slug, email FROM seg WHERE segment = 'no_show') THEN 'no_show' ELSE '' END AS attendance_status
FROM j LEFT JOIN domco d ON d.event_slug = j.event_slug AND d.domain = j.domain LEFT JOIN counts n ON n.event_slug = j.event_slug AND n.email = j.email
LEFT JOIN fin f ON f.event_slug = j.event_slug AND f.email = j.email LEFT JOIN ow ON ow.k = j.region""")
def _(v):
    return snapshot(v).select("event_slug", "email", "contact_id", "company", "lifecyclestage", "opens", "form_fills", "region", "owner", "attendance_status")


def snapshot(v):
    crm = v("crm").join(v("contacts").select((F.col("id") + 100000).alias("vid"), "country"), "vid", "left")
    return K.snapshot(crm, E.counters(v("engagement")), M.final_stages(M.changes(v("lifecycle"))), segment_list(v), RULES)


@query("contact_overlay", "JN33", """SELECT c.id AS contact_id, c.email, CASE WHEN x.jobtitle IS NULL THEN c.jobtitle ELSE x.jobtitle END AS jobtitle, coalesce(x.company, c.company) AS company, coalesce(x.lead_status, '') AS lead_status
  FROM {contacts} c LEFT JOIN (SELECT vid - 100000 AS id, nullif(jobtitle, '') AS jobtitle, upper(company) AS company, lead_status FROM {crm}) x USING (id)""")
def _(v):
    base = v("contacts").select(F.col("id").alias("contact_id"), "email", "jobtitle", "company")
    detail = v("crm").select((F.col("vid") - 100000).alias("contact_id"), F.nullif(F.col("jobtitle"), F.lit("")).alias("jobtitle"),
                             F.upper("company").alias("company"), "lead_status")
    return K.overlay(base, detail).withColumn("lead_status", F.coalesce("lead_status", F.lit("")))


@query("contact_company_bridge", "JN31 AGG28", f"SELECT event_slug, split_part(email, '@', 2) AS domain, id AS contact_id FROM {{contacts}} WHERE split_part(email, '@', 2) NOT IN {FREE}")
def _(v):
    return K.contact_companies(v("contacts").withColumnRenamed("id", "contact_id"))


@query("portal_companies", "JN31 SET7 AGG28", f"""WITH own AS (SELECT event_slug, split_part(email, '@', 2) AS domain, count(*) AS contacts, arg_min(nullif(company, ''), CASE WHEN company <> '' THEN email END) AS name
  FROM {{contacts}} WHERE split_part(email, '@', 2) NOT IN {FREE} GROUP BY 1, 2),
known AS (SELECT event_slug, company_id AS domain, industry AS name FROM {{vendor_answers}} WHERE company_id NOT IN {FREE})
SELECT k.event_slug, k.domain, coalesce(nullif(k.name, ''), {PRETTY.format(d='k.domain')}) AS name, coalesce(o.contacts, 0) AS contacts, 'portal' AS origin FROM known k LEFT JOIN own o USING (event_slug, domain)
UNION ALL SELECT event_slug, domain, coalesce(name, {PRETTY.format(d='domain')}), contacts, 'derived' FROM own WHERE (event_slug, domain) NOT IN (SELECT event_slug, domain FROM known)""")
def _(v):
    known = v("vendor_answers").filter(~F.col("company_id").isin(*fixed.FREEMAIL_WIDE)).select(
        "event_slug", F.col("company_id").alias("domain"), F.col("industry").alias("name"))
    return K.companies(v("contacts"), known)


@query("email_engagements", "JN34", """SELECT o.o_custkey AS contact_id, o.o_orderkey AS mail_id, strftime(e.ts, '%Y-%m-%d %H:%M') AS ts FROM {orders} o JOIN {events} e ON e.event_id = o.o_orderkey""")
def _(v):
    links = v("orders").groupBy(F.lit("all").alias("event_slug"), F.col("o_custkey").alias("contact_id"), F.floor(F.col("o_orderkey") / 100).alias("page")).agg(
        F.collect_list("o_orderkey").alias("mail_ids"))
    mails = v("events").select(F.col("event_id").alias("mail_id"), F.col("event_type").alias("subject"), "ts")
    return K.email_engagements(links, mails).select("contact_id", "mail_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts"))


# --- reports ---------------------------------------------------------------------------
def report_values(v):
    m = metrics(v)
    acc = E.accounts(m)
    return P.ranked_text(E.top_contacts(m), "email", "top_contacts").unionByName(
        P.ranked_text(E.top_accounts(acc), "company", "top_accounts")).unionByName(
        M.windows(M.changes(v("lifecycle")), now(v)).select(
            "event_slug", F.concat(F.lit("movement_"), F.col("days").cast("string")).alias("field"), F.col("transitions").cast("string").alias("value")).select(
                "event_slug", "value", "field"))


VALUES = ACCOUNTS + ", " + TOPC + f""", {ASOF},
vals AS (SELECT event_slug, 'top_contacts' AS field, string_agg(email, '|' ORDER BY rank) AS value FROM top WHERE rank <= 5 GROUP BY 1
  UNION ALL SELECT event_slug, 'top_accounts', string_agg(company, '|' ORDER BY rank) FROM (SELECT *, row_number() OVER (PARTITION BY event_slug ORDER BY score DESC, company, domain) AS rank FROM accounts) WHERE rank <= 5 GROUP BY 1
  UNION ALL SELECT a.event_slug, 'movement_' || w.days, count(h.email)::VARCHAR FROM newest a CROSS JOIN (SELECT unnest([7, 14, 30]) AS days) w LEFT JOIN hits h ON h.event_slug = a.event_slug AND h.days = w.days GROUP BY 1, 2)"""


@query("model_validator", "JN28", f"""WITH {VALUES}, said AS (SELECT event_slug, field, CASE WHEN field = 'movement_7' THEN '99' ELSE value END AS value FROM vals WHERE field <> 'movement_14'
  UNION ALL SELECT event_slug, 'headcount', '12' FROM {{event_dim}})
SELECT coalesce(c.event_slug, s.event_slug) AS event_slug, coalesce(c.field, s.field) AS field, coalesce(c.value, '') AS computed, coalesce(s.value, '') AS answered,
  CASE WHEN s.value IS NULL THEN 'silent' WHEN c.value IS NOT DISTINCT FROM s.value THEN 'agree' ELSE 'disagree' END AS verdict
FROM vals c FULL JOIN said s ON s.event_slug = c.event_slug AND s.field = c.field""")
def _(v):
    from turnout.session import settled
    computed = settled(report_values(v))
    said = computed.filter("field <> 'movement_14'").withColumn("value", F.when(F.col("field") == "movement_7", "99").otherwise(F.col("value")))
    extra = v("event_dim").select("event_slug", F.lit("12").alias("value"), F.lit("headcount").alias("field"))
    return P.compared(computed, said.unionByName(extra))


@query("ungrounded_scores", "JN28", "SELECT DISTINCT event_slug, email FROM {crm} WHERE (event_slug, email) NOT IN (SELECT event_slug, email FROM {contacts})")
def _(v):
    return P.ungrounded(v("crm"), v("contacts"))


@query("kpi_row", "AGG27", f"""WITH {FUNNEL}, {ACCOUNTS[ACCOUNTS.index('accounts AS'):]}, {ANOMALY[ANOMALY.index('fence AS'):]}, {ASOF}
SELECT s.*, round_even(mqls / attendees, 4) AS mql_rate,
  (SELECT count(*) FROM accounts a WHERE a.event_slug = s.event_slug) AS companies,
  (SELECT least(10, count(*)) FROM accounts a WHERE a.event_slug = s.event_slug AND is_committee) AS committees,
  (SELECT count(*) FROM listed l WHERE l.event_slug = s.event_slug) AS anomalies,
  (SELECT count(*) FROM {{mail_touches}} t WHERE t.event_slug = s.event_slug) AS email_engagements,
  (SELECT count(*) FROM hits h WHERE h.event_slug = s.event_slug AND days = 30) AS movement_30d,
  round_even(round_even(mqls / attendees, 4) * 100, 1) AS mql_rate_pct FROM steps s""")
def _(v):
    m = metrics(v)
    acc = E.accounts(m)
    return P.kpis(E.funnel(m), acc, E.committees(acc), _anomalies(v), v("mail_touches"), M.windows(M.changes(v("lifecycle")), now(v)))


@query("dashboard_contacts", "JN29", f"""WITH {METRICS}, {TOPC}, best AS (SELECT event_slug, max(score) AS b FROM top GROUP BY 1)
SELECT t.event_slug, t.email, rank, round_even(100.0 * score / b, 0)::BIGINT AS rules_score, coalesce(a.confidence, -1)::DOUBLE AS model_score, coalesce(a.rationale, '') AS model_reason
FROM top t JOIN best USING (event_slug) LEFT JOIN {{tier_answers}} a ON a.event_slug = t.event_slug AND a.row_id = t.email WHERE rank <= 10""")
def _(v):
    m = metrics(v)
    answers = v("tier_answers").select("event_slug", F.col("row_id").alias("email"), F.col("confidence").alias("model_score"), F.col("rationale").alias("model_reason"))
    return P.dashboard_contacts(E.top_contacts(m).select("event_slug", "email", "rank"), E.interest_scores(m), answers).select(
        "event_slug", "email", "rank", "rules_score", F.coalesce("model_score", F.lit(-1.0)).alias("model_score"), F.coalesce("model_reason", F.lit("")).alias("model_reason"))


@query("dashboard_committees", "JN29 AGG19", f"""WITH {ACCOUNTS}, com AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_slug ORDER BY engaged_contacts DESC, score DESC, domain) AS rank FROM accounts WHERE is_committee) WHERE rank <= 10),
ans AS (SELECT event_slug, company, min(lastname) AS w FROM {{crm}} WHERE lead_status = 'OPEN' AND company <> '' GROUP BY 1, 2)
SELECT c.event_slug, c.domain, c.company, CASE WHEN ans.w IS NULL THEN 'rules' ELSE 'model' END AS why_source FROM com c LEFT JOIN ans USING (event_slug, company)""")
def _(v):
    answers = v("crm").filter("lead_status = 'OPEN' AND company <> ''").groupBy("event_slug", "company").agg(F.min("lastname").alias("model_why"))
    return P.dashboard_committees(E.committees(E.accounts(metrics(v))), answers).select("event_slug", "domain", "company", "why_source")


@query("call_summary", "AGG26 SNK5", """SELECT event_slug, purpose, model, count(*) AS attempts, count(*) FILTER (WHERE ok) AS completed, count(*) FILTER (WHERE NOT ok) AS failed,
  sum(seconds)::BIGINT AS seconds, max(seconds) AS slowest FROM {call_log} GROUP BY 1, 2, 3""")
def _(v):
    return P.call_summary(v("call_log"))


@query("run_lanes", "AGG26", """WITH b AS (SELECT call_id, count(*) AS batches, count(*) FILTER (WHERE NOT ok) AS parse_failures, sum(CASE WHEN ok THEN seconds ELSE 0 END)::BIGINT AS rows_patched FROM {call_log} GROUP BY 1)
SELECT *, CASE WHEN rows_patched = 0 OR parse_failures >= batches THEN 'degraded' ELSE 'live' END AS lane FROM b""")
def _(v):
    return P.lanes(v("call_log").groupBy("call_id").agg(
        F.count(F.lit(1)).alias("batches"), F.count_if(~F.col("ok")).alias("parse_failures"),
        F.sum(F.when(F.col("ok"), F.col("seconds")).otherwise(0)).cast("bigint").alias("rows_patched")))


@query("run_summary", "AGG34", """WITH r AS (SELECT event_slug, 'contacts' AS measure, CASE WHEN event_slug = 'ev1' THEN NULL ELSE count(*) * 2 END AS n FROM {crm} GROUP BY 1),
c AS (SELECT event_slug, 'contacts' AS measure, count(*) AS n FROM {contacts} GROUP BY 1 UNION ALL SELECT event_slug, 'events', count(*) FROM {engagement} GROUP BY 1)
SELECT coalesce(r.event_slug, c.event_slug) AS event_slug, coalesce(r.measure, c.measure) AS measure, coalesce(r.n, c.n) AS n, CASE WHEN r.n IS NOT NULL THEN 'receipt' WHEN c.n IS NOT NULL THEN 'rows' ELSE 'unknown' END AS origin
FROM r FULL JOIN c ON r.event_slug = c.event_slug AND r.measure = c.measure""")
def _(v):
    def counted(df, name):
        return df.groupBy("event_slug").agg(F.count(F.lit(1)).alias("n")).withColumn("measure", F.lit(name))
    receipts = counted(v("crm"), "contacts").withColumn("n", F.when(F.col("event_slug") != "ev1", F.col("n") * 2))
    return P.summary(receipts, counted(v("contacts"), "contacts").unionByName(counted(v("engagement"), "events")))
