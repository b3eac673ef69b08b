"""Row rules, enrichment and completeness queries with their oracles."""

from pyspark.sql import functions as F

from turnout.functions import contact as C, fixed
from turnout.functions.sql import register
from turnout.operators import enrich as N, quality as Q
from turnout.operators.ordered import batches
from turnout.queries.registry import query
from turnout.session import settled

RULES = C.Rules(host_domains=("machinery-7.com",), competitor_domains=("furniture-3.com", "building-11.com"))


# --- pieces of oracle text, generated from the same fixed tables -----------------
def lit(x):
    return "'" + str(x).replace("'", "''") + "'"


def table(name, mapping):
    return f"{name}(k, v) AS (VALUES " + ", ".join(f"({lit(k)}, {lit(v) if isinstance(v, str) else v})" for k, v in mapping.items()) + ")"


def inlist(xs):
    return "(" + ", ".join(lit(x) for x in xs) + ")"


def cased(col):
    """Capitalise around blanks and hyphens."""
    return (f"array_to_string(list_transform(string_split(trim({col}), ' '), lambda p: array_to_string(list_transform("
            f"string_split(p, '-'), lambda q: upper(left(q, 1)) || lower(substr(q, 2))), '-')), ' ')")


def has(col, *words):
    return "(" + " OR ".join(f"contains({col}, {lit(w)})" for w in words) + ")"


def func_kw(t):
    t = f"lower({t})"
    return (f"CASE WHEN {has(t, 'cmo', 'founder')} THEN 'executive' WHEN {has(t, 'revops')} THEN 'revops' "
            f"WHEN {has(t, 'customer success')} THEN 'customer_success' WHEN {has(t, 'sales development', 'account executive')} THEN 'sales' "
            f"WHEN {has(t, 'marketing', 'demand gen', 'growth')} THEN 'marketing' ELSE 'general' END")


def senior(t):
    t = f"lower({t})"
    return (f"CASE WHEN {has(t, 'cmo', 'founder')} THEN 'c_suite' WHEN starts_with({t}, 'vp ') OR contains({t}, ' vp') THEN 'vp' "
            f"WHEN contains({t}, 'head of') THEN 'head' WHEN contains({t}, 'director') THEN 'director' WHEN ends_with({t}, 'manager') THEN 'manager' "
            f"WHEN contains({t}, 'intern') THEN 'intern' WHEN {has(t, 'specialist', 'analyst', 'coordinator', 'rep', 'executive')} THEN 'individual_contributor' ELSE 'unknown' END")


def by_keyword(c):
    return "CASE " + " ".join(f"WHEN contains(lower({c}), {lit(k)}) THEN {lit(v)}" for k, v in fixed.INDUSTRY_KEYWORDS) + " ELSE 'Other' END"


def by_pattern(c, rules, other):
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, {lit(p)}) THEN {lit(v)}" for v, p in rules) + f" ELSE '{other}' END"


def code(c):
    return (f"CASE WHEN length(trim({c})) <= 2 THEN upper(trim({c})) ELSE coalesce((SELECT v FROM alias WHERE k = lower(trim({c}))), upper(trim({c}))) END")


ALIAS = table("alias", fixed.COUNTRY_ALIASES)
REGION = table("region_cfg", {c: r for r, cs in RULES.regions.items() for c in cs})
FALLBACK = table("region_fb", {c: r for r, cs in fixed.FALLBACK_REGIONS.items() for c in cs})
OWNER = table("owner_cfg", RULES.owners)
STAGES = table("stage_rank", fixed.STAGE_RANK)
SYN = table("synonym", fixed.INDUSTRY_SYNONYMS)
LEVEL = table("level", fixed.TIER_LEVEL)


def headcount(seed):
    b = [f"('0x' || substr(md5({seed}), {2 * i + 1}, 2))::BIGINT" for i in range(3)]
    return (f"CASE WHEN {b[0]} % 100 < 55 THEN 5 + {b[1]} % 46 WHEN {b[0]} % 100 < 85 THEN 50 + {b[1]} % 151 "
            f"ELSE 200 + {b[1]} % 400 + ({b[2]} % 12) * 400 END")


def tier(title, size, industry):
    whens = []
    for t in RULES.tiers[:-1]:
        whens.append(f"WHEN lower({title}) IN {inlist(x.lower() for x in t.titles)} AND {size} BETWEEN {t.size[0]} AND {t.size[1]} "
                     f"AND {industry} IN {inlist(t.industries)} THEN '{t.name}'")
    last = RULES.tiers[-1]
    return "CASE " + " ".join(whens) + f" WHEN {size} BETWEEN {last.size[0]} AND {last.size[1]} THEN 'tier3' ELSE 'unqualified' END"


def target(t, attended, minutes):
    return (f"CASE WHEN {t} = 'tier1' AND {attended} AND coalesce(try_cast(nullif({minutes}, '') AS DOUBLE) >= 25, false) THEN 'marketingqualifiedlead' "
            f"WHEN {t} IN ('tier1', 'tier2') THEN 'lead' ELSE 'subscriber' END")


PREP = f"""prep AS (
  SELECT row_idx, event_slug, email, split_part(email, '@', 1) AS local, CASE WHEN contains(email, '@') THEN split_part(email, '@', -1) ELSE '' END AS domain,
         {cased('first_name')} AS firstname, {cased('last_name')} AS lastname, company_raw,
         regexp_replace(lower(company_raw), '\\s+', ' ', 'g') AS company_key, trim(job_title) AS jobtitle_raw, country, attended = 'Yes' AS attended, minutes,
         CASE WHEN lower(trim(first_name)) IN {inlist(fixed.PLACEHOLDER_NAMES)} AND lower(trim(last_name)) IN {inlist(fixed.PLACEHOLDER_NAMES)} THEN 'placeholder_name'
              WHEN split_part(email, '@', 1) IN {inlist(fixed.PLACEHOLDER_LOCALS)} THEN 'placeholder_mailbox'
              WHEN split_part(email, '@', 1) = split_part(split_part(email, '@', -1), '.', 1) THEN 'mirrors_domain' ELSE '' END AS reject_reason
  FROM (SELECT *, lower(trim(email_raw)) AS email, trim(company) AS company_raw FROM (SELECT * RENAME (email AS email_raw) FROM {{registrants}}))),
kept AS (SELECT * FROM prep WHERE reject_reason = '')"""


def vote(name, keys, value, source, prefer="0"):
    ks = ", ".join(keys)
    return f"""{name} AS (SELECT {ks}, {value} AS pick FROM (
  SELECT {ks}, {value}, row_number() OVER (PARTITION BY {ks} ORDER BY count(*) DESC, {prefer} DESC, min(row_idx)) AS rn
  FROM {source} GROUP BY {ks}, {value}) WHERE rn = 1)"""


MIXED = "CASE WHEN upper(company_raw) = lower(company_raw) OR (company_raw <> upper(company_raw) AND company_raw <> lower(company_raw)) THEN 1 ELSE 0 END"
VOTES = f"""{PREP},
{vote('spell', ['event_slug', 'company_key'], 'company_raw', "kept WHERE company_raw <> ''", MIXED)},
named AS (SELECT k.* EXCLUDE (company_raw), CASE WHEN k.company_raw <> '' THEN s.pick ELSE '' END AS company_raw
          FROM kept k LEFT JOIN spell s USING (event_slug, company_key)),
{vote('dom', ['event_slug', 'domain'], 'company_raw', f"named WHERE company_raw <> '' AND domain NOT IN {inlist(fixed.FREEMAIL_BASIC)}")},
{vote('ttl', ['event_slug', 'company_key'], 'jobtitle_raw', "named WHERE company_raw <> '' AND jobtitle_raw <> ''")}"""
CASCADE = f"""{VOTES}, {ALIAS}, {REGION}, {FALLBACK}, {OWNER},
c1 AS (SELECT n.*, CASE WHEN n.company_raw <> '' THEN n.company_raw ELSE coalesce(d.pick, 'Unknown') END AS company
       FROM named n LEFT JOIN dom d USING (event_slug, domain)),
c2 AS (SELECT c1.*, CASE WHEN jobtitle_raw <> '' THEN jobtitle_raw ELSE coalesce(t.pick, 'Attendee') END AS jobtitle,
              CASE WHEN company = 'Unknown' THEN 'Unknown' ELSE {by_keyword('company')} END AS industry
       FROM c1 LEFT JOIN ttl t ON t.event_slug = c1.event_slug AND t.company_key = regexp_replace(lower(trim(company)), '\\s+', ' ', 'g')),
c3 AS (SELECT *, industry = 'Other' AND length(regexp_replace(company, '[^\\p{{L}}]', '', 'g')) > 0 AND
        (length(regexp_replace(company, '[^\\p{{L}}]', '', 'g')) - length(regexp_replace(company, '[^A-Za-z]', '', 'g')))::DOUBLE / greatest(1, length(regexp_replace(company, '[^\\p{{L}}]', '', 'g'))) > 0.5 AS unread,
        {code('country')} AS code FROM c2),
cas AS (SELECT row_idx, event_slug, email, firstname, lastname, jobtitle, company, industry,
   CASE WHEN company = 'Unknown' THEN 10 ELSE {headcount(f"CASE WHEN domain NOT IN {inlist(fixed.FREEMAIL_BASIC)} THEN domain ELSE regexp_replace(lower(trim(company)), '\\s+', ' ', 'g') END")} END AS numemployees,
   {func_kw('jobtitle')} AS function, {senior('jobtitle')} AS seniority,
   coalesce((SELECT v FROM region_cfg WHERE k = code), (SELECT v FROM region_fb WHERE k = code), 'UNASSIGNED') AS region,
   CASE WHEN attended THEN 'attended' ELSE 'no_show' END AS attendance_status, minutes, country,
   greatest(0.05, least(1.0, round_even(1.0 - CASE WHEN company_raw <> '' THEN 0 WHEN company = 'Unknown' THEN 0.25 ELSE 0.10 END
     - CASE WHEN jobtitle_raw = '' THEN 0.15 ELSE 0 END - CASE WHEN unread THEN 0.30 ELSE 0 END - 0.05, 2)))::DOUBLE AS confidence,
   unread AS needs_review, CASE WHEN domain IN {inlist(fixed.FREEMAIL_BASIC)} THEN '' ELSE domain END AS company_domain,
   CASE WHEN domain = 'machinery-7.com' THEN 'host company domain (''' || domain || ''')'
        WHEN domain IN ('furniture-3.com', 'building-11.com') THEN 'competitor domain (''' || domain || ''')' ELSE '' END AS suppression_reason
   FROM c3)"""
KEYED = CASCADE + """, keyed AS (SELECT *, CASE WHEN company_domain <> '' THEN company_domain
   WHEN company <> 'Unknown' AND company <> '' THEN 'name:' || regexp_replace(lower(trim(company)), '\\s+', ' ', 'g') ELSE '' END AS company_id FROM cas)"""


def prep(v):
    return N.people(N.prepared(v("registrants")))


def named(v):
    rows = prep(v)
    return settled(N.respelled(rows, N.canonical_spelling(rows)))


def cascade(v):
    rows = named(v)
    return settled(N.cascade(rows, rows, RULES))


# --- row rules ----------------------------------------------------------------------
@query("prepared_registrants", "PRJ1 PRJ2 PRJ3", f"WITH {PREP} SELECT * EXCLUDE (reject_reason) FROM kept")
def _(v):
    return prep(v).drop("title_source", "company_source", "is_speaker")


@query("placeholder_rows", "PRJ19", f"WITH {PREP} SELECT event_slug, row_idx, email, reject_reason FROM prep WHERE reject_reason <> ''")
def _(v):
    return N.rejected(N.prepared(v("registrants")))


@query("contact_labels", "PRJ4 PRJ5 PRJ6 PRJ7 PRJ8 PRJ9 PRJ15 PRJ21", f"""SELECT id, {by_keyword('company')} AS industry_rule, {func_kw('jobtitle')} AS function_keyword,
  {by_pattern('trim(jobtitle)', fixed.FUNCTION_PATTERNS, 'general')} AS function_pattern, {senior('jobtitle')} AS seniority,
  {by_pattern('trim(company)', fixed.BUCKET_PATTERNS, 'other_commercial')} AS bucket, firstname || ' ' || lastname AS display_name,
  array_to_string(list_transform(string_split(replace(split_part(domain, '.', 1), '-', ' '), ' '), lambda q: upper(left(q, 1)) || substr(q, 2)), ' ') AS display_company,
  CASE WHEN lower(jobtitle) IN {inlist(x.lower() for x in RULES.tiers[0].titles)} THEN 'tier1' WHEN lower(jobtitle) IN {inlist(x.lower() for x in RULES.tiers[1].titles)} THEN 'tier2' ELSE 'tier3' END AS title_tier,
  starts_with(company, 'Компания') AS non_ascii FROM {{contacts}}""")
def _(v):
    c = F.col
    return v("contacts").select(
        "id", C.industry_of_company(c("company")).alias("industry_rule"), C.function_by_keyword(c("jobtitle")).alias("function_keyword"),
        C.function_by_pattern(c("jobtitle")).alias("function_pattern"), C.seniority(c("jobtitle")).alias("seniority"),
        C.bucket_of_industry(c("company")).alias("bucket"), C.display_name(c("firstname"), c("lastname"), c("email")).alias("display_name"),
        C.display_company(c("domain")).alias("display_company"), RULES.tier_by_title(c("jobtitle")).alias("title_tier"),
        C.mostly_non_ascii(c("company")).alias("non_ascii"))


@query("synthetic_headcount", "PRJ11 HSH1", f"SELECT DISTINCT domain, {headcount('domain')} AS size FROM {{contacts}}")
def _(v):
    return v("contacts").select("domain").distinct().withColumn("size", C.synthetic_headcount(F.col("domain")))


@query("country_routing", "PRJ12 PRJ13 SRC4", f"""WITH {ALIAS}, {REGION}, {FALLBACK}, {OWNER},
coded AS (SELECT id, trim(country) AS raw, {code('country')} AS code FROM {{contacts}}),
placed AS (SELECT *, coalesce((SELECT v FROM region_cfg WHERE k = code), (SELECT v FROM region_fb WHERE k = code), 'UNASSIGNED') AS region FROM coded)
SELECT id, code, region, coalesce((SELECT v FROM owner_cfg WHERE k = CASE WHEN region = 'UNASSIGNED' THEN 'AMER' ELSE region END), '') AS owner,
  coalesce((SELECT v FROM region_cfg WHERE k = upper(raw)), '') AS plain_region FROM placed""")
def _(v):
    placed = v("contacts").withColumn("region", RULES.region(F.col("country")))
    return placed.select("id", C.country_code(F.col("country")).alias("code"), "region", RULES.owner(F.col("region")).alias("owner"),
                                RULES.region_plain(F.col("country")).alias("plain_region"))


@query("tier_and_stage", "PRJ14 PRJ16 PRJ17 PRJ18", f"""WITH {STAGES},
t AS (SELECT c.id, {tier('c.jobtitle', 'c.numemployees', 'c.industry')} AS tier, attended = 'Yes' AS came, minutes, l.stage AS existing
      FROM {{contacts}} c LEFT JOIN {{latest_stage}} l ON l.contact_id = c.id),
u AS (SELECT *, {target('tier', 'came', 'minutes')} AS target FROM t)
SELECT id, tier, target, CASE WHEN existing IS NOT NULL AND (SELECT v FROM stage_rank WHERE k = existing) >= (SELECT v FROM stage_rank WHERE k = target) THEN existing ELSE target END AS stage,
  (SELECT v FROM stage_rank WHERE k = existing)::INTEGER AS rank FROM u""")
def _(v):
    j = v("contacts").join(v("latest_stage").withColumnRenamed("contact_id", "id"), "id", "left").withColumnRenamed("stage", "existing")
    t, _why = RULES.tier_rule(F.col("jobtitle"), F.col("numemployees"), F.col("industry"))
    j = j.withColumn("tier", t).withColumn("target", C.target_stage(F.col("tier"), F.col("attended") == "Yes", F.col("minutes")))
    return j.select("id", "tier", "target", C.guarded_stage(F.col("existing"), F.col("target")).alias("stage"),
                    C.stage_rank(F.col("existing")).alias("rank"))


@query("tier_rationale", "PRJ14", f"""WITH t AS (SELECT *, {tier('jobtitle', 'numemployees', 'industry')} AS tier FROM {{contacts}})
SELECT id, CASE tier {" ".join(f"WHEN '{t.name}' THEN '{t.name}: title ' || jobtitle || ' listed, size ' || numemployees || ' within {t.size[0]}-{t.size[1]}, industry ' || industry || ' served'" for t in RULES.tiers[:-1])}
  WHEN 'tier3' THEN 'tier3: any title (' || jobtitle || '), size ' || numemployees || ' within 1-200, any industry'
  ELSE 'unqualified: no tier fits title ' || jobtitle || ', size ' || numemployees || ', industry ' || industry END AS rationale FROM t""")
def _(v):
    _tier, why = RULES.tier_rule(F.col("jobtitle"), F.col("numemployees"), F.col("industry"))
    return v("contacts").select("id", why.alias("rationale"))


@query("stage_names", "PRJ18", """SELECT row_idx, regexp_replace(lower(raw_stage), '(_pending|_new)$', '') AS stage,
  CASE WHEN regexp_replace(lower(raw_stage), '_pending$', '') IN ('subscriber','lead','marketingqualifiedlead','salesqualifiedlead','opportunity','customer','evangelist','other')
       THEN regexp_replace(lower(raw_stage), '_pending$', '') ELSE '' END AS crm_stage FROM {stages}""")
def _(v):
    return v("stages").select("row_idx", C.stage_name(F.col("raw_stage")).alias("stage"), C.crm_stage(F.col("raw_stage")).alias("crm_stage"))


@query("suppression_flags", "PRJ20", """SELECT id, CASE WHEN domain = 'machinery-7.com' THEN 'host company domain (''' || domain || ''')'
  WHEN domain IN ('furniture-3.com', 'building-11.com') THEN 'competitor domain (''' || domain || ''')' ELSE '' END AS reason FROM {contacts}""")
def _(v):
    return v("contacts").select("id", RULES.suppression_reason(F.col("domain")).alias("reason"))


VOCAB = RULES.vocabulary()


@query("industry_vocabulary", "AGG30 PRJ10", f"""WITH {SYN} SELECT company_id, event_slug, coalesce(CASE
  WHEN trim(industry) IN {inlist(VOCAB)} THEN nullif(trim(industry), 'Other') ELSE (SELECT v FROM synonym WHERE k = lower(trim(industry))) END, '') AS label FROM {{model_answers}}""")
def _(v):
    return v("model_answers").select("company_id", "event_slug", F.coalesce(
        C.industry_label(F.col("industry"), RULES.vocabulary()), F.lit("")).alias("label"))


@query("crm_industry", "PRJ27", f"WITH {table('crm_ind', fixed.CRM_INDUSTRY)} SELECT id, coalesce((SELECT v FROM crm_ind WHERE k = lower(trim(industry))), '') AS crm_industry FROM {{contacts}}")
def _(v):
    return v("contacts").select("id", F.coalesce(C.crm_industry(F.col("industry")), F.lit("")).alias("crm_industry"))


# --- votes -----------------------------------------------------------------------------
@query("canonical_spelling", "AGG5 WIN12", f"WITH {VOTES} SELECT event_slug, company_key, pick AS canonical FROM spell")
def _(v):
    return N.canonical_spelling(prep(v))


@query("respelled_rows", "JN6", f"WITH {VOTES} SELECT row_idx, company_raw FROM named")
def _(v):
    return named(v).select("row_idx", "company_raw")


@query("peer_company", "AGG6", f"WITH {VOTES} SELECT event_slug, domain, pick AS peer_company FROM dom")
def _(v):
    return N.company_of_domain(named(v))


@query("peer_title", "AGG6", f"WITH {VOTES} SELECT event_slug, company_key, pick AS peer_title FROM ttl")
def _(v):
    return N.title_of_company(named(v)).withColumnRenamed("_title_key", "company_key")


@query("peer_title_sample", "AGG7 ARR1", f"""WITH {VOTES}, d AS (SELECT DISTINCT event_slug, company_key, jobtitle_raw FROM named WHERE company_key <> '' AND jobtitle_raw <> '')
SELECT event_slug, company_key, array_to_string((list(jobtitle_raw ORDER BY jobtitle_raw))[1:5], '|') AS titles FROM d GROUP BY 1, 2""")
def _(v):
    return N.peer_titles(named(v))


# --- cascade ---------------------------------------------------------------------------
@query("enrichment_cascade", "JN4 JN5 PRJ22 PRJ23", f"WITH {CASCADE} SELECT * FROM cas")
def _(v):
    return cascade(v).drop("owner_email", "needs_review_reason", "industry_source", "numemployees_source",
                           "firmographics_confidence", "is_speaker", "notes")


@query("needs_inference", "PRJ24", f"""WITH {CASCADE} SELECT row_idx FROM cas WHERE jobtitle = 'Attendee' OR company = 'Unknown' OR starts_with(lower(company), 'компания')""")
def _(v):
    return N.needs_inference(cascade(v)).select("row_idx")


@query("company_work_units", "AGG8 ARR1", f"""WITH {KEYED}, u AS (SELECT * FROM keyed WHERE company_id <> '')
SELECT event_slug, company_id, arg_min(company, row_idx) AS company, count(*) AS registrants,
  coalesce(array_to_string(list_sort(list(DISTINCT code) FILTER (WHERE country <> '')), ','), '') AS countries,
  coalesce(array_to_string(list_sort(list(DISTINCT jobtitle) FILTER (WHERE jobtitle NOT IN ('', 'Attendee')))[1:5], '|'), '') AS sample_titles
FROM (SELECT *, {code('country')} AS code FROM u) GROUP BY 1, 2""")
def _(v):
    return N.work_units(cascade(v))


MODEL = KEYED + f""", {SYN},
masks AS (SELECT DISTINCT event_slug, company_id FROM keyed),
mans AS (SELECT a.event_slug, a.company_id, CASE WHEN trim(industry) IN {inlist(VOCAB)} THEN nullif(trim(industry), 'Other')
           ELSE (SELECT v FROM synonym WHERE k = lower(trim(industry))) END AS ni,
         CASE WHEN try_cast(employee_count AS DOUBLE) >= 1 THEN floor(try_cast(employee_count AS DOUBLE))::BIGINT END AS ns,
         greatest(0.0, least(1.0, confidence)) AS nc
         FROM {{model_answers}} a JOIN masks USING (event_slug, company_id)),
m1 AS (SELECT k.* REPLACE (coalesce(ni, industry) AS industry, coalesce(ns, numemployees) AS numemployees),
       CASE WHEN ni IS NOT NULL THEN 'model' ELSE 'rules' END AS industry_source, CASE WHEN ns IS NOT NULL THEN 'model' ELSE 'synthetic' END AS numemployees_source,
       greatest(0.0, coalesce(nc, 0.0)) AS firmographics_confidence FROM keyed k LEFT JOIN mans USING (event_slug, company_id))"""
VENDOR = MODEL + """,
vans AS (SELECT a.event_slug, a.company_id, nullif(trim(industry), '') AS ni,
         CASE WHEN try_cast(employee_count AS DOUBLE) >= 1 THEN floor(try_cast(employee_count AS DOUBLE))::BIGINT END AS ns
         FROM {vendor_answers} a JOIN masks USING (event_slug, company_id)),
v1 AS (SELECT m.* REPLACE (coalesce(v.ni, m.industry) AS industry, coalesce(v.ns, m.numemployees) AS numemployees,
         CASE WHEN v.ni IS NOT NULL THEN 'vendor' ELSE m.industry_source END AS industry_source,
         CASE WHEN v.ns IS NOT NULL THEN 'vendor' ELSE m.numemployees_source END AS numemployees_source,
         CASE WHEN v.company_id IS NOT NULL AND (v.ni IS NOT NULL OR v.ns IS NOT NULL) THEN 1.0 ELSE m.firmographics_confidence END AS firmographics_confidence)
       FROM m1 m LEFT JOIN vans v USING (event_slug, company_id))"""
COLS = "row_idx, company_id, industry, numemployees, industry_source, numemployees_source, firmographics_confidence::DOUBLE AS firmographics_confidence"


def with_model(v):
    rows = N.keyed(cascade(v))
    return N.apply_firmographics(rows, N.model_firmographics(v("model_replies"), rows, RULES), "model")


def with_vendor(v):
    rows = with_model(v)
    return N.apply_firmographics(rows, N.vendor_firmographics(v("vendor_replies"), rows), "vendor")


SHOWN = ["row_idx", "company_id", "industry", "numemployees", "industry_source", "numemployees_source", "firmographics_confidence"]


@query("model_firmographics", "JN8 PRJ31 PRJ10", f"WITH {MODEL} SELECT {COLS} FROM m1")
def _(v):
    return with_model(v).select(*SHOWN)


@query("vendor_firmographics", "JN9 JN8", f"WITH {VENDOR} SELECT {COLS} FROM v1")
def _(v):
    return with_vendor(v).select(*SHOWN)


@query("vendor_report", "JN9", f"""WITH {KEYED}, masks AS (SELECT DISTINCT event_slug, company_id FROM keyed),
v AS (SELECT a.event_slug, a.company_id, nullif(trim(industry), '') AS ni, CASE WHEN try_cast(employee_count AS DOUBLE) >= 1 THEN 1 END AS ns, m.company_id AS hit
      FROM {{vendor_answers}} a LEFT JOIN masks m USING (event_slug, company_id))
SELECT event_slug, count(*) AS supplied, count(*) FILTER (WHERE hit IS NOT NULL AND (ni IS NOT NULL OR ns IS NOT NULL)) AS applied,
  count(*) FILTER (WHERE hit IS NOT NULL AND ns IS NOT NULL) AS sizes, count(*) FILTER (WHERE hit IS NOT NULL AND ni IS NOT NULL) AS industries FROM v GROUP BY 1""")
def _(v):
    return N.vendor_report(v("vendor_replies"), N.keyed(cascade(v)))


@query("unresolved_companies", "AGG29", f"""WITH {MODEL} SELECT DISTINCT event_slug, company_id FROM m1 WHERE company_id <> '' AND
  (industry_source <> 'model' OR industry IN ('Other', 'Unknown') OR numemployees_source <> 'model' OR firmographics_confidence < 0.7)""")
def _(v):
    return N.unresolved_companies(with_model(v))


@query("row_patches", "JN10 PRJ31", f"""WITH {CASCADE}, j AS (SELECT c.*, trim(p.company) AS pc, trim(p.jobtitle) AS pt, p.function AS pf, p.seniority AS ps
  FROM cas c LEFT JOIN {{row_patches}} p ON p.event_slug = c.event_slug AND p.row_id = c.email),
k AS (SELECT *, coalesce(pc NOT IN ('', 'Unknown') AND pc <> company, false) AS dc, coalesce(pt NOT IN ('', 'Unknown') AND pt <> jobtitle, false) AS dt,
  coalesce(pf IN {inlist(fixed.FUNCTIONS)}, false) AS okf, coalesce(ps IN {inlist(fixed.SENIORITIES)}, false) AS oks FROM j),
l AS (SELECT *, concat_ws(',', CASE WHEN dc THEN 'company' END, CASE WHEN dt THEN 'jobtitle' END, CASE WHEN okf AND pf <> function THEN 'function' END,
  CASE WHEN oks AND ps <> seniority THEN 'seniority' END) AS patched FROM k)
SELECT row_idx, CASE WHEN dc THEN pc ELSE company END AS company, CASE WHEN dt THEN pt ELSE jobtitle END AS jobtitle, CASE WHEN okf THEN pf ELSE function END AS function,
  CASE WHEN oks THEN ps ELSE seniority END AS seniority, patched, CASE WHEN patched <> '' THEN round_even(least(1.0, confidence + 0.1), 2) ELSE confidence END AS confidence FROM l""")
def _(v):
    return N.apply_patches(cascade(v), v("patch_replies")).select(
        "row_idx", "company", "jobtitle", "function", "seniority", "patched", "confidence")


FINAL = VENDOR + f""", {LEVEL}, {STAGES},
dec AS (SELECT event_slug, row_id AS email, lower(trim(tier)) AS mt, round_even(greatest(0.0, least(1.0, confidence)), 2) AS mc FROM {{tier_answers}}
        WHERE lower(trim(tier)) IN ('tier1', 'tier2', 'tier3', 'unqualified')),
crmx AS (SELECT event_slug, email, any_value(lifecyclestage) AS ex FROM {{crm}} GROUP BY 1, 2),
f1 AS (SELECT v1.*, {tier('jobtitle', 'numemployees', 'industry')} AS icp_tier_rules, mt, mc, ex FROM v1
       LEFT JOIN dec USING (event_slug, email) LEFT JOIN crmx USING (event_slug, email)),
f2 AS (SELECT *, coalesce(mt, icp_tier_rules) AS icp_tier, mt IS NOT NULL AND abs((SELECT v FROM level WHERE k = mt) - (SELECT v FROM level WHERE k = icp_tier_rules)) > 1 AS apart FROM f1),
f3 AS (SELECT *, CASE WHEN apart THEN 'disagreement' WHEN mt IS NOT NULL THEN 'agree' ELSE 'rules' END AS verdict,
       {target('icp_tier', "attendance_status = 'attended'", 'minutes')} AS want FROM f2),
fin AS (SELECT *, CASE WHEN ex IS NOT NULL AND (SELECT v FROM stage_rank WHERE k = ex) >= (SELECT v FROM stage_rank WHERE k = want) THEN ex ELSE want END AS lifecyclestage FROM f3)"""


def final(v):
    matches = v("crm").groupBy("event_slug", "email").agg(F.any_value("lifecyclestage").alias("existing_stage"))
    return N.finalised(with_vendor(v), N.tier_decisions(v("tier_replies")), matches, RULES)


@query("final_tiers", "JN11 PRJ17 PRJ23", f"WITH {FINAL} SELECT row_idx, icp_tier, icp_tier_rules, verdict, coalesce(mc, -1)::DOUBLE AS icp_confidence, lifecyclestage FROM fin")
def _(v):
    return final(v).select("row_idx", "icp_tier", "icp_tier_rules", "verdict",
                           F.coalesce("icp_confidence", F.lit(-1.0)).alias("icp_confidence"), "lifecyclestage")


@query("verdict_counts", "AGG25", f"WITH {FINAL} SELECT event_slug, verdict AS label, count(*) AS n FROM fin GROUP BY 1, 2")
def _(v):
    return Q.label_counts(final(v), "verdict")


@query("tier_mix", "AGG25", "SELECT event_slug, icp_tier AS label, count(*) AS n FROM {enriched} GROUP BY 1, 2")
def _(v):
    return Q.label_counts(v("enriched"), "icp_tier")


@query("company_rows", "AGG4 WIN12", """SELECT event_slug, company_domain AS domain, company AS name, industry, numemployees FROM (
  SELECT event_slug, company_domain, company, industry, numemployees,
    row_number() OVER (PARTITION BY event_slug, company_domain ORDER BY count(*) DESC, min(row_idx)) AS rn
  FROM {enriched} WHERE company_domain <> '' GROUP BY 1, 2, 3, 4, 5) WHERE rn = 1""")
def _(v):
    return N.company_rows(v("enriched"))


# --- completeness ------------------------------------------------------------------------
def filled(f):
    return f"coalesce(trim({f}::VARCHAR), '') NOT IN ('', 'Unknown', '0')"


def evidence(f):
    extra = {"jobtitle": " AND jobtitle <> 'Attendee'", "industry": " AND industry <> 'Other'"}.get(f, "")
    if f in ("industry", "numemployees"):
        extra += f" AND ({f}_source = 'vendor' OR ({f}_source = 'model' AND firmographics_confidence >= 0.7))"
    return filled(f) + extra


RATES = "rates AS (" + " UNION ALL ".join(
    f"SELECT event_slug, '{f}' AS field, round_even(100.0 * count(*) FILTER (WHERE {filled(f)}) / count(*), 1) AS raw_pct, "
    f"round_even(100.0 * count(*) FILTER (WHERE {evidence(f)}) / count(*), 1) AS verified_pct FROM {{enriched}} GROUP BY 1"
    for f in dict.fromkeys(fixed.COMPLETENESS_FIELDS + fixed.COMPANY_SPEC)) + ")"


@query("fill_rates", "AGG9 AGG10 PRJ25", f"WITH {RATES} SELECT * FROM rates WHERE field <> 'company_domain'")
def _(v):
    return Q.fill_rates(v("enriched"))


@query("spec_completeness", "AGG11", f"""WITH {RATES}, s AS (
  SELECT event_slug, 'contact' AS scope, round_even(sum(raw_pct) / 10, 1) AS raw_pct, round_even(sum(verified_pct) / 10, 1) AS verified_pct FROM rates WHERE field IN {inlist(fixed.CONTACT_SPEC)} GROUP BY 1
  UNION ALL SELECT event_slug, 'company', round_even(sum(raw_pct) / 4, 1), round_even(sum(verified_pct) / 4, 1) FROM rates WHERE field IN {inlist(fixed.COMPANY_SPEC)} GROUP BY 1)
SELECT *, raw_pct > 90 AS pass_raw, verified_pct >= 90 AS pass_verified FROM s""")
def _(v):
    fields = tuple(dict.fromkeys(fixed.CONTACT_SPEC + fixed.COMPANY_SPEC))
    return Q.completeness(Q.fill_rates(v("enriched"), fields))


@query("fallback_counts", "AGG12", """SELECT event_slug, count(*) FILTER (WHERE jobtitle = 'Attendee') AS generic_titles, count(*) FILTER (WHERE industry = 'Other') AS generic_industries,
  count(*) FILTER (WHERE numemployees_source = 'synthetic') AS synthetic_sizes, count(*) FILTER (WHERE numemployees_source = 'rules') AS unresolved_sizes,
  count(*) FILTER (WHERE industry_source = 'model' AND firmographics_confidence < 0.7) AS low_confidence FROM {enriched} GROUP BY 1""")
def _(v):
    return Q.fallback_counts(v("enriched"))


@query("source_mix", "AGG12", """SELECT event_slug, 'industry_source' AS field, industry_source AS source, count(*) AS n FROM {enriched} GROUP BY ALL
UNION ALL SELECT event_slug, 'numemployees_source', numemployees_source, count(*) FROM {enriched} GROUP BY ALL
UNION ALL SELECT event_slug, 'icp_source', icp_source, count(*) FROM {enriched} GROUP BY ALL""")
def _(v):
    return Q.source_mix(v("enriched"))


@query("review_counts", "AGG13", """WITH s AS (SELECT event_slug, count(*) AS row_count, count(*) FILTER (WHERE needs_review) AS needs_review,
  count(*) FILTER (WHERE jobtitle = 'Attendee' OR industry = 'Other') AS needs_review_broad, count(*) FILTER (WHERE suppression_reason <> '') AS suppressed FROM {enriched} GROUP BY 1)
SELECT *, row_count - suppressed AS mailable, round_even(100.0 * needs_review / row_count, 1) AS needs_review_pct,
  round_even(100.0 * needs_review_broad / row_count, 1) AS needs_review_broad_pct, round_even(100.0 * suppressed / row_count, 1) AS suppressed_pct FROM s""")
def _(v):
    return Q.review_counts(v("enriched"))


@query("sql_functions", "SQL1", f"""SELECT row_idx, {cased('first_name')} AS name, regexp_replace(lower(trim(company)), '\\s+', ' ', 'g') AS key, trim(minutes) NOT IN ('', 'Unknown', '0') AS filled,
  'https://x.example/r?a=' || row_idx || '&utm_source=web&utm_medium=mail&utm_campaign=c1&utm_content=n' || row_idx || '#t' AS link FROM {{registrants}}""")
def _(v):
    register(v.spark)
    return v.sql("""SELECT row_idx, norm_name(first_name) AS name, company_key(company) AS key, is_filled(minutes) AS filled,
      with_utm('https://x.example/r?a=' || row_idx || '&utm_source=old&b=#t', 'web', 'mail', 'c1', 'n' || row_idx) AS link FROM {registrants}""")


@query("work_batches", "TOP9", """SELECT batch_no, slot, row_idx FROM (SELECT row_idx, (row_number() OVER (PARTITION BY event_slug ORDER BY row_idx) - 1) AS p,
  event_slug || '/' || ((row_number() OVER (PARTITION BY event_slug ORDER BY row_idx) - 1) // 40) AS batch_no, (row_number() OVER (PARTITION BY event_slug ORDER BY row_idx) - 1) % 40 AS slot FROM {registrants})""")
def _(v):
    b = batches(v("registrants").select("event_slug", "row_idx"), ["event_slug"], ["row_idx"], 40)
    return b.select(F.concat_ws("/", "event_slug", F.col("batch_no").cast("string")).alias("batch_no"), "slot", "row_idx")
