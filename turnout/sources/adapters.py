"""Event tables as views over the driver's parquet tables.

Each view is one SQL text that both Spark and DuckDB accept; ``{name}`` stands
for another view or a base table.  Spark binds the names to DataFrames, the
oracle binds them to CTEs, so both sides start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
        "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "seeds": """
SELECT c_custkey AS id, c_nationkey AS nat, c_acctbal AS bal, c_mktsegment AS seg,
       CAST(floor(c_custkey / 3) AS BIGINT) AS g,
       CAST(floor(c_custkey / 2325) AS BIGINT) AS cyc,
       CAST(floor(c_custkey / 12) AS BIGINT) % 4 AS ev
FROM {customer}""",
    "contacts": """
SELECT id, event_slug, firstname, lastname, local || '@' || domain AS email, local, domain,
       CASE WHEN id % 13 = 0 THEN ''
            WHEN domain IN ('gmail.com', 'live.com') AND id % 2 = 0 THEN ''
            WHEN id % 17 = 0 THEN 'Компания ' || CAST(nat AS STRING)
            WHEN id % 11 = 0 THEN upper(brand) WHEN id % 11 = 5 THEN lower(brand)
            ELSE brand END AS company,
       split_part('CHRO|Head of HR|HR Business Partner|Payroll Manager||Marketing Director|Sales Development Rep|VP People|Founder',
                  '|', CAST(id % 9 AS INT) + 1) AS jobtitle,
       split_part('India|IN|United States|usa|Qatar|Singapore|deutschland||Australia', '|', nat % 9 + 1) AS country,
       attended,
       CASE WHEN attended = 'No' THEN '' WHEN id % 19 = 0 THEN 'n/a'
            ELSE CAST(CAST(floor(abs(bal)) AS BIGINT) % 60 AS STRING) END AS minutes,
       CAST(floor(abs(bal)) AS BIGINT) % 3000 AS numemployees,
       split_part('SaaS|IT/ITES|Retail|Fitness|Other|Unknown', '|', nat % 6 + 1) AS industry
FROM (
  SELECT id, nat, bal, event_slug, attended, firstname, lastname,
         upper(substr(seg, 1, 1)) || lower(substr(seg, 2)) ||
           CASE nat % 3 WHEN 0 THEN ' Systems ' WHEN 1 THEN ' SaaS ' ELSE ' Works ' END || CAST(nat AS STRING) AS brand,
         lower(CASE id % 3 WHEN 0 THEN firstname || '.' || lastname
                    WHEN 1 THEN substr(firstname, 1, 1) || '.' || lastname || CAST(g AS STRING)
                    ELSE firstname || lastname || CAST(g AS STRING) END) AS local,
         CASE WHEN id % 10 < 3 THEN 'gmail.com' WHEN id % 10 = 9 THEN 'live.com'
              ELSE lower(seg) || '-' || CAST(nat AS STRING) ||
                   CASE WHEN cyc = 0 THEN '' ELSE '-' || CAST(cyc AS STRING) END || '.com' END AS domain
  FROM (
    SELECT *, 'ev' || CAST(ev AS STRING) AS event_slug,
           CASE WHEN ev = 3 OR id % 2 = 1 THEN 'No' ELSE 'Yes' END AS attended,
           split_part('Aisha,Rohan,Maria,Liam,Chen,Fatima,Noah,Priya,Omar,Ingrid,Diego,Hana,Kofi,Lucia,Sven,Mei,Amir,Nadia,Paulo,Yuki,Zara,Tomas,Elena,Ravi,Greta',
                      ',', CAST(g % 25 AS INT) + 1) AS firstname,
           split_part('Haddad,Verma,Silva,Okafor,Tanaka,Novak,Larsen,Rossi,Khan,Mbeki,Costa,Wagner,Dubois,Santos,Kim,Patel,Ivanova,Nguyen,Farah,Olsen,Moreau,Becker,Sato,Mensah,Reyes,Bauer,Conti,Aziz,Lopez,Demir,Al-Sayed',
                      ',', CAST(floor(g / 25) AS INT) % 31 + 1) ||
             CASE WHEN cyc = 0 THEN '' ELSE CAST(cyc AS STRING) END AS lastname
    FROM {seeds}) AS s) AS t""",
    "registrants": """
SELECT id * 2 AS row_idx, event_slug, firstname AS first_name, lastname AS last_name, email,
       jobtitle AS job_title, company, country, attended, minutes
FROM {contacts}
UNION ALL
SELECT c.id * 2 + 1 AS row_idx, c.event_slug,
       CASE WHEN c.id % 20 = 7 THEN 'Test' ELSE upper(c.firstname) END AS first_name,
       CASE WHEN c.id % 20 = 7 THEN 'sample' ELSE lower(c.lastname) END AS last_name,
       CASE WHEN c.id % 20 = 9 THEN 'noreply@' || c.domain ELSE '  ' || upper(c.email) END AS email,
       '' AS job_title, CASE WHEN c.id % 3 = 0 THEN '  ' || upper(c.company) ELSE '' END AS company,
       c.country, 'No' AS attended, '' AS minutes
FROM {contacts} AS c
JOIN (SELECT DISTINCT user_id FROM {events} WHERE event_type = 'signup') AS s ON s.user_id = c.id""",
    "stages": """
SELECT o_orderkey AS row_idx, o_custkey AS contact_id,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'opportunity' WHEN '2' THEN 'salesqualifiedlead'
            WHEN '3' THEN 'MarketingQualifiedLead_pending' WHEN '4' THEN 'lead_new' ELSE 'subscriber' END AS raw_stage,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'opportunity' WHEN '2' THEN 'salesqualifiedlead'
            WHEN '3' THEN 'marketingqualifiedlead' WHEN '4' THEN 'lead' ELSE 'subscriber' END AS stage,
       o_orderdate + INTERVAL '8216' DAY AS ts,
       CASE o_orderstatus WHEN 'O' THEN 'seeded' ELSE 'crm_history' END AS source
FROM {orders}""",
    "lifecycle": """
SELECT s.row_idx, c.event_slug, c.email, s.raw_stage, s.ts, s.source
FROM {stages} AS s JOIN {contacts} AS c ON c.id = s.contact_id""",
    "latest_stage": """
SELECT contact_id, stage FROM (
  SELECT contact_id, stage, row_number() OVER (PARTITION BY contact_id ORDER BY ts DESC, row_idx) AS rn
  FROM {stages}) AS x WHERE rn = 1""",
    "crm": """
SELECT c.id + 100000 AS vid, c.event_slug,
       CASE WHEN c.id % 7 = 3 THEN replace(c.local, '.', '') || '@' || c.domain ELSE c.email END AS email,
       CASE WHEN c.id % 5 = 1 THEN substr(c.firstname, 1, 3) ELSE c.firstname END AS firstname,
       c.lastname, c.jobtitle, c.company, l.stage AS lifecyclestage,
       CASE WHEN c.id % 2 = 0 THEN 'OPEN' ELSE 'IN_PROGRESS' END AS lead_status
FROM {contacts} AS c JOIN {latest_stage} AS l ON l.contact_id = c.id""",
    "engagement": """
SELECT e.event_id, c.event_slug, c.email,
       CASE e.event_type WHEN 'purchase' THEN 'form_fill' WHEN 'click' THEN 'click' WHEN 'view' THEN 'pageview'
            WHEN 'signup' THEN 'open' ELSE e.event_type END AS type,
       e.ts, e.props AS asset, 'fixture' AS source
FROM {events} AS e JOIN {contacts} AS c ON c.id = e.user_id""",
    "mail_touches": """
SELECT event_id AS id, event_slug, email, ts FROM {engagement} WHERE type = 'open'""",
    "enriched": """
SELECT c.id AS row_idx, c.event_slug, c.email, c.firstname, c.lastname,
       CASE WHEN c.jobtitle = '' THEN 'Attendee' ELSE c.jobtitle END AS jobtitle,
       CASE WHEN c.company = '' THEN 'Unknown' ELSE c.company END AS company,
       c.industry, c.numemployees, c.country, c.attended, c.minutes,
       CASE WHEN c.domain = 'gmail.com' THEN '' ELSE c.domain END AS company_domain,
       CASE WHEN c.attended = 'Yes' THEN 'attended' ELSE 'no_show' END AS attendance_status,
       CASE WHEN c.nat = 7 THEN 'competitor' ELSE '' END AS suppression_reason,
       CASE c.id % 4 WHEN 0 THEN 'vendor' WHEN 1 THEN 'model' WHEN 2 THEN 'rules' ELSE 'model' END AS industry_source,
       CASE c.id % 5 WHEN 0 THEN 'vendor' WHEN 1 THEN 'model' WHEN 2 THEN 'synthetic' WHEN 3 THEN 'rules' ELSE 'model' END AS numemployees_source,
       CASE c.id % 3 WHEN 0 THEN 'model' ELSE 'rules' END AS icp_source,
       CAST(c.id % 11 AS DOUBLE) / 10 AS firmographics_confidence,
       CASE WHEN c.id % 21 = 0 THEN true ELSE false END AS needs_review,
       CASE WHEN c.id % 3 = 0 THEN 'marketing' WHEN c.id % 3 = 1 THEN 'general' ELSE '' END AS function,
       CASE WHEN c.id % 6 = 0 THEN 'unknown' ELSE 'manager' END AS seniority,
       split_part('tier1,tier2,tier3,unqualified', ',', CAST(c.id % 4 AS INT) + 1) AS icp_tier,
       CASE WHEN c.nat % 3 = 0 THEN 'INDIA' WHEN c.nat % 3 = 1 THEN 'NA' ELSE 'UNASSIGNED' END AS region,
       CASE WHEN c.nat % 3 = 2 THEN '' ELSE 'owner@host.example' END AS owner_email,
       coalesce(l.stage, '') AS lifecyclestage
FROM (SELECT x.*, s.nat FROM {contacts} AS x JOIN {seeds} AS s ON s.id = x.id) AS c
LEFT JOIN {latest_stage} AS l ON l.contact_id = c.id""",
    "model_answers": """
SELECT event_slug, domain AS company_id,
       split_part('Banking,SaaS,Information Technology,Retail,Alien Tech,Other', ',', CAST(min(id) % 6 AS INT) + 1) AS industry,
       CAST(min(id) % 9 * 150 AS STRING) AS employee_count, CAST(min(id) % 13 AS DOUBLE) / 10 AS confidence
FROM {contacts} WHERE domain <> 'gmail.com' GROUP BY event_slug, domain""",
    "vendor_answers": """
SELECT event_slug, domain AS company_id,
       split_part('Energy,Telecom,,Pharma', ',', CAST(max(id) % 4 AS INT) + 1) AS industry,
       CASE WHEN max(id) % 5 = 0 THEN 'n/a' ELSE CAST(max(id) % 4000 AS STRING) END AS employee_count,
       'run/' || domain AS run_url
FROM {contacts} WHERE domain <> 'gmail.com' GROUP BY event_slug, domain HAVING count(*) >= 3""",
    "tier_answers": """
SELECT c.event_slug, c.email AS row_id,
       split_part('tier1,Tier2 ,tier3,unqualified,platinum', ',', CAST(c.id % 5 AS INT) + 1) AS tier,
       CAST(c.id % 14 AS DOUBLE) / 10 AS confidence, 'model view ' || c.jobtitle AS rationale
FROM {contacts} AS c JOIN (SELECT DISTINCT user_id FROM {events} WHERE event_type = 'purchase') AS p ON p.user_id = c.id""",
    "row_patches": """
SELECT c.event_slug, c.email AS row_id,
       CASE WHEN c.id % 4 = 0 THEN 'Unknown' WHEN c.id % 4 = 1 THEN ' Patched Co ' ELSE c.company END AS company,
       CASE WHEN c.id % 2 = 0 THEN 'CHRO' ELSE '' END AS jobtitle,
       split_part('marketing,wizard,sales,general', ',', CAST(c.id % 4 AS INT) + 1) AS function,
       split_part('manager,vp,boss', ',', CAST(c.id % 3 AS INT) + 1) AS seniority
FROM {contacts} AS c JOIN (SELECT DISTINCT user_id FROM {events} WHERE event_type = 'view') AS p ON p.user_id = c.id""",
    "model_replies": """
SELECT event_slug, company_id, 2 AS answer_no, industry, employee_count, confidence FROM {model_answers}
UNION ALL SELECT event_slug, company_id, 1, 'Retail', '777', 0.5 FROM {model_answers} WHERE confidence < 0.6
UNION ALL SELECT event_slug, company_id, 2, industry, employee_count, confidence FROM {model_answers} WHERE confidence > 0.9""",
    "vendor_replies": """
SELECT event_slug, company_id, 2 AS answer_no, industry, employee_count, run_url FROM {vendor_answers}
UNION ALL SELECT event_slug, company_id, 1, 'Retail', '888', run_url FROM {vendor_answers} WHERE industry <> '' AND length(company_id) % 2 = 0""",
    "tier_replies": """
SELECT event_slug, row_id, 2 AS answer_no, tier, confidence, rationale FROM {tier_answers}
UNION ALL SELECT event_slug, row_id, 1, 'tier2', 0.1, 'an earlier view' FROM {tier_answers} WHERE tier IN ('tier1', 'tier3')
UNION ALL SELECT event_slug, row_id, 3, 'platinum', 0.2, 'no such tier' FROM {tier_answers}""",
    "patch_replies": """
SELECT event_slug, row_id, 2 AS answer_no, company, jobtitle, function, seniority FROM {row_patches}
UNION ALL SELECT event_slug, row_id, 1, 'Earlier Co', 'Founder', 'sales', 'vp' FROM {row_patches}""",
    "speakers": """
SELECT event_slug, id AS speaker_no, firstname || ' ' || lastname AS name, jobtitle AS title, company,
       CASE WHEN id % 2 = 0 THEN email ELSE '' END AS email
FROM {contacts} WHERE jobtitle = 'Founder'""",
    "speaker_inboxes": """
SELECT event_slug, id AS inbox_no, email FROM {contacts} WHERE jobtitle = 'Founder'""",
    "event_dim": """
SELECT 'ev' || CAST(r_regionkey AS STRING) AS event_slug, 'People Summit ' || r_name || ': Live Edition' AS event_name,
       '2026-08-1' || CAST(r_regionkey AS STRING) AS date, '1' || CAST(r_regionkey AS STRING) || ':30' AS start_time_local,
       CASE r_regionkey % 2 WHEN 0 THEN 'Asia/Kolkata' ELSE 'America/New_York' END AS timezone,
       45 + r_regionkey AS duration_min,
       'https://watch.example.com/v/' || CAST(r_regionkey AS STRING) || '?utm_source=old&x=1' AS recording_url,
       'https://join.example.com/r' || CAST(r_regionkey AS STRING) AS registration_page
FROM {region}""",
    "recording_files": """
SELECT 'ev' || CAST(n_nationkey % 4 AS STRING) AS event_slug, CAST(floor(n_nationkey / 4) AS INT) + 1 AS chapter,
       CAST(300 + n_nationkey * 7 AS DOUBLE) AS duration_sec
FROM {nation}""",
    "turns": """
SELECT conv_id AS recording_id, turn AS seq, turn * 30 AS sec, role AS speaker, replace(text, chr(10), ' ') AS text
FROM {conversations}""",
    "stt_pieces": """
SELECT conv_id AS recording_id, turn AS seq,
       CAST(turn * CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 30 END AS DOUBLE) AS start_sec,
       CAST(turn * CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 30 END + 12 AS DOUBLE) AS end_sec,
       CASE WHEN turn % 3 = 0 THEN 'assistant' ELSE role END AS speaker,
       replace(text, chr(10), ' ') AS text
FROM {conversations}""",
    "transcript_lines": """
SELECT conv_id AS recording_id, turn AS line_no,
       '[' || lpad(CAST(CAST(floor(turn * 30 / 60) AS BIGINT) AS STRING), 2, '0') || ':' ||
       lpad(CAST(turn * 30 % 60 AS STRING), 2, '0') || '] **' || role ||
       CASE WHEN turn % 7 = 6 THEN '** ' ELSE ':** ' END || replace(text, chr(10), ' ') AS line
FROM {conversations}""",
    "spoken": """
SELECT 'c' || CAST(conv_id AS STRING) AS event_slug, turn AS seq, turn * 30 AS sec,
       upper(substr(role, 1, 1)) || substr(role, 2) AS speaker, replace(text, chr(10), ' ') AS text
FROM {conversations}""",
    "assets": """
SELECT event_slug, event_slug || '/' || CAST(seq AS STRING) AS asset_id, 'blog.md' AS kind,
       '<!-- generated -->' || chr(10) || '## Recap' || chr(10) || 'As ' || speaker || ' explained, "' ||
       CASE WHEN seq % 3 = 2 THEN reverse(substr(clean, 1, 90)) ELSE substr(clean, 11, 90) END || '" [00:' ||
       lpad(CAST(sec % 60 AS STRING), 2, '0') || '].' || chr(10) || 'And ' || speaker || ', Host [' ||
       lpad(CAST(CAST(floor(sec / 60) AS BIGINT) AS STRING), 2, '0') || ':' || lpad(CAST(sec % 60 AS STRING), 2, '0') || ']' || chr(10) ||
       '-- ' || speaker || ', Host Co' || chr(10) || '-- Nobody Known, Elsewhere' || chr(10) || 'Ends [59:59].' AS text
FROM (SELECT *, replace(replace(replace(text, '"', ''), '[', '('), chr(8220), '') AS clean FROM {spoken}) AS s""",
    "spec_assets": """
SELECT 'ev' || CAST(doc_id % 4 AS STRING) AS event_slug, doc_id AS asset_id,
       split_part('blog.md,social.md,youtube.md,infographic.md', ',', CAST(doc_id % 4 AS INT) + 1) AS kind,
       CASE doc_id % 4 WHEN 0 THEN text
         WHEN 1 THEN repeat('### Post 1' || chr(10) || 'Platform: LinkedIn' || chr(10) || 'Hook style: ' || source || chr(10) || '[link] ', CAST(n_chars % 4 AS INT) + 1) ||
              repeat('### Post 2' || chr(10) || '**Platform:** x' || chr(10) || CASE WHEN n_chars % 3 = 0 THEN 'Hook style: Question' || chr(10) ELSE '' END, CAST(n_chars % 5 AS INT))
         WHEN 2 THEN '## Chapters' || chr(10) || CASE WHEN n_chars % 5 = 0 THEN '00:10' ELSE '00:00' END || ' Intro' || chr(10) ||
              repeat('05:0' || CAST(n_chars % 10 AS STRING) || ' Next' || chr(10), CAST(n_chars % 6 AS INT)) || '## Description' || chr(10) ||
              CASE WHEN n_chars % 7 = 0 THEN '' ELSE '## Thumbnail Brief' || chr(10) END
         ELSE '## Headline Options' || chr(10) || 'A' || chr(10) || '## Data Points' || chr(10) ||
              repeat('- **42%** — of teams *x*' || chr(10) || '**7** — y' || chr(10), CAST(n_chars % 5 AS INT)) || '## Layout' || chr(10) ||
              'Stat ' || CAST(n_chars % 9 AS STRING) || ' beside Stat 2' || chr(10) END AS text
FROM {documents}""",
    "verdicts": """
SELECT event_slug, purpose AS asset_id, call_id * 100 + seconds AS claim_no, model AS type,
       model || ' in call ' || CAST(call_id AS STRING) || ' after ' || CAST(seconds AS STRING) || ' s' AS raw, ok AS verified,
       CASE WHEN NOT ok THEN 'no answer within ' || CAST(seconds AS STRING) || ' s' END AS reason
FROM {call_log}""",
    "moments": """
SELECT event_id AS moment_id, 'ev' || CAST(user_id % 4 AS STRING) AS event_slug,
       CAST(floor(value * 100) AS BIGINT) % 4000 AS sec, CAST(floor(value * 100) AS BIGINT) % 100 AS worth,
       event_type AS title
FROM {events}""",
    "stamps": """
SELECT event_slug, sec FROM (
  SELECT 'ev' || CAST(l_suppkey % 4 AS STRING) AS event_slug,
         CAST(floor(l_extendedprice) AS BIGINT) % 60 * 50 + l_suppkey % 7 AS sec FROM {lineitem}) AS x
GROUP BY event_slug, sec""",
    "message_matrix": """
SELECT 'ev' || CAST(p_partkey % 4 AS STRING) AS event_slug,
       split_part('marketing,revops,sales,executive,customer_success,general', ',', p_size % 6 + 1) AS function,
       min(p_name) AS headline, max(p_type) AS body
FROM {part} WHERE p_size <> 3 GROUP BY 1, 2""",
    "angle_matrix": """
SELECT 'ev' || CAST(p_partkey % 4 AS STRING) AS event_slug,
       split_part('saas,services_it,other_commercial', ',', p_size % 3 + 1) AS bucket, max(p_brand) AS angle
FROM {part} GROUP BY 1, 2""",
    "dispatch_results": """
SELECT e.event_id AS row_idx, c.event_slug, c.email,
       CASE e.event_type WHEN 'error' THEN 'failed' ELSE 'sent' END AS status,
       CASE WHEN e.event_type = 'view' THEN NULL ELSE 'msg-' || CAST(CAST(floor(e.event_id / 2) AS BIGINT) AS STRING) END AS message_id,
       e.ts AS sent_at
FROM {events} AS e JOIN {contacts} AS c ON c.id = e.user_id""",
    "call_log": """
SELECT l_orderkey AS call_id, 'ev' || CAST(l_suppkey % 4 AS STRING) AS event_slug,
       l_linestatus || l_returnflag AS purpose, 'model-' || CAST(l_linenumber AS STRING) AS model,
       CASE WHEN l_discount > 0.08 THEN false ELSE true END AS ok,
       CAST(floor(l_quantity) AS BIGINT) AS seconds
FROM {lineitem}""",
    "links": """
SELECT page_id, url FROM {pages}""",
}

_NAME = re.compile(r"\{(\w+)\}")


def names_in(sql: str) -> list[str]:
    return list(dict.fromkeys(_NAME.findall(sql)))


class Views:
    """Spark side: ``views("contacts")`` is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._seen = spark, folder, {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._seen:
            if name in BASE:
                self._seen[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                self._seen[name] = self.sql(VIEWS[name])
        return self._seen[name]

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: self(n) for n in names_in(text)})


def oracle(text: str) -> str:
    """DuckDB side: the same views as CTEs in front of ``text``."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in names_in(sql):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                needed.append(name)

    visit(text)

    def bare(sql: str) -> str:
        return _NAME.sub(r"\1", sql)

    ctes = [f"{name} AS ({bare(VIEWS[name])})" for name in needed]
    body = bare(text).strip()
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body
