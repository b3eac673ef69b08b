"""Scans, sinks and streams over the given tables."""

from pyspark.sql import functions as F

from turnout.functions import fixed
from turnout.operators import engagement as E, enrich as N, reports as P, transcript as X
from turnout.operators.ordered import tasks
from turnout.queries.analytics import ACCOUNTS, CHANGES, COUNTERS, attending
from turnout.queries.content import CUES
from turnout.queries.registry import QUERIES, query
from turnout.session import scratch
from turnout.sources import readers as R, sinks as S
from turnout.sources.versions import Log
from turnout.streaming import jobs as J, release
from turnout.streaming.analysis import Analysis


# --- scans and sinks --------------------------------------------------------------------
@query("registrant_csv", "SRC1", "SELECT row_idx::VARCHAR AS row_idx, event_slug, first_name, last_name, email, job_title, company, country, attended, minutes FROM {registrants}")
def _(v):
    path = scratch(v.spark, "registrants")
    odd = v("registrants").select("row_idx", "event_slug", F.col("first_name").alias("First Name"), F.col("last_name").alias("SURNAME"),
                                  F.col("email").alias("E-mail"), F.col("job_title").alias("Position"), F.col("company").alias("Organisation"),
                                  F.col("country").alias("Country/Region"), F.col("attended").alias("Did attend?"),
                                  F.col("minutes").alias("Time in Session (minutes)"))
    odd.write.csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return R.registrants(v.spark, path).select("row_idx", "event_slug", "first_name", "last_name", "email", "job_title", "company", "country", "attended", "minutes")


@query("crm_json", "SRC2", "SELECT vid, event_slug, email, firstname, lifecyclestage FROM {crm}")
def _(v):
    path = scratch(v.spark, "crm")
    v("crm").write.json(path)
    return R.crm_contacts(v.spark, path, multiline=False).select("vid", "event_slug", "email", "firstname", "lifecyclestage")


@query("enriched_scan", "SRC3", """SELECT event_slug, email, firstname AS first_name, trim(coalesce(nullif(trim(jobtitle), ''), '')) AS job_title, company, icp_tier AS icp_tier, minutes FROM {enriched}""")
def _(v):
    path = scratch(v.spark, "enriched")
    v("enriched").select("event_slug", F.col("email").alias("Email"), F.col("firstname").alias("First Name"), F.lit("").alias("jobtitle"),
                         F.col("jobtitle").alias("Title"), F.col("company").alias("Company Name"), F.col("icp_tier").alias("tier"),
                         F.col("minutes").alias("Time in Session (minutes)")).write.json(path)
    return R.enriched(v.spark, path, "json").select("event_slug", "email", "first_name", "job_title", "company", "icp_tier", "minutes")


@query("stt_scan", "SRC5", """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN turn * 30.0 ELSE 0.0 END::DOUBLE AS start_sec, CASE WHEN turn % 2 = 0 THEN role ELSE 'Unknown' END AS speaker, length(trim(text)) AS chars FROM {conversations}""")
def _(v):
    start = (F.col("turn") * 30).cast("double")
    nested = F.to_json(F.struct(F.struct(F.array(F.struct(start.alias("start_time_seconds"), (start + 9).alias("end_time_seconds"), F.col("role").alias("speaker_id"),
                                                          F.col("text").alias("transcript"))).alias("entries")).alias("diarized_transcript")))
    plain = F.to_json(F.struct(F.col("text").alias("transcript")))
    files = v("conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, nested).otherwise(plain).alias("value"))
    return R.stt_turns(files).select("conv_id", "turn", "start_sec", "speaker", F.length("text").cast("bigint").alias("chars"))


@query("limited_scan", "SNK7", "SELECT row_idx, email FROM {registrants} ORDER BY row_idx LIMIT 50")
def _(v):
    return R.first_rows(v("registrants"), 50).select("row_idx", "email")


@query("exported_views", "SNK1 SNK3", "SELECT event_slug, email, jobtitle, company, icp_tier FROM {enriched}")
def _(v):
    folder = scratch(v.spark, "views")
    rows = v("enriched")
    S.write_views(rows, N.company_rows(rows), folder)
    back = v.spark.read.csv(f"{folder}/contacts", header=True)
    return back.select("event_slug", "email", "jobtitle", "company", "icp_tier")


@query("event_partitions", "SNK3", "SELECT event_slug, id, CASE WHEN event_slug = 'ev1' THEN 'second' ELSE 'first' END AS run FROM {contacts}")
def _(v):
    path = scratch(v.spark, "events")
    rows = v("contacts").select("event_slug", "id", F.lit("first").alias("run"))
    S.write_events(rows, path)
    S.write_events(rows.filter("event_slug = 'ev1'").withColumn("run", F.lit("second")), path)
    return v.spark.read.parquet(path).select(F.col("event_slug").cast("string").alias("event_slug"), "id", "run")


@query("report_files", "SNK2", "SELECT event_slug, purpose, model, count(*) AS attempts FROM {call_log} GROUP BY 1, 2, 3")
def _(v):
    path = scratch(v.spark, "report")
    S.write_report(P.call_summary(v("call_log")), path)
    return v.spark.read.json(path).select("event_slug", "purpose", "model", "attempts")


@query("caption_files", "SNK4", f"WITH {CUES} SELECT recording_id, count(*) * 3 AS text_lines FROM cues GROUP BY 1")
def _(v):
    path = scratch(v.spark, "captions")
    S.write_ordered_text(X.cue_text(X.cues(v("turns"))), path, "recording_id", "cue_no")
    back = v.spark.read.option("basePath", path).text(path).filter("value <> ''")
    return back.groupBy(F.col("recording_id").cast("bigint").alias("recording_id")).agg(F.count(F.lit(1)).alias("text_lines"))


@query("receipt_log", "SNK5 AGG26", "SELECT event_slug, call_id, seconds, model, ok, call_id % 2 AS part FROM {call_log}")
def _(v):
    path = scratch(v.spark, "receipts")
    log = v("call_log").withColumn("part", F.col("call_id") % 2)
    for part in (0, 1, 0):  # the repeated job replaces its part
        S.append_log(log.filter(F.col("part") == part), path, f"calls-{part}")
    return Log(v.spark, path).read().select("event_slug", "call_id", "seconds", "model", "ok", "part")


@query("asset_manifest", "SNK6", """WITH a AS (SELECT asset_id, kind AS name, text FROM {spec_assets} UNION ALL SELECT asset_id, 'clip.mp4', 'two words' FROM {spec_assets})
SELECT asset_id || '/' || name AS asset_id, strlen(text) + 1 AS bytes, CASE name WHEN 'clip.mp4' THEN 'clip' ELSE split_part(name, '.', 1) END AS kind, CASE name WHEN 'clip.mp4' THEN 'ffmpeg' ELSE 'llm' END AS source,
  CASE WHEN name <> 'clip.mp4' THEN CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split_regex(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+')) END END AS words,
  CASE WHEN name <> 'clip.mp4' THEN asset_id % 2 = 0 END AS grounded FROM a""")
def _(v):
    path = scratch(v.spark, "assets")
    own = v("spec_assets").select("asset_id", F.col("kind").alias("name"), F.col("text").alias("value"))
    clips = own.select("asset_id", F.lit("clip.mp4").alias("name"), F.lit("two words").alias("value"))
    named = F.concat(F.col("asset_id").cast("string"), F.lit("/"), F.col("name"))
    S.write_assets(own.unionByName(clips).select(named.alias("asset_id"), "value"), path)
    passed = own.select(named.alias("asset_id"), (F.col("asset_id") % 2 == 0).alias("passed"))
    return S.manifest(v.spark, path, passed).select("asset_id", "bytes", "kind", "source", "words", "grounded")


# --- streams -----------------------------------------------------------------------------
def table_stream(v, name):
    return J.file_stream(v.spark, v.folder, v(name).schema, glob=f"{name}.parquet")


def event_stream(v):
    """The events table as a stream, joined to its contacts."""
    kinds = F.when(F.col("event_type") == "purchase", "form_fill").when(F.col("event_type") == "view", "pageview").when(
        F.col("event_type") == "signup", "open").otherwise(F.col("event_type"))
    who = v("contacts").select(F.col("id").alias("user_id"), "event_slug", "email")
    return table_stream(v, "events").join(who, "user_id").select(
        "event_id", "event_slug", "email", kinds.alias("type"), F.col("ts").cast("timestamp").alias("ts"))


def change_stream(v):
    who = v("contacts").select(F.col("id").alias("o_custkey"), "event_slug", "email")
    return table_stream(v, "orders").join(who, "o_custkey").select(
        F.col("o_orderkey").alias("row_idx"), "event_slug", "email", F.expr("CAST(o_orderdate + INTERVAL '8216' DAY AS timestamp)").alias("ts"))


@query("stream_counters", "STM2 AGG1", f"""WITH {COUNTERS}
SELECT event_slug, email, opens, clicks, pageviews, form_fills, strftime(last_engaged, '%Y-%m-%d %H:%M:%S') AS last_engaged FROM counts""")
def _(v):
    return J.upsert(J.live_counters(event_stream(v)), ["event_slug", "email"]).withColumn(
        "last_engaged", F.date_format("last_engaged", "yyyy-MM-dd HH:mm:ss"))


def change_rows(v):
    who = v("contacts").select(F.col("id").alias("o_custkey"), "event_slug", "email")
    return v("orders").join(who, "o_custkey").select(
        F.col("o_orderkey").alias("row_idx"), "event_slug", "email", F.expr("CAST(o_orderdate + INTERVAL '8216' DAY AS timestamp)").alias("ts"))


@query("stream_timeline", "STM4", f"""WITH {CHANGES} SELECT event_slug, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n,
  date_trunc('day', any_value(ts)) + INTERVAL 1 DAY > (SELECT max(ts) FROM changes) - INTERVAL 1 DAY AS provisional FROM changes GROUP BY 1, 2""")
def _(v):
    return J.with_open(J.settle(J.daily_timeline(change_stream(v))), J.daily_timeline(change_rows(v)), ["event_slug", "day"])


@query("stream_movement", "STM3", """WITH c AS (SELECT event_slug, ts FROM {lifecycle}),
w AS (SELECT event_slug, days, date_trunc('day', ts) + to_days(k::INTEGER) AS until FROM c, (VALUES (7), (14), (30)) AS d(days), unnest(range(1, days + 1)) AS r(k))
SELECT event_slug, days, strftime(until, '%Y-%m-%d') AS until, count(*) AS transitions, until > (SELECT max(ts) FROM c) - INTERVAL 1 DAY AS provisional
FROM w GROUP BY event_slug, days, w.until""")
def _(v):
    each = [J.with_open(J.settle(J.trailing_movement(change_stream(v), n)), J.trailing_movement(change_rows(v), n), ["event_slug", "until"]).withColumn("days", F.lit(n))
            for n in fixed.MOVEMENT_DAYS]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("stream_visits", "STM5", """WITH e AS (SELECT event_slug, email, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM {engagement} WINDOW w AS (PARTITION BY event_slug, email ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY event_slug, email ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM e),
g AS (SELECT event_slug, email, min(ts) AS started, max(ts) AS last, count(*) AS events FROM s GROUP BY event_slug, email, sid)
SELECT event_slug, email, strftime(started, '%Y-%m-%d %H:%M:%S') AS started, events, last + INTERVAL 30 MINUTE > (SELECT max(ts) FROM {engagement}) - INTERVAL 1 HOUR AS provisional FROM g""")
def _(v):
    rows = v("engagement").select("event_id", "event_slug", "email", "type", F.col("ts").cast("timestamp").alias("ts"))
    done = J.with_open(J.settle(J.visits(event_stream(v))), J.visits(rows), ["event_slug", "email", "started"])
    return done.withColumn("started", F.date_format("started", "yyyy-MM-dd HH:mm:ss"))


def kept_up_to_date(v, files=3):
    """The reports after three batches of each stream, from what the batches added; a batch is files enough for all tasks."""
    streams, each = [], -(-tasks(v.spark) // files)
    for name in ("engagement", "lifecycle"):
        path = scratch(v.spark, name)
        v(name).repartition(files * each).write.parquet(path)
        streams.append(J.file_stream(v.spark, path, v.spark.read.parquet(path).schema, maxFilesPerTrigger=each))
    kept = Analysis(v.spark, scratch(v.spark, "analysis"))
    kept.refresh(*streams)
    return kept.reports(attending(v), v("mail_touches"))


@query("stream_analysis", "STM9", f"""WITH {ACCOUNTS} SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY event_slug ORDER BY score DESC, company, domain) AS rank FROM accounts) WHERE rank <= 10""")
def _(v):
    return kept_up_to_date(v)["top_accounts"]


@query("stream_windows", "STM9 AGG20", QUERIES["movement_windows"].sql)
def _(v):
    f = "yyyy-MM-dd HH:mm:ss"
    return kept_up_to_date(v)["movement"].withColumns({c: F.date_format(c, f) for c in ("window_start", "window_end")})


@query("stream_seed_labels", "STM8", f"""WITH {CHANGES}, r AS (SELECT event_slug, min(ts) AS cut FROM {{engagement}} GROUP BY 1)
SELECT c.event_slug, row_idx, CASE WHEN c.ts >= r.cut THEN 'seeded' ELSE 'crm_history' END AS source FROM changes c LEFT JOIN r USING (event_slug)""")
def _(v):
    runs = v("engagement").groupBy("event_slug").agg(F.min("ts").alias("seed_started"))
    return J.settle(J.seed_labels(change_stream(v), runs)).select("event_slug", "row_idx", "source")


@query("stream_registrants", "STM1", "SELECT event_slug, count(*) AS n FROM {registrants} WHERE trim(first_name) <> 'Test' AND lower(trim(email)) NOT LIKE 'noreply@%' GROUP BY 1")
def _(v):
    drop, out = scratch(v.spark, "drop"), scratch(v.spark, "people")
    v("registrants").write.csv(drop, header=True, quoteAll=True, escape='"')
    stream = J.file_stream(v.spark, drop, v("registrants").schema, "csv", header=True, escape='"')

    def handle(batch, number):
        N.people(N.prepared(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")
    J.ingest(stream, handle)
    return v.spark.read.parquet(out).groupBy("event_slug").agg(F.count(F.lit(1)).alias("n"))


@query("stream_answers", "STM6", """WITH a AS (SELECT l_orderkey AS run_id, l_linenumber, l_quantity::BIGINT::VARCHAR AS payload FROM {lineitem} WHERE l_linenumber <= 5)
SELECT o_orderkey AS run_id, o_custkey AS company_id, max_by(payload, (l_linenumber, payload)) AS payload FROM {orders} LEFT JOIN a ON run_id = o_orderkey GROUP BY 1, 2""")
def _(v):
    # a line answers two minutes after the one before it; what comes after ten minutes is too late
    asked = table_stream(v, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("company_id"),
                                             F.col("o_orderdate").cast("timestamp").alias("asked_at"))
    who = v("orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("company_id"), F.col("o_orderdate").cast("timestamp").alias("_at"))
    replies = table_stream(v, "lineitem").withColumnRenamed("l_orderkey", "run_id").join(who, "run_id").select(
        "run_id", "company_id", (F.col("_at") + F.make_dt_interval(mins=F.col("l_linenumber") * 2)).alias("answered_at"),
        F.col("l_quantity").cast("bigint").cast("string").alias("payload"))
    return J.newest_answer(J.settle(J.assembled_answers(asked, replies)))


def result_stream(v):
    who = v("contacts").select(F.col("id").alias("user_id"), "event_slug", "email")
    return table_stream(v, "events").join(who, "user_id").select(
        F.col("event_id").alias("row_idx"), "event_slug", "email", F.when(F.col("event_type") == "error", "failed").otherwise("sent").alias("status"),
        F.when(F.col("event_type") != "view", F.concat(F.lit("msg-"), F.floor(F.col("event_id") / 2).cast("string"))).alias("message_id"),
        F.col("ts").cast("timestamp").alias("sent_at"))


@query("stream_dispatch_log", "STM7", "SELECT DISTINCT event_slug, message_id FROM {dispatch_results} WHERE status = 'sent' AND message_id IS NOT NULL")
def _(v):
    path = scratch(v.spark, "log")
    for _ in range(2):  # a replay must not add anything
        J.log_sends(result_stream(v), path)
    return v.spark.read.parquet(path).select("event_slug", "message_id")


@query("stream_sla", "STM10", """WITH c AS (SELECT DISTINCT event_slug, date_trunc('day', ts) AS closed FROM {engagement} WHERE type = 'error')
SELECT d.event_slug, d.row_idx, count(*) AS closes FROM {dispatch_results} d JOIN c ON c.event_slug = d.event_slug AND d.sent_at >= c.closed AND d.sent_at <= c.closed + INTERVAL 24 HOUR WHERE d.status = 'sent' GROUP BY 1, 2""")
def _(v):
    closes = v("engagement").filter("type = 'error'").select("event_slug", F.date_trunc("day", F.col("ts").cast("timestamp")).alias("closed_at")).distinct()
    path = scratch(v.spark, "closes")
    closes.write.parquet(path)
    stream = J.file_stream(v.spark, path, closes.schema)
    return J.settle(J.sla(result_stream(v).filter("status = 'sent'"), stream)).groupBy("event_slug", "row_idx").agg(F.count(F.lit(1)).alias("closes"))


BEGUN = "1995-01-01 00:00:00"


@query("stream_releases", "STM6", """WITH r AS (SELECT o_custkey AS run_id, o_orderkey AS company_id, o_custkey % 97 AS h FROM {orders}),
a AS (SELECT l_orderkey AS company_id, min(l_suppkey % 13) AS m FROM {lineitem} WHERE l_suppkey % 13 <= 10 GROUP BY 1),
g AS (SELECT run_id, any_value(h) AS h, count(*) AS n_asked, count(m) AS answered, max(m) AS last FROM r LEFT JOIN a USING (company_id) GROUP BY 1)
SELECT run_id::VARCHAR AS run_id, n_asked, answered, n_asked = answered AS complete,
  strftime(TIMESTAMP '1995-01-01 00:00:00' + to_minutes((h * 60 + CASE WHEN n_asked = answered THEN last ELSE 10 END)::INT), '%Y-%m-%d %H:%M') AS released_at
FROM g WHERE n_asked = answered OR h < 96""")
def _(v):
    # a customer's orders are asked for in one run; each line answers some minutes later, from the eleventh on too late
    asked_at = (F.lit(BEGUN).cast("timestamp") + F.make_dt_interval(hours=(F.col("run_id") % 97).cast("int"))).alias("asked_at")
    sizes = v("orders").groupBy(F.col("o_custkey").alias("run_id")).agg(F.count(F.lit(1)).alias("n_asked"))
    asks = table_stream(v, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("company_id")).join(sizes, "run_id").select(
        "run_id", "company_id", asked_at, "n_asked")
    who = v("orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("company_id"))
    says = table_stream(v, "lineitem").withColumnRenamed("l_orderkey", "company_id").join(who, "company_id").select(
        "run_id", "company_id", asked_at, F.make_dt_interval(mins=(F.col("l_suppkey") % 13).cast("int")).alias("_m")).select(
        "run_id", "company_id", (F.col("asked_at") + F.col("_m")).alias("answered_at"))
    return J.settle(release.released_runs(asks, says)).withColumn("released_at", F.date_format("released_at", "yyyy-MM-dd HH:mm"))
