"""CRM payloads, quarantine, upsert plans, associations and snapshot assembly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from turnout.functions import contact as C, fixed
from turnout.operators.engagement import COUNTERS

EV = "event_slug"


# --- payloads -------------------------------------------------------------------
def owner_ids(rows: DataFrame, rules: C.Rules, directory: DataFrame) -> DataFrame:
    """Region -> owner address -> owner id, with the reason when either hop misses.

    ``directory`` (owner_email, owner_id) may be large; it joins by address.
    """
    bucket = F.upper(F.trim(F.coalesce("region", F.lit(""))))
    j = rows.withColumns({"_bucket": bucket, "_mail": C.lookup(rules.owner_map, bucket)})
    j = j.join(directory.select(F.col("owner_email").alias("_mail"), "owner_id").dropDuplicates(["_mail"]), "_mail", "left")
    why = F.when(F.col("_mail").isNull(), F.concat(F.lit("no owner for region '"), F.when(F.col("_bucket") == "", "(blank)").otherwise(
        F.col("_bucket")), F.lit("'"))).when(F.col("owner_id").isNull(), F.concat(F.lit("owner '"), F.col("_mail"), F.lit("' not in the directory"))).otherwise("")
    return j.withColumn("owner_skip", why).drop("_bucket", "_mail")


def contact_payload(rows: DataFrame, tag: str) -> DataFrame:
    """Upsert rows for contacts: flags as words, unknown stages omitted (NULL = not sent)."""
    return rows.filter(F.trim(F.coalesce("email", F.lit(""))) != "").select(
        EV, F.trim("email").alias("email"), "firstname", "lastname", "jobtitle", "company", "country", "icp_tier",
        "attendance_status", F.when(F.col("needs_review"), "true").otherwise("false").alias("needs_review"),
        F.lit(tag).alias("event_tag"), F.nullif(C.crm_stage(F.col("lifecyclestage")), F.lit("")).alias("lifecyclestage"))


def speaker_payload(paired: DataFrame, tag: str) -> DataFrame:
    """Speakers with an inbox, fixed at 'evangelist'."""
    name = F.split(F.trim("name"), r"\s+")
    return paired.filter("email <> ''").select(
        EV, "email", name[0].alias("firstname"),
        F.array_join(F.slice(name, 2, F.greatest(F.size(name) - 1, F.lit(0))), " ").alias("lastname"),
        F.trim("title").alias("jobtitle"), F.trim("company").alias("company"), F.lit("evangelist").alias("lifecyclestage"),
        F.lit(tag).alias("event_tag"))


def company_payload(companies: DataFrame, tag: str) -> DataFrame:
    return companies.filter(F.trim(F.coalesce("domain", F.lit(""))) != "").select(
        EV, F.trim("domain").alias("domain"), "name", "numemployees", C.crm_industry(F.col("industry")).alias("industry"),
        F.lit(tag).alias("event_tag"))


def quarantined(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Split rows into valid ones and rejects that name every broken check.

    One bad record never costs its batch: validity is a column, not an exception.
    """
    reason = F.concat_ws("; ", *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    marked = rows.withColumn("reason", reason)
    return marked.filter("reason = ''").drop("reason"), marked.filter("reason <> ''")


# --- write plans -------------------------------------------------------------------
def upsert_plan(payload: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """'update' with the known id where the key exists, 'create' where it does not."""
    known = existing.withColumn("_k", F.lower(key)).groupBy("_k").agg(F.min("id").alias("id"))
    j = payload.withColumn("_k", F.lower(key)).join(known, "_k", "left").drop("_k")
    return j.withColumn("action", F.when(F.col("id").isNotNull(), "update").otherwise("create"))


def id_map(results: DataFrame, key: str) -> DataFrame:
    """Key -> id out of write results (arrays of id and properties); the last write wins."""
    rows = results.select("call_no", F.posexplode("results").alias("_pos", "r")).select(
        "call_no", "_pos", F.col("r.id").alias("id"), F.col(f"r.{key}").alias(key))
    rows = rows.filter((F.coalesce(key, F.lit("")) != "") & F.col("id").isNotNull())
    return rows.groupBy(key).agg(F.max_by("id", F.struct("call_no", "_pos")).alias("id"))


def associations(contacts: DataFrame, company_ids: DataFrame, contact_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contact <-> company rows, and what had to be skipped per event."""
    j = contacts.select(EV, F.trim("email").alias("email"), F.trim(F.coalesce("company_domain", F.lit(""))).alias("domain"))
    j = j.join(contact_ids.select("email", F.col("id").alias("contact_id")), "email", "left").join(
        company_ids.select("domain", F.col("id").alias("company_id")), "domain", "left")
    linked = F.col("contact_id").isNotNull() & F.col("company_id").isNotNull() & (F.col("domain") != "")
    return (j.filter(linked).select(EV, "contact_id", "company_id"),
            j.groupBy(EV).agg(F.count_if(linked).alias("linked"), F.count_if(~linked).alias("skipped")))


def email_log(batches: DataFrame, contact_ids: DataFrame, gates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sends of approved events with a known contact; the rest counted.

    ``batches``: (event_slug, batch_no, subject, sends ARRAY<STRUCT<to>>).  An
    event without a gate row is open; a closed gate lets nothing through.
    """
    closed = gates.filter(~F.col("approved")).select(EV)
    sends = batches.join(closed, EV, "left_anti").select(EV, "batch_no", "subject", F.posexplode("sends").alias("send_no", "s")).select(
        EV, "batch_no", "send_no", "subject", F.col("s.to").alias("email"))
    j = sends.join(contact_ids.select("email", F.col("id").alias("contact_id")), "email", "left")
    hit = F.col("contact_id").isNotNull()
    return j.filter(hit), j.groupBy(EV).agg(F.count_if(hit).alias("entries"), F.count_if(~hit).alias("skipped"))


def reconciled(written: DataFrame, found: DataFrame) -> DataFrame:
    """Rows written against rows found, per event tag."""
    a = written.groupBy("event_tag").agg(F.count(F.lit(1)).alias("written"))
    b = found.groupBy("event_tag").agg(F.count(F.lit(1)).alias("found"))
    return a.join(b, "event_tag", "full_outer").fillna(0, ["written", "found"]).withColumn(
        "missing", F.col("written") - F.col("found"))


# --- snapshot ---------------------------------------------------------------------------
def no_shows(segments: DataFrame) -> DataFrame:
    """No-show addresses that are not attendees as well."""
    mail = segments.select(EV, "segment", F.lower("email").alias("email"))
    return mail.filter("segment = 'no_show'").select(EV, "email").distinct().join(
        mail.filter("segment = 'attendee'").select(EV, "email").distinct(), [EV, "email"], "left_anti")


def key_union(*sources: DataFrame) -> DataFrame:
    """Every (event, address) any source knows, once."""
    return reduce(DataFrame.union, [s.select(EV, F.lower("email").alias("email")).distinct() for s in sources]).distinct()


def matched_keys(stream: DataFrame, crm: DataFrame) -> DataFrame:
    keys = lambda d: d.select(EV, F.lower("email").alias("email"))
    return keys(stream).intersect(keys(crm))


def company_of_domain(crm: DataFrame) -> DataFrame:
    """First named CRM row per domain."""
    d = crm.filter(F.coalesce("company", F.lit("")) != "").withColumn("domain", C.account_key(F.col("email")))
    return d.filter(F.col("domain").isNotNull()).groupBy(EV, "domain").agg(F.min_by("company", "vid").alias("domain_company"))


def snapshot(crm: DataFrame, totals: DataFrame, finals: DataFrame, segments: DataFrame, rules: C.Rules) -> DataFrame:
    """Contact snapshot: every source's rows under their key, one aggregate for all attributes.

    Each source is read once and the rows meet in a single shuffle by (event, address).
    """
    email = F.lower("email").alias("email")
    held = F.struct("vid", "firstname", "lastname", "company", "jobtitle", "lifecyclestage", "country").alias("c")
    counted = [*COUNTERS, "last_engaged"]
    rows = (crm.select(EV, email, held)
            .unionByName(totals.select(EV, email, F.struct(*counted).alias("t")), allowMissingColumns=True)
            .unionByName(finals.select(EV, email, F.col("stage").alias("_stage")), allowMissingColumns=True)
            .unionByName(segments.select(EV, email, (F.col("segment") == "attendee").alias("_came"), (F.col("segment") == "no_show").alias("_missed")),
                         allowMissingColumns=True))
    one = rows.filter("email IS NOT NULL").groupBy(EV, "email").agg(
        F.max_by("c", "c.vid").alias("c"), F.max("t").alias("t"), F.max("_stage").alias("_stage"),
        F.bool_or("_came").alias("_came"), F.bool_or("_missed").alias("_missed"))
    j = one.select("*", "t.*").drop("t").withColumn("domain", C.account_key(F.col("email")))
    j = j.join(company_of_domain(crm), [EV, "domain"], "left")
    blank = F.lit("")
    region = rules.region_plain(F.col("c.country"))
    return j.withColumn("region", region).select(
        EV, "email", F.coalesce(F.col("c.vid").cast("string"), blank).alias("contact_id"),
        F.coalesce("c.firstname", blank).alias("firstname"), F.coalesce("c.lastname", blank).alias("lastname"),
        F.coalesce(F.nullif(F.col("c.company"), blank), "domain_company", C.display_company(F.col("domain")), blank).alias("company"),
        F.coalesce("c.jobtitle", blank).alias("jobtitle"), F.coalesce("_stage", C.stage_name(F.col("c.lifecyclestage"))).alias("lifecyclestage"),
        *[F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in COUNTERS], "last_engaged", "region",
        F.coalesce(C.lookup(rules.owners, F.col("region")), blank).alias("owner"),
        F.when(F.col("_came"), "attended").when(F.col("_missed"), "no_show").otherwise("").alias("attendance_status"))


def overlay(base: DataFrame, detail: DataFrame, key: str = "contact_id") -> DataFrame:
    """Detail row over search row: the detail's non-null values win."""
    cols = [c for c in detail.columns if c != key]
    j = base.join(detail.select(key, *[F.col(c).alias(f"_d_{c}") for c in cols]), key, "left")
    kept = [F.coalesce(f"_d_{c}", c).alias(c) if c in cols else F.col(c) for c in base.columns]
    added = [F.col(f"_d_{c}").alias(c) for c in cols if c not in base.columns]
    return j.select(*kept, *added)


def contact_companies(contacts: DataFrame) -> DataFrame:
    """Bridge of contacts and the account their domain names."""
    return contacts.withColumn("domain", C.account_key(F.col("email"))).filter(F.col("domain").isNotNull()).select(
        EV, "domain", "contact_id")


def companies(contacts: DataFrame, known: DataFrame) -> DataFrame:
    """Portal companies plus one per uncovered contact domain.

    ``known``: (event_slug, domain, company_id, name).
    """
    own = contacts.withColumn("domain", C.account_key(F.col("email"))).filter(F.col("domain").isNotNull())
    named = F.nullif(F.col("company"), F.lit(""))
    derived = own.groupBy(EV, "domain").agg(
        F.count(F.lit(1)).alias("contacts"), F.min_by(named, F.when(named.isNotNull(), F.col("email"))).alias("_name"))
    covered = derived.join(known, [EV, "domain"], "left_anti").select(
        EV, "domain", F.coalesce("_name", C.display_company(F.col("domain"))).alias("name"), "contacts", F.lit("derived").alias("origin"))
    portal = known.join(derived.select(EV, "domain", "contacts"), [EV, "domain"], "left").select(
        EV, "domain", F.coalesce(F.nullif(F.col("name"), F.lit("")), C.display_company(F.col("domain"))).alias("name"),
        F.coalesce("contacts", F.lit(0).cast("bigint")).alias("contacts"), F.lit("portal").alias("origin"))
    return portal.unionByName(covered)


def email_engagements(links: DataFrame, mails: DataFrame) -> DataFrame:
    """One row per contact and mail; mails that do not resolve are dropped."""
    ids = links.select(EV, "contact_id", F.explode("mail_ids").alias("mail_id"))
    return ids.join(mails.select("mail_id", "subject", "ts"), "mail_id", "inner")
