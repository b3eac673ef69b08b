"""Segments, message resolution, recipients, arms, dispatch log and linting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from turnout.functions import contact as C, fixed, text as T
from turnout.operators.ordered import attach, in_order, quantiles, top_k

EV = "event_slug"


# --- audience --------------------------------------------------------------------
def segments(enriched: DataFrame) -> DataFrame:
    """attendee / no_show for mailable rows; suppressed rows carry 'suppressed'."""
    rows = enriched.filter(F.col("attendance_status").isin("attended", "no_show"))
    name = F.when(F.coalesce("suppression_reason", F.lit("")) != "", "suppressed").when(
        F.col("attendance_status") == "attended", "attendee").otherwise("no_show")
    return rows.withColumn("segment", name)


def contact_view(emails: DataFrame, enriched: DataFrame, registrants: DataFrame, rules: C.Rules) -> DataFrame:
    """Mailing contact per address: enriched row first, registrant row second, rules for the rest."""
    e = enriched.select(EV, "email", *[F.col(c).alias(f"e_{c}") for c in ("firstname", "jobtitle", "company", "function", "icp_tier", "industry")])
    r = registrants.groupBy(EV, C.email_key(F.col("email")).alias("email")).agg(
        F.max_by(F.struct("first_name", "job_title", "company"), "row_idx").alias("r"))
    j = emails.join(e, [EV, "email"], "left").join(r, [EV, "email"], "left")
    known = F.col("e_jobtitle").isNotNull()

    def pick(a, b):
        return F.when(known, F.coalesce(a, F.lit(""))).otherwise(F.coalesce(b, F.lit("")))
    title = pick(F.col("e_jobtitle"), F.col("r.job_title"))
    stem = F.initcap(F.split_part(C.local_part(F.col("email")), F.lit("."), F.lit(1)))
    first = pick(F.col("e_firstname"), F.col("r.first_name"))
    j = j.withColumns({"job_title": title, "first_name": F.when(first != "", first).otherwise(stem)})
    blank = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    return j.select(
        EV, "email", "first_name", pick(F.col("e_company"), F.col("r.company")).alias("company"), "job_title",
        F.coalesce(blank("e_function"), C.function_by_pattern(F.col("job_title"))).alias("function"),
        F.coalesce(blank("e_icp_tier"), rules.tier_by_title(F.col("job_title"))).alias("icp_tier"),
        C.bucket_of_industry(F.coalesce("e_industry", F.lit(""))).alias("bucket"))


def attendance_snapshot(enriched: DataFrame, k: int = 5) -> DataFrame:
    """Registrants, attendees, rate, mean and median minutes and the top accounts per event."""
    came = F.col("attendance_status") == "attended"
    minutes = F.when(came, F.col("minutes").try_cast("double"))
    n = enriched.filter(F.col("attendance_status").isin("attended", "no_show")).groupBy(EV).agg(
        F.count(F.lit(1)).alias("registrants"), F.count_if(came).alias("attendees"),
        F.coalesce(F.bround(F.avg(minutes), 1), F.lit(0.0)).alias("avg_minutes"))
    middle = quantiles(enriched.select(EV, minutes.alias("_minutes")), [EV], "_minutes", {"_middle": 0.5})
    n = n.join(middle, EV, "left").withColumn("median_minutes", F.coalesce(F.bround("_middle", 1), F.lit(0.0)))
    named = enriched.filter(came & (F.trim("company") != ""))
    counts = named.groupBy(EV, F.trim("company").alias("company")).agg(
        F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("_first"))
    top = top_k(counts, [EV], [F.desc("n"), F.asc("_first")], k).groupBy(EV).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "company", "n"))),
        lambda s: F.concat(s["company"], F.lit(" ("), s["n"].cast("string"), F.lit(")"))), ", ").alias("top_accounts"))
    return n.join(top, EV, "left").select(
        EV, "registrants", "attendees", (F.col("registrants") - F.col("attendees")).alias("no_shows"),
        F.bround(F.try_divide("attendees", "registrants"), 3).alias("attendance_rate"), "avg_minutes", "median_minutes",
        F.coalesce("top_accounts", F.lit("n/a")).alias("top_accounts"))


def with_fallback(enriched: DataFrame, registrants: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """Enriched rows, and for events that have none what else is known.

    That is the event's segment lists where there are any (``segments``: event_slug, no, email, segment, 'attendee' or
    'no_show'), with minutes and company of each address's last registration, or else the registrants themselves.
    """
    came = F.when(F.lower(F.trim("attended")).isin("yes", "true", "attended", "1"), "attended").otherwise("no_show")
    cols = [EV, "row_idx", "attendance_status", "minutes", "company"]
    have = enriched.select(EV).distinct()
    out = enriched.select(*cols)
    if segments is not None:
        lists = segments.join(have, EV, "left_anti").filter(F.col("segment").isin("attendee", "no_show"))
        last = registrants.groupBy(EV, C.email_key(F.col("email")).alias("email")).agg(F.max_by(F.struct("minutes", "company"), "row_idx").alias("r"))
        told = lists.withColumn("email", F.lower("email")).join(last, [EV, "email"], "left").select(
            EV, F.col("no").alias("row_idx"), F.when(F.col("segment") == "attendee", "attended").otherwise("no_show").alias("attendance_status"),
            F.coalesce("r.minutes", F.lit("")).alias("minutes"), F.coalesce("r.company", F.lit("")).alias("company"))
        out, have = out.unionByName(told), have.unionByName(lists.select(EV).distinct())
    shaped = registrants.select(EV, "row_idx", came.alias("attendance_status"), "minutes", "company")
    return out.unionByName(shaped.join(have, EV, "left_anti"))


def snapshot_fields(snapshot: DataFrame) -> DataFrame:
    """The snapshot as display strings for the message tokens."""
    s = lambda c: F.col(c).cast("string").alias(f"snapshot_{c}")
    return snapshot.select(
        EV, s("registrants"), s("attendees"), s("no_shows"), s("avg_minutes"), s("median_minutes"), s("top_accounts"),
        F.concat(F.bround(100 * F.col("attendance_rate")).cast("int").cast("string"), F.lit("%")).alias("snapshot_attendance_rate"))


def audience_mix(contacts: DataFrame) -> DataFrame:
    """Counts by function, by bucket and by both, in one cube."""
    return contacts.cube(EV, "function", "bucket").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g")) \
        .filter(F.col(EV).isNotNull() & (F.col("_g") < 4)).select(
            EV, F.coalesce("function", F.lit("*")).alias("function"), F.coalesce("bucket", F.lit("*")).alias("bucket"), "n")


# --- message resolution -------------------------------------------------------------
def takeaways(contacts: DataFrame, matrix: DataFrame, angles: DataFrame) -> DataFrame:
    """Role takeaway plus industry angle; 'general' and 'other_commercial' are the fallbacks."""
    any_role = matrix.filter("function = 'general'").select(EV, F.col("headline").alias("_gh"), F.col("body").alias("_gb"))
    any_angle = angles.filter("bucket = 'other_commercial'").select(EV, F.col("angle").alias("_ga"))
    j = attach(contacts, matrix, [EV, "function"])
    j = attach(j, any_role, [EV])
    j = attach(j, angles, [EV, "bucket"])
    j = attach(j, any_angle, [EV])
    angle = F.coalesce("angle", "_ga", F.lit(""))
    return j.select(*contacts.columns, F.coalesce("headline", "_gh", F.lit("")).alias("takeaway_headline"),
                    F.trim(F.concat_ws(" ", F.coalesce("body", "_gb", F.lit("")), angle)).alias("takeaway_body"))


def arms(contacts: DataFrame) -> DataFrame:
    """Deterministic A/B split: parity of the position in address order per event and segment."""
    placed = in_order(contacts, [EV, "segment"], ["email"], position="position")
    return placed.withColumn("arm", F.when(F.col("position") % 2 == 0, "a").otherwise("b"))


def links(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Tagged recording and call-to-action links; no-shows are sent to the registration page."""
    dim = events.select(EV, "recording_url", "registration_page", T.event_tag(F.col("event_name"), F.col("date")).alias("campaign"))
    j = attach(rows, dim, [EV], "inner")
    content = F.concat_ws("-", "segment", "arm")
    goal = F.when(F.col("segment") == "no_show", F.coalesce("registration_page", "recording_url")).otherwise(F.col("recording_url"))

    def tag(url):
        return T.with_utm(url, F.lit(fixed.UTM_SOURCE), F.lit(fixed.UTM_MEDIUM), F.col("campaign"), content)
    return j.withColumns({"recording_link": tag(F.col("recording_url")), "cta_link": tag(goal), "utm_content": content}) \
        .drop("recording_url", "registration_page")


def recipients(rows: DataFrame, variants: DataFrame) -> DataFrame:
    """One rendered message per contact; ``leftover`` lists tokens nothing could fill.

    ``variants``: (segment, subject_a, subject_b, body_md), one row per segment.
    """
    j = attach(rows, variants, ["segment"], "inner")
    fields = {"firstname": F.col("first_name"), **{c: F.col(c) for c in (
        "recording_link", "cta_link", "takeaway_headline", "takeaway_body")}}
    j = j.withColumn("body_md", T.render(F.col("body_md"), fields))
    return j.withColumns({
        "subject": F.when(F.col("arm") == "a", F.col("subject_a")).otherwise(F.col("subject_b")),
        "body_text": T.md_text(F.col("body_md")), "leftover": F.array_join(T.tokens(F.col("body_md")), ","),
    }).drop("subject_a", "subject_b")


def demo_redirect(rows: DataFrame) -> DataFrame:
    """The first recipient of the best tier present, per event and segment."""
    order = F.struct(F.coalesce(C.lookup({"tier1": 0, "tier2": 1, "tier3": 2}, F.col("icp_tier")), F.lit(3)), F.col("email"))
    best = rows.groupBy(EV, "segment").agg(F.min_by(F.struct("email", "icp_tier"), order).alias("b"))
    return best.select(EV, "segment", F.col("b.email").alias("selected"), F.col("b.icp_tier").alias("tier_used"),
                       (F.col("b.icp_tier") != "tier1").alias("fallback"))


def sample(rows: DataFrame, k: int = 5) -> DataFrame:
    """Resolved messages of the first ``k`` contacts per segment."""
    return top_k(rows, [EV, "segment"], [F.asc("email")], k)


def approved(rows: DataFrame, mode: str) -> DataFrame:
    """'demo' keeps redirected recipients and speakers, 'full' everyone with an address."""
    if mode == "demo":
        return rows.filter(F.col("redirected") | (F.col("segment") == "speaker"))
    return rows.filter(F.coalesce("email", F.lit("")) != "")


def speaker_quotes(quotes: DataFrame, k: int = 3) -> DataFrame:
    """Up to ``k`` verified quotes per speaker in order, as one block of quoted lines."""
    kept = top_k(quotes.filter("verified"), [EV, "speaker"], [F.asc("quote_no")], k)
    line = F.concat(F.lit('> "'), F.col("text"), F.lit('" -- ['), F.col("stamp"), F.lit("]"))
    return kept.withColumn("_l", line).groupBy(EV, "speaker").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "_l"))), lambda s: s["_l"]), "\n").alias("quotes"))


# --- linting ------------------------------------------------------------------------
def variant_problems(variants: DataFrame) -> DataFrame:
    """Every rule a message variant breaks, one row per problem."""
    found = F.array_distinct(T.tokens(F.col("body_md")))

    def per_segment(table):
        chain = F
        for seg, names in table.items():
            chain = chain.when(F.col("segment") == seg, F.array(*[F.lit(n) for n in names]))
        return chain.otherwise(F.array().cast("array<string>"))
    base = ("firstname", "recording_link", "cta_link")
    allowed = per_segment({"attendee": base + ("takeaway_headline", "takeaway_body"), "no_show": base + ("takeaway_headline", "takeaway_body"),
                           "speaker": base + fixed.SNAPSHOT_TOKENS})
    missing, unknown = F.array_except(per_segment(fixed.REQUIRED_TOKENS), found), F.array_except(found, allowed)
    snap = F.size(F.filter(found, lambda t: t.startswith("snapshot_")))
    n_words = F.size(F.regexp_extract_all(F.col("body_md"), F.lit(r"(\w+)"), F.lit(1)))
    n_take = F.size(F.filter(F.col("takeaways"), lambda t: F.trim(t) != ""))
    problems = [
        F.when(F.trim("subject_a") == "", "missing subject_a"), F.when(F.trim("subject_b") == "", "missing subject_b"),
        F.when(F.trim("preheader") == "", "missing preheader"), F.when(F.trim("body_md") == "", "missing body_md"),
        F.when(F.trim("subject_a") == F.trim("subject_b"), "subjects are not an A/B pair"),
        F.when((n_take < 3) | (n_take > 5), F.format_string("takeaways: %d", n_take)),
        F.when(F.size(missing) > 0, F.concat(F.lit("missing tokens: "), F.array_join(F.array_sort(missing), ","))),
        F.when(F.size(unknown) > 0, F.concat(F.lit("unknown tokens: "), F.array_join(F.array_sort(unknown), ","))),
        F.when((F.col("segment") == "speaker") & (snap < 4), F.format_string("snapshot tokens: %d", snap)),
        F.when(n_words > 400, F.format_string("words: %d", n_words)),
    ]
    return variants.select("variant_id", "segment", F.explode(F.filter(F.array(*problems), lambda p: p.isNotNull())).alias("problem"))


def talks_about_self(name: Column, body: Column) -> Column:
    """Does a speaker's own mail refer to them in the third person?"""
    first = F.split_part(F.trim(name), F.lit(" "), F.lit(1))
    pattern = F.concat(F.lit(r"(?i)\b\Q"), first, F.lit(r"\E\s+(" + "|".join(fixed.SELF_VERBS) + r")\b"))
    return F.regexp_like(body, pattern)


def extraction_problems(takeaways_: DataFrame, quotes: DataFrame, moments: DataFrame, roster: DataFrame) -> DataFrame:
    """Cardinality rules of an extraction: 5-7 takeaways, 4-6 quotes, 3 moments, every speaker quoted."""
    def usable(df, name, lo, hi):
        n = df.filter(T.seconds_of(F.col("stamp")).isNotNull() & (F.trim("text") != "")).groupBy(EV).agg(F.count(F.lit(1)).alias("n"))
        return roster.select(EV).distinct().join(n, EV, "left").withColumn("n", F.coalesce("n", F.lit(0))).filter(
            ~F.col("n").between(lo, hi)).select(EV, F.format_string(f"{name}: %d, need {lo}-{hi}", F.col("n")).alias("problem"))
    said = quotes.select(EV, F.lower("speaker").alias("_s")).distinct()
    silent = roster.withColumn("_s", F.lower("name")).join(said, [EV, "_s"], "left_anti").select(
        EV, F.concat(F.lit("no quote from "), F.col("name")).alias("problem"))
    return usable(takeaways_, "takeaways", 5, 7).unionByName(usable(quotes, "quotes", 4, 6)).unionByName(
        usable(moments, "moments", 3, 3)).unionByName(silent)


# --- dispatch log ----------------------------------------------------------------------
def dispatch_triage(results: DataFrame, plan: DataFrame) -> DataFrame:
    """Each result is logged, skipped (with reason) or an error (recipient not planned)."""
    who = plan.select(EV, "email").distinct().withColumn("_planned", F.lit(True))
    j = results.join(who, [EV, "email"], "left")
    sent = (F.col("status") == "sent") & (F.coalesce("message_id", F.lit("")) != "")
    outcome = F.when(~sent, "skipped").when(F.col("_planned").isNull(), "error").otherwise("logged")
    reason = F.when(sent & F.col("_planned").isNull(), "recipient not planned").when(sent, "").when(
        F.col("status") == "failed", "status=failed").otherwise("missing message_id")
    return j.withColumns({"outcome": outcome, "reason": reason}).drop("_planned")


def new_log_rows(triaged: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """Rows to append: one per message id, none that the log already holds."""
    once = triaged.filter("outcome = 'logged'").groupBy(EV, "message_id").agg(
        F.min_by(F.struct("email", "row_idx", "sent_at"), "row_idx").alias("r")).select(EV, "message_id", "r.*")
    return once if log is None else once.join(log.select(EV, "message_id"), [EV, "message_id"], "left_anti")
