"""Registrant enrichment: preparation, peer votes, cascade, precedence merges, final tier."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from turnout.functions import contact as C, fixed
from turnout.operators.ordered import majority, spread, top_k
from turnout.session import settled

EV = "event_slug"


# --- preparation --------------------------------------------------------------
def prepared(registrants: DataFrame) -> DataFrame:
    """Normalised registrants; ``reject_reason`` is '' for people and names the rule otherwise.

    Rows are dealt out ahead of the rules and written once behind them: a small file is one scan task, and a later
    filter on the reason would be pushed into that scan, with all expressions it is made of.
    """
    text = lambda c: C.strip(F.coalesce(c, F.lit("")))
    # normalise once; everything below reads the normalised columns
    base = spread(registrants).select(
        "row_idx", EV, C.email_key(F.col("email")).alias("email"), text("first_name").alias("_first"), text("last_name").alias("_last"),
        text("company").alias("company_raw"), text("job_title").alias("jobtitle_raw"), F.trim(F.coalesce("country", F.lit(""))).alias("country"),
        (F.col("attended") == "Yes").alias("attended"), F.trim(F.coalesce("minutes", F.lit(""))).alias("minutes"))
    base = base.withColumns({"local": C.local_part(F.col("email")), "domain": C.mail_domain(F.col("email"))})
    given = lambda c: F.when(F.col(c) != "", "given").otherwise("")
    return settled(base.select(
        "row_idx", EV, "email", "local", "domain", C.person_name(F.col("_first")).alias("firstname"),
        C.person_name(F.col("_last")).alias("lastname"), "company_raw", C.company_key(F.col("company_raw")).alias("company_key"),
        "jobtitle_raw", "country", "attended", "minutes", given("jobtitle_raw").alias("title_source"),
        given("company_raw").alias("company_source"), F.lit(False).alias("is_speaker"),
        C.placeholder_reason(F.col("_first"), F.col("_last"), F.col("local"), F.col("domain")).alias("reject_reason")))


def people(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("reject_reason") == "").drop("reject_reason")


def rejected(rows: DataFrame) -> DataFrame:
    """Side output: every excluded row with its reason."""
    return rows.filter(F.col("reject_reason") != "").select(EV, "row_idx", "email", "reject_reason")


def with_speakers(rows: DataFrame, paired: DataFrame) -> DataFrame:
    """Registrants plus the event's paired speakers in the same row shape."""
    name = F.split(F.trim("name"), r"\s+")
    company, title = F.trim("company"), F.trim("title")
    as_rows = paired.filter(F.col("email") != "").select(
        (F.lit(1 << 50) + F.col("speaker_no")).alias("row_idx"), EV, F.lower("email").alias("email"),
        C.local_part(F.lower("email")).alias("local"), C.mail_domain(F.lower("email")).alias("domain"),
        C.person_name(name[0]).alias("firstname"),
        C.person_name(F.array_join(F.slice(name, 2, F.greatest(F.size(name) - 1, F.lit(0))), " ")).alias("lastname"),
        company.alias("company_raw"), C.company_key(company).alias("company_key"), title.alias("jobtitle_raw"),
        F.lit("").alias("country"), F.lit(True).alias("attended"), F.lit("").alias("minutes"),
        F.lit("given").alias("title_source"), F.lit("given").alias("company_source"), F.lit(True).alias("is_speaker"))
    return rows.unionByName(as_rows)


# --- votes ----------------------------------------------------------------------
def canonical_spelling(rows: DataFrame) -> DataFrame:
    """One display spelling per company key: most frequent, ties to mixed case, then first seen."""
    raw = F.col("company_raw")
    caseless = F.upper(raw) == F.lower(raw)
    mixed = caseless | ((raw != F.upper(raw)) & (raw != F.lower(raw)))
    named = rows.filter(raw != "")
    return majority(named, [EV, "company_key"], ["company_raw"], "row_idx", prefer=mixed).select(
        EV, "company_key", F.col("company_raw").alias("canonical"))


def respelled(rows: DataFrame, spelling: DataFrame) -> DataFrame:
    """Replace every typed company by its canonical spelling."""
    return rows.join(spelling, [EV, "company_key"], "left").withColumn(
        "company_raw", F.when(F.col("company_raw") != "", F.coalesce("canonical", "company_raw")).otherwise("")
    ).drop("canonical")


def company_of_domain(rows: DataFrame) -> DataFrame:
    named = rows.filter((F.col("company_raw") != "") & ~F.col("domain").isin(*fixed.FREEMAIL_BASIC))
    return majority(named, [EV, "domain"], ["company_raw"], "row_idx").select(
        EV, "domain", F.col("company_raw").alias("peer_company"))


def title_of_company(rows: DataFrame) -> DataFrame:
    titled = rows.filter((F.col("company_raw") != "") & (F.col("jobtitle_raw") != ""))
    return majority(titled, [EV, "company_key"], ["jobtitle_raw"], "row_idx").select(
        EV, F.col("company_key").alias("_title_key"), F.col("jobtitle_raw").alias("peer_title"))


def peer_titles(rows: DataFrame, k: int = 5) -> DataFrame:
    """First ``k`` distinct titles per company in alphabetical order."""
    titles = rows.filter((F.col("company_key") != "") & (F.col("jobtitle_raw") != "")).select(
        EV, "company_key", "jobtitle_raw").distinct()
    kept = top_k(titles, [EV, "company_key"], [F.asc("jobtitle_raw")], k)
    return kept.groupBy(EV, "company_key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "jobtitle_raw"))),
                                 lambda s: s["jobtitle_raw"]), "|").alias("titles"))


# --- rule cascade ------------------------------------------------------------------
def cascade(rows: DataFrame, peers: DataFrame, rules: C.Rules, headcount: str = "synthetic") -> DataFrame:
    """Company, title, function, seniority, industry, size, routing and the confidence ledger.

    ``rows`` are the (deduplicated) people; ``peers`` are all respelled rows the
    votes are taken over.  The voted rows are written out once before the rules:
    one generated method for the joins and all rules would outgrow the JVM limit.  ``headcount`` is 'synthetic' (offline) or 'rules'.
    """
    joined = rows.join(company_of_domain(peers), [EV, "domain"], "left")
    typed = F.col("company_raw") != ""
    company = F.when(typed, F.col("company_raw")).otherwise(F.coalesce("peer_company", F.lit("Unknown")))
    joined = joined.withColumn("company", company).withColumn("_title_key", C.company_key(F.col("company")))
    joined = joined.join(title_of_company(peers), [EV, "_title_key"], "left")
    has_title = F.col("jobtitle_raw") != ""
    unknown = F.col("company") == "Unknown"
    joined = joined.withColumn("jobtitle", F.when(has_title, F.col("jobtitle_raw")).otherwise(
        F.coalesce("peer_title", F.lit(fixed.GENERIC_TITLE))))
    joined = settled(joined.select(*rows.columns, "company", "jobtitle", "peer_title"))
    joined = joined.withColumn("industry", F.when(unknown, "Unknown").otherwise(C.industry_of_company(F.col("company"))))
    joined = joined.withColumn("unread", (F.col("industry") == "Other") & C.mostly_non_ascii(F.col("company")))
    unread = F.col("unread")
    seed = F.when(~F.col("domain").isin(*fixed.FREEMAIL_BASIC), F.col("domain")).otherwise(C.company_key(F.col("company")))
    size = F.when(unknown, F.lit(10)).otherwise(C.synthetic_headcount(seed)) if headcount == "synthetic" else F.lit(0)
    sibling = (F.col("title_source") == "sibling_record") | (F.col("company_source") == "sibling_record")
    penalties = [
        F.when(~typed, F.when(unknown, 0.25).otherwise(0.10)), F.when(~has_title, 0.15), F.when(unread, 0.30),
        F.lit(0.05) if headcount == "synthetic" else F.lit(0.0), F.when(sibling, 0.05)]
    joined = joined.withColumn("region", rules.region(F.col("country")))
    notes = F.filter(F.array(
        F.when(~typed & ~unknown, F.lit("company from peers on this domain")),
        F.when(~typed & unknown, F.lit("no company signal")),
        F.when(~has_title & F.col("peer_title").isNotNull(), F.lit("title from peers at this company")),
        F.when(~has_title & F.col("peer_title").isNull(), F.lit("generic title")),
        F.when(F.col("title_source") == "sibling_record", F.lit("title from a merged duplicate")),
        F.when(F.col("company_source") == "sibling_record", F.lit("company from a merged duplicate")),
        F.when(unread, F.lit("company name unreadable to the keyword rules")),
        F.lit("synthetic headcount" if headcount == "synthetic" else None).cast("string")), lambda x: x.isNotNull())
    return joined.select(
        "row_idx", EV, "email", "firstname", "lastname", "jobtitle", "company", "industry",
        size.cast("bigint").alias("numemployees"), C.function_by_keyword(F.col("jobtitle")).alias("function"),
        C.seniority(F.col("jobtitle")).alias("seniority"), "country", "region", rules.owner(F.col("region")).alias("owner_email"),
        F.when(F.col("attended"), "attended").otherwise("no_show").alias("attendance_status"), "minutes",
        confidence(penalties).alias("confidence"), unread.alias("needs_review"),
        F.when(unread, "non_ascii_company_unclassified").otherwise("").alias("needs_review_reason"),
        C.company_domain(F.col("email")).alias("company_domain"),
        rules.suppression_reason(F.col("domain")).alias("suppression_reason"), F.lit("rules").alias("industry_source"),
        F.lit(headcount).alias("numemployees_source"), F.lit(0.0).alias("firmographics_confidence"), "is_speaker",
        notes.alias("notes"))


def confidence(penalties: list[Column]) -> Column:
    """1.0 less every penalty that applies, rounded half-even and kept in [0.05, 1]."""
    ledger = reduce(lambda acc, p: acc - F.coalesce(p, F.lit(0.0)), penalties, F.lit(1.0))
    return F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.bround(ledger, 2)))


# --- outside answers ------------------------------------------------------------------
def firmographics_key(row_domain: Column, company: Column) -> Column:
    """Domain if there is one, else the typed company name, else ''."""
    key = C.company_key(company)
    named = (key != "") & (company != "Unknown")
    return F.when(row_domain != "", row_domain).when(named, F.concat(F.lit("name:"), key)).otherwise("")


def keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("company_id", firmographics_key(F.col("company_domain"), F.col("company")))


def needs_inference(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("jobtitle") == fixed.GENERIC_TITLE) | (F.col("company") == "Unknown")
                       | C.mostly_non_ascii(F.col("company")))


def work_units(rows: DataFrame, k: int = 5) -> DataFrame:
    """One lookup per company instead of one per row: size, countries and sample titles."""
    units = keyed(rows).filter(F.col("company_id") != "")
    code = C.country_code(F.col("country"))
    base = units.groupBy(EV, "company_id").agg(
        F.min_by("company", "row_idx").alias("company"), F.count(F.lit(1)).alias("registrants"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("country") != "", code))), ",").alias("countries"))
    titles = units.filter((F.col("jobtitle") != "") & (F.col("jobtitle") != fixed.GENERIC_TITLE)).select(
        EV, F.col("company_id").alias("company_key"), F.col("jobtitle").alias("jobtitle_raw"))
    sample = peer_titles(titles, k).select(EV, F.col("company_key").alias("company_id"), F.col("titles").alias("sample_titles"))
    return base.join(sample, [EV, "company_id"], "left").withColumn(
        "sample_titles", F.coalesce("sample_titles", F.lit("")))


def clamp01(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c.try_cast("double"))), F.lit(default))


def last_answers(raw: DataFrame, key: str) -> DataFrame:
    """One answer per event and key: the one with the highest ``answer_no``.

    A table without that column has no order; its conflicts are settled by value, so that
    a run repeats.
    """
    values = [F.col(c) for c in raw.columns if c not in (EV, key, "answer_no")]
    order = [F.col("answer_no")] if "answer_no" in raw.columns else []
    best = raw.groupBy(EV, key).agg(F.max_by(F.struct(*values), F.struct(*order, *values)).alias("_a"))
    return best.select(EV, key, "_a.*")


def headcount(c: Column) -> Column:
    n = F.floor(c.try_cast("double"))
    return F.when(n > 0, n.cast("bigint"))


def model_firmographics(raw: DataFrame, asked: DataFrame, rules: C.Rules) -> DataFrame:
    """Schema gate on model answers: asked companies only, vocabulary industries, positive sizes."""
    known = asked.select(EV, "company_id").distinct()
    return last_answers(raw, "company_id").join(known, [EV, "company_id"], "left_semi").select(
        EV, "company_id", C.industry_label(F.col("industry"), rules.vocabulary()).alias("new_industry"),
        headcount(F.col("employee_count")).alias("new_size"), clamp01(F.col("confidence")).alias("new_confidence"))


def vendor_firmographics(raw: DataFrame, asked: DataFrame) -> DataFrame:
    """Vendor answers keyed by domain, falling back to the company name; one per company, confidence 1."""
    known = asked.select(EV, "company_id").distinct()
    number = F.col("answer_no") if "answer_no" in raw.columns else F.lit(0)
    answers = raw.select(
        EV, "company_id", F.when(F.trim("industry") != "", F.trim("industry")).alias("new_industry"),
        headcount(F.col("employee_count")).alias("new_size"), F.lit(1.0).alias("new_confidence"), number.alias("answer_no"))
    answers = answers.filter(F.col("new_industry").isNotNull() | F.col("new_size").isNotNull())
    by_domain = answers.join(known, [EV, "company_id"], "left_semi").withColumn("answer_no", F.struct(F.lit(1).alias("direct"), "answer_no"))
    by_name = answers.join(known, [EV, "company_id"], "left_anti").withColumn(
        "company_id", F.concat(F.lit("name:"), C.company_key(F.col("company_id")))).join(known, [EV, "company_id"], "left_semi").withColumn(
        "answer_no", F.struct(F.lit(0).alias("direct"), "answer_no"))
    return last_answers(by_domain.unionByName(by_name), "company_id")


def apply_firmographics(rows: DataFrame, answers: DataFrame, source: str) -> DataFrame:
    """Merge company facts onto every row of the company; weaker sources never win."""
    rank = fixed.SOURCE_RANK[source]
    held = lambda c: F.coalesce(C.lookup(fixed.SOURCE_RANK, F.col(c)), F.lit(0))
    j = rows.join(answers, [EV, "company_id"], "left")
    take_i = F.col("new_industry").isNotNull() & (held("industry_source") <= rank)
    take_n = F.col("new_size").isNotNull() & (held("numemployees_source") <= rank)
    j = j.withColumns({
        "needs_review": F.when(take_i & (F.col("new_industry") != "Other"), F.lit(False)).otherwise(F.col("needs_review")),
        "industry": F.when(take_i, F.col("new_industry")).otherwise(F.col("industry")),
        "numemployees": F.when(take_n, F.col("new_size")).otherwise(F.col("numemployees")),
        "industry_source": F.when(take_i, F.lit(source)).otherwise(F.col("industry_source")),
        "numemployees_source": F.when(take_n, F.lit(source)).otherwise(F.col("numemployees_source")),
        "firmographics_confidence": F.greatest(F.col("firmographics_confidence"), F.coalesce("new_confidence", F.lit(0.0))),
    })
    return j.drop("new_industry", "new_size", "new_confidence")


def vendor_report(raw: DataFrame, asked: DataFrame) -> DataFrame:
    """Answers supplied, applied and what they verify, per event."""
    used = vendor_firmographics(raw, asked)
    supplied = last_answers(raw, "company_id").groupBy(EV).agg(F.count(F.lit(1)).alias("supplied"))
    applied = used.groupBy(EV).agg(F.count(F.lit(1)).alias("applied"), F.count("new_size").alias("sizes"),
                                   F.count("new_industry").alias("industries"))
    return supplied.join(applied, EV, "left").fillna(0, ["applied", "sizes", "industries"])


def apply_patches(rows: DataFrame, patches: DataFrame) -> DataFrame:
    """Row-level model answers: allowed words only; any change adds 0.10 confidence."""
    p = last_answers(patches, "row_id").select(EV, F.col("row_id").alias("email"), F.trim("company").alias("_company"),
                       F.trim("jobtitle").alias("_jobtitle"), F.col("function").alias("_function"),
                       F.col("seniority").alias("_seniority"))
    j = rows.join(p, [EV, "email"], "left")
    ok = {
        "company": F.coalesce(~F.col("_company").isin("", "Unknown"), F.lit(False)),
        "jobtitle": F.coalesce(~F.col("_jobtitle").isin("", "Unknown"), F.lit(False)),
        "function": F.coalesce(F.col("_function").isin(*fixed.FUNCTIONS), F.lit(False)),
        "seniority": F.coalesce(F.col("_seniority").isin(*fixed.SENIORITIES), F.lit(False)),
    }
    changed = {f: ok[f] & (F.col(f"_{f}") != F.col(f)) for f in ok}
    listed = F.concat_ws(",", *[F.when(c, F.lit(f)) for f, c in changed.items()])
    j = j.withColumn("patched", listed)
    j = j.withColumns({f: F.when(ok[f], F.col(f"_{f}")).otherwise(F.col(f)) for f in ok})
    return j.withColumn("confidence", F.when(F.col("patched") != "", F.bround(F.least(
        F.lit(1.0), F.col("confidence") + 0.10), 2)).otherwise(F.col("confidence"))).drop(*[f"_{f}" for f in ok])


def tier_decisions(raw: DataFrame) -> DataFrame:
    """Usable tier answers: the last allowed tier per row, confidence clamped."""
    tier = F.lower(F.trim("tier"))
    return last_answers(raw.filter(tier.isin(*fixed.TIER_LEVEL)), "row_id").select(
        EV, F.col("row_id").alias("email"), tier.alias("model_tier"), F.trim("rationale").alias("model_rationale"),
        F.bround(clamp01(F.col("confidence"), 0.5), 2).alias("icp_confidence"))


def finalised(rows: DataFrame, decisions: DataFrame, matches: DataFrame, rules: C.Rules) -> DataFrame:
    """Ship the model's tier, validate it by rule, then derive the stage without regression.

    ``matches`` carries (event_slug, email, existing_stage) of known CRM contacts.
    """
    rules_tier, rationale = rules.tier_rule(F.col("jobtitle"), F.col("numemployees"), F.col("industry"))
    j = rows.join(decisions, [EV, "email"], "left").withColumns({"icp_tier_rules": rules_tier, "_why": rationale})
    level = lambda c: F.coalesce(C.lookup(fixed.TIER_LEVEL, F.col(c)), F.lit(0))
    given = F.col("model_tier").isNotNull()
    apart = given & (F.abs(level("model_tier") - level("icp_tier_rules")) > 1)
    j = j.withColumns({
        "icp_tier": F.coalesce("model_tier", "icp_tier_rules"),
        "icp_source": F.when(given, "model").otherwise("rules"),
        "verdict": F.when(apart, "disagreement").when(given, "agree").otherwise("rules"),
        "needs_review": F.col("needs_review") | apart,
        "needs_review_reason": F.when(apart, "icp_disagreement").otherwise(F.col("needs_review_reason")),
        "icp_rationale": F.coalesce(F.when(F.col("model_rationale") != "", F.col("model_rationale")), F.col("_why")),
    })
    target = F.when(F.col("is_speaker"), "evangelist").otherwise(
        C.target_stage(F.col("icp_tier"), F.col("attendance_status") == "attended", F.col("minutes")))
    j = j.join(matches.select(EV, "email", "existing_stage"), [EV, "email"], "left")
    return j.withColumn("lifecyclestage", C.guarded_stage(F.col("existing_stage"), target)).drop(
        "_why", "model_tier", "model_rationale", "existing_stage")


# --- companies ----------------------------------------------------------------------
def company_rows(rows: DataFrame) -> DataFrame:
    """One row per domain: the majority (name, industry, size) triple, first seen on ties."""
    own = rows.filter(F.coalesce("company_domain", F.lit("")) != "")
    best = majority(own, [EV, "company_domain"], ["company", "industry", "numemployees"], "row_idx")
    return best.select(EV, F.col("company_domain").alias("domain"), F.col("company").alias("name"), "industry", "numemployees")


def unresolved_companies(rows: DataFrame) -> DataFrame:
    """Companies still without a trusted industry and size: the vendor's work list."""
    outside = ("model", "vendor")
    missing = (~F.col("industry_source").isin(*outside) | F.col("industry").isin("Other", "Unknown")
               | ~F.col("numemployees_source").isin(*outside))
    low = F.coalesce("firmographics_confidence", F.lit(0.0)) < fixed.CONFIDENCE_FLOOR
    done = (F.col("industry_source") == "vendor") & (F.col("numemployees_source") == "vendor")
    return keyed(rows).filter((F.col("company_id") != "") & ~done & (missing | low)).select(EV, "company_id").distinct()
