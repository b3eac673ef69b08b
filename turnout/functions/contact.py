"""Row rules on contacts, each a native Column expression."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, functions as F

from turnout.functions import fixed


def strip(c: Column) -> Column:
    """Trim any surrounding whitespace, not only blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_filled(c: Column) -> Column:
    """The one blank rule: '', 'Unknown', '0' and NULL are all missing."""
    return ~F.coalesce(F.trim(c.cast("string")), F.lit("")).isin(*fixed.BLANKS)


def lookup(table: dict, key: Column) -> Column:
    """Value of a fixed table, NULL when the key is not in it (in-plan literal map)."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def first_match(rules, test, otherwise) -> Column:
    """``when`` chain over ordered (pattern, label) rules; the first hit wins."""
    chain = reduce(lambda acc, r: acc.when(test(r[0]), F.lit(r[1])), rules, F)
    return chain.otherwise(otherwise)


# --- identity ---------------------------------------------------------------
def email_key(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def local_part(email: Column) -> Column:
    return F.split_part(email, F.lit("@"), F.lit(1))


def mail_domain(email: Column) -> Column:
    """Text after the last '@'; blank when there is none."""
    return F.when(email.contains("@"), F.element_at(F.split(email, "@"), -1)).otherwise("")


def company_domain(email: Column) -> Column:
    """Domain unless it is one of the six basic freemail hosts."""
    d = mail_domain(email)
    return F.when(d.isin(*fixed.FREEMAIL_BASIC), "").otherwise(d)


def account_key(email: Column) -> Column:
    """Account = domain outside the wide freemail list, NULL otherwise."""
    low = email_key(email)
    d = F.when(low.contains("@"), F.regexp_extract(low, r"^[^@]*@(.*)$", 1))
    return F.when((d != "") & ~d.isin(*fixed.FREEMAIL_WIDE), d)


def person_name(c: Column) -> Column:
    """Capitalise every piece around blanks and hyphens (initcap skips hyphens)."""
    pieces = F.split(strip(c), r"(?<=[\s-])")
    return F.array_join(F.transform(pieces, lambda p: F.initcap(p)), "")


def company_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), r"(?U)\s+", " ")


def title_words(c: Column) -> Column:
    """Capitalise every run of letters, also behind digits and apostrophes (initcap takes blanks only)."""
    runs = F.split(c, r"(?<=\P{L})(?=\p{L})")
    return F.array_join(F.transform(runs, lambda run: F.concat(F.upper(F.substring(run, 1, 1)), F.lower(F.substring(run, F.lit(2), F.length(run))))), "")


def display_company(domain: Column) -> Column:
    stem = F.split_part(domain, F.lit("."), F.lit(1))
    return F.when(domain == "", "").otherwise(title_words(F.regexp_replace(stem, "[-_]", " ")))


def display_name(first: Column, last: Column, email: Column) -> Column:
    full = F.trim(F.concat_ws(" ", F.trim(F.coalesce(first, F.lit(""))), F.trim(F.coalesce(last, F.lit("")))))
    local = title_words(F.regexp_replace(local_part(email), "[._]", " "))
    return F.when(full != "", full).when(local != "", local).otherwise(email)


def placeholder_reason(first: Column, last: Column, local: Column, domain: Column) -> Column:
    """Why a row is a placeholder, '' when it is a person (address parts in lower case)."""
    f, l = F.lower(first), F.lower(last)
    return (
        F.when(f.isin(*fixed.PLACEHOLDER_NAMES) & l.isin(*fixed.PLACEHOLDER_NAMES), F.lit("placeholder_name"))
        .when(local.isin(*fixed.PLACEHOLDER_LOCALS), F.lit("placeholder_mailbox"))
        .when((domain != "") & (local == F.split_part(domain, F.lit("."), F.lit(1))), F.lit("mirrors_domain"))
        .otherwise("")
    )


# --- classification ----------------------------------------------------------
def industry_of_company(company: Column) -> Column:
    low = F.lower(company)
    return first_match(fixed.INDUSTRY_KEYWORDS, lambda kw: low.contains(kw), "Other")


def _any(col: Column, *words: str) -> Column:
    return col.rlike("|".join(words))


def function_by_keyword(title: Column) -> Column:
    t = F.lower(title)
    return (
        F.when(_any(t, "cmo", "founder"), "executive")
        .when(t.contains("revops"), "revops")
        .when(t.contains("customer success"), "customer_success")
        .when(_any(t, "sales development", "account executive"), "sales")
        .when(_any(t, "marketing", "demand gen", "growth"), "marketing")
        .otherwise("general")
    )


def function_by_pattern(title: Column) -> Column:
    t = F.trim(F.coalesce(title, F.lit("")))
    rules = [(pattern, label) for label, pattern in fixed.FUNCTION_PATTERNS]
    return first_match(rules, lambda p: t.rlike(p), "general")


def bucket_of_industry(industry: Column) -> Column:
    v = F.trim(F.coalesce(industry, F.lit("")))
    rules = [(pattern, label) for label, pattern in fixed.BUCKET_PATTERNS]
    return first_match(rules, lambda p: v.rlike(p), "other_commercial")


def seniority(title: Column) -> Column:
    t = F.lower(title)
    return (
        F.when(_any(t, "cmo", "founder"), "c_suite")
        .when(t.startswith("vp ") | t.contains(" vp"), "vp")
        .when(t.contains("head of"), "head")
        .when(t.contains("director"), "director")
        .when(t.endswith("manager"), "manager")
        .when(t.contains("intern"), "intern")
        .when(_any(t, "specialist", "analyst", "coordinator", "rep", "executive"), "individual_contributor")
        .otherwise("unknown")
    )


def mostly_non_ascii(c: Column) -> Column:
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    latin = F.length(F.regexp_replace(c, r"[^A-Za-z]", ""))
    return (letters > 0) & ((letters - latin) / F.greatest(letters, F.lit(1)) > fixed.NON_ASCII_SHARE)


def synthetic_headcount(seed: Column) -> Column:
    """Stable stand-in headcount from three md5 bytes, in three size bands."""
    digest = F.md5(seed)
    byte = [F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("bigint") for i in range(3)]
    roll = byte[0] % 100
    return (
        F.when(roll < 55, 5 + byte[1] % 46)
        .when(roll < 85, 50 + byte[1] % 151)
        .otherwise(200 + byte[1] % 400 + (byte[2] % 12) * 400)
    )


def industry_label(answer: Column, vocabulary) -> Column:
    """Vocabulary label of a model's industry; NULL when outside it or 'Other'."""
    raw = F.trim(answer)
    words = [w for w in vocabulary if w != "Other"]
    named = F.when(raw.isin(*words, "Other"), raw).otherwise(F.coalesce(lookup(fixed.INDUSTRY_SYNONYMS, F.lower(raw)), raw))
    return F.when(named.isin(*words), named)


def crm_industry(industry: Column) -> Column:
    return lookup(fixed.CRM_INDUSTRY, F.lower(F.trim(industry)))


# --- geography ---------------------------------------------------------------
def country_code(c: Column) -> Column:
    raw = F.trim(F.coalesce(c, F.lit("")))
    return F.when(F.length(raw) <= 2, F.upper(raw)).otherwise(
        F.coalesce(lookup(fixed.COUNTRY_ALIASES, F.lower(raw)), F.upper(raw)))


# --- lifecycle ---------------------------------------------------------------
def stage_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "(_pending|_new)$", "")


def stage_rank(c: Column) -> Column:
    return F.coalesce(lookup(fixed.STAGE_RANK, stage_name(c)), F.lit(-1))


def crm_stage(c: Column) -> Column:
    """Stage a CRM accepts: '_pending' stripped, unknown values blank."""
    v = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "_pending$", "")
    return F.when(v.isin(*fixed.ALLOWED_STAGES), v).otherwise("")


def target_stage(tier: Column, attended: Column, minutes: Column) -> Column:
    long_enough = F.coalesce(minutes.try_cast("double") >= fixed.SESSION_MINUTES, F.lit(False))
    return (
        F.when((tier == "tier1") & attended & long_enough, "marketingqualifiedlead")
        .when(tier.isin("tier1", "tier2"), "lead")
        .otherwise("subscriber")
    )


def guarded_stage(existing: Column, target: Column) -> Column:
    """Never move a known contact backwards; NULL ``existing`` means a new contact."""
    have = F.coalesce(lookup(fixed.STAGE_RANK, existing), F.lit(0))
    want = F.coalesce(lookup(fixed.STAGE_RANK, target), F.lit(0))
    return F.when(existing.isNotNull() & (have >= want), existing).otherwise(target)


# --- engagement --------------------------------------------------------------
def weighted_score(opens: Column, clicks: Column, pageviews: Column, form_fills: Column) -> Column:
    w = fixed.WEIGHT_OF_TYPE
    raw = opens * w["open"] + clicks * w["click"] + pageviews * w["pageview"] + form_fills * w["form_fill"]
    return F.bround(raw, 1)


# --- rule set ----------------------------------------------------------------
@dataclass(frozen=True)
class Tier:
    name: str
    titles: tuple
    size: tuple
    industries: tuple


@dataclass(frozen=True)
class Rules:
    """Routing and tiering configuration; replace any part for another event."""

    tiers: tuple = tuple(Tier(*row) for row in fixed.TIERS)
    regions: dict = field(default_factory=lambda: dict(fixed.REGIONS))
    owners: dict = field(default_factory=lambda: {
        r: f"sdr.{r.lower()}@host.example" for r in ("INDIA", "SEA", "MENA", "NA", "UKEU")})
    owner_map: dict = field(default_factory=lambda: {
        r: "crm.owner@host.example" for r in ("INDIA", "SEA", "MENA", "NA")})
    host_domains: tuple = ("host.example",)
    competitor_domains: tuple = ()

    def vocabulary(self) -> list[str]:
        """Distinct tier industries in order of first mention, then 'Other'."""
        seen = dict.fromkeys(i for t in self.tiers for i in t.industries if i != "*")
        return [*seen, "Other"]

    def tier_rule(self, title: Column, size: Column, industry: Column) -> tuple[Column, Column]:
        """(tier, rationale): strict tiers need title, size and industry; the last needs size only."""
        tier, why = F, F
        size_text, ind = size.cast("string"), industry
        for t in self.tiers[:-1]:
            hit = (F.lower(title).isin(*[x.lower() for x in t.titles])
                   & size.between(*t.size)
                   & (F.lit("*" in t.industries) | ind.isin(*t.industries)))
            tier = tier.when(hit, F.lit(t.name))
            why = why.when(hit, F.concat(
                F.lit(f"{t.name}: title "), title, F.lit(" listed, size "), size_text,
                F.lit(f" within {t.size[0]}-{t.size[1]}, industry "), ind, F.lit(" served")))
        last = self.tiers[-1]
        hit = size.between(*last.size)
        why = why.when(hit, F.concat(
            F.lit(f"{last.name}: any title ("), title, F.lit("), size "), size_text, F.lit(f" within {last.size[0]}-{last.size[1]}, any industry"))).otherwise(
            F.concat(F.lit("unqualified: no tier fits title "), title, F.lit(", size "), size_text, F.lit(", industry "), ind))
        return tier.when(hit, F.lit(last.name)).otherwise("unqualified"), why

    def tier_by_title(self, title: Column) -> Column:
        t = F.lower(F.trim(F.coalesce(title, F.lit(""))))
        chain = F
        for tier in self.tiers[:-1]:
            chain = chain.when((t != "") & t.isin(*[x.lower() for x in tier.titles]), F.lit(tier.name))
        return chain.otherwise(self.tiers[-1].name)

    def region_configured(self) -> dict:
        """code -> region of the configured table; the first region listing a code wins."""
        return {code.upper(): region for region, codes in reversed(self.regions.items()) for code in codes}

    def region(self, country: Column) -> Column:
        """Configured region first, then the built-in fallback, then UNASSIGNED."""
        fallback = {c: r for r, codes in fixed.FALLBACK_REGIONS.items() for c in codes}
        return F.coalesce(lookup({**fallback, **self.region_configured()}, country_code(country)), F.lit("UNASSIGNED"))

    def owner(self, region: Column) -> Column:
        """Owner of a region; fallback regions own nobody, UNASSIGNED takes AMER's."""
        return F.coalesce(lookup({**self.owners, "UNASSIGNED": self.owners.get("AMER", "")}, region), F.lit(""))

    def region_plain(self, country: Column) -> Column:
        """Dashboard variant: the raw value has to be a listed code already."""
        return F.coalesce(lookup(self.region_configured(), F.upper(F.trim(F.coalesce(country, F.lit(""))))), F.lit(""))

    def suppression_reason(self, domain: Column) -> Column:
        d = F.lower(F.coalesce(domain, F.lit("")))
        return (
            F.when(d.isin(*self.host_domains), F.concat(F.lit("host company domain ('"), d, F.lit("')")))
            .when(d.isin(*(self.competitor_domains or ("",))) & (d != ""), F.concat(F.lit("competitor domain ('"), d, F.lit("')")))
            .otherwise("")
        )
