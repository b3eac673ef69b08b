"""Word lists, ranks, thresholds and lookup tables.

These are data, not logic; they have to equal the published rule set for the
results to be right, so they are stated here plainly and in natural order.
"""

# --- identity resolution -----------------------------------------------------
LOCAL_WEIGHT = 0.25
IDENTITY_WEIGHT = 0.75
MERGE_SCORE = 0.80
REVIEW_SCORE = 0.65
FIRST_NAME_GATE = 0.5
REVIEW_BATCH = 20  # pairs that a reader takes at a time

# --- mail domains and placeholder rows ---------------------------------------
FREEMAIL_BASIC = ("gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com", "icloud.com")
FREEMAIL_WIDE = FREEMAIL_BASIC + (
    "protonmail.com", "live.com", "msn.com", "rediffmail.com", "rediff.com",
    "ymail.com", "mail.com", "gmx.com", "yandex.com",
)
PLACEHOLDER_NAMES = ("asdf", "test", "fake", "foo", "bar", "sample", "xxx")
PLACEHOLDER_LOCALS = ("noreply", "no-reply", "admin", "test", "asdf", "sample", "donotreply")

# --- lifecycle ---------------------------------------------------------------
STAGE_RANK = {
    "subscriber": 0, "lead": 1, "marketingqualifiedlead": 2,
    "salesqualifiedlead": 3, "opportunity": 4, "customer": 5, "evangelist": 6,
}
ALLOWED_STAGES = tuple(STAGE_RANK) + ("other",)
MQL_RANK = STAGE_RANK["marketingqualifiedlead"]
SQL_RANK = STAGE_RANK["salesqualifiedlead"]
SESSION_MINUTES = 25

# --- engagement --------------------------------------------------------------
COUNTER_OF_TYPE = {"open": "opens", "click": "clicks", "pageview": "pageviews", "form_fill": "form_fills"}
WEIGHT_OF_TYPE = {"form_fill": 10.0, "click": 3.0, "pageview": 1.0, "open": 0.5}
COMMITTEE_MIN = 2
MOVEMENT_DAYS = (7, 14, 30)
ANOMALY_CAP = 12

# --- classification ----------------------------------------------------------
INDUSTRY_KEYWORDS = (
    ("fintech", "Fintech"), ("saas", "SaaS"), ("software", "SaaS"),
    ("commerce", "Ecommerce"), ("ecom", "Ecommerce"), ("analytics", "IT Services"),
    ("data", "IT Services"), ("systems", "IT Services"), ("it services", "IT Services"),
    ("cloud", "IT Services"),
)
FUNCTION_PATTERNS = (
    ("customer_success", r"(?i)customer success|client success"),
    ("revops", r"(?i)revops|revenue operations|people analytics|hris"),
    ("marketing", r"(?i)marketing|growth|demand gen|content"),
    ("sales", r"(?i)\bsales\b|account executive|business development|\bbdr\b|\bsdr\b"),
    ("executive", r"(?i)\bceo\b|\bcfo\b|\bcoo\b|\bcto\b|\bchro\b|chief\s|founder|\bpresident\b"),
)
BUCKET_PATTERNS = (
    ("saas", r"(?i)\bsaas\b|software"),
    ("services_it", r"(?i)\bit services\b|information technology|consulting"),
)
FUNCTIONS = ("marketing", "revops", "sales", "executive", "customer_success", "general")
SENIORITIES = ("c_suite", "vp", "head", "director", "manager", "intern", "individual_contributor", "unknown")
BUCKETS = ("saas", "services_it", "other_commercial")
GENERIC_TITLE = "Attendee"
NON_ASCII_SHARE = 0.5

INDUSTRY_SYNONYMS = {
    "it services": "IT/ITES", "information technology": "IT/ITES", "it": "IT/ITES",
    "it/ites": "IT/ITES", "ites": "IT/ITES", "bpo": "IT/ITES", "consulting": "IT/ITES",
    "professional services": "IT/ITES", "technology": "IT/ITES",
    "banking": "BFSI", "financial services": "BFSI", "finance": "BFSI",
    "insurance": "BFSI", "banking & financial services": "BFSI", "bfsi": "BFSI",
    "software": "SaaS", "saas": "SaaS", "cloud": "SaaS",
    "ecommerce": "Internet", "e-commerce": "Internet", "consumer internet": "Internet",
    "marketplace": "Internet", "internet": "Internet",
    "pharmaceuticals": "Pharma", "pharmaceutical": "Pharma", "biotech": "Pharma",
    "hospitals": "Healthcare", "health care": "Healthcare", "healthcare": "Healthcare",
    "fmcg": "Consumer Goods", "consumer packaged goods": "Consumer Goods",
    "cpg": "Consumer Goods", "food & beverage": "Consumer Goods",
    "automotive": "Manufacturing", "industrial": "Manufacturing", "steel": "Manufacturing",
    "engineering": "Manufacturing", "chemicals": "Manufacturing",
    "transportation": "Logistics", "supply chain": "Logistics", "shipping": "Logistics",
    "airline": "Aviation", "airlines": "Aviation", "aerospace": "Aviation",
    "telecommunications": "Telecom", "telco": "Telecom",
    "oil & gas": "Energy", "utilities": "Energy", "power": "Energy",
    "travel": "Hospitality", "hotels": "Hospitality", "restaurants": "Hospitality",
    "property": "Real Estate", "realestate": "Real Estate",
    "diversified": "Conglomerate", "holding company": "Conglomerate",
}
CRM_INDUSTRY = {
    "saas": "COMPUTER_SOFTWARE", "software": "COMPUTER_SOFTWARE",
    "fintech": "FINANCIAL_SERVICES", "financial services": "FINANCIAL_SERVICES",
    "it services": "INFORMATION_TECHNOLOGY_AND_SERVICES",
    "information technology": "INFORMATION_TECHNOLOGY_AND_SERVICES",
    "ecommerce": "INTERNET", "e-commerce": "INTERNET", "internet": "INTERNET",
    "marketing": "MARKETING_AND_ADVERTISING", "consulting": "MANAGEMENT_CONSULTING",
    "healthcare": "HOSPITAL_HEALTH_CARE", "education": "EDUCATION_MANAGEMENT",
    "retail": "RETAIL", "manufacturing": "MECHANICAL_OR_INDUSTRIAL_ENGINEERING",
}

# --- geography ---------------------------------------------------------------
COUNTRY_ALIASES = {
    "united states": "US", "united states of america": "US", "usa": "US", "u.s.": "US",
    "u.s.a.": "US", "america": "US", "canada": "CA", "brazil": "BR", "brasil": "BR",
    "mexico": "MX", "méxico": "MX", "united kingdom": "UK", "great britain": "UK",
    "england": "UK", "scotland": "UK", "wales": "UK", "gb": "UK", "gbr": "UK",
    "germany": "DE", "deutschland": "DE", "deu": "DE", "france": "FR", "fra": "FR",
    "spain": "ES", "españa": "ES", "esp": "ES", "netherlands": "NL",
    "the netherlands": "NL", "nld": "NL", "ireland": "IE", "irl": "IE", "italy": "IT",
    "ita": "IT", "sweden": "SE", "poland": "PL", "portugal": "PT", "switzerland": "CH",
    "belgium": "BE", "denmark": "DK", "norway": "NO", "finland": "FI", "austria": "AT",
    "united arab emirates": "AE", "uae": "AE", "are": "AE", "saudi arabia": "SA",
    "israel": "IL", "turkey": "TR", "türkiye": "TR", "south africa": "ZA", "zaf": "ZA",
    "nigeria": "NG", "kenya": "KE", "egypt": "EG", "india": "IN", "ind": "IN",
    "singapore": "SG", "sgp": "SG", "australia": "AU", "aus": "AU", "new zealand": "NZ",
    "japan": "JP", "jpn": "JP", "china": "CN", "hong kong": "HK", "south korea": "KR",
    "korea": "KR", "indonesia": "ID", "malaysia": "MY", "philippines": "PH",
    "thailand": "TH", "vietnam": "VN",
}
FALLBACK_REGIONS = {
    "AMER": ("US", "CA", "BR", "MX", "AR", "CL", "CO", "PE"),
    "EMEA": ("UK", "DE", "FR", "ES", "NL", "IE", "IT", "SE", "PL", "PT", "CH", "BE", "DK",
             "NO", "FI", "AT", "AE", "SA", "IL", "TR", "ZA", "NG", "KE", "EG"),
    "APAC": ("IN", "SG", "AU", "NZ", "JP", "CN", "HK", "KR", "ID", "MY", "PH", "TH", "VN"),
}

# --- provenance --------------------------------------------------------------
SOURCE_RANK = {"rules": 0, "synthetic": 0, "model": 1, "vendor": 2}
TIER_LEVEL = {"unqualified": 0, "tier3": 1, "tier2": 2, "tier1": 3}
CONFIDENCE_FLOOR = 0.7
BLANKS = ("", "Unknown", "0")

COMPLETENESS_FIELDS = (
    "email", "firstname", "lastname", "jobtitle", "company", "industry", "numemployees",
    "function", "seniority", "country", "region", "owner_email", "lifecyclestage", "icp_tier",
)
CONTACT_SPEC = (
    "jobtitle", "function", "seniority", "company", "numemployees", "industry",
    "region", "icp_tier", "lifecyclestage", "owner_email",
)
COMPANY_SPEC = ("company", "company_domain", "numemployees", "industry")

# --- messages ----------------------------------------------------------------
REQUIRED_TOKENS = {
    "attendee": ("firstname", "takeaway_headline", "takeaway_body", "recording_link", "cta_link"),
    "no_show": ("firstname", "takeaway_headline", "takeaway_body", "recording_link", "cta_link"),
    "speaker": ("firstname", "recording_link", "cta_link", "snapshot_your_quotes"),
}
SNAPSHOT_TOKENS = (
    "snapshot_registrants", "snapshot_attendees", "snapshot_attendance_rate", "snapshot_avg_minutes",
    "snapshot_median_minutes", "snapshot_no_shows", "snapshot_top_accounts", "snapshot_your_quotes",
)
SELF_VERBS = ("made", "shared", "walked", "said", "noted", "argued", "pointed out", "mentioned", "added")
UTM_SOURCE, UTM_MEDIUM = "webinar", "email"
CHANNEL_UTM = {
    "blog.md": ("blog", "content", "blog"),
    "youtube.md": ("youtube", "video", "youtube-description"),
}

# --- transcript and claims ---------------------------------------------------
TS = r"\d{1,2}:\d{2}(?::\d{2})?"
TURN_LINE = rf"^\[({TS})\]\s*\*\*([^:*]+):\*\*\s*(.*)$"
CUE_LINE = r"^\[(\d+):(\d{2})\]\s+\*\*(.*?)\*\*(.*)$"
SEGMENT_BOUNDS = rf"\(({TS})\s*[–‒-]\s*({TS})\)"
QUOTE_MIN = 25
SHOWN_QUOTE = 90  # characters of texts that reports show
SHOWN_VALUE = 60
SHOWN_TITLE = 120
SHOWN_CLAIM = 120
QUOTE_RATIO = 0.90
NAME_RATIO = 0.85
SNAP_DRIFT = 45
CLIP_MIN, CLIP_MAX = 30, 60
CAPTION_CHARS = 42
CAPTION_VISIBLE = 0.25
MERGE_GAP = 2.0
LAST_CUE = 20

# --- asset specification -----------------------------------------------------
BLOG_WORDS = (800, 1200)
SOCIAL_POSTS = (5, 10)
MIN_LINKEDIN, MIN_X = 3, 2
MIN_CHAPTERS, MIN_POINTS = 3, 6
REQUIRED_SECTIONS = {
    "youtube.md": ("## Chapters", "## Description", "## Thumbnail Brief"),
    "infographic.md": ("## Headline Options", "## Data Points", "## Layout"),
}

# --- shapes of model answers --------------------------------------------------
# purpose: fields that tell its items
ANSWER_FIELDS = {
    "anomalies": ("metric", "evidence", "evidence_rows", "anomaly", "contact"),
    "interest_scores": ("score", "interest_score"),
    "committees": ("company", "contacts"),
}
NARRATIVE = "movement_narrative"

# --- deliverables -----------------------------------------------------------------
# file name or ending: kind, maker
ASSET_KINDS = {
    "blog.md": ("blog", "llm"), "youtube.md": ("youtube", "llm"), "infographic.md": ("infographic", "llm"),
    "social.md": ("social", "llm"), "extraction.json": ("extraction", "llm"), "manifest.json": ("manifest", "llm"),
    "grounding_report.json": ("report", "llm"), ".png": ("visual", "image_model"), ".mp4": ("clip", "ffmpeg"), ".srt": ("caption", "sarvam"),
}

# --- tiers and regions --------------------------------------------------------------
COMMON_INDUSTRIES = ("IT/ITES", "BFSI", "Manufacturing", "Pharma", "Retail", "Consumer Goods", "Hospitality",
           "Healthcare", "Telecom", "Energy", "Aviation", "Conglomerate", "Internet", "Fintech",
           "SaaS", "Logistics", "Real Estate")
# name, titles, size from and to, industries; * is any
TIERS = (
    ("tier1", ("CHRO", "Chief People Officer", "VP Human Resources", "VP People", "Head of People",
               "Head of HR", "Director HR", "HR Digital Transformation Lead", "HRIS Lead",
               "HRIS Manager", "Head of Shared Services"), (500, 1000000), COMMON_INDUSTRIES),
    ("tier2", ("HR Business Partner", "Senior HRBP", "HR Operations Manager",
               "Head of Talent Acquisition", "TA Manager", "Payroll Manager", "Head of L&D",
               "Compensation & Benefits Manager", "People Analytics Lead", "CFO", "COO", "CIO",
               "IT Director", "Digital Transformation Head"), (200, 1000000), COMMON_INDUSTRIES + ("Fitness",)),
    ("tier3", ("*",), (1, 200), ("*",)),
)
REGIONS = {
    "INDIA": ("IN",), "SEA": ("SG", "MY", "ID", "PH", "TH", "VN"),
    "MENA": ("AE", "SA", "QA", "KW", "OM", "BH", "EG"), "NA": ("US", "CA"),
    "UKEU": ("UK", "GB", "DE", "FR", "NL", "IE"),
}

# --- patterns of rendered text ------------------------------------------------------
QUOTED = "[\"“”«»]([^\"“”«»]{8,400})[\"“”«»]"
STAT = r"\bStat\s+(\d+)\b"
POST = r"(?s)(### Post \d+.*?(?=### Post \d+|\z))"
