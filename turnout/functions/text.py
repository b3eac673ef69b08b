"""Slugs, match keys, markdown, templates, links and clock strings as Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from turnout.functions import fixed

# --- slugs and keys -----------------------------------------------------------
def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug_or_event(c: Column) -> Column:
    s = slug(c)
    return F.when(s == "", "event").otherwise(s)


def event_tag(name: Column, date: Column) -> Column:
    """Slug of the name up to its first colon, then the date."""
    return F.concat_ws("-", slug(F.split_part(name, F.lit(":"), F.lit(1))), date)


def match_key(c: Column) -> Column:
    """Lower case, straight quotes, everything else than letters and digits one blank."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def words(c: Column) -> Column:
    t = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, " ")))


def spaced(c: Column) -> Column:
    """Lower case with single blanks, for verbatim containment."""
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


# --- markdown and templates ------------------------------------------------------
def md_text(c: Column) -> Column:
    """Markdown to plain text: links, bold, italics, headings and quote marks."""
    for pattern, put in ((r"\[([^\]]+)\]\(([^)\s]+)\)", "$1 ($2)"), (r"\*\*(.+?)\*\*", "$1"),
                         (r"(?<!\*)\*([^*]+)\*(?!\*)", "$1"), (r"(?m)^#{1,6}\s*", ""), (r"(?m)^>\s?", "")):
        c = F.regexp_replace(c, pattern, put)
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def section(c: Column, heading: str) -> Column:
    """Body of a level-two markdown section, '' when it is missing."""
    body = F.regexp_extract(c, rf"(?ms)^##\s*\Q{heading}\E\s*?$(.*?)(?=^##\s|\z)", 1)
    return F.regexp_replace(body, r"^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\{\{([a-z0-9_]+)\}\}"), F.lit(1))


def render(body: Column, fields: dict[str, Column]) -> Column:
    """Fill ``{{token}}`` marks; a value that brings its own % absorbs one that follows."""
    for name, value in fields.items():
        value = F.coalesce(value, F.lit(""))
        mark = "{{" + name + "}}"
        body = F.when(value.endswith("%"), F.replace(body, F.lit(mark + "%"), value)).otherwise(body)
        body = F.replace(body, F.lit(mark), value)
    return body


def replaced(c: Column, fixes: list[tuple[str, str]]) -> Column:
    """Literal spelling fixes in order."""
    for wrong, right in fixes:
        c = F.replace(c, F.lit(wrong), F.lit(right))
    return c


# --- links -------------------------------------------------------------------------
def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))


def _encoded(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def with_utm(url: Column, source: Column, medium: Column, campaign: Column, content: Column) -> Column:
    """Merge campaign parameters into a link's query.

    Existing keys keep their position and take the new value, blank values are
    dropped, the last of repeated keys wins, the fragment stays behind.
    """
    bare, fragment = F.split_part(url, F.lit("#"), F.lit(1)), F.regexp_extract(url, "#(.*)$", 1)
    base, query = F.split_part(bare, F.lit("?"), F.lit(1)), F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1)
    parts = F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]*=.+$"))
    pairs = F.transform(parts, lambda p: F.struct(_decoded(F.regexp_extract(p, "^([^=]*)=", 1)).alias("k"),
                                                  _decoded(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v")))
    new = F.create_map(F.lit("utm_source"), source, F.lit("utm_medium"), medium,
                       F.lit("utm_campaign"), campaign, F.lit("utm_content"), content)
    kept = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    keys = F.array_distinct(F.concat(kept, F.array(*[F.lit(k) for k in ("utm_source", "utm_medium", "utm_campaign", "utm_content")])))
    held = F.transform(keys, lambda k: F.concat(_encoded(k), F.lit("="), _encoded(F.coalesce(
        F.try_element_at(new, k), F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))))
    return F.concat(base, F.lit("?"), F.array_join(held, "&"),
                    F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""))


# --- clocks --------------------------------------------------------------------------
def seconds_of(c: Column) -> Column:
    """'MM:SS' or 'H:MM:SS' to seconds, NULL when it is neither."""
    ok = F.trim(c).rlike(r"^(\d{1,2}:)?\d{1,2}:\d{2}$")
    part = F.split(F.trim(c), ":")
    n = F.size(part)
    at = lambda i: F.coalesce(F.try_element_at(part, F.lit(i)).try_cast("int"), F.lit(0))
    return F.when(ok, at(-1) + 60 * at(-2) + 3600 * F.when(n == 3, at(1)).otherwise(F.lit(0)))


def mm_ss(sec: Column) -> Column:
    s = F.bround(sec.cast("double")).cast("bigint")
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def _clock(sec: Column, sep: str) -> Column:
    s = F.greatest(sec.cast("double"), F.lit(0.0))
    whole = F.floor(s)
    return F.format_string(f"%02d:%02d:%02d{sep}%03d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60,
                           F.bround((s - whole) * 1000).cast("bigint"))


def srt_clock(sec: Column) -> Column:
    return _clock(sec, ",")


def vtt_clock(sec: Column) -> Column:
    return _clock(sec, ".")


def naive_utc(c: Column) -> Column:
    """ISO text (with or without zone) or epoch milliseconds to a UTC wall clock; bad input is NULL."""
    millis = F.when(c.rlike(r"^\d+$"), F.timestamp_millis(c.try_cast("bigint")))
    zoned = F.when(~c.rlike(r"^\d+$"), F.try_to_timestamp(c))
    return F.coalesce(millis, zoned)


def local_close(date: Column, start: Column, zone: Column, minutes: Column) -> Column:
    """When an event ends, as a UTC instant: local date and start in its own zone plus duration."""
    begin = F.to_timestamp(F.concat_ws(" ", date, F.coalesce(start, F.lit("00:00"))), "yyyy-MM-dd HH:mm")
    return F.to_utc_timestamp(begin, F.coalesce(zone, F.lit("UTC"))) + F.make_dt_interval(mins=F.coalesce(minutes, F.lit(0)))


def json_part(c: Column) -> Column:
    """The first JSON object or array in a model's answer: fences and prose around it are dropped.

    A whole answer that parses is kept; otherwise the widest bracketed span that
    parses, from the first bracket of either kind.
    """
    t = F.trim(c)
    spans = F.array(t, F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)```", 1), F.regexp_extract(t, r"(?s)(\{.*\})", 1),
                    F.regexp_extract(t, r"(?s)(\[.*\])", 1))
    good = F.filter(spans, lambda s: (s != "") & F.try_parse_json(s).isNotNull() & s.rlike(r"(?s)^\s*[\[{]"))
    return F.try_element_at(good, F.lit(1))


def coerced_answer(purpose: Column, part: Column) -> Column:
    """A model's answer under the key its purpose asks for: ``key``, ``payload`` (JSON text) and ``note``.

    ``part`` is JSON text.  An object is taken as it is, under an empty key.  A bare list goes under
    the purpose's key if any of its objects has one of that purpose's fields; for the narrative its
    strings are joined.  Anything else gives no payload.  Every change leaves a note.
    """
    answer = F.try_parse_json(part)
    kind = lambda v: F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    items = F.coalesce(F.try_variant_get(answer, "$", "array<variant>"), F.array().cast("array<variant>"))
    objects = F.filter(items, lambda v: kind(v) == "OBJECT")
    fields = F.flatten(F.transform(objects, lambda v: F.coalesce(F.json_object_keys(F.to_json(v)), F.array().cast("array<string>"))))
    words = F.filter(items, lambda v: kind(v) == "STRING")
    told = F.trim(F.array_join(F.transform(words, lambda v: v.cast("string")), " "))
    key, payload = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, own in fixed.ANSWER_FIELDS.items():
        hit = (purpose == name) & F.arrays_overlap(fields, F.array(*[F.lit(f) for f in own]))
        key, payload = F.when(hit, F.lit(name)).otherwise(key), F.when(hit, F.to_json(objects)).otherwise(payload)
    narrative = (purpose == fixed.NARRATIVE) & (told != "")
    key, payload = F.when(narrative, F.lit("narrative")).otherwise(key), F.when(narrative, told).otherwise(payload)
    text = F.trim(answer.cast("string"))
    spoken = (kind(answer) == "STRING") & (purpose == fixed.NARRATIVE) & (text != "")
    out = lambda k, p, n: F.struct(k.alias("key"), p.alias("payload"), n.alias("note"))
    nothing = F.lit(None).cast("string")
    return (F.when(kind(answer) == "OBJECT", out(F.lit(""), part, F.lit("")))
            .when(kind(answer) == "ARRAY", out(key, payload, F.concat(purpose, F.lit(": bare list taken as "), F.coalesce(key, F.lit("nothing")))))
            .when(spoken, out(F.lit("narrative"), text, F.concat(purpose, F.lit(": bare text taken as narrative"))))
            .otherwise(out(nothing, nothing, F.concat(purpose, F.lit(": no object, left out")))))
