"""Claims that generated text makes about its source, found with their positions.

A small per-text helper: it only marks what is claimed.  Whether a claim holds
is decided by joins in ``operators.grounding``.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from turnout.functions import fixed

# Fixed patterns of the claim grammar.
BRACKET = re.compile(rf"\[({fixed.TS})(?:\s*[–‒-]\s*({fixed.TS}))?\]")
CHAPTER_LINE = re.compile(rf"^({fixed.TS})\s+\S")
NAME_BEFORE = re.compile(r"([A-Z][\w'.-]+(?:\s+[A-Z][\w'.-]+){0,2}),\s*[^,\[\]\n]{0,60}$")
DASH_LINE = re.compile(r"^\s*[—–-]{1,2}\s*([A-Z][\w'.-]+(?:\s+[A-Z][\w'.-]+){0,3}),", re.MULTILINE)
DASH_INLINE = re.compile(r'["”]\s*[—–-]{1,2}\s*([A-Z][\w\'.-]+(?:\s+[A-Z][\w\'.-]+){0,3}),')
QUOTED = (re.compile(r'"([^"\n]+)"'), re.compile(r"“([^”\n]+)”"))
HEADING = re.compile(r"^#{1,6}\s+(.*)$", re.MULTILINE)
CREATIVE = re.compile(r"headline options|thumbnail brief", re.IGNORECASE)
BEFORE, AFTER = 180, 120

CLAIM = StructType([
    StructField("type", StringType()), StructField("raw", StringType()), StructField("stamp", StringType()),
    StructField("name", StringType()), StructField("context", StringType()),
    StructField("before", StringType()), StructField("after", StringType()),
])


class _Sections:
    """Is a position under a heading whose copy is creative rather than cited?"""

    def __init__(self, text: str):
        heads = [(m.start(), bool(CREATIVE.search(m.group(1)))) for m in HEADING.finditer(text)]
        self.at, self.creative = [h[0] for h in heads], [h[1] for h in heads]

    def cited(self, pos: int) -> bool:
        i = bisect.bisect_right(self.at, pos) - 1
        return i < 0 or not self.creative[i]


def stamps_in(text: str):
    for m in BRACKET.finditer(text):
        context = text[max(0, m.start() - 40):m.end() + 10].strip()
        both = [t for t in m.groups() if t]
        for t in both:
            yield "timestamp", m.group(0), t, None, context, None, None
        named = NAME_BEFORE.search(text[max(0, m.start() - 60):m.start()])
        if named and len(both) == 1:
            yield "speaker_at", f"{named.group(1).strip()} @ [{both[0]}]", both[0], named.group(1).strip(), context, None, None
    if "## Chapters" in text:
        for line in map(str.strip, text.splitlines()):
            hit = CHAPTER_LINE.match(line)
            if hit:
                yield "timestamp", line, hit.group(1), None, line, None, None


def quotes_in(text: str, where: _Sections):
    for pattern in QUOTED:
        for m in pattern.finditer(text):
            said = m.group(1).strip()
            if len(said) >= fixed.QUOTE_MIN and where.cited(m.start()):
                yield ("quote", said, None, None, None,
                       text[max(0, m.start() - BEFORE):m.start()], text[m.end():m.end() + AFTER])


def attributions_in(text: str, where: _Sections):
    for pattern in (DASH_LINE, DASH_INLINE):
        for m in pattern.finditer(text):
            if where.cited(m.start()):
                yield "attribution", m.group(1).strip(), None, m.group(1).strip(), None, None, None


def found_in(text: str | None) -> list[tuple]:
    """All claims of a text, by kind and in text order."""
    where = _Sections(text or "")
    return [*stamps_in(text or ""), *quotes_in(text or "", where), *attributions_in(text or "", where)]


@F.pandas_udf(ArrayType(CLAIM))
def claims_in(text: pd.Series) -> pd.Series:
    names = [f.name for f in CLAIM.fields]
    return pd.Series([[dict(zip(names, c)) for c in found_in(t)] for t in text])


@F.udtf(returnType="claim_no int, type string, raw string, stamp string, name string, context string, before string, after string", useArrow=True)
class ClaimsOf:
    """Table function: a row for each claim of a text, to be called with LATERAL."""

    def eval(self, text: str):
        for number, claim in enumerate(found_in(text)):
            yield (number, *claim)


@F.pandas_udf(ArrayType(StringType()))
def gram_tokens(text: pd.Series) -> pd.Series:
    """Character 4-grams of a text, repeated ones numbered, so a set join counts multiplicity."""
    def one(t):
        low, seen, out = (t or "").lower(), Counter(), []
        for i in range(len(low) - 3):
            g = low[i:i + 4]
            out.append(f"{g}{seen[g]}" if seen[g] else g + "0")
            seen[g] += 1
        return out
    return pd.Series([one(t) for t in text])
