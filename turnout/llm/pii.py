"""Personal data: expressions propose spans, validators confirm them, words nearby move the score.

Base kinds (email, ip, card, phone) are kept whenever their check passes.  All others must reach
``KEPT``: what their check proves alone (``iban`` and ``nir`` by mod-97, keys of a fixed format
``key``, for some with a checksum) is kept unless words speak against it; numbers with one check
digit (``taxid``, ``nhs``, ``dni``), numbers without (``ssn``) and tokens that only look random
(``secret``) need a word for them nearby.  Offsets count code points, ends are exclusive.

Null text counts as empty: no spans.  Repeated rows give repeated results, an empty table an
empty one, other columns are ignored.  Every expression is linear in the text's length.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from turnout.llm.base import batched

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "nir", "taxid", "nhs", "dni", "key", "secret")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile(r"[0-9]")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
#: National numbers with a check: French NIR, German tax number, British NHS number, Spanish DNI and NIE.
NIR = re.compile(r"(?<![0-9A-Za-z])[1-478]\x20?[0-9]{2}\x20?(?:0[1-9]|1[0-2]|[2-9][0-9])\x20?[0-9][0-9AB]\x20?[0-9]{3}\x20?[0-9]{3}\x20?[0-9]{2}(?![0-9A-Za-z])")
TAXID = re.compile(r"(?<![0-9A-Za-z])[1-9][0-9](?:\x20?[0-9]{3}){3}(?![0-9A-Za-z])")
NHS = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}[\x20-]?[0-9]{3}[\x20-]?[0-9]{4}(?![0-9A-Za-z-])")
DNI = re.compile(r"(?<![0-9A-Za-z])[XYZ0-9][0-9]{7}-?[A-Z](?![0-9A-Za-z])")
#: Letters of a DNI by its remainder (a fixed value of the format).
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
#: Access keys and tokens of published formats, and headers of private keys.
KEY = re.compile(r"(?<![0-9A-Za-z_-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,}|[sr]k_(?:live|test)_[0-9A-Za-z]{16,}"
                 r"|eyJ[0-9A-Za-z_-]+\.[0-9A-Za-z_-]+\.[0-9A-Za-z_-]+)(?![0-9A-Za-z_])"
                 r"|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----")
SECRET = re.compile(r"(?<![0-9A-Za-z+/_-])[0-9A-Za-z+/_-]{16,}=*")
PASSWORD = re.compile(r"(?i)(?<![a-z])(?:password|passwd|passphrase|pwd|passwort|kennwort|contrase\u00f1a|mot de passe)\x20?[:=]\x20?[\"']?([^\s\"',;]{6,})")
#: A value that is given to a name.
ASSIGNED = re.compile(r"[:=]\x20?[\"']?\Z")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Score of a span whose check passed, before its context is looked at.
SCORES = {"email": 0.8, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3, "nir": 0.7, "taxid": 0.3, "nhs": 0.3, "dni": 0.4,
          "key": 0.8, "secret": 0.3}
NEARBY = 40
STEP = 0.2
KEPT = 0.5
FOR = {
    "email": {"mail", "email", "contact", "write"},
    "ip": {"ip", "address", "host", "server", "login"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "debit", "payment"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "fax"},
    "iban": {"iban", "bank", "account", "transfer"},
    "ssn": {"ssn", "social", "security", "taxpayer"},
    "nir": {"nir", "sociale", "secu", "insee", "vitale"},
    "taxid": {"steuer", "steuernummer", "identifikationsnummer", "steuerid", "idnr", "tin", "tax"},
    "nhs": {"nhs", "patient", "hospital"},
    "dni": {"dni", "nie", "nif", "identidad", "documento"},
    "key": {"key", "secret", "token", "credential", "credentials"},
    "secret": {"token", "secret", "key", "apikey", "password", "passwd", "credential", "credentials", "auth", "bearer",
               "passphrase", "pwd", "passwort", "kennwort", "contrase", "passe"},
}
AGAINST = {"version", "release", "isbn", "issn", "order", "sku", "serial", "build", "example"}
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) * (1 + n % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def taxid(digits: str) -> bool:
    """ISO 7064 mod 11, 10, and one digit that stands two or three times among the first ten."""
    p = 10
    for c in digits[:10]:
        p = ((int(c) + p) % 10 or 10) * 2 % 11
    return (11 - p) % 10 == int(digits[10]) and sum(digits[:10].count(c) > 1 for c in set(digits[:10])) == 1


def nhs(digits: str) -> bool:
    return (11 - sum(int(c) * (10 - n) for n, c in enumerate(digits[:9])) % 11) % 11 == int(digits[9])


def nir(code: str) -> bool:
    number = code[:13].replace("2A", "19").replace("2B", "18") if code[5:7] in ("2A", "2B") else code[:13]
    return number.isdigit() and 97 - int(number) % 97 == int(code[13:])


def dni(code: str) -> bool:
    number = str("XYZ".index(code[0])) + code[1:8] if code[0] in "XYZ" else code[:8]
    return DNI_LETTERS[int(number) % 23] == code[-1]


def key(code: str) -> bool:
    """Formats with a checksum or an inner format have to keep it."""
    if code.startswith("gh"):  # the last six are the CRC of the thirty before them
        crc, out = zlib.crc32(code[4:34].encode()), ""
        while crc:
            crc, r = divmod(crc, 62)
            out = BASE62[r] + out
        return out.rjust(6, "0") == code[34:]
    if code.startswith("eyJ"):
        head = code.split(".")[0]
        try:
            return isinstance(json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4))), dict)
        except ValueError:
            return False
    return True


def random_looking(code: str) -> bool:
    """Letters and digits by turns, and no fewer kinds than random ones have."""
    code = code.rstrip("=")
    digits = sum(c in "0123456789" for c in code)
    turns = sum((a in "0123456789") != (b in "0123456789") for a, b in zip(code, code[1:]))
    return 0 < digits < len(code) and turns * 6 >= len(code) and len(set(code)) >= 9


def met(known: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether a span that does not overlap its own kind meets one of the sorted ``known``."""
    at = bisect.bisect_left(known, (end, 0))
    return any(start < b for _, b in known[max(0, at - 2):at])


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain, found from the @ outwards."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        free = found.end() if found else at + 1
        at = text.find("@", free)


def proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans that pass their check."""
    if "@" in text:
        for start, end in emails(text):
            yield "email", start, end
    known = []
    for m in PASSWORD.finditer(text):
        if not m[1].rstrip(".!?)").isalpha():
            known.append(m.span(1))
            yield "secret", *m.span(1)
    if "-----BEGIN" in text and not DIGIT.search(text):
        for m in KEY.finditer(text):
            yield "key", m.start(), m.end()
    if not DIGIT.search(text):
        return
    if "." in text:
        for m in IP.finditer(text):
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in m[0].split(".")):
                yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield "phone", m.start(), m.end()
    for m in IBAN.finditer(text):
        end = m.end()
        while end - m.start() >= 15:  # upper-case words may follow behind a space
            after = text[end:end + 1]
            code = text[m.start():end].replace(" ", "")
            if not (after.isalnum() and after.isascii()) and 15 <= len(code) <= 34 and mod97(code):
                yield "iban", m.start(), end
                break
            end = text.rfind(" ", m.start(), end)
    if "-" in text:
        for m in SSN.finditer(text):
            yield "ssn", m.start(), m.end()
    for kind, pattern, check in (("nir", NIR, nir), ("taxid", TAXID, taxid), ("nhs", NHS, nhs), ("dni", DNI, dni)):
        for m in pattern.finditer(text):
            if check(m[0].replace(" ", "").replace("-", "")):
                yield kind, m.start(), m.end()
    for m in KEY.finditer(text):
        if key(m[0]):
            known.append(m.span())
            yield "key", m.start(), m.end()
    known.sort()
    for m in SECRET.finditer(text):
        if random_looking(m[0]) and not met(known, *m.span()):
            yield "secret", m.start(), m.end()


def scored(text: str, kind: str, start: int, end: int) -> float:
    around = set(re.findall(r"[a-z]+", (text[max(0, start - NEARBY):start] + " " + text[end:end + NEARBY]).lower()))
    score = SCORES[kind] + STEP * bool(around & FOR[kind]) - STEP * bool(around & AGAINST)
    if kind in ("key", "secret") and ASSIGNED.search(text, max(0, start - 3), start):
        score += STEP
    return round(min(1.0, max(0.0, score)), 2)


def spans(text: str) -> list[Span]:
    """All spans of a text by start, then kind as listed."""
    found = [Span(kind, start, end, scored(text, kind, start, end)) for kind, start, end in proposed(text)]
    found = [s for s in found if s.kind in BASE or s.score >= KEPT]
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def masked(text: str, found: list[Span]) -> str:
    """The text with each span, or run of overlapping ones, replaced by its first kind."""
    out, done = [], 0
    for s in found:
        if s.start >= done:
            out += [text[done:s.start], f"[{s.kind.upper()}]"]
        done = max(done, s.end)
    return "".join([*out, text[done:]])


def listed(found: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in found)


def found_spans(docs: DataFrame) -> DataFrame:
    """``doc_id`` and its scored spans, one row per row of ``docs``."""
    batched(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = [[s._asdict() for s in spans(t or "")] for t in batch.column(1).to_pylist()]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, f"doc_id bigint, spans {SPANS}")


def without_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with every span masked and ``n_chars`` brought in line; texts without one stay as they are."""
    batched(docs.sparkSession)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [t and masked(t, spans(t)) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pii_digests(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans and the list of all spans, per document."""
    batched(docs.sparkSession)
    names = ["doc_id", *(f"n_{kind}" for kind in BASE), "base_sha256", "spans"]

    def run(batches):
        for batch in batches:
            counts, sha, every = [[] for _ in BASE], [], []
            for text in batch.column(1).to_pylist():
                found = spans(text or "")
                base = [s for s in found if s.kind in BASE]
                for n, kind in enumerate(BASE):
                    counts[n].append(sum(s.kind == kind for s in base))
                sha.append(hashlib.sha256(listed(base).encode()).hexdigest())
                every.append(listed(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(every, pa.string())], names)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, "doc_id bigint, " + ", ".join(f"n_{kind} bigint" for kind in BASE) + ", base_sha256 string, spans string")
