"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Emails, addresses of the Internet protocol, payment cards (Luhn) and international telephone numbers are always
reported when their pattern and check hold. The method adds bank account numbers (IBAN, mod-97), and numbers that are
only likely to be personal when the words around them say so: national telephone numbers, social security numbers, and
long hexadecimal strings that are secrets (keys, tokens, passwords).
The patterns use possessive repeats and fixed starts, so that a scan takes time in proportion to the text.
"""

from __future__ import annotations

import bisect
import itertools
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import map_texts

#: Kinds in the order in which equal starts are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "phone_local", "secret")
BASE = 4
#: A span is reported when its score reaches this.
REPORTED = 0.5
#: Context is looked for in so many characters before and after a span.
NEAR = 40

#: Score of a span by itself, and what a context word adds (fixed values).
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3, "phone_local": 0.2, "secret": 0.3}
#: Context words of each kind (fixed values).
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social security"),
    "phone_local": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"),
    "secret": ("token", "secret", "key", "password", "passwd", "apikey", "api_key", "credential", "auth"),
}
CONTEXT_GAIN = 0.3

EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
PHONE_LOCAL = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,128}+(?![A-Za-z0-9])")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of a bank account number: letters are 10 to 35, the first four characters go last."""
    code = iban.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        if start < at and (m := EMAIL_DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _proposed(text: str):
    """(kind, start, end) of everything that a pattern proposes and its own check confirms."""
    for a, b in _emails(text):
        yield "email", a, b
    if not DIGIT.search(text):
        return
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
                yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 37 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(m[0].count, "0123456789")) <= 15:
                yield "phone", m.start(), m.end()
    for m in IBAN.finditer(text):
        if mod97(m[0]):
            yield "iban", m.start(), m.end()
    if "-" in text:
        for m in SSN.finditer(text):
            if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
                yield "ssn", m.start(), m.end()
    for m in PHONE_LOCAL.finditer(text):
        yield "phone_local", m.start(), m.end()
    for m in SECRET.finditer(text):
        yield "secret", m.start(), m.end()


def spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in code points, by start and then kind; base kinds are always reported, others when
    their score reaches REPORTED and no base span overlaps them."""
    out, taken, reach = [], [], None
    for kind, a, b in _proposed(text or ""):
        around = text[max(0, a - NEAR) : a].lower() + " " + text[b : b + NEAR].lower()
        score = min(1.0, PRIOR[kind] + CONTEXT_GAIN * any(re.search(rf"(?<!\w){re.escape(w)}(?!\w)", around) for w in CONTEXT[kind]))
        base = KINDS.index(kind) < BASE
        if base:
            taken.append((a, b))
        elif reach is None:
            taken.sort()
            reach = list(itertools.accumulate((y for _, y in taken), max))
        if base or score >= REPORTED and not ((i := bisect.bisect_left(taken, (b, 0))) and reach[i - 1] > a):
            out.append((kind, a, b, round(score, 3)))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find(docs: DataFrame) -> DataFrame:
    """doc_id and its spans (kind, start, end, score). Null and empty texts have none; rows that repeat a doc_id each
    give a row; extra columns are ignored."""

    def of(piece):
        return {"doc_id": piece.column("doc_id"), "spans": [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans(t)] for t in piece.column("text").to_pylist()]}

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), of, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>")


def digest(found: DataFrame) -> DataFrame:
    """The spans of find() as counts (n_spans: of all kinds), a joined string, and the SHA-256 of the base spans joined likewise."""
    joined = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:BASE]))
    of_kind = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS[:BASE]]
    return found.select("doc_id", *counts, F.size("spans").cast("long").alias("n_spans"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
