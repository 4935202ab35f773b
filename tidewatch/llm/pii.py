"""Personal data in whole texts: patterns propose spans, checksums confirm them, context words set the score.

Base kinds (email, ip, card, phone) follow their patterns exactly: leftmost, without overlap within a
kind; a match that fails its check (octets, Luhn, number of digits) is dropped and not tried again.
Further kinds (iban, confirmed by mod 97 and its country's length; ssn, which needs a context word
nearby; secret, a value given to a name like password or token, or one of a known form, confirmed by its
entropy) are kept from a score of 0.6.  Offsets are code points, the end is exclusive.

Null and empty texts have no span.  Spans of different kinds may overlap.  Repeated rows give a row each; an
empty table gives none.  A text is held whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.texts import map_texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "secret")
KEEP_FROM, REACH = 0.6, 48

# No group below is ever re-read: what follows a possessive run cannot start with one of its characters.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_GIVEN = re.compile(r"""(?:passw(?:or)?d|passphrase|pwd|token|secret|api[_-]?key|access[_-]?key|private[_-]?key|credentials?)["']?[ \t]{0,8}(?:=|:)[ \t]{0,8}["']?([A-Za-z0-9+/_.~-]{12,512})""", re.I)
# fixed values: public forms of access keys
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,72})(?![A-Za-z0-9])")
LEAST_ENTROPY = 2.5  # bits a character

# fixed values: lengths in the public IBAN registry
_IBAN_LENGTH = dict(
    AD=24, AE=23, AT=20, BE=16, BG=22, CH=21, CY=28, CZ=24, DE=22, DK=18, EE=20, ES=24, FI=18, FR=27, GB=22, GR=27, HR=21, HU=28,
    IE=22, IL=23, IS=26, IT=27, LI=21, LT=20, LU=20, LV=21, MC=27, MT=31, NL=18, NO=15, PL=28, PT=25, RO=24, SA=24, SE=24, SI=19, SK=24, SM=27, TR=26,
)
_FIRST_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4, "secret": 0.8}
_CONTEXT = {
    "email": re.compile(r"\b(?:e-?mail|mailto|contact|write)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address|login)\b", re.I),
    "card": re.compile(r"\b(?:card|credit|visa|mastercard|payment|karte|tarjeta|carte)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|call|mobile|fax|telefon|tél)\b", re.I),
    "iban": re.compile(r"\b(?:iban|bank|account|konto|cuenta|compte)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social security|taxpayer)\b", re.I),
    "secret": re.compile(r"\b(?:key|login|user|account|config|export|auth)\b", re.I),
}
_AGAINST = re.compile(r"\b(?:version|release|order|invoice|isbn|part|serial|example)\b", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    out, floor = [], 0
    for m in _DOMAIN.finditer(text):
        at = first = m.start()
        while first > floor and text[first - 1] in _LOCAL:
            first -= 1
        if first < at:
            out.append((first, m.end()))
            floor = m.end()
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _iban_end(text: str, m: re.Match) -> int | None:
    size = _IBAN_LENGTH.get(m[0][:2])
    seen = 0
    for i in range(m.start(), m.end() if size else m.start()):
        seen += text[i] != " "
        if seen == size:
            behind = text[i + 1 : i + 2]
            ok = not (behind.isascii() and behind.isalnum()) and mod97(text[m.start() : i + 1].replace(" ", ""))
            return i + 1 if ok else None
    return None


def entropy(s: str) -> float:
    """Bits a character."""
    n = len(s)
    return -sum(k / n * math.log2(k / n) for k in Counter(s).values())


def _secrets(text: str) -> list[tuple[int, int]]:
    """Mixed values of high entropy behind a telling name, and keys of a known form; without overlap."""
    out: list[tuple[int, int]] = []
    if "=" in text or ":" in text:
        for m in _GIVEN.finditer(text):
            value = m[1].rstrip(".")
            if len(value) >= 12 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and entropy(value) >= LEAST_ENTROPY:
                out.append((m.start(1), m.start(1) + len(value)))
    for m in _KEY.finditer(text):
        if entropy(m[0]) >= LEAST_ENTROPY and not any(a < m.end() and m.start() < b for a, b in out):
            out.append(m.span())
    return out


def _score(text: str, kind: str, a: int, b: int) -> float:
    near = text[max(0, a - REACH) : a] + " " + text[b : b + REACH]
    return round(min(1.0, _FIRST_SCORE[kind] + 0.2 * bool(_CONTEXT[kind].search(near)) - 0.2 * bool(_AGAINST.search(near))), 2)


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), by start, then kind as listed."""
    found = []
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    if re.search("[0-9]", text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                d = _digits(m[0])
                if 12 <= len(d) <= 19 and luhn(d):
                    found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
        for m in _IBAN.finditer(text):
            if end := _iban_end(text, m):
                found.append(("iban", m.start(), end))
        if "-" in text:
            found += [("ssn", *m.span()) for m in _SSN.finditer(text)]
        found += [("secret", a, b) for a, b in _secrets(text)]
    scored = [(k, a, b, _score(text, k, a, b)) for k, a, b in found]
    kept = [x for x in scored if x[0] in BASE or x[3] >= KEEP_FROM]
    return sorted(kept, key=lambda x: (x[1], KINDS.index(x[0])))


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end, score>>) of every row; a narrow map."""

    def work(texts: list[str]) -> list:
        return [[[dict(zip(("kind", "start", "end", "score"), s)) for s in find_spans(x)] for x in texts]]

    return map_texts(docs, work, [T.StructField("spans", T.ArrayType(SPAN))], id_col, text_col)


def mask(text: str | None) -> str | None:
    """The text with each span (overlapping ones joined) replaced by its first kind in brackets."""
    if not text:
        return text
    out, at, run = [], 0, None
    for kind, a, b, _ in [*find_spans(text), ("", len(text) + 1, 0, 0)]:
        if run and a < run[2]:
            run = (run[0], run[1], max(run[2], b))
            continue
        if run:
            out += [text[at : run[1]], f"[{run[0].upper()}]"]
            at = run[2]
        run = (kind, a, b)
    return "".join([*out, text[at:]])


def _listed(spans) -> F.Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
