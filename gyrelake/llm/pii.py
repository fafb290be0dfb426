"""Personal data: patterns propose spans, checksums confirm them, words nearby move the score.

Base kinds are email, ip, card and phone, each found leftmost and without overlap inside its kind;
a proposal that fails its test is dropped and its text is not searched again. Further kinds (iban,
ssn, local phone numbers) are kept when their score reaches ``THRESHOLD``: a prior of the kind,
plus a bonus for a passed checksum, plus or minus what context words within ``WINDOW`` characters
say. Base spans stay whatever their score is. Offsets are code points, ends exclusive.

Nulls: a null text counts as empty and has no spans; null ids stay. Repeated rows are searched one
by one; an empty table gives an empty result; further input columns are ignored. Every search
is linear in the text and overlaps are found by bisection, so that very long texts, long runs of digits or letters
and texts full of spans are safe.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyrelake.llm.common import groups

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "local_phone")
THRESHOLD, WINDOW = 0.6, 48

# Prior score, bonus of a passed checksum, and context words for and against a kind.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.4, "phone": 0.6, "iban": 0.3, "ssn": 0.4, "local_phone": 0.4}
CHECKED = {"card": 0.4, "iban": 0.6}
FOR = {
    "email": {"email", "mail", "contact", "write"},
    "ip": {"ip", "host", "address", "server", "login"},
    "card": {"card", "credit", "visa", "mastercard", "payment", "karte", "tarjeta", "carte"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telefon"},
    "iban": {"iban", "bank", "account", "konto"},
    "ssn": {"ssn", "social", "security", "insurance"},
    "local_phone": {"phone", "tel", "call", "mobile", "fax", "telefon"},
}
AGAINST = {"version", "isbn", "order", "invoice", "serial", "sku", "part"}

#: Characters of an IBAN by country; for a country that is not here, every length from 15 to 34 is tried.
IBAN_LENGTHS = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE BI", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE IM JE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BF CF CM CG CI DJ FR GA GR IT MC MG MR SM", 28: "AL AZ BJ BY CY DO GT HN HU LB ML NI PL SN SV TG",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match never ends inside a run of digits, so that a new one begins where a run begins.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
_IBAN_NEXT = re.compile(r" ?[A-Z0-9]")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NEAR_PHONE = re.compile(r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ takes the local part before it, back to the last match, and the domain after it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Each country and check number takes as many characters as its country has, spaces aside, up to the end of a word.

    A country without a known length takes the longest stretch of 15 to 34 characters that passes.
    """
    end = 0
    for m in _IBAN.finditer(text):
        if m.start() < end:
            continue
        known, compact, at = IBAN_LENGTHS.get(m[0][:2]), m[0], m.end()
        found = 0
        while len(compact) < (known or 34) and (x := _IBAN_NEXT.match(text, at)):
            compact, at = compact + text[x.end() - 1], x.end()
            ended = at == len(text) or not (text[at].isascii() and text[at].isalnum())
            if ended and (len(compact) == known if known else len(compact) >= 15) and mod97(compact):
                found = at
        if found:
            end = found
            yield m.start(), end


def _score(kind: str, text: str, start: int, end: int) -> float:
    near = {w.lower() for w in _WORD.findall(text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW])}
    score = PRIOR[kind] + CHECKED.get(kind, 0.0) + 0.3 * bool(near & FOR[kind]) - 0.3 * bool(near & AGAINST)
    return round(min(1.0, max(0.0, score)), 2)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def disjoint(found: list[tuple[int, int, str]]) -> tuple[list[int], list[int]]:
    """(starts, ends) of the stretches that the spans cover together, in order and apart from each other."""
    starts, ends = [], []
    for s, e, _ in sorted(found):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def spans(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score), by start, then by the order of ``KINDS``."""
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        found += [(*x, "email") for x in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            found.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 37 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((*m.span(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                found.append((*m.span(), "phone"))
    starts, ends = disjoint(found)
    more = [(*x, "iban") for x in ibans(text)]
    more += [(*m.span(), "ssn") for m in _SSN.finditer(text)]
    more += [(*m.span(), "local_phone") for m in _NEAR_PHONE.finditer(text)]
    out = [(s, e, k, _score(k, text, s, e)) for s, e, k in found]
    for s, e, k in more:
        before = bisect_right(starts, e - 1) - 1  # the last base stretch that begins before the span ends
        if (before < 0 or ends[before] <= s) and (score := _score(k, text, s, e)) >= THRESHOLD:
            out.append((s, e, k, score))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id and its spans, an array of (kind, start, end, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in groups(batches):
            found = [[{"kind": k, "start": s, "end": e, "score": x} for s, e, k, x in spans(t)] for t in texts]
            yield pa.record_batch({"doc_id": part.column(0), "spans": pa.array(found, _SPAN_ARROW)})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {SPAN}")


def joined(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, all spans as text and their scores, in the same order."""
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return pii_spans(docs).select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.array_join(F.transform("spans", lambda x: F.format_number(x["score"], 2)), ",").alias("scores"))


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    if not text:
        return text
    out, at = [], 0
    for start, end, kind, _ in spans(text):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text


def redact_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with personal data masked in text, and n_chars (where there is one) of the new text.

    Null texts stay null; all other columns are carried along unchanged, whatever their names are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in groups(batches):
            at = batch.schema.get_field_index("text")
            masked = [redact(t) if known else None for t, known in zip(texts, batch.column(at).is_valid().to_pylist(), strict=True)]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(masked, batch.schema.field(at).type))
            if (n := batch.schema.get_field_index("n_chars")) >= 0:
                batch = batch.set_column(n, batch.schema.field(n), pa.array([None if t is None else len(t) for t in masked], batch.schema.field(n).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
