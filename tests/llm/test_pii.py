import hashlib
import random
import re
import time
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gyrelake.llm import pii

RULES = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
)


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    found = [(m.start(), k, m.end()) for k, (_, rx, ok) in enumerate(RULES) for m in re.finditer(rx, text) if ok(m[0])]
    return [(RULES[k][0], s, e) for s, k, e in sorted(found)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@-_+ 1258(3)x%é", max_size=40) | st.text(max_size=20))
def test_base_spans_equal_the_patterns(text):
    assert [(k, s, e) for s, e, k, _ in pii.spans(text) if k in pii.BASE] == brute(text)


def test_base_cases():
    text = "mail a.b+c@x-1.example.com_d@e.fr ip 10.0.0.255 1.2.3.256; 4111 1111 1111 1111, +1 (651) 555-8500 é 0010.1.1.1"
    assert [(k, s, e) for s, e, k, _ in pii.spans(text) if k in pii.BASE] == brute(text)
    assert {k for _, _, k, _ in pii.spans(text)} == {"email", "ip", "card", "phone"}


def test_checksums_and_context():
    assert [k for _, _, k, _ in pii.spans("iban DE89 3704 0044 0532 0130 00 ok")] == ["iban"]
    assert [k for _, _, k, _ in pii.spans("DE89 3704 0044 0532 0130 01")] == []
    assert [k for _, _, k, _ in pii.spans("his ssn is 123-45-6789")] == ["ssn"]
    assert pii.spans("code 123-45-6789") == []
    assert [k for _, _, k, _ in pii.spans("call 651 555-8500 now")] == ["local_phone"]
    assert pii.spans("order 651 555-8500 now") == []
    assert pii.redact("x a@b.cc y") == "x [EMAIL] y"


def test_long_texts_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + " " * 300_000, "a@" * 150_000, "A1" * 150_000):
        pii.spans(text)


def test_a_long_text_full_of_spans_of_both_sorts():
    """10 MB of base and added spans side by side; every stretch gives what it gives alone."""
    unit, n = "a@b.co call 555 123 4567 ", 400_000
    one = [x[:3] for x in pii.spans(unit)]
    assert [k for *_, k in one] == ["email", "local_phone"]
    began = time.process_time()
    found = pii.spans(unit * n)
    assert time.process_time() - began < 120
    assert len(found) == 2 * n and [x[:3] for x in found[:2]] == one and [x[0] for x in found[-2:]] == [x[0] + len(unit) * (n - 1) for x in one]


@pytest.mark.parametrize("seed", range(20))
def test_overlaps_equal_plain_comparison(seed):
    """No added span meets a base one, and those left out do, or score too little."""
    rng = random.Random(seed)
    text = "".join(rng.choice(["555 123 4567", "+1 555 123 4567", "123-45-6789", "4111 1111 1111 1111", "call ", "ssn ", " ", ".", "a@b.co", "DE89370400440532013000"]) for _ in range(60))
    found = pii.spans(text)
    base = [x for x in found if x[2] in pii.BASE]
    every = [(*x, "iban") for x in pii.ibans(text)] + [(*m.span(), "ssn") for m in pii._SSN.finditer(text)] + [(*m.span(), "local_phone") for m in pii._NEAR_PHONE.finditer(text)]
    want = {(s, e, k) for s, e, k in every if pii._score(k, text, s, e) >= pii.THRESHOLD and not any(a < e and s < b for a, b, *_ in base)}
    assert {x[:3] for x in found if x[2] not in pii.BASE} == want


def test_digest_and_edges(spark):
    rows = [(1, "a@b.cc 4111111111111111"), (None, "a@b.cc"), (2, None), (2, None), (3, "")]
    got = pii.pii_digest(spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, spans string")).collect()
    want = Counter()
    for i, t in rows:
        found = brute(t or "")
        n = Counter(k for k, _, _ in found)
        want[i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in found).encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:6] for r in got) == want
    docs = spark.createDataFrame([(1, "a@b.cc", "de", 6), (2, None, None, None)], "doc_id long, text string, lang string, n_chars long")
    assert sorted(map(tuple, pii.redact_documents(docs).collect())) == [(1, "[EMAIL]", "de", 7), (2, None, None, None)]
    assert pii.pii_digest(docs.limit(0)).collect() == []


def test_iban_ends_with_its_country_length():
    """Whatever follows a valid number, or stands before it, its span is the number alone."""
    for iban in ("DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO9386011117947", "FR14 2004 1010 0505 0001 3M02 606"):
        for after in ("", " Please pay", " BIC COBADEFFXXX", " I pay", " 2 days", " VAT 12", ", ok", " ok", " " + iban):
            for before in ("", "to ", "BIC COBADEFFXXX ", "DE12 "):
                text = before + iban + after
                found = [(s, e) for s, e, k, _ in pii.spans(text) if k == "iban"]
                twice = [(len(before) + len(iban) + 1, len(text))] if after.strip() == iban else []
                assert found == [(len(before), len(before) + len(iban)), *twice], text
    assert pii.redact("DE89370400440532013000 Please pay") == "[IBAN] Please pay"


def test_iban_of_an_unknown_length():
    """A country that has no entry takes the longest stretch that passes mod-97."""
    body = "0011223344556677"
    check = 98 - int("".join(str(int(c, 36)) for c in body + "ZZ00")) % 97
    iban = f"ZZ{check:02d}{body}"
    assert [x[:3] for x in pii.spans(f"{iban} Please pay")] == [(0, len(iban), "iban")]
    assert pii.spans(f"{iban}x") == []
    assert pii.spans("DE89370400440532013000X") == []
