import hashlib
import random
import re

import pytest

from strandline.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, d in enumerate(digits[::-1]):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def brute(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub(r"\D", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]


CASES = [
    "", "a@b.c", "x a.b@c-d.example.com, y", "a@b@c.d.e", "@a.b", "a@.b c@d.e", "a@b.c@d.e.f", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.255",
    "4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1112", "4111  1111 1111 1111", "12345 4111111111111111", "+1 (988) 555-2485", "+1-2", "+49 30 123456 ext",
    "+1 (269) 555-3296 4524132264652876", "é+33 1 23 45 67 89é", "1" * 40 + ".1.1.1",
]


def test_base_rules_match_brute_force():
    rng = random.Random(4)
    made = ["".join(rng.choice("01245a@. .-+()é") for _ in range(rng.randrange(60))) for _ in range(4000)]
    for text in CASES + made:
        assert pii.base_spans(text) == brute(text), text


def test_long_runs_are_linear():
    text = "a" * 300_000 + " " + "1" * 300_000 + "." * 10 + "+1" * 50_000 + "a@" * 50_000
    assert isinstance(pii.base_spans(text), list)


@pytest.fixture(scope="module")
def docs(spark):
    texts = [
        "Write to jane.roe@mail.example.com or call +1 (988) 555-2485 now", "host 10.20.30.40 card 4111 1111 1111 1111.", "mail bob (at) corp.example.org please",
        "phone 415-555-0199 today", None, "", "nothing here", "version 1.2.3.4 of it",
    ]
    return spark.createDataFrame([(i, t, "x", len(t or "")) for i, t in enumerate(texts)] + [(None, "q@r.st", "x", 6), (1, texts[1], "x", 1)], "doc_id long, text string, kind string, n_chars long")


def test_detect(docs):
    rows = docs.collect()
    got = {(r.doc_id, r.base_sha256): r for r in pii.detect(docs).collect()}
    for row in rows:
        base = brute(row.text or "")
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        r = got[row.doc_id, hashlib.sha256(written.encode()).hexdigest()]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for k, _, _ in base) for n in pii.KINDS]
        assert set(filter(None, written.split(","))) <= set(r.spans.split(","))
    assert pii.detect(docs).count() == len(rows)


def test_redact(docs):
    clean = {r.doc_id: r for r in pii.redact(docs).where("doc_id is not null").collect()}
    assert clean[0].text == "Write to <EMAIL> or call <PHONE> now" and clean[0].n_chars == len(clean[0].text)
    assert clean[1].text == "host <IP> card <CARD>."
    assert clean[4].text is None and clean[6].text == "nothing here"
    assert pii.redact(docs).columns == docs.columns
    assert pii.detect(docs.limit(0)).collect() == []


def test_numbers_side_by_side(spark):
    """The base rules take both numbers for one and drop it; the method finds each."""
    rng = random.Random(7)
    texts = []
    for i in range(60):
        card = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        card += next(c for c in "0123456789" if luhn(card + c))
        texts.append(f"see +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} {card} and a{i}@b{i}.example.com or 10.0.{i}.7 now")
        texts.append(f"card {card} then +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} end")
    texts.append("build 1234 5678 9012 3456 of 2024-01-02 and 12:34:56, 3.14159, order 100-200-3000 x")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.detect(docs).collect()}
    for i in range(0, 120, 2):
        assert got[i].n_phone == got[i].n_card == 0
        assert [s.split(":")[0] for s in got[i].spans.split(",")] == ["email", "ip", "card", "phone"]
        kind, a, b = got[i].spans.split(",")[3].split(":")
        assert texts[i][int(a) : int(b)].startswith("+1 (") and int(b) - int(a) == 17
    assert got[120].spans == ""
