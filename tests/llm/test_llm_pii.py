"""Spans beside Python's regular expressions."""

import hashlib
import random
import re

import data

from readlake.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CARD, SHORT, IBAN = "4111 1111 1111 1111", "378282246310005", "DE89 3704 0044 0532 0130 00"


def luhn(digits):
    values = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in values) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(part) > 255 for part in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def texts():
    rng = random.Random(7)
    out = list(data.SPECIAL)
    out += ["a@b.c", "a@b.com_x@y.org", "a@b..c", "@b.c", "x é𝒳 q@w.e 1.2.3.4.5.6.7.8", "999.1.1.1 001.02.3.4", CARD + " 1"]
    out += ["1 " * 20000, "1." * 20000, "a." * 9000 + "@" + "b." * 9000, "+" * 3000, "a@" * 3000, "9" * 40000, "x1.2.3.4 "]
    out += ["".join(rng.choice("a1@.. -+2 (é_4") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    parts = [CARD, CARD.replace(" ", ""), SHORT, "card", "1.2.3.4", "a@b.co", "+49 30 1234567", "x", "-", ".", "é𝒳", "12"]
    for _ in range(300):
        out.append(" ".join(rng.choice(parts) + rng.choice(["", "-", " ", ".", "@"]) for _ in range(rng.randint(0, 12))))
    return out


def test_base_spans(spark):
    df, rows = data.documents(spark, texts(), partitions=8)
    want = []
    for key, text, *_ in rows:
        spans = brute(text)
        counts = tuple(sum(s.startswith(kind) for s in spans) for kind in BASE)
        want.append((key, *counts, hashlib.sha256(",".join(spans).encode()).hexdigest()))
    found = pii.find_pii(df).collect()
    assert sorted((tuple(r)[:6] for r in found), key=str) == sorted(want, key=str)
    by_id = {r.doc_id: r.spans for r in found}
    for key, text, *_ in rows:
        assert [s for s in by_id[key].split(",") if s.split(":")[0] in BASE] == brute(text)


def test_added_spans_and_context(spark):
    cases = {
        f"pay to {IBAN} today": "iban:7:34",
        f"pay to {IBAN.replace('89', '88')} today": "",
        "GB82WEST12345698765432": "iban:0:22",
        "BE68 5390 0754 7034 BIC GKCCBEBB": "iban:0:19",
        f"{IBAN} DEUTDEFF, NO93 8601 1117 947 OSLO": "iban:0:27,iban:38:56",
        f"{IBAN}X": "",
        "my social security number is 123-45-6789": "national_id:29:40",
        "call 123-45-6789": "",
        "my ssn 000-45-6789": "",
        f"visa {SHORT}": "short_card:5:20",
        f"number {SHORT}": "",
        "token = " + "0123456789abcdef" * 2: "secret:8:40",
        "commit " + "0123456789abcdef" * 2: "",
    }
    df, _ = data.documents(spark, list(cases))
    got = {r.doc_id: r.spans for r in pii.find_pii(df).collect()}
    assert [got[k + 1] for k in range(len(cases))] == list(cases.values())


def test_redact(spark):
    df, rows = data.documents(spark, [*texts()[-200:], f"é {CARD}, 1.2.3.4", "+1.2.3.4.5678 x", None, ""])
    spans = {r.doc_id: r.spans for r in pii.find_pii(df).collect()}
    masked = pii.redact(df)
    assert masked.columns == df.columns
    got = {r.doc_id: r.text for r in masked.collect()}
    for key, text, *_ in rows:
        if text is None:
            assert got[key] is None
            continue
        at, out = 0, ""
        for start, end, kind in sorted((int(s.split(":")[1]), int(s.split(":")[2]), s.split(":")[0]) for s in spans[key].split(",") if s):
            if start >= at:
                out += text[at:start] + f"[{kind.upper()}]"
            at = max(at, end)
        assert got[key] == out + text[at:]


def test_empty(spark):
    assert pii.find_pii(data.empty(spark)).count() == 0
    assert pii.redact(data.empty(spark)).count() == 0
