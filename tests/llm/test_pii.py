import hashlib
import random
import re

from hypothesis import given, settings, strategies as st

from pitrank.llm import pii as P

from texts import filings, odd_rows, prose, table

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def check_digit_ok(digits: str) -> bool:
    double = [sum(divmod(2 * int(c), 10)) for c in digits[-2::-2]]
    return (sum(double) + sum(int(c) for c in digits[-1::-2])) % 10 == 0


def valid(kind: str, text: str) -> bool:
    digits = "".join(c for c in text if c in "0123456789")
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in text.split(".")),
            "card": 16 <= len(digits) <= 19 and check_digit_ok(digits), "phone": 8 <= len(digits) <= 15}[kind]


def plain(text: str):
    return {k: [m.span() for m in re.finditer(p, text) if valid(k, m[0])] for k, p in PATTERNS.items()}


def same_base(text: str) -> None:
    found = P.find_spans(text)
    assert {k: found[k] for k in P.BASE_KINDS} == plain(text), text


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="aZ9@@.+-_% 0125()é\n", max_size=60))
def test_base_kinds_are_their_patterns(text):
    same_base(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["1", "25", "255", "256", ".", "..", " ", "-", "+", "4111111111111111", "4111 1111 1111 1111",
                                 "(", ")", "a@b.c", "@", "x", "+49 30 1234567", "0"]), max_size=14).map("".join))
def test_base_kinds_of_number_runs(text):
    same_base(text)


def test_added_kinds():
    text = ("See https://a.example/x?q=1. IBAN: DE89 3704 0044 0532 0130 00, account no. 12345678; SSN 123-45-6789 "
            "and 12 Long Hill Road, not ssn 000-12-3456, IBAN DE00 1234 5678 9012 3456 78, account of x")
    got = {k: [text[a:b] for a, b in v] for k, v in P.find_spans(text).items() if k in P.ADDED_KINDS}
    assert got == {"url": ["https://a.example/x?q=1"], "iban": ["DE89 3704 0044 0532 0130 00"], "account": ["12345678"],
                   "ssn": ["123-45-6789"], "street": ["12 Long Hill Road"], "secret": []}


def test_secrets():
    text = ('x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" y, API_KEY: sk-12ab34cd56, "password": "hunter2hunter", secrets is a1b2c3d4e5; '
            "a token of thanks, the secret is safe, token = abc1, password: correcthorse, untoken=zz11zz22zz")
    found = [text[a:b] for a, b in P.find_spans(text)["secret"]]
    assert found == ["04dbebab91ab85687d33eeaaf9ac699e1188f962", "sk-12ab34cd56", "hunter2hunter", "a1b2c3d4e5"]


def test_lower_case_keeps_positions():
    text = "İSTANBUL A@B.C ẞ"
    assert len(P.ascii_lower(text)) == len(text) and P.ascii_lower("AbÄ") == "abÄ"


def test_long_runs_are_linear():
    for text in ("1" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "a@" * 50_000, "+1" * 50_000, "1 " * 100_000):
        P.find_spans(text)


def test_query_columns(spark):
    r = random.Random(1)
    bits = ["a.b@c.example", "10.0.0.255", "4111-1111-1111-1111", "+1 (555) 010-9999", "256.1.1.1", "http://x.example/é",
            "😀", "é@é.é", "\n"]
    rows = [(100 + i, " ".join(r.choice(bits + prose(3, i).split()) for _ in range(30))) for i in range(60)]
    rows += [x[:2] for x in odd_rows()]
    got = table(filings(spark, rows).select("filing_id", P.personal_data("document").alias("p")).select("filing_id", "p.*"))
    assert len(got) == len(rows)
    by = {g[0]: g[1:] for g in got}
    for i, text in rows:
        base = plain(text or "")
        assert by[i][:4] == tuple(len(base[k]) for k in P.BASE_KINDS)
        spans = [f"{k}:{a}:{b}" for k in P.BASE_KINDS for a, b in base[k]]
        assert by[i][5] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(by[i][6].split(","))
    assert filings(spark, []).select(P.personal_data("document")).count() == 0
