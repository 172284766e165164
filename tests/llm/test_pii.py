from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import pii
from tests.llm.frames import documents, empty, frame

A = pii._automaton()
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    def fine(kind, s):
        digits = re.sub("[^0-9]", "", s)
        return {
            "email": lambda: True,
            "ip": lambda: all(int(p) <= 255 for p in s.split(".")),
            "card": lambda: 13 <= len(digits) <= 19 and sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0,
            "phone": lambda: 9 <= len(digits) <= 15,
        }[kind]()

    return {k: [m.span() for m in re.finditer(p, text) if fine(k, m.group())] for k, p in PATTERNS.items()}


@settings(max_examples=2000, deadline=None)
@given(st.text(alphabet="012459.@+- ()ab%_é\n", max_size=60))
def test_base_kinds_are_those_of_the_patterns(text):
    found = pii.find(text, A)
    assert {k: found[k] for k in pii.BASE} == brute(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4111-1111-1111-1112", "+44 20 7946 0958", "10.0.0.1", "256.1.1.1", "1.2.3.4.5.6.7.8", "a@b.co", "a@b", "@", "++1", " ", "-", ".", "é", "0000.1.2.3"]), max_size=8))
def test_base_kinds_side_by_side(parts):
    text = "".join(parts)
    assert {k: pii.find(text, A)[k] for k in pii.BASE} == brute(text)


def test_added_kinds():
    text = 'ssh://root:pw1@host/ IBAN: GB82 WEST 1234 5698 7654 32, account no: 12345678 token = "24be64439e3e49cf" password: hunter token of trust'
    found = {k: [text[a:b] for a, b in v] for k, v in pii.find(text, A).items()}
    assert found["login"] == ["root:pw1"] and found["account"] == ["GB82 WEST 1234 5698 7654 32", "12345678"] and found["secret"] == ["24be64439e3e49cf"]


def test_accounts_without_separators():
    account = lambda text: [text[a:b] for a, b in pii.find(text, A)["account"]]
    for text, value in (
        ("IBAN DE89 3704 0044 0532 0130 00 please", "DE89 3704 0044 0532 0130 00"),
        ("iban\nDE89370400440532013000.", "DE89370400440532013000"),
        ("IBAN number is GB82 WEST 1234 5698 7654 32,", "GB82 WEST 1234 5698 7654 32"),
        ("account no 12345678", "12345678"),
        ("account number id no is 12345678", "12345678"),
        ("account " + "no. " * 50 + "is 12345678", "12345678"),
        ("Account No. 12345678.", "12345678"),
        ("SSN 123-45-6789", "123-45-6789"),
        ("SSN 123 45 6789 or", "123 45 6789"),
        ("account: 1234 5678 9012", "1234 5678 9012"),
        ("passport P1234567", "P1234567"),
        ("social security number 123-45-6789", "123-45-6789"),
        ("account number of the holder: 123456", "123456"),
        ("account #12345678", "12345678"),
        ("acct. 12345678", "12345678"),
    ):
        assert account(text) == [value], text
    for text in ("IBAN DE89 3704 0044 0532 0130 01", "account no 1234", "the account was opened in 20240115", "accounting 20240115", "I closed the account. 20240115 was the day", "account user12345@example.com", "account holder and the time they met: 20240115", "account", "iban ", "account no"):
        assert account(text) == [], text


def test_query_rows(spark):
    rows = pii.detect(frame(spark)).collect()
    assert len(rows) == len(documents()) and all(r["spans"] == "" for r in rows)
    assert pii.detect(empty(spark)).collect() == []
    one = pii.detect(spark.createDataFrame([(1, "é a@b.co +44 20 7946 0958")], "doc_id long, text string")).first()
    assert one["spans"] == "email:2:8,phone:9:25" and one["n_email"] == one["n_phone"] == 1


SECRET = "24be64439e3e49cf"
FORMS = ("API key: {}", "apiKey={}", "accessKey={}", "API_key: {}", "api-key = {}", "ACCESS-KEY: {}", "Access Key {{}}: {}".replace("{{}}", "for prod"), "Token: {}", "TOKEN = {}", "PassWord: {}", "passwd={}", "client_secret: {}", "the password for the mail server: {}")


def test_each_spelling_of_a_cue():
    for form in FORMS:
        text = form.format(SECRET)
        assert [text[a:b] for a, b in pii.find(text, A)["secret"]] == [SECRET], text
    for cue in pii.ACCOUNT_CUES:
        for join in ("", " ", "_", "-"):
            for case in (str.lower, str.upper, str.title, str.swapcase):
                text = "é " + case(cue.replace(" ", join)) + ": 123456789"
                assert [text[a:b] for a, b in pii.find(text, A)["account"]] == ["123456789"], text
    for text, value in (("account number of the client: 12345678", "12345678"), ("Account no. of my customer: 12345678", "12345678"), ("Customer ID: 4711-0815", "4711-0815")):
        assert [text[a:b] for a, b in pii.find(text, A)["account"]] == [value], text
    for text in ("token and one two words: " + SECRET, "token\n: " + SECRET, "secret. Then: " + SECRET, "token " + "x" * 50 + ": " + SECRET):
        assert pii.find(text, A)["secret"] == [], text


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["token", "API key", "account", "iban", "İ", "ß", "ſ", " ", ":", "=", "a1b2c3d4", "12345678", "no.", "of", "\n", "."]), max_size=12).map("".join))
def test_offsets_are_of_the_text_itself(text):
    found = pii.find(text, A)
    for kind, spans in found.items():
        assert all(0 <= a < b <= len(text) for a, b in spans) and spans == sorted(spans), kind
    for a, b in found["secret"]:
        assert len(text[a:b]) >= 8 and any(c.isdigit() for c in text[a:b])


def test_many_cues_in_a_row_take_linear_time():
    import time

    began = time.perf_counter()
    for part in ("token", "token ", "account number ", "x@", "+1 "):
        pii.find(part * 200_000, A)
    assert time.perf_counter() - began < 30
