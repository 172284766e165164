"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus signs, digits, schemes and
identifier cues.  A deterministic parser expands each anchor to both sides and
validates what it finds.  Offsets count code points, ends are exclusive.

Kinds, in the order of results:

* ``email``, ``ip``, ``card``, ``phone``: leftmost matches of the contract's
  patterns, none overlapping another of its kind; what fails validation is
  dropped and not tried again from a later start.
* ``login``: the user part of a URL's authority, as in ``ssh://name:word@host``.
* ``account``: the value after a cue such as ``iban`` or ``account no``, with a
  separator or right after the cue and any number of words such as ``number is``; IBANs must
  pass their check digits, other values need five digits.
* ``secret``: the value after a cue such as ``token =`` or ``api_key:``, of eight
  characters or more with a digit and a letter.

Cues are found in any case, their words joined, or apart by a space, hyphen or low
line.  Between a cue and its separator (``:``, ``=`` or ``#``) on the line may stand any
number of the words of ``LINK_WORDS`` and ``BETWEEN``, and two others, each of 40
letters at most; a full stop only after a word for number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .cluster import small_batches, tidy

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "account", "secret")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"

DIGITS = frozenset("0123456789")
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
LABEL = LETTERS | DIGITS | {"-"}
LOCAL = LABEL | set("._%+")
PHONE = DIGITS | set(" ().-")
VALUE = LETTERS | DIGITS | set("_-./+")
ACCOUNT_CUES = ("iban", "account", "acct", "ssn", "passport", "social security", "customer id")
BETWEEN = frozenset(("of", "the", "for", "a", "an", "my", "your", "our", "his", "her", "its", "their", "this", "holder", "client", "customer", "user", "owner", "value", "key"))
OTHER_WORDS, WORD_LETTERS = 2, 40
#: Words that may stand between an account cue and a value without a separator; the first kind may end with a full stop.
NUMBER_WORDS = frozenset(("no", "nr", "nbr", "num", "number", "id", "code"))
LINK_WORDS = NUMBER_WORDS | {"is"}
SECRET_CUES = ("token", "password", "passwd", "secret", "api key", "access key")
#: ASCII capitals made small, one character for one.
FOLD = {k: k + 32 for k in range(65, 91)}


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for d in DIGITS:
        a.add_word(d, "digit")
    for text, tag in (("@", "at"), ("+", "plus"), ("://", "scheme")):
        a.add_word(text, tag)
    for tag, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for join in ("", " ", "_", "-"):
                a.add_word(cue.replace(" ", join), tag)
    a.make_automaton()
    return a


def _email(t: str, at: int, since: int) -> tuple[int, int] | None:
    start = at
    while start > since and t[start - 1] in LOCAL:
        start -= 1
    if start == at:
        return None
    n, i, end = len(t), at + 1, 0
    while i < n and t[i] in LABEL:
        i += 1
    if i == at + 1:
        return None
    while i + 1 < n and t[i] == "." and t[i + 1] in LABEL:
        i += 2
        while i < n and t[i] in LABEL:
            i += 1
        end = i
    return (start, end) if end else None


def _dotted(t: str, i: int) -> tuple[list[tuple[int, int]], int]:
    """Runs of digits with single dots between, from the digit at i; where they end."""
    n, runs = len(t), []
    while True:
        j = i
        while j < n and t[j] in DIGITS:
            j += 1
        runs.append((i, j))
        if j + 1 < n and t[j] == "." and t[j + 1] in DIGITS:
            i = j + 1
        else:
            return runs, j


def _grouped(t: str, i: int) -> int:
    """Where the digits, with single spaces or hyphens between, from the digit at i end."""
    n = len(t)
    while True:
        while i < n and t[i] in DIGITS:
            i += 1
        if i + 1 < n and t[i] in " -" and t[i + 1] in DIGITS:
            i += 1
        else:
            return i


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _phone(t: str, plus: int) -> int:
    """End of the number that starts at the plus sign, or 0."""
    n = len(t)
    if plus + 1 >= n or t[plus + 1] not in DIGITS:
        return 0
    i = plus + 2
    while i < n and t[i] in PHONE:
        i += 1
    while i > plus + 3 and t[i - 1] not in DIGITS:
        i -= 1
    return i if i > plus + 3 else 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if c in DIGITS)


def _value(t: str, i: int) -> tuple[int, int] | None:
    """The run of value characters from i on, without dots, slashes and hyphens at its end."""
    n, start = len(t), i
    while i < n and t[i] in VALUE:
        i += 1
    while i > start and t[i - 1] in "./-":
        i -= 1
    return (start, i) if i > start else None


def _cued(t: str, i: int) -> tuple[int, int] | None:
    """The value after a cue that ends at i: few words, then ``:``, ``=`` or ``#``, then a run."""
    n, others, stop_may_come = len(t), 0, t[max(0, i - 4) : i].lower() == "acct"
    while True:
        while i < n and (t[i] in " '\"" or (stop_may_come and t[i] == ".")):
            i += 1
        if i >= n:
            return None
        if t[i] in ":=#":
            break
        j = i
        while j < n and j <= i + WORD_LETTERS and t[j] in LETTERS:
            j += 1
        word = t[i:j].lower()
        others += word not in LINK_WORDS and word not in BETWEEN
        if j == i or j > i + WORD_LETTERS or others > OTHER_WORDS:
            return None
        i, stop_may_come = j, word in NUMBER_WORDS
    i += 1
    while i < n and t[i] in " \"'":
        i += 1
    return _value(t, i)


def _number(t: str, start: int) -> int:
    """End of the IBAN or the value of five digits or more that starts here, or 0; digits may be grouped if the first group is too short."""
    if end := _iban(t, start):
        return end
    span = _value(t, start)
    if span and len(_only_digits(t[start : span[1]])) < 5 and t[start] in DIGITS:
        span = (start, _grouped(t, start))
    return span[1] if span and len(_only_digits(t[start : span[1]])) >= 5 else 0


def _account(t: str, cue_end: int) -> tuple[int, int] | None:
    """The account after a cue that ends at cue_end: after a separator, or right after the cue and its link words."""
    n, i, word = len(t), cue_end, ""
    while True:
        short = word or t[max(0, cue_end - 4) : cue_end].lower() == "acct"  # a dot after it ends no sentence
        while i < n and (t[i] in " \t\n'\"()-" or (short and t[i] == ".")):
            i += 1
        j = i
        while j < n and j < i + 8 and t[j] in LETTERS:
            j += 1
        if i == cue_end or t[i:j].lower() not in LINK_WORDS or (j < n and t[j] in DIGITS):
            break
        word, i = t[i:j], j
    if span := _cued(t, cue_end):
        end = _number(t, span[0])
        return (span[0], end) if end else None
    # Glued to the cue, only check digits tell a value from the rest of a word.
    end = _number(t, i) if i > cue_end else _iban(t, i)
    return (i, end) if end and t[end : end + 1] != "@" else None


def _iban(t: str, start: int) -> int:
    """End of a valid IBAN that starts here, its groups of four split by spaces or not, or 0."""
    i, n, chars = start, len(t), []
    ends = 0
    while i < n and len(chars) < 34:
        if t[i] in LETTERS or t[i] in DIGITS:
            chars.append(t[i].upper())
            i += 1
        elif t[i] == " " and chars and len(chars) % 4 == 0:
            i += 1
            continue
        else:
            break
        if len(chars) >= 15 and chars[0].isalpha() and chars[1].isalpha() and chars[2] in DIGITS and chars[3] in DIGITS and int("".join(str(int(c, 36)) for c in chars[4:] + chars[:4])) % 97 == 1:
            ends = i
    return ends


def _login(t: str, after: int) -> tuple[int, int] | None:
    n, i = len(t), after
    while i < n and t[i] not in "@/?#<>\"' \t\n\r":
        i += 1
    return (after, i) if after < i < n and t[i] == "@" else None


def find(text: str, automaton: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind in the whole text, by start."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    folded = text.lower()
    if len(folded) != len(text):  # a few letters become two
        folded = text.translate(FOLD)
    past = {"email": 0, "dots": 0, "card": 0, "phone": 0, "value": 0}
    for last, tag in automaton.iter(folded):
        if tag == "digit":
            if last >= past["dots"]:
                runs, past["dots"] = _dotted(text, last)
                for k in range(0, len(runs) - 3, 4):
                    if all(len(p := text[a:b].lstrip("0")) <= 3 and int(p or 0) <= 255 for a, b in runs[k : k + 4]):
                        out["ip"].append((runs[k][0], runs[k + 3][1]))
            if last >= past["card"]:
                past["card"] = end = _grouped(text, last)
                if end - last >= 13 and 13 <= len(digits := _only_digits(text[last:end])) <= 19 and luhn(digits):
                    out["card"].append((last, end))
        elif tag == "at":
            if last >= past["email"] and (span := _email(text, last, past["email"])):
                past["email"] = span[1]
                out["email"].append(span)
        elif tag == "plus":
            if last >= past["phone"] and (end := _phone(text, last)):
                past["phone"] = end
                if 9 <= len(_only_digits(text[last:end])) <= 15:
                    out["phone"].append((last, end))
        elif tag == "scheme":
            if span := _login(text, last + 1):
                out["login"].append(span)
        elif last >= past["value"] and (span := (_account if tag == "account" else _cued)(text, last + 1)):
            value = text[span[0] : span[1]]
            if tag == "secret" and (len(value) < 8 or not (set(value) & DIGITS and set(value) & LETTERS)):
                continue
            past["value"] = span[1]
            out[tag].append(span)
    return out


def detect(docs: DataFrame) -> DataFrame:
    """Personal data of every document: ``SCHEMA``.

    Reads ``doc_id`` and ``text``; other columns are ignored.  A null text is
    empty, a null id stays null, repeated rows give repeated results.  ``spans``
    lists ``kind:start:end``, ``base_sha256`` hashes the list of the base kinds.
    Each text is searched whole, by itself; there is no shuffle.
    """

    small_batches(docs.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            counts, hashes, spans = [], [], []
            for text in batch.column(1).to_pylist():
                found = find(text, automaton) if text else {}
                listed = {k: [f"{k}:{a}:{b}" for a, b in found.get(k, ())] for k in KINDS}
                base = [x for k in BASE for x in listed[k]]
                counts.append([len(listed[k]) for k in BASE] + [sum(map(len, listed.values()))])
                hashes.append(hashlib.sha256(",".join(base).encode()).hexdigest())
                spans.append(",".join(x for k in KINDS for x in listed[k]))
            n = [pa.array([c[i] for c in counts], pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *n[:4], pa.array(hashes, pa.string()), pa.array(spans, pa.string()), n[4]], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    from pyspark.sql import functions as F

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
