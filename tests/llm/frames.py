"""Small documents with the awkward cases, shared by the tests."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 string, bucket long, place string, label long"
SPACES = " \t\n\x0b\x0c\r"


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 7))) for _ in range(words))


def documents() -> list[tuple]:
    """Nulls, empty and blank texts, copies, near copies, repeated rows, ties of ids, a long text, clashing columns."""
    base = prose(1, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    texts = [
        (0, base), (1, base), (2, near), (3, None), (4, ""), (5, " \n\t "), (6, "one two"), (7, "one two"), (8, "one  two"), (9, prose(2, 200)),
        (10, base + "\n" + prose(3, 40) + "\n" + base), (11, base.upper()), (12, "naïve ﬁancé ÀÉ 日本語 🎉"), (13, prose(4, 6000)), (14, " ".join(words[20:70])),
        (15, "\n".join([prose(5, 12), "", prose(5, 12), prose(6, 5)])), (16, prose(5, 12)), (9, prose(2, 200)), (9, prose(7, 30)), (None, base), (None, None), (-3, near + " tail"),
        (18, "x" * 5000), (19, "...   !!! 123"),
    ]
    return [(i, t, "en" if k % 2 else None, f"s{k % 3}" if k % 4 else None, None if t is None else len(t), "h", k, "p", k) for k, (i, t) in enumerate(texts)]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text: str | None) -> list[str]:
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
