from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from marlstone.llm import substring_dedup
from tests.llm.frames import documents, empty, frame, prose, words


def tie(text):
    """The hash by which texts of one id are ordered."""
    return 42 if text is None else np.uint64(xxhash.xxh64_intdigest(text.encode(), seed=42)).astype(np.int64)


def expected(rows, width=20):
    order = sorted(range(len(rows)), key=lambda d: (rows[d][0] is None, rows[d][0] or 0, tie(rows[d][1])))
    seen, out = set(), Counter()
    for d in order:
        w = words(rows[d][1])
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if key in seen:
                gone[k : k + width] = [True] * width
            seen.add(key)
        out[(rows[d][0], len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))] += 1
    return out


def made_rows():
    r = random.Random(2)
    shared = [prose(80 + k, 60) for k in range(3)]
    rows = documents()
    for i in range(60):
        parts = [prose(200 + i, r.randint(0, 30)), *r.sample(shared, r.randint(0, 3)), prose(300 + i, r.randint(0, 30))]
        w = " ".join(parts).split()
        cut = r.randint(0, 25)
        rows.append((1000 + i, " ".join(w[cut:]), None, None, 0, "", 0, "", 0))
    rows.append((5000, "a b " * 60, None, None, 0, "", 0, "", 0))
    return rows


@pytest.mark.parametrize("part_mb", [6, 0.0005])
def test_against_brute_force(spark, part_mb):
    rows = made_rows()
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.dedup(frame(spark, rows), part_mb=part_mb).collect())
    assert got == expected(rows)


@pytest.mark.parametrize("settings", [{"FAN_BITS": 1, "PARTS_A_BUCKET": 1}, {"FAN_BITS": 2, "PARTS_A_BUCKET": 1}, {"FAN_BITS": 1, "PARTS_A_BUCKET": 3, "RESULT_BYTES": 50}])
def test_levels_of_the_exchange(spark, monkeypatch, settings):
    for k, v in settings.items():
        monkeypatch.setattr(substring_dedup, k, v)
    rows = made_rows()
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.dedup(frame(spark, rows), part_mb=0.0015).collect())
    assert got == expected(rows)


def test_texts_of_one_id_are_dealt_by_text_and_ordered_by_hash(spark):
    rows = made_rows()
    rows += [(i, f"{prose(400 + k, 10)} {prose(80, 60)} {prose(500 + k, 5)}", None, None, 0, "", 0, "", 0) for i in (None, 77) for k in range(20)]
    dealt, _ = substring_dedup._dealt(frame(spark, rows), 0.001)
    assert dealt.where("doc_id = 77").select("part").distinct().count() > 5 and dealt.where("doc_id IS NULL").select("part").distinct().count() > 5
    for part_mb in (6, 0.001):  # however many parts there are, the same copies go
        got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.dedup(frame(spark, rows), part_mb=part_mb).collect())
        assert got == expected(rows)


def test_messages_grow_with_the_input(spark, monkeypatch):
    """Three sizes: the number of messages of all levels grows as the number of parts does, not as its square."""
    monkeypatch.setattr(substring_dedup, "FAN_BITS", 2)
    monkeypatch.setattr(substring_dedup, "PARTS_A_BUCKET", 1)
    counts = []
    for parts in (16, 64, 256):
        bits = (parts - 1).bit_length()
        level, senders, total = substring_dedup.Level(bits, 0, min(bits, 2)), parts, 0
        while True:
            total += senders << (level.upto - level.since)  # each sender, each of its receivers
            if level.upto == bits:
                break
            senders = substring_dedup.nodes(parts, level) << level.upto
            level = substring_dedup.Level(bits, level.upto, min(bits, level.upto + 2))
        counts.append(total / parts)
    assert counts[2] <= counts[0] * 2.5
    sent = []
    original = substring_dedup.exchange
    monkeypatch.setattr(substring_dedup, "exchange", lambda rows, kind, parts, level: sent.append((rows.groupBy("part").count().agg({"count": "max"}).first()[0], level.upto)) or original(rows, kind, parts, level))
    assert substring_dedup.dedup(frame(spark, made_rows()), part_mb=0.0015).count() == len(made_rows())
    assert len(sent) > 4 and all(most <= 4 for most, _ in sent)


def test_words_of_equal_letter_sums_are_told_apart(spark):
    from tests.llm.test_wordtable import TWINS

    rows = [(k, f"{prose(1, 15)} {word} {prose(2, 15)}", None, None, 0, "", 0, "", 0) for k, word in enumerate([*TWINS[0], TWINS[0][1]])]
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.dedup(frame(spark, rows)).collect())
    assert got == expected(rows) and sorted(r[2] for r in got) == [0, 0, 31]


def test_other_width(spark):
    rows = made_rows()
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.dedup(frame(spark, rows), width=8, part_mb=0.001).collect())
    assert got == expected(rows, 8)


def test_ranges_are_maximal(spark):
    text = prose(1, 100)
    rows = [(1, text, None, None, 0, "", 0, "", 0), (2, "x y " + " ".join(text.split()[10:50]) + " z", None, None, 0, "", 0, "", 0)]
    two = next(r for r in substring_dedup.dedup(frame(spark, rows)).collect() if r["doc_id"] == 2)
    assert [(x["start"], x["end"]) for x in two["repeats"]] == [(2, 42)] and two["kept"] == "x y z"


def test_empty(spark):
    assert substring_dedup.dedup(empty(spark)).collect() == []
