from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

from marlstone.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, audit string, repeated long"


def legal(initials: str) -> bool:
    return re.fullmatch("(s?(ua)+)?", initials) is not None


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        t = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows):
    """Every edit of every row and up to two inserts in each gap; the cheapest, then the least audit."""
    found = faults(rows)
    per_row = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for f in found]
    gaps = [("", "u", "a", "ua", "au")] * (len(rows) + 1)
    best = None
    for edits in itertools.product(*per_row):
        for added in itertools.product(*gaps):
            out, audit, cost = [], "", 0
            for k in range(len(rows) + 1):
                for i in added[k]:
                    out.append(({"u": "user", "a": "assistant"}[i], ""))
                    audit, cost = audit + "I", cost + 2
                if k == len(rows):
                    break
                (_, role, text), e = rows[k], edits[k]
                audit += e[0]
                if e == "D":
                    cost += 3
                    continue
                cost += (e != "K") * 2 + (found[k] == "truncated")
                out.append((role if e == "K" else {"u": "user", "a": "assistant"}[e[1]], text))
            if legal("".join(r[:1] or "-" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, "\n".join(f"{r}:{t}" for r, t in out)
    return best


def expected(rows):
    """rows: turn, role, text of one conversation; nulls of the last two filled."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    found, turns = faults(rows), [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, text = brute(rows)
    return (gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)


def test_repair_against_all_edits(spark):
    r = random.Random(5)
    texts = ["Yes.", "No", " \t", "", "Why?  \n", "no end ", "Ja!"]
    roles = ["user", "assistant", "system", "tool", " "]
    rows = [(c, r.choice([None, 0, 1, 2, 5]), r.choice(roles), r.choice(texts)) for c in [*range(60), None] for _ in range(r.randint(1, 4))]
    got = {x[0]: tuple(x[1:]) for x in cr.repair(frame(spark, rows)).collect()}
    by = {}
    for c, *row in rows:
        by.setdefault(c, []).append(tuple(row))
    assert got == {c: expected(v) for c, v in by.items()}


def test_nulls_repeats_and_emptied_conversations(spark):
    rows = [(1, None, None, None), (1, None, "user", "Hi."), (1, None, "user", "Hi."), (2, 3, "user", None), (None, 4, None, "x.")]
    got = {x["conv_id"]: x for x in cr.repair(frame(spark, rows), frame(spark, [*rows, (9, 1, "user", "gone.")])).collect()}
    assert (got[1]["blank"], got[1]["duplicate"], got[1]["gaps"], got[1]["audit"]) == (1, 1, 0, "DKDI")
    assert got[2]["blank"] == 1 and got[2]["audit"] == "D" and got[2]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[9]["cost"] == 0 and got[9]["audit"] == "" and got[9]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[None]["audit"] == "D"
    none = spark.createDataFrame([], SCHEMA)
    assert cr.repair(cr.damage(none), none).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", f"A! b? {t}.") for c in range(40) for t in (None, 0, 1, 2)] + [(None, 1, None, None)]
    want = []
    for c, t, role, text in rows:
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", " " if text is None else text
        one = (c, t, "user" if f == 4 else role, "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text)
        want += [one] * {0: 0, 3: 2}.get(f, 1)
    assert sorted(map(str, map(tuple, cr.damage(frame(spark, rows)).collect()))) == sorted(map(str, want))


def whole_strings(rows):
    """The same search with strings that are never put aside."""
    s = cr.Search()
    s._fold = lambda: None
    for row in rows:
        s.row(*row)
    return s.finish()


def test_long_conversations_keep_short_tails():
    r = random.Random(7)
    mixed = [(t, r.choice(["user", "assistant", "system", "x"]), r.choice(["Yes.", "No", ""]), r.random() < 0.1) for t in range(3000)]
    kinds = [("user", "Same.", False), ("assistant", "", False), ("system", "No end", False), ("user", "No", False)]
    for rows in (mixed, *([(t, *k) for t in range(1000)] for k in kinds), [(t, *r.choice(kinds)) for t in range(1000)]):
        s, most = cr.Search(), 0
        for row in rows:
            s.row(*row)
            most = max(most, *(len(p.tail) for p in s.best if p))
        assert most <= 4 * cr.FOLD_EVERY and s.finish() == whole_strings(rows)
