from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict

import pytest

from marlstone.llm import mixing
from tests.llm.frames import documents, empty, frame, words


def expected(rows, target, budget=None):
    name = lambda s: mixing.NULL if s is None else s
    docs = [(r[0], name(r[3]), len(words(r[1]))) for r in rows]
    tokens = defaultdict(int)
    for _, s, n in docs:
        tokens[s] += n
    total = sum(tokens.values())
    budget = total if budget is None else budget
    p = {s: n / total for s, n in tokens.items() if n}
    weights = lambda a: {s: x**a / sum(y**a for y in p.values()) for s, x in p.items()}
    entropy = lambda a: -sum(w * math.log(w) for w in weights(a).values())

    def bisect(holds, rising):
        lo, hi = 0.0, 1.0
        if holds(lo if rising else hi):
            return lo if rising else hi
        if not holds(hi if rising else lo):
            return hi if rising else lo
        for _ in range(80):
            m = (lo + hi) / 2
            if holds(m) == rising:
                hi = m
            else:
                lo = m
        return (lo + hi) / 2

    a = 1.0
    if target.evenness is not None:
        a = bisect(lambda x: entropy(x) >= target.evenness * math.log(len(p)) - 1e-12, False)
    if target.repeats is not None:
        a = max(a, bisect(lambda x: max(w * budget / (p[s] * total) for s, w in weights(x).items()) <= target.repeats * (1 + 1e-12), True))
    w = weights(round(a, 6))
    out = Counter()
    for s in set(x[1] for x in docs):
        own = sorted((hashlib.md5(f"0:{s}:{'null' if i is None else i}".encode()).hexdigest(), str(i), n) for i, x, n in docs if x == s)
        want = math.floor(w.get(s, 0) * budget + 1e-6)
        whole, rest = divmod(want, tokens[s]) if tokens[s] else (0, 0)
        for h, i, n in own:
            upto = sum(m for g, _, m in own if g <= h)
            out[(i, n, whole + (bool(tokens[s]) and upto <= rest))] += 1
    return out


@pytest.mark.parametrize("target,budget", [(mixing.Target(0.97, 4.0), None), (mixing.Target(evenness=0.9999), None), (mixing.Target(repeats=1.2), None), (mixing.Target(1.0, 1.05), 3000), (mixing.Target(), 20_000), (mixing.Target(0.99), 0)])
def test_against_bisection(spark, target, budget):
    got = mixing.mix(frame(spark), target, budget, block_rows=2)
    assert Counter((str(r["doc_id"]), r["n_tokens"], r["copies"]) for r in got.collect()) == expected(documents(), target, budget)


def test_blocks_do_not_matter(spark):
    rows = [(i, "w " * (i % 7), None, "ab"[i % 10 == 0], 0, "", 0, "", 0) for i in range(400)]
    results = [sorted(map(str, mixing.mix(frame(spark, rows), mixing.Target(0.9), 700, block_rows=n).select("doc_id", "copies").collect())) for n in (1, 3, 4096)]
    assert results[0] == results[1] == results[2]


def test_budgets_hold(spark):
    got = mixing.mix(frame(spark), mixing.Target(), 10_000).collect()
    assert sum(r["n_tokens"] * r["copies"] for r in got) <= 10_000


def test_realise_repeats_rows(spark):
    mixed = mixing.mix(frame(spark), mixing.Target(), 20_000)
    assert mixing.realise(mixed).count() == mixed.agg({"copies": "sum"}).first()[0]
    assert mixing.realise(mixed).columns == frame(spark).columns


def test_empty(spark):
    assert mixing.mix(empty(spark), mixing.Target(0.9)).collect() == []
    blank = mixing.mix(frame(spark, [(1, None, None, None, 0, "", 0, "", 0)]), mixing.Target(0.9)).first()
    assert blank["copies"] == 0
