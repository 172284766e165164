from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.llm import context_mixing as cm
from marlstone.llm import lookup
from tests.llm.frames import documents, empty, frame, prose, words


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def base(rows):
    """n_tokens, n_known, N and the base score of every row."""
    split = [[w.encode().translate(bytes(cm.LOWER)) for w in words(t)] + [None] for _, t in rows]
    counts = Counter(w for (i, _), ws in zip(rows, split, strict=True) if not held_out(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [(len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for ws in split]


def contexts(rows):
    """Counts of (context of an order, byte) in training texts."""
    out = Counter()
    for i, text in rows:
        if not held_out(i):
            framed = b"\xff" * 5 + (text or "").encode() + b"\xff"
            for p in range(5, len(framed)):
                for order in cm.ORDERS:
                    out[framed[p - order : p], framed[p]] += 1
    return out


def chance(counts, mixer, framed, p):
    """log10 of the chance of one byte, bit by bit from the counts."""
    total, byte = 0.0, framed[p]
    for j in range(8):
        seen = []
        for order in cm.ORDERS:
            own = [0, 0]
            for b in range(256):
                if b >> (8 - j) == byte >> (8 - j):
                    own[b >> (7 - j) & 1] += counts.get((framed[p - order : p], b), 0)
            seen.append(own)
        n3, n4, n5 = (sum(s) for s in seen[2:])
        gate = next((g for g, hit in enumerate([n5 >= 10, n5 >= 3, n5 >= 1, n4 >= 3, n4 >= 1, n3 >= 10, n3 >= 3, n3 >= 1]) if hit), 8)
        x = [math.log((one + cm.DELTA) / (zero + cm.DELTA)) for zero, one in seen] + [0.3]
        mixed = max(-cm.LIMIT, min(cm.LIMIT, sum(a * w for a, w in zip(x, mixer.weights[gate * 8 + j], strict=True))))
        at = (mixed + cm.LIMIT) / (2 * cm.LIMIT) * (cm.BINS - 1)
        low = min(int(at), cm.BINS - 2)
        p_one = 0.5 / (1 + math.exp(-mixed)) + 0.5 * ((low + 1 - at) * mixer.refined[gate][low] + (at - low) * mixer.refined[gate][low + 1])
        total += math.log10(p_one if byte >> (7 - j) & 1 else 1 - p_one)
    return total


@pytest.fixture
def fitted(monkeypatch):
    kept, fit = [], cm.fit
    monkeypatch.setattr(cm, "fit", lambda *a: kept.append(fit(*a)) or kept[-1])
    return kept


@pytest.mark.parametrize(("part_mb", "fan"), [(cm.PART_MB, lookup.FAN_BITS), (0.002, 1)])
def test_against_brute_force(spark, fitted, monkeypatch, part_mb, fan):
    monkeypatch.setattr(lookup, "FAN_BITS", fan)
    rows = [(r[0], None if r[1] is None else r[1][:900]) for r in documents()]
    docs = frame(spark).withColumn("text", F.substring("text", 1, 900))
    got = cm.score(docs, part_mb).collect()
    counts, mixer = contexts(rows), fitted[0][1]
    want, memo = [], {}
    for (i, text), b in zip(rows, base(rows), strict=True):
        framed = b"\xff" * 5 + (text or "").encode() + b"\xff"
        if framed not in memo:
            memo[framed] = sum(chance(counts, mixer, framed, p) for p in range(5, len(framed)))
        want.append((i, held_out(i), *b[:3], round(b[3], 6), round(memo[framed], 2)))
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 2)) for r in got), key=str) == sorted(want, key=str)


def test_chances_of_all_bytes_add_up_to_one():
    text = pa.array([prose(3, 400), "aé日本" * 20])
    part = cm.Part(pa.table({"doc_id": [1, 2], "text": text, "held_out": [False, False]}))
    codes, counts, pairs = part.runs()
    weights, _, _, _ = cm.learn(codes >> np.uint64(16), counts, pairs.reshape(256, 256))
    mixer = cm.Mixer(pairs.reshape(256, 256), weights, np.broadcast_to(cm._squash(np.linspace(-8, 8, cm.BINS)), (cm.GATES, cm.BINS)))
    for code in (codes[0], codes[len(codes) // 2]):
        every = (code >> np.uint64(24) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        known = dict(zip((codes >> np.uint64(16)).tolist(), counts.tolist(), strict=True))
        both = np.unique(np.concatenate((every, codes >> np.uint64(16))))
        p = 10 ** mixer.log10(both, np.array([known.get(c, 0) for c in both.tolist()]))
        assert abs(p[np.isin(both, every)].sum() - 1) < 1e-9


def test_learning_helps_on_held_out_texts(spark):
    vocabulary = [prose(k, 1) for k in range(300)]
    r = np.random.default_rng(1)
    docs = [(i, " ".join(r.choice(vocabulary, 200))) for i in range(200)] + [(1000, "".join(map(chr, r.integers(0x4E00, 0x9000, 500))))]
    got = {x["doc_id"]: x for x in cm.score(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    held = [x for x in got.values() if x["held_out"] and x["doc_id"] < 1000]
    assert held and max(x["bits_per_byte"] for x in held) < 2.6 < got[1000]["bits_per_byte"]


def test_empty_table(spark):
    assert cm.score(empty(spark)).count() == 0


def test_pieces_of_long_texts(monkeypatch):
    text = pa.array([prose(2, 3000), None, "", "é" * 700, "ab"])
    part = cm.Part(pa.table({"doc_id": range(5), "text": text, "held_out": [False, False, True, False, False]}))
    whole = part.runs()
    monkeypatch.setattr(cm, "BLOCK_BYTES", 97)
    assert all((a == b).all() for a, b in zip(whole, part.runs(), strict=True))
    assert (cm.gathered_back(cm.spread(np.arange(1 << 24, dtype=np.uint32))) == np.arange(1 << 24)).all()
