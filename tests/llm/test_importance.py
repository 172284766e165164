from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa

from marlstone.llm import importance
from tests.llm.frames import documents, empty, frame, prose


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features(text):
    w = words(text)
    return [" ".join(w[i : i + k]).encode() for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def totals(texts):
    out = [0] * 10_000
    for t in texts:
        for f in features(t):
            out[zlib.crc32(f) % 10_000] += 1
    return out


def expected(rows, target):
    s, t = totals(x for _, x in rows), totals(target)
    gain = [math.floor(1000 * math.log((float(b) + 1) * (sum(s) + 10_000.0) / ((a + 1.0) * (sum(t) + 10_000.0)))) for a, b in zip(s, t, strict=True)]
    out = []
    for i, text in rows:
        weight = sum(gain[zlib.crc32(f) % 10_000] for f in features(text))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(features(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text)) >= 20])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], -r[1]))
    for k, r in enumerate(able[: 50 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_against_brute_force(spark):
    target = [prose(1, 90), None, "", prose(4, 500), "A-b c"]
    got = importance.resample(frame(spark), spark.createDataFrame([(t,) for t in target], "text string"), percent=50)
    assert got.dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
    assert sorted(map(tuple, got.collect()), key=str) == expected([(r[0], r[1]) for r in documents()], target)


def test_empty_tables(spark):
    assert importance.resample(empty(spark), frame(spark)).count() == 0
    rows = importance.resample(frame(spark), empty(spark), percent=100).collect()
    assert len(rows) == len(documents()) and sum(r["rank"] is not None for r in rows) == sum(len(words(r[1])) >= 20 for r in documents())


def test_pieces_of_a_long_text_count_as_the_whole():
    text = " ".join(["Straße, x1", prose(8, 900), "-" * 300, "日本 y", prose(9, 50)])
    column = pa.array([text, "a b", None, text[:500]])
    for most in (64, 1000, 1 << 20):
        assert sum(trie.totals() for _, _, trie, _, _ in importance.blocks(column, most)).tolist() == totals(column.to_pylist())


def test_crc_is_carried_over_any_length():
    heads, tails = [b"", b"abc", b"\xff" * 70], [b" ", b" x" * 40, b" " + b"\x00" * 3000]
    pairs = [(a, b) for a in heads for b in tails]
    got = importance.extended(*(np.array(x) for x in ([zlib.crc32(a) for a, _ in pairs], [zlib.crc32(b) for _, b in pairs], [len(b) for _, b in pairs])))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]
