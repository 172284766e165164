from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from marlstone.llm import line_dedup
from tests.llm.frames import documents, empty, frame, words


def expected(rows, t=0.8):
    last = 1 << 63
    lines = [((last if r[0] is None else r[0]), k, frozenset(words(line)), d) for d, r in enumerate(rows) if r[1] is not None for k, line in enumerate(r[1].split("\n"))]
    gone = [set() for _ in rows]
    for i, k, s, d in lines:
        if s and any((j, m) < (i, k) and len(s & o) * (1 + t) >= t * (len(s) + len(o)) - 1e-9 for j, m, o, _ in lines if o):
            gone[d].add(k)
    out = Counter()
    for d, r in enumerate(rows):
        parts = [] if r[1] is None else r[1].split("\n")
        kept = None if r[1] is None else "\n".join(p for k, p in enumerate(parts) if k not in gone[d])
        out[(r[0], kept, len(parts), len(gone[d]))] += 1
    return out


def made_rows():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        lines = [" ".join(r.choices(vocabulary, k=r.choice([1, 2, 4, 5, 9, 10, 30]))) for _ in range(4)]
        if rows:
            copied = r.choice(rows)[1].split("\n")
            lines += [" ".join([*r.choice(copied).split(), *r.choices(vocabulary, k=r.choice([0, 0, 1, 2]))])]
        rows.append((i, "\n".join(lines), None, None, 0, "", 0, "", 0))
    long = [f"u{i}" for i in range(300)]
    rows += [(100 + i, " ".join([*long[i * 9 :], *(f"v{i}x{j}" for j in range(3 * i))]), None, None, 0, "", 0, "", 0) for i in range(8)]
    return rows


@pytest.mark.parametrize("settings", [{}, {"SURE": 2.0, "NEAREST": 0}, {"SURE": -1.0, "NEAREST": 1, "SLOT_BITS": 15}, {"SURE": 2.0, "NEAREST": 0, "ENOUGH": 1, "INDEX_ROWS": 5}, {"RANK_BITS": 4, "SKETCH_CHUNKS": 2}, {"BROADCAST_BYTES": -1, "BUCKET_WORDS": 40}, {"HOT_SHARE": 1, "HOT_ENTRIES": 4, "BLOCK_ENTRIES": 3}, {"HOT_SHARE": 1, "HOT_ENTRIES": 0, "BLOCK_ENTRIES": 1, "ENOUGH": 2}, {"FAN_BITS": 1, "BUCKET_WORDS": 200, "HOT_SHARE": 1, "HOT_ENTRIES": 20, "BLOCK_ENTRIES": 9, "INDEX_ROWS": 30}, {"FAN_BITS": 3, "BUCKET_WORDS": 40}])
def test_against_all_pairs(spark, monkeypatch, settings):
    for k, v in settings.items():
        monkeypatch.setattr(line_dedup, k, v)
    rows = documents() + [r for r in made_rows()]
    got = Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.dedup(frame(spark, rows)).collect())
    assert got == expected(rows)


@pytest.mark.parametrize("t", [0.6, 0.95])
def test_other_thresholds(spark, t):
    rows = made_rows()
    got = Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.dedup(frame(spark, rows), t).collect())
    assert got == expected(rows, t)


def test_empty(spark):
    out = line_dedup.dedup(empty(spark))
    assert out.collect() == [] and set(empty(spark).columns) < set(out.columns)


def test_sizes_beyond_16_bits():
    sizes, hashes = [70_000, 100_000, 70_010, 9, 65_535], [1 << 16, 2 << 16, 3 << 16, 4 << 16, 5 << 16]
    n = len(sizes)
    columns = [np.array(x, d) for x, d in zip(([7] * n, [0] * n, sizes, [0] * n, hashes, range(n), [0] * n, [0] * n, [0] * n, [0] * n), line_dedup.ENTRY, strict=True)]
    table = pa.Table.from_batches(line_dedup._pack_entries([[np.zeros(n, np.int64), *columns]]))
    assert line_dedup._sorted_entries(table)[0][2].tolist() == sorted(sizes)
    out = line_dedup._propose(table, 0.8)
    assert (2, 0) in {(b["doc"], a["doc"]) for b, a in zip(out["b"].to_pylist(), out["a"].to_pylist(), strict=True)}


def test_lines_of_equal_hash_sums_are_told_apart(spark):
    from tests.llm.test_wordtable import TWINS

    rows = [(1, TWINS[0][0], None, None, 0, "", 0, "", 0), (2, TWINS[0][1] + "\nq r s", None, None, 0, "", 0, "", 0), (3, TWINS[0][0], None, None, 0, "", 0, "", 0)]
    got = Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.dedup(frame(spark, rows)).collect())
    assert got == expected(rows)


def test_short_lines_that_share_a_32_bit_hash():
    """Of copies by size, word, parity and the 32 bits, those whose second hash differs are no copies."""
    n = 3
    columns = [np.array(x, d) for x, d in zip(([7] * n, [0] * n, [1] * n, [5] * n, [9] * n, range(n), [0] * n, [1, 2, 1], [0] * n, [0] * n), line_dedup.ENTRY, strict=True)]
    out = line_dedup._propose(pa.Table.from_batches(line_dedup._pack_entries([[np.zeros(n, np.int64), *columns]])), 0.8)
    assert [(b["doc"], a["doc"]) for b, a, e in zip(out["b"].to_pylist(), out["a"].to_pylist(), out["equal"].to_pylist(), strict=True) if e] == [(2, 0)]


@pytest.mark.parametrize("common", [7, 8, 20])
def test_template_lines_cost_no_square(common):
    """One line a document that differs in one word: under a template word, 30,000 entries are settled in seconds."""
    import time

    shared = [f"t{k}" for k in range(common)]
    text = pa.array([" ".join([*shared, f"x{i}"]) for i in range(30_000)])
    rank = np.arange(1 << line_dedup.RANK_BITS, dtype=np.uint64)[::-1].copy()
    for _, _, t in line_dedup.chunks(pa.array([" ".join(shared)])):  # the template's words are the most frequent ones
        at = (t.word_hashes() & np.uint64((1 << line_dedup.RANK_BITS) - 1)).astype(np.int64)
        rank[at] = np.arange(len(rank) - len(at), len(rank), dtype=np.uint64)
    parts = [line_dedup._entries(np.arange(a, b), line_dedup.Lines(t, rank), 0.8, 0)[:-2] for a, b, t, _ in line_dedup.tables(text)]
    table = pa.Table.from_batches(line_dedup._pack_entries(parts))
    began = time.perf_counter()
    out = line_dedup._propose(table, 0.8)
    assert time.perf_counter() - began < 20
    late = {b["doc"] for b in out["b"].to_pylist()}
    assert len(late) == (29_999 if common >= 8 else 0)


def test_pieces_of_long_texts_have_the_lines_of_the_whole(monkeypatch):
    r = random.Random(4)
    texts = ["\n".join(" ".join(r.choices(["a", "b", "c", "d"], k=r.randint(0, 6))) for _ in range(20)), None, "x", "\n\n", "a b\nc d\n"]
    rank = np.arange(1 << line_dedup.RANK_BITS, dtype=np.uint64)
    found = []
    for most in (10**6, 15):
        lines = [(a + int(d), int(n), int(z)) for a, _, t, base in _tables_of(monkeypatch, texts, most) for x in [line_dedup.Lines(t, rank, base=base)] for d, n, z in zip(x.doc, x.line, x.hash, strict=True)]
        found.append(sorted(lines))
    assert found[0] == found[1] and len(found[0]) == sum(bool(words(x)) for t in texts if t for x in t.split("\n"))


def _tables_of(monkeypatch, texts, most):
    original = line_dedup.chunks
    monkeypatch.setattr(line_dedup, "chunks", lambda column, cut_at: original(column, most, cut_at))
    out = list(line_dedup.tables(pa.array(texts)))
    monkeypatch.undo()
    return out


@pytest.mark.parametrize("bucket_bits", [4, 12, 24])
def test_senders_have_few_receivers(monkeypatch, bucket_bits):
    """However many buckets there are, a pack of entries goes to 2 ** FAN_BITS receivers, and nodes pass on to as many."""
    monkeypatch.setattr(line_dedup, "FAN_BITS", 4)
    rank = np.arange(1 << line_dedup.RANK_BITS, dtype=np.uint64)
    text = "\n".join(f"w{i} x{i}" for i in range(3000))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["doc_id", "text"])
    none = line_dedup.Hot(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    sent = list(line_dedup._index(iter([batch]), lambda: rank, 0.8, bucket_bits, lambda: none))
    assert [b.num_rows for b in sent] == [16]
    upto, tables, buckets = 4, [pa.Table.from_batches([sent[0].slice(k, 1)]) for k in range(16)], 0
    while upto < bucket_bits:
        upto += 4
        tables = [out.slice(k, 1) for t in tables for out in [line_dedup._passing(max(0, bucket_bits - upto))(t)] for k in range(out.num_rows) if out.num_rows <= 16 or pytest.fail("too many receivers")]
    found = [line_dedup._load(t) for t in tables]
    want = line_dedup._entries(np.array([1]), line_dedup.Lines(next(iter(line_dedup.tables(batch.column(1))))[2], rank), 0.8, bucket_bits)
    assert sorted(zip(np.concatenate([f[0] for f in found]).tolist(), np.concatenate([f[6] for f in found]).tolist(), strict=True)) == sorted(zip(want[1].tolist(), want[7].tolist(), strict=True))
    assert {t["bucket"][0].as_py() for t in tables} == set(want[0].tolist())
