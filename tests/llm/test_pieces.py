from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import pieces
from tests.llm.frames import documents, empty, frame, prose

E = pieces.Encoder()
BY_TEXT = {body: (i, score) for body, i, score in reversed(E.vocabulary.scored)}
SP = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)  # by merges


def brute(text):
    """Best path over all substrings of the whole text, without segments or an automaton."""
    b = (" " + text).encode() if text else b""
    bound = [k == len(b) or (b[k] & 0xC0) != 0x80 for k in range(len(b) + 1)]
    best, back = [0.0] + [-float("inf")] * len(b), [None] * (len(b) + 1)
    longest = max(map(len, BY_TEXT))
    for end in (k for k in range(1, len(b) + 1) if bound[k]):
        for start in (k for k in range(max(0, end - longest), end) if bound[k]):
            if (found := BY_TEXT.get(b[start:end])) and best[start] + found[1] > best[end]:
                best[end], back[end] = best[start] + found[1], (start, [found[0]])
        start = max(k for k in range(end) if bound[k])
        if best[start] + E.automaton.worst > best[end]:
            best[end], back[end] = best[start] + E.automaton.worst, (start, [int(E.vocabulary.byte_id[c]) for c in b[start:end]])
    out, at = [], len(b)
    while at:
        at, ids = back[at]
        out = ids + out
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdeiou  \n\t▁éß日🎉.!0"), max_size=40))
def test_best_path_and_round_trip(text):
    ids = E.ids(text)
    assert ids == brute(text)
    assert E.vocabulary.decode(np.array(ids, np.int32)).decode() == text == SP.decode(ids)


def fields(raw):
    """Number, wire type and content of each field of a protocol buffer."""

    def varint(at):
        value = shift = 0
        while True:
            value, shift, at = value | (raw[at] & 127) << shift, shift + 7, at + 1
            if not raw[at - 1] & 128:
                return value, at

    at = 0
    while at < len(raw):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, key & 7, value


def message(parts):
    def varint(n):
        return bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])

    return b"".join(varint(k << 3 | w) + (varint(v) if w == 0 else (varint(len(v)) if w == 2 else b"") + v) for k, w, v in parts)


def unigram():
    """The library with the pieces of the model and the scores used here, as a unigram model."""
    score = {i: s for _, i, s in E.vocabulary.scored}
    parts, i = [], 0
    for number, wire, value in fields(open(pieces.MODEL, "rb").read()):
        if number == 1:
            piece = {k: (w, v) for k, w, v in fields(value)}
            if i in score:
                piece |= {2: (5, struct.pack("<f", score[i])), 3: (0, 1)}
            value, i = message([(k, *wv) for k, wv in sorted(piece.items())]), i + 1
        elif number == 2:
            value = message([(k, w, 1 if k == 3 else v) for k, w, v in fields(value)])
        parts.append((number, wire, value))
    return sentencepiece.SentencePieceProcessor(model_proto=message(parts))


UNIGRAM = unigram()


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(alphabet=st.sampled_from("abcdeiou  \n\téß日🎉.!0"), max_size=60), st.lists(st.sampled_from(["the", "of", "ing", "ation", "straße", "  ", " ", "日本", "x", "ment"]), max_size=12).map("".join)))
def test_ids_are_those_of_the_library(text):
    assert E.ids(text) == UNIGRAM.encode(text)


def test_ids_of_documents_are_those_of_the_library(spark, sf_dir):
    """By 200 words, as the library adds scores in single precision, which is exact up to some 2,000 tokens."""
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        w = r["text"].split(" ")
        for k in range(0, len(w), 200):
            part = " ".join(w[k : k + 200])
            assert E.ids(part) == UNIGRAM.encode(part), r["doc_id"]


def test_words_are_mostly_split_as_the_merges_split_them(spark, sf_dir):
    words = [w for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() for w in r["text"].split()]
    merged = SP.encode(words)
    ids, at = E.column(pa.array(words))
    mine = [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    assert np.mean([a == b for a, b in zip(mine, merged, strict=True)]) > 0.75
    assert 0.95 < sum(map(len, mine)) / sum(map(len, merged)) < 1.02


@pytest.mark.parametrize("text", ["a" * 50 + "é日" * 40 + "🎉" * 30 + "the" * 60, "日本語テスト" * 30 + "\x00\x01" * 9])
def test_long_segments(monkeypatch, text):
    want = brute(text)
    monkeypatch.setattr(pieces, "LONG_SEGMENT", 20)
    assert pieces.Encoder().ids(text) == want == E.ids(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab  é\n", max_size=80), st.integers(1, 30))
def test_pieces_of_a_text(text, most):
    raw = np.frombuffer(text.encode(), np.uint8)
    at = pieces.segment_cuts(raw, most)
    assert at[0] == 0 and at[-1] == len(raw) and at == sorted(at)
    whole = pieces.segment_table(raw, np.array([0, len(raw)]))
    parts = [pieces.segment_table(raw[a:b], np.array([0, b - a]), a == 0) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert [t.word(k) for t in parts for k in range(len(t.start))] == [whole.word(k) for k in range(len(whole.start))]


@pytest.mark.parametrize("text", ["a▁b", "▁", " ▁ ", "", " ", "x" * 3000, prose(1, 80), "  two  spaces  ", "日本語 テスト"])
def test_examples(text):
    assert E.ids(text) == brute(text)


def test_frames(spark):
    out = pieces.decode(pieces.encode(frame(spark)))
    rows = out.collect()
    assert len(rows) == len(documents()) and all(r["decoded"] == (r["text"] or "") and len(r["ids"]) == 4 * r["n_tokens"] for r in rows)
    assert set(frame(spark).columns) | {"n_tokens", "ids", "decoded"} == set(out.columns)
    assert pieces.decode(pieces.encode(empty(spark))).collect() == [] and pieces.round_trip(empty(spark)).collect() == []
    once = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["round_trip"]) for r in pieces.round_trip(frame(spark)).collect()}
    assert once == {(r["doc_id"], r["n_tokens"], hashlib.sha256(r["ids"]).hexdigest(), True) for r in rows}


def test_forgetting_changes_nothing():
    texts = [prose(k, 50) for k in range(20)]
    small = pieces.Encoder()
    small.codes.most = 10
    assert [small.ids(t) for t in texts] == [E.ids(t) for t in texts]
