from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import wordtable as wt
from marlstone.llm.wordcodes import WordCodes
from tests.llm.frames import words


def thue_morse(n: int, a: str = "a", b: str = "b") -> str:
    return "".join((a, b)[k.bit_count() % 2] for k in range(n))


#: Words that a sum of letters times powers cannot tell apart, however its odd base is chosen.
TWINS = [(thue_morse(n), thue_morse(n, "b", "a")) for n in (1024, 2048)]


@pytest.mark.parametrize("which", [0, 1])
def test_twins_have_different_hashes(which):
    for pair in TWINS:
        a, b = (wt.hashed(pa.array([t]), which)[0][0] for t in pair)
        assert a != b and a >> np.uint64(32) != b >> np.uint64(32)
    order = [thue_morse(n, "x ", "y ") for n in (16, 20)] + [thue_morse(n, "y ", "x ") for n in (16, 20)]
    for width in (5, 8, 16, 20):
        seen: dict = {}
        for text in order:
            h, offsets = wt.hashed(pa.array([text]), which)
            for first, key in zip(*wt.runs(h, offsets, width, which), strict=True):
                assert seen.setdefault(int(key), words(text)[first : first + width]) == words(text)[first : first + width]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té日", max_size=60)), max_size=6), st.integers(1, 40), st.integers(1, 7))
def test_pieces_of_long_texts_change_nothing(texts, most, width):
    column = pa.array(texts, pa.string())
    whole, offsets = wt.hashed(column)
    parts = list(wt.hash_chunks(column, most=most))
    assert [(a, b) for a, b, _, _ in parts] == sorted({(a, b) for a, b, _, _ in parts}) and sum(b - a for a, b, _, _ in parts) == len(texts)
    assert np.concatenate([h for _, _, h, _ in parts] or [np.zeros(0, np.uint64)]).tolist() == whole.tolist()
    listed = [w for t in texts for w in words(t)]
    assert np.diff(offsets).tolist() == [len(words(t)) for t in texts]
    assert len({(w, int(h)) for w, h in zip(listed, whole, strict=True)}) == len(set(listed)) == len(set(whole.tolist()))
    first, keys = wt.runs(whole, offsets, width)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    starts = [k for k in range(len(listed) - width + 1) if doc[k] == doc[k + width - 1]]
    assert first.tolist() == starts and len(set(zip(keys.tolist(), (tuple(listed[k : k + width]) for k in starts), strict=True))) == len(set(keys.tolist())) == len({tuple(listed[k : k + width]) for k in starts})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "ab", "abcdefgh", "abcdefgx", "abcdefghi", "abcdefghj", "x" * 40, "x" * 39 + "y", "é"]), max_size=30), st.integers(0, 3), st.integers(1, 8))
def test_codes_are_right_whatever_the_hash(listed, bits, most):
    codes = WordCodes(lambda ws: (np.array([len(w) for w in ws]), np.frombuffer(b"".join(ws), np.uint8).astype(np.int32)), most=most)
    for k in range(0, len(listed), 7):
        _, _, t = next(wt.chunks(pa.array([" ".join(listed[k : k + 7])])))
        rows = codes.rows(t, t.word_hashes() & np.uint64((1 << bits) - 1))
        assert [bytes(codes.ids[codes.offsets[r] : codes.offsets[r + 1]].astype(np.uint8).tolist()).decode() for r in rows] == listed[k : k + 7]
