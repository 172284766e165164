"""Codes of words, worked out once for each different word of a batch."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .wordtable import Words


def gather(offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the items of ``rows`` of a ragged array, and how many each has."""
    counts = offsets[rows + 1] - offsets[rows]
    shift = np.repeat(offsets[rows] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return np.arange(len(shift)) + shift, counts


class WordCodes:
    """Ragged codes by word; forgets all once it knows ``most`` words or ``most_bytes`` of them, so memory is bounded.

    Words are found by hash and compared byte by byte; one that shares the hash of
    another word is encoded by itself.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = 400_000, most_bytes: int = 16 << 20):
        self.encode, self.most, self.most_bytes = encode, most, most_bytes
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.slot = np.zeros(0, np.int64)  # of each key
        self.offsets = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.text = np.zeros(0, np.uint8)  # of the words, by slot
        self.text_at = np.zeros(1, np.int64)

    def _add(self, words: list[bytes]) -> np.ndarray:
        """Slots of new words."""
        counts, ids = self.encode(words)
        slots = len(self.offsets) - 1 + np.arange(len(words))
        self.offsets = np.concatenate((self.offsets, self.offsets[-1] + np.cumsum(counts)))
        self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
        self.text = np.concatenate((self.text, np.frombuffer(b"".join(words), np.uint8)))
        self.text_at = np.concatenate((self.text_at, self.text_at[-1] + np.cumsum([len(w) for w in words])))
        return slots

    def rows(self, table: Words, hashes: np.ndarray) -> np.ndarray:
        """For each word its row in ``offsets`` and ``ids``; good until the next call."""
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.most or len(self.text) > self.most_bytes:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        if len(new):
            slots = self._add([table.word(i) for i in first[new]])
            self.keys, self.slot = np.insert(self.keys, at[new], keys[new]), np.insert(self.slot, at[new], slots)
            at = np.searchsorted(self.keys, keys)
        found = self.slot[at]
        # Words against the first of their hash here, and those against the known ones.
        other = differ(table.data, table.start, table.end, table.data, table.start[first], table.end[first], inverse)
        held = np.flatnonzero(known)
        wrong = np.zeros(len(keys), bool)
        wrong[held] = differ(table.data, table.start[first[held]], table.end[first[held]], self.text, self.text_at[found[held]], self.text_at[found[held] + 1], np.arange(len(held)))
        slots = found[inverse]
        strange = np.flatnonzero(other | wrong[inverse])
        if len(strange):
            distinct = sorted({table.word(i) for i in strange})
            by_word = dict(zip(distinct, self._add(distinct), strict=True))
            slots[strange] = [by_word[table.word(i)] for i in strange]
        return slots


def differ(x: np.ndarray, start: np.ndarray, end: np.ndarray, y: np.ndarray, y_start: np.ndarray, y_end: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether bytes x[start:end] differ from those of their partner ``to`` in y."""
    size = end - start
    out = size != (y_end - y_start)[to]
    same = np.flatnonzero(~out & (size > 0))
    # Eight bytes at once, then the rest; the last block overlaps the one before it.
    at, partner, n = start[same], y_start[to[same]], size[same]
    for few, step in ((n < 8, 1), (n >= 8, 8)):
        rows = np.flatnonzero(few)
        if not len(rows):
            continue
        blocks = -(-n[rows] // step)
        place = step * (np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        place = np.minimum(place, np.repeat(n[rows], blocks) - step)
        a, b = (_load(z, np.repeat(s[rows], blocks) + place, step) for z, s in ((x, at), (y, partner)))
        wrong = np.flatnonzero(a != b)
        out[same[rows[np.repeat(np.arange(len(rows)), blocks)[wrong]]]] = True
    return out


def _load(data: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    if step == 1:
        return data[at]
    return np.lib.stride_tricks.as_strided(data, (len(data) - step + 1, step), (1, 1))[at].view(np.uint64).reshape(-1)
