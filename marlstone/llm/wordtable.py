"""Word tables over batches of texts: numpy on Arrow buffers, no Python strings.

Words are maximal runs of bytes other than x20 and x09-x0D.  A null text has no
words.  Hashes are 64 bits, depend only on the bytes, and are equal on every
machine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes handled at once; temporary arrays take about 40 times as much.
CHUNK_BYTES = 500_000

NEWLINE = np.zeros(256, dtype=bool)
NEWLINE[10] = True

#: Seeds of the two hash functions, and the step between places.
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_STEP = np.uint64(0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 bits."""
    z = x + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def word_hash(data: np.ndarray, first: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of the bytes data[first:end] for each pair.

    Blocks of eight bytes are mixed with their place and summed: no structure of the
    bytes cancels, and of words of up to eight bytes no two have one hash.
    """
    size = end - first
    blocks = (size + 7) >> 3
    total = int(blocks.sum())
    if not total:
        return mix(np.zeros(len(size), np.uint64) + _SEEDS[which])
    at = np.cumsum(blocks) - blocks
    place = np.arange(total) - np.repeat(at, blocks)
    start = np.repeat(first, blocks) + 8 * place
    room = np.minimum(np.repeat(end, blocks) - start, 8).astype(np.uint64)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    raw = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))[start].view(np.uint64).reshape(-1)
    raw &= np.uint64(0xFFFFFFFFFFFFFFFF) >> ((np.uint64(8) - room) << np.uint64(3))
    mixed = mix(mix(raw ^ _SEEDS[which]) + place.astype(np.uint64) * _STEP)
    sums = np.zeros(len(size), np.uint64)
    full = np.flatnonzero(blocks)
    sums[full] = np.add.reduceat(mixed, at[full])
    return mix(sums + size.astype(np.uint64) * _STEP + _SEEDS[which])


def sequence_hash(values: np.ndarray, first: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of the sequence values[first:end] for each pair, none of them empty."""
    size = end - first
    at = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(at, size)
    mixed = mix(values[np.repeat(first, size) + place] + place.astype(np.uint64) * _STEP + _SEEDS[which])
    return mix(np.add.reduceat(mixed, at) + size.astype(np.uint64) * _STEP) if len(size) else np.zeros(0, np.uint64)


@dataclass
class Words:
    """data: the bytes; doc: offsets of documents; start, end: of words; offsets: first word of each document; before, after: bytes of the text before and after a piece."""

    data: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    offsets: np.ndarray
    before: int = 0
    after: int = 0

    @property
    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))

    def word_hashes(self, which: int = 0) -> np.ndarray:
        return word_hash(self.data, self.start, self.end, which)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, doc: np.ndarray) -> Words:
    space = IS_SPACE[data]
    n = len(data)
    begins = np.empty(n, dtype=bool)
    ends = np.empty(n, dtype=bool)
    if n:
        begins[0] = ends[-1] = True
        begins[1:] = space[:-1]
        ends[:-1] = space[1:]
        edges = doc[(doc > 0) & (doc < n)]
        begins[edges] = True
        ends[edges - 1] = True
        begins &= ~space
        ends &= ~space
    start = np.flatnonzero(begins)
    return Words(data, doc, start, np.flatnonzero(ends) + 1, np.searchsorted(start, doc))


def cuts(data: np.ndarray, most: int, cut_at: np.ndarray) -> list[int]:
    """Offsets of pieces of about ``most`` bytes, all but the last ending with a byte of ``cut_at``; a run without such a byte is not cut."""
    out, n = [0], len(data)
    while n - out[-1] > most:
        at = out[-1] + most
        while at < n:
            hits = np.flatnonzero(cut_at[data[at : at + most]])
            if len(hits):
                at += int(hits[0]) + 1
                break
            at += most
        if at >= n:
            break
        out.append(at)
    return [*out, n]


def chunks(column: pa.Array, most: int = CHUNK_BYTES, cut_at: np.ndarray | None = None):
    """Yield (first row, last row + 1, Words) over runs of rows of about ``most`` bytes.

    A longer text is one run or, with ``cut_at`` (256 flags), several pieces that end
    after such a byte, one after the other; ``before`` tells them apart.
    """
    data, doc = buffers(column)
    row, rows = 0, len(column)
    while row < rows:
        stop = int(np.searchsorted(doc, doc[row] + most, side="right")) - 1
        stop = min(rows, max(stop, row + 1))
        run = data[doc[row] : doc[stop]]
        if cut_at is not None and len(run) > most:
            at = cuts(run, most, cut_at)
            for a, b in zip(at[:-1], at[1:], strict=True):
                t = words(run[a:b], np.array([0, b - a]))
                t.before, t.after = a, len(run) - b
                yield row, stop, t
        else:
            yield row, stop, words(run, doc[row : stop + 1] - doc[row])
        row = stop


def hash_chunks(column: pa.Array, which: int = 0, most: int = CHUNK_BYTES):
    """Yield (first row, last row + 1, word hashes, first word of each row); of a long text only the hashes are held at once."""
    pieces: list[np.ndarray] = []
    for a, b, t in chunks(column, most, IS_SPACE):
        h = t.word_hashes(which)
        if t.before or t.after:
            pieces.append(h)
            if t.after:
                continue
            h, pieces = np.concatenate(pieces), []
            yield a, b, h, np.array([0, len(h)])
        else:
            yield a, b, h, t.offsets


def order_by(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Order by group, small non-negative integers, then by key, 64 unsigned bits; one sort of one number if that tells all apart."""
    if len(group) and int(group.max()) < 1 << 20:
        both = (group.astype(np.uint64) << np.uint64(44)) | (key >> np.uint64(20))
        order = np.argsort(both)
        b, k = both[order], key[order]
        if not ((b[1:] == b[:-1]) & (k[1:] != k[:-1])).any():
            return order
    return np.lexsort((key, group))


def runs(hashes: np.ndarray, offsets: np.ndarray, width: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every run of ``width`` words of one document; offsets: first word of each document.

    Runs of one, two, four words and so on are mixed in pairs, in order.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    first = np.flatnonzero(doc[:n] == doc[width - 1 :])
    join = lambda a, b: mix(a[: len(b)] * _STEP + b + _SEEDS[which])
    found, covered, power, step = None, 0, hashes, 1
    while True:
        if width & step:
            found = power if found is None else join(found, power[covered:])
            covered += step
        if 2 * step > width:
            return first, found[first]
        power = join(power, power[step:])
        step *= 2


def hashed(column: pa.Array, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a string column, and the first word of each row."""
    parts, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, _, h, offsets in hash_chunks(column, which):
        parts.append(h)
        counts.append(np.diff(offsets))
    return np.concatenate(parts), np.concatenate(([0], np.cumsum(np.concatenate(counts))))
