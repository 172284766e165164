"""SentencePiece encoding and decoding by an Aho-Corasick Viterbi.

An automaton over the bytes of all pieces reads a segment once.  At each position
the output links name every piece that ends there, longest first, and each relaxes
the best score of that position.  Characters no piece covers fall back to byte
pieces.  Pieces hold a space only as a leading run, so the best path of a text is
made of the best paths of its segments (a run of spaces and what follows), and
each different segment of a batch is worked out once, many side by side.

Scores must be additive for a best sum to mean anything.  A model whose scores are
whole numbers holds ranks of merges; these are turned into log frequencies by the
law of Zipf and Mandelbrot, -ln(rank + ``ZIPF_OFFSET``), in steps of 1/1024 so that
sums are exact.  Other scores are taken as they are.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import map_batches, release, small_batches, tidy
from .wordcodes import WordCodes, gather
from .wordtable import Words, buffers

MODEL = os.environ.get("MARLSTONE_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
SPACE = "▁".encode()
#: Bytes at once: large, as the known segments are merged with the new ones each time.
CODED_BYTES = 1_000_000
UNKNOWN_BELOW = 10.0  # a fallback character scores so much less than the worst piece
#: Of 1 to 3,000, the offset with which most words are split as the merges split them (see README).
ZIPF_OFFSET = 300.0
#: Segments of more bytes than this are worked out by themselves.
LONG_SEGMENT = 4096


class Vocabulary:
    """Pieces of a model file as bytes, with space for the visible space sign."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.byte_id = np.full(256, -1, np.int32)
        self.text: list[bytes] = []  # what an id decodes to
        self.scored: list[tuple[bytes, int, float]] = []
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.text.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.text.append(b"")
            else:
                body = piece.encode().replace(SPACE, b" ")
                self.text.append(body)
                self.scored.append((body, i, sp.get_score(i)))
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte pieces")
        if any(b" " in body.lstrip(b" ") for body, _, _ in self.scored):
            raise ValueError("a piece holds a space after other characters")
        scores = np.array([s for _, _, s in self.scored])
        if (scores == np.round(scores)).all():
            # Ranks beyond the vocabulary stand for pieces that no merge makes.
            rank = np.clip(-scores, 0, self.size)
            self.scored = [(body, i, float(s)) for (body, i, _), s in zip(self.scored, np.round(-1024 * np.log(rank + ZIPF_OFFSET)) / 1024, strict=True)]
        self.offsets = np.concatenate(([0], np.cumsum([len(t) for t in self.text])))
        self.bytes = np.frombuffer(b"".join(self.text), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        at, _ = gather(self.offsets, ids.astype(np.int64))
        out = self.bytes[at].tobytes()
        return out[1:] if out.startswith(b" ") else out


class Automaton:
    """States by prefix; ``step`` has the next state of every state and byte class."""

    def __init__(self, vocabulary: Vocabulary):
        state: dict[bytes, int] = {b"": 0}
        for body, _, _ in vocabulary.scored:
            for n in range(1, len(body) + 1):
                state.setdefault(body[:n], len(state))
        names = list(state)
        used = sorted({b for name in names for b in name[-1:]})
        self.byte_class = np.zeros(256, np.int32)
        self.byte_class[used] = np.arange(1, len(used) + 1)
        depth = np.array([len(n) for n in names])
        parent = np.array([state[n[:-1]] for n in names])
        by = self.byte_class[np.array([n[-1] if n else 0 for n in names])]
        n = len(names)
        self.step = np.zeros((n, len(used) + 1), np.uint16 if n < 1 << 16 else np.int32)
        fail, self.link = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.piece, self.length, self.score = np.full(n, -1, np.int32), depth.astype(np.int64), np.zeros(n)
        for body, i, score in vocabulary.scored:
            if self.piece[state[body]] < 0:
                self.piece[state[body]], self.score[state[body]] = i, score
        self.worst = min((s for _, _, s in vocabulary.scored), default=0.0) - UNKNOWN_BELOW
        order = np.argsort(depth, kind="stable")
        edges = np.searchsorted(depth[order], np.arange(depth.max() + 2))
        for d in range(1, depth.max() + 1):
            here = order[edges[d] : edges[d + 1]]
            above = parent[here]
            fail[here] = self.step[fail[above], by[here]] if d > 1 else 0
            self.link[here] = np.where(self.piece[fail[here]] >= 0, fail[here], self.link[fail[here]])
            self.step[above, by[here]] = here
            # The row of a state starts as that of its failure state, whose own children are all known: it is less deep.
            if d < depth.max():
                last = here
                self._inherit(last, fail)

    def _inherit(self, states: np.ndarray, fail: np.ndarray) -> None:
        self.step[states] = self.step[fail[states]]

    def segments(self, words: list[bytes], byte_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each segment's best path: how many, and all of them in order."""
        sizes = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-sizes, kind="stable")
        counts, found = np.zeros(len(words), np.int64), []
        k = 0
        while k < len(order):
            width = int(sizes[order[k]])
            if width > LONG_SEGMENT:
                found.append(self._single(words[order[k]], byte_id))
                counts[order[k]] = len(found[-1])
                k += 1
                continue
            group = order[k : k + max(1, 400_000 // (width + 1))]
            ids, n = self._lockstep([words[i] for i in group], width, byte_id)
            counts[group] = n
            found.append(ids)
            k += len(group)
        flat = np.concatenate(found) if found else np.zeros(0, np.int32)
        starts = np.empty(len(words), np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        offsets = np.repeat(starts - (np.cumsum(counts) - counts), counts)
        return counts, flat[np.arange(len(flat)) + offsets]

    def _outputs(self, state: int) -> list[tuple[int, int, float]]:
        """Piece, length and score of all pieces that end in a state, longest first."""
        out, node = [], state if self.piece[state] >= 0 else int(self.link[state])
        while node:
            out.append((int(self.piece[node]), int(self.length[node]), float(self.score[node])))
            node = int(self.link[node])
        return out

    def _single(self, word: bytes, byte_id: np.ndarray) -> np.ndarray:
        """Ids of the best path of one long segment; scores are kept for as many positions as the longest piece spans."""
        n, ring = len(word), int(self.length.max()) + 8
        code = self.byte_class[np.frombuffer(word, np.uint8)]
        best, back = [-np.inf] * ring, array("i", bytes(4 * n + 4))
        best[0], state, head, outputs = 0.0, 0, 0, {}
        for t in range(n):
            state = int(self.step[state, code[t]])
            if word[t] & 0xC0 != 0x80:
                head = t
            found = outputs.get(state)
            if found is None:
                found = outputs[state] = self._outputs(state)
            top, piece = -np.inf, -1
            for i, length, score in found:
                if (s := best[(t + 1 - length) % ring] + score) > top:
                    top, piece = s, i
            if (t + 1 == n or word[t + 1] & 0xC0 != 0x80) and t + 1 - head <= 4 and (s := best[head % ring] + self.worst) > top:
                top, piece = s, -1
            best[(t + 1) % ring], back[t + 1] = top, piece
        lengths = dict(zip(self.piece.tolist(), self.length.tolist(), strict=True))
        ids, p = array("i"), n
        while p:
            i = back[p]
            ids.append(int(byte_id[word[p - 1]]) if i < 0 else i)
            p -= 1 if i < 0 else lengths[i]
        return np.array(ids, np.int32)[::-1]

    def _lockstep(self, words: list[bytes], width: int, byte_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """words: by falling length."""
        n = len(words)
        size = np.array([len(w) for w in words], np.int64)
        x = np.zeros((width + 1, n), np.uint8)  # by position, so that a step reads one row
        flat = np.frombuffer(b"".join(words), np.uint8)
        x.T[np.arange(width + 1) < size[:, None]] = flat
        code = self.byte_class[x]
        best, back = np.full((width + 1, n), -np.inf), np.full((width + 1, n), -1, np.int32)
        best[0] = 0
        state = np.zeros(n, np.int64)
        head = np.zeros(n, np.int64)  # where the current character begins
        for t in range(width):
            live = int(np.searchsorted(-size, -t, side="left"))  # words longer than t
            state = self.step[state[:live], code[t, :live]].astype(np.int64)
            head = np.where((x[t, :live] & 0xC0) == 0x80, head[:live], t)
            node = np.where(self.piece[state] >= 0, state, self.link[state])
            rows = np.flatnonzero(node)
            while len(rows):
                at = node[rows]
                score = best[t + 1 - self.length[at], rows] + self.score[at]
                better = score > best[t + 1, rows]
                best[t + 1, rows[better]], back[t + 1, rows[better]] = score[better], self.piece[at[better]]
                node = self.link[at]
                rows, node_next = rows[node > 0], node[node > 0]
                node = np.zeros(live, np.int64)
                node[rows] = node_next
            ended = (x[t + 1, :live] & 0xC0) != 0x80
            fallback = best[head, np.arange(live)] + self.worst
            worse = ended & (fallback > best[t + 1, :live])
            best[t + 1, :live][worse] = fallback[worse]
        lengths = np.zeros(self.piece.max() + 1, np.int64)
        lengths[self.piece[self.piece >= 0]] = self.length[self.piece >= 0]
        pos, rows, taken, count = size.copy(), np.flatnonzero(size), [], np.zeros(n, np.int64)
        while len(rows):
            p = pos[rows]
            i = back[p, rows]
            raw = i < 0
            ids = np.where(raw, byte_id[x[p - 1, rows]], i)
            taken.append((rows, count[rows], ids))
            count[rows] += 1
            pos[rows] = p - np.where(raw, 1, lengths[np.maximum(i, 0)])
            rows = rows[pos[rows] > 0]
        out, starts = np.empty(int(count.sum()), np.int32), np.cumsum(count) - count
        for rows, k, ids in taken:
            out[starts[rows] + count[rows] - 1 - k] = ids
        return out, count


def segment_table(data: np.ndarray, doc: np.ndarray, opens: bool = True) -> Words:
    """Segments of texts; each text but an empty one is given a space in front if it ``opens``, is no later piece of one."""
    size = np.diff(doc)
    extra = (size > 0).astype(np.int64) * opens
    new = np.concatenate(([0], np.cumsum(size + extra)))
    out = np.full(new[-1], 32, np.uint8)
    shift = np.repeat(new[:-1] + extra - doc[:-1], size)
    out[np.arange(len(data)) + shift] = data
    begins = out == 32
    begins[1:] &= out[:-1] != 32
    begins[new[:-1][size > 0]] = True
    start = np.flatnonzero(begins)
    return Words(out, new, start, np.append(start[1:], len(out)) if len(start) else start, np.searchsorted(start, new))


def segment_cuts(data: np.ndarray, most: int | None = None) -> list[int]:
    """Offsets of pieces of about ``most`` bytes of one text, each but the first beginning where a segment does."""
    most = CODED_BYTES if most is None else most
    out, n = [0], len(data)
    while n - out[-1] > most:
        at, found = out[-1] + most, None
        while at < n and found is None:
            stop = min(n, at + most)
            hits = np.flatnonzero((data[at:stop] == 32) & (data[at - 1 : stop - 1] != 32))
            found, at = (at + int(hits[0]) if len(hits) else None), stop
        if found is None:
            break
        out.append(found)
    return [*out, n]


class Encoder:
    def __init__(self, model: str = MODEL):
        self.vocabulary = Vocabulary(model)
        self.automaton = Automaton(self.vocabulary)
        release()
        self.codes = WordCodes(lambda words: self.automaton.segments(words, self.vocabulary.byte_id), most=250_000)

    def column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and where each text's begin; a long text is worked out in pieces, each of whole segments."""
        data, doc = buffers(column)
        parts, counts, row = [np.zeros(0, np.int32)], np.zeros(len(column), np.int64), 0
        while row < len(column):
            stop = int(np.searchsorted(doc, doc[row] + CODED_BYTES, side="right")) - 1
            stop = min(len(column), max(stop, row + 1))
            run, offsets = data[doc[row] : doc[stop]], doc[row : stop + 1] - doc[row]
            edges = segment_cuts(run) if len(run) > CODED_BYTES else [0, len(run)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                t = segment_table(run[a:b], offsets if len(edges) == 2 else np.array([0, b - a]), a == 0)
                rows = self.codes.rows(t, t.word_hashes())
                at, n = gather(self.codes.offsets, rows)
                parts.append(self.codes.ids[at])
                counts[row:stop] += np.diff(np.concatenate(([0], np.cumsum(n)))[t.offsets])
            row = stop
        return np.concatenate(parts), np.concatenate(([0], np.cumsum(counts)))

    def ids(self, text: str) -> list[int]:
        return self.column(pa.array([text]))[0].tolist()


def encode(docs: DataFrame, model: str = MODEL, rows: int = 1000) -> DataFrame:
    """``doc_id, n_tokens long, ids binary`` (little-endian int32) and the other columns of ``docs`` but those names.

    The path has the highest sum of piece scores; of equal sums the one whose last
    piece is longer, at each position.  A space is put before the text.  The visible
    space sign is spelt in bytes, so that it is not taken for a space.  A null or
    empty text has no tokens, repeated rows give repeated results.  Every text is
    encoded whole, a long one in pieces; what is held of a run without spaces is five
    bytes for each of it.  The model must be readable on all executors under one path.
    """
    small_batches(docs.sparkSession)
    others = [f for f in docs.schema if f.name not in ("doc_id", "n_tokens", "ids")]
    text_at = [f.name for f in others].index("text") + 1
    schema = ", ".join(["doc_id long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "n_tokens long", "ids binary"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for whole in batches:
            for k in range(0, whole.num_rows, rows):
                batch = whole.slice(k, rows)
                ids, at = encoder.column(batch.column(text_at))
                body = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(at * 4), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(at)), body], names=["doc_id", *(f.name for f in others), "n_tokens", "ids"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), *[F.col(f"`{f.name}`") for f in others]), run, schema)


def round_trip(docs: DataFrame, model: str = MODEL, rows: int = 500) -> DataFrame:
    """``n_tokens long, ids_sha256 string`` (of little-endian int32 ids) and ``round_trip boolean`` beside the columns of ``docs`` but ``text``.

    Encodes each text, decodes the ids and compares, in one pass that ships neither
    ids nor texts; ``encode`` and ``decode`` do the same in two.  A null is empty,
    and an empty text has no tokens; any text comes back as it was.  Columns named like
    a result are replaced, repeated rows give repeated results, an empty table an empty one.
    """
    small_batches(docs.sparkSession)
    others = [f for f in docs.schema if f.name not in ("text", "n_tokens", "ids_sha256", "round_trip")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "n_tokens long, ids_sha256 string, round_trip boolean"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for whole in batches:
            for k in range(0, whole.num_rows, rows):
                batch = whole.slice(k, rows)
                ids, at = encoder.column(batch.column(0))
                digests, equal = [], []
                for text, a, b in zip(batch.column(0), at[:-1], at[1:], strict=True):
                    digests.append(hashlib.sha256(ids[a:b].tobytes()).hexdigest())
                    equal.append(encoder.vocabulary.decode(ids[a:b]) == (text.as_py() or "").encode())
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.diff(at)), pa.array(digests, pa.string()), pa.array(equal, pa.bool_())], names=[*(f.name for f in others), "n_tokens", "ids_sha256", "round_trip"])

    return map_batches(docs.select("text", *[F.col(f"`{f.name}`") for f in others]), run, schema)


def decode(encoded: DataFrame, model: str = MODEL, name: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ``ids`` in column ``name``; null ids give an empty text, bytes that are no UTF-8 the replacement sign."""
    small_batches(encoded.sparkSession)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != name), f"`{name}` string"])

    columns = encoded.columns
    ids_at, kept = columns.index("ids"), [k for k, c in enumerate(columns) if c != name]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(model)
        for batch in batches:
            texts = [vocabulary.decode(np.frombuffer(b, "<i4")).decode("utf-8", "replace") if b else "" for b in batch.column(ids_at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(texts, pa.string())], names=[*(columns[k] for k in kept), name])

    return map_batches(encoded, run, schema)
