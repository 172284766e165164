"""Language identification by a byte convolutional network.

Every text is cut into windows of a fixed number of bytes.  Filters of several
widths run over the bytes of a window, the strongest response of each is kept
(max pooling), and a softmax layer scores the languages.  A document gets the
mean score of its windows, all of them, weighted by length.  Training is plain
numpy; the filters are then folded into tables by byte pair, so that scoring
only adds table rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cluster import map_batches, small_batches, tidy
from .wordtable import buffers

WINDOW = 256
WIDTHS = (2, 3, 4)
SCHEMA = "doc_id long, lang_pred string, score double"
NONE = "und"


@dataclass
class Network:
    """embed: 256 x d; filters: per width (width * d) x f; dense: (widths * f) x languages."""

    langs: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    filter_bias: list[np.ndarray]
    dense: np.ndarray
    bias: np.ndarray

    @classmethod
    def new(cls, langs: list[str], d: int = 8, f: int = 8, seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        draw = lambda *shape, s: (r.standard_normal(shape) * s).astype(np.float32)
        filters = [draw(w * d, f, s=(w * d) ** -0.5) for w in WIDTHS]
        return cls(langs, draw(256, d, s=0.5), filters, [np.zeros(f, np.float32) for _ in WIDTHS], draw(len(WIDTHS) * f, len(langs), s=0.2), np.zeros(len(langs), np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.filter_bias, self.dense, self.bias]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Cross entropy of windows x (n x WINDOW bytes) with labels y, and its gradients in the order of ``arrays``."""
    n, d = len(x), net.embed.shape[1]
    e = net.embed[x]
    seen, pooled, where = [], [], []
    for w, k, b in zip(WIDTHS, net.filters, net.filter_bias, strict=True):
        columns = np.concatenate([e[:, j : x.shape[1] - w + 1 + j] for j in range(w)], axis=2)
        z = columns @ k + b
        at = z.argmax(axis=1)
        seen.append(columns)
        where.append(at)
        pooled.append(np.take_along_axis(z, at[:, None], axis=1)[:, 0])
    h = np.concatenate(pooled, axis=1)
    active = np.maximum(h, 0)
    p = softmax(active @ net.dense + net.bias)
    loss = -np.log(np.maximum(p[np.arange(n), y], 1e-12)).mean()
    p[np.arange(n), y] -= 1
    p /= n
    g_dense, g_bias = active.T @ p, p.sum(axis=0)
    g_h = (p @ net.dense.T) * (h > 0)
    g_embed, g_filters, g_fbias = np.zeros_like(net.embed), [], []
    f = net.filters[0].shape[1]
    for i, w in enumerate(WIDTHS):
        g = g_h[:, i * f : (i + 1) * f]
        best = np.take_along_axis(seen[i], where[i][:, :, None], axis=1)  # n x f x (w * d)
        g_filters.append(np.einsum("nf,nfc->cf", g, best))
        g_fbias.append(g.sum(axis=0))
        back = g[:, :, None] * net.filters[i].T[None]
        for j in range(w):
            chars = x[np.arange(n)[:, None], where[i] + j]
            np.add.at(g_embed, chars, back[:, :, j * d : (j + 1) * d])
    return float(loss), [g_embed, *g_filters, *g_fbias, g_dense, g_bias]


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], epochs: int = 6, batch: int = 64, rate: float = 4e-3, seed: int = 7) -> Network:
    """Adam on shuffled batches; the same input gives the same network."""
    net = Network.new(langs, seed=seed)
    if not len(windows):
        return net
    r = np.random.default_rng(seed)
    arrays = net.arrays()
    m, v, step = [np.zeros_like(a) for a in arrays], [np.zeros_like(a) for a in arrays], 0
    for _ in range(epochs):
        order = r.permutation(len(windows))
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            _, gs = gradients(net, windows[rows], labels[rows])
            step += 1
            for a, g, m1, v1 in zip(arrays, gs, m, v, strict=True):
                m1 += 0.1 * (g - m1)
                v1 += 0.001 * (g * g - v1)
                a -= (rate * (m1 / (1 - 0.9**step)) / (np.sqrt(v1 / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


class Scorer:
    """The network as tables: a filter's response is a sum of rows chosen by byte pairs."""

    def __init__(self, net: Network):
        self.net = net
        e, d = net.embed, net.embed.shape[1]
        one = [[e @ k[j * d : (j + 1) * d] for j in range(w)] for w, k in zip(WIDTHS, net.filters, strict=True)]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        # For each byte pair: all of width 2, the first two of widths 3 and 4; then what the third and fourth bytes add.
        self.first = np.ascontiguousarray(np.concatenate([pair(o[0], o[1]) for o in one], axis=1), dtype=np.float32)
        self.third = np.ascontiguousarray(one[1][2], dtype=np.float32)
        self.last = np.ascontiguousarray(pair(one[2][2], one[2][3]), dtype=np.float32)

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Probabilities by window and language of x (n x WINDOW bytes)."""
        f = self.net.filters[0].shape[1]
        codes = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        a = self.first[codes]
        two = a[:, :, :f].max(axis=1)
        three = (a[:, :-1, f : 2 * f] + self.third[x[:, 2:]]).max(axis=1)
        four = (a[:, :-2, 2 * f :] + self.last[codes[:, 2:]]).max(axis=1)
        h = np.concatenate([two, three, four], axis=1) + np.concatenate(self.net.filter_bias)
        return softmax(np.maximum(h, 0) @ self.net.dense + self.net.bias)


def cut_windows(data: np.ndarray, offsets: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of each text, side by side, the last padded with zeros: bytes, text, length.  Capitals of ASCII and Latin-1 are made small."""
    text, start, length = window_places(offsets, width)
    return window_bytes(data, start, length, width), text, length


def window_places(offsets: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first byte and length of the windows of each text."""
    size = np.diff(offsets)
    counts = -(-size // width)
    text = np.repeat(np.arange(len(size)), counts)
    inside = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[text] + inside * width
    return text, start, np.minimum(width, offsets[text + 1] - start)


def window_bytes(data: np.ndarray, start: np.ndarray, length: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """The windows' bytes, capitals made small; memory follows the windows, not the text they are of."""
    if not len(start):
        return np.zeros((0, width), np.uint8)
    at = start[:, None] + np.arange(width)
    x = data[np.minimum(at, len(data) - 1)]
    before = np.empty_like(x)
    before[:, 1:] = x[:, :-1]
    before[:, 0] = data[np.maximum(start - 1, 0)]
    before[start == 0, 0] = 0
    # Latin-1 capitals are xC3 x80-x9E but for x97 in UTF-8.
    second = (before == 0xC3) & (x >= 0x80) & (x <= 0x9E) & (x != 0x97)
    x += np.where(second | ((x >= 65) & (x <= 90)), 32, 0).astype(np.uint8)
    x[np.arange(width) >= length[:, None]] = 0
    return x


def _has_letter() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def sample_windows(labelled: DataFrame, per_lang: int = 400, per_doc: int = 6, in_all: int = 80_000, most_langs: int = 1000) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """A bounded training set: ``per_lang`` documents of each language, ``per_doc`` windows of each.

    With many languages each has fewer, so that there are ``in_all`` documents in all.
    The ``most_langs`` labels of the most different texts are learned (of equal ones the
    first by name), so that the network and what the driver holds are bounded; texts of
    other labels are predicted as one of these.

    Different texts are chosen by least hash, among those whose hash is so low that
    about four times ``per_lang`` different ones are left, and the windows lie evenly over a
    text.  Windows of fewer than 32 bytes are left out where a language has longer
    ones.  These are bounds of the sample, not of what is scored.
    """
    rows = labelled.where(F.col("lang").isNotNull()).select("lang", "text").where(_has_letter())
    counts = rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("texts"))
    top = {r["lang"]: r["texts"] for r in counts.orderBy(F.desc("texts"), "lang").limit(most_langs).collect()}
    per_lang = max(1, min(per_lang, in_all // max(len(top), 1)))
    langs = sorted(top)
    size = F.octet_length("text")
    pieces = F.transform(
        F.sequence(F.lit(0), F.lit(per_doc - 1)),
        lambda i: F.substring(F.col("text"), (i * F.greatest(F.length("text") - WINDOW, F.lit(0)) / max(per_doc - 1, 1)).cast("int") + 1, F.lit(WINDOW)),
    )
    # Hashes below a share of their range that holds some four times as many different texts as are wanted; copies have one hash.
    share = {k: min(1.0, 4 * per_lang / max(n, 1)) for k, n in top.items()}
    low = F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, v)]) if share else F.create_map(F.lit(""), F.lit(0.0))
    hashed = rows.withColumn("h", F.xxhash64("text"))
    few = hashed.where(F.col("h").cast("double") / 2.0**64 + 0.5 < low[F.col("lang")]).select("lang", "h", size.alias("size"), F.array_distinct(pieces).alias("pieces"))
    few = few.groupBy("lang", "h", "size").agg(F.first("pieces").alias("pieces"))
    chosen = few.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h", "size"))).where(F.col("r") <= per_lang)
    got = sorted((r["lang"], r["h"], piece) for r in chosen.select("lang", "h", "pieces").collect() for piece in r["pieces"])
    column = pa.array([g[2] for g in got], pa.string())
    data, offsets = buffers(column)
    x, text, length = cut_windows(data, offsets)
    full = length >= min(32, WINDOW)
    where = {lang: i for i, lang in enumerate(langs)}
    y = np.array([where[g[0]] for g in got], np.int64)[text] if len(got) else np.zeros(0, np.int64)
    full |= ~np.isin(y, y[full])
    return x[full], y[full], langs


def fit(labelled: DataFrame, **limits: int) -> Network:
    """Trains on the driver, on the bounded sample of ``sample_windows``; only ``text`` and ``lang`` are read."""
    return train(*sample_windows(labelled, **limits))


def predict(docs: DataFrame, net: Network, keep: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text, and the columns ``keep``.

    A null text, and one without letters, is ``und`` with score 0; so is all if no
    language was learned.  Other columns are ignored, repeated rows give repeated
    results.  There is no shuffle; a window is scored alike wherever it stands, and
    memory follows the windows at hand, not the length of a text.  ``prefix`` is
    put before the names of the two results; a column to be kept must not have one of them.
    """
    small_batches(docs.sparkSession)
    columns = [c for c in keep if c != "doc_id"]
    results = [f"{prefix}lang_pred", f"{prefix}score"]
    if taken := {c.lower() for c in columns} & {c.lower() for c in ("doc_id", *results)}:
        raise ValueError(f"columns {sorted(taken)} have the name of a result; choose a prefix")
    fields = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[F.col(f"`{c}`") for c in columns]).schema) if columns else ""
    step = 400  # windows at once

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net) if net.langs else None
        names = np.array([*net.langs, NONE], dtype=object)
        for batch in batches:
            n = batch.num_rows
            total, weight = np.zeros((n, max(1, len(net.langs)))), np.zeros(n)
            data, offsets = buffers(batch.column(1))
            row = 0
            while scorer and row < n:
                stop = max(row + 1, min(n, int(np.searchsorted(offsets, offsets[row] + step * WINDOW, side="right")) - 1))
                part, base = data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
                text, start, length = window_places(base)
                for k in range(0, len(text), step):
                    some = slice(k, k + step)
                    p = scorer.windows(window_bytes(part, start[some], length[some])) * length[some, None]
                    np.add.at(total, row + text[some], p)
                    np.add.at(weight, row + text[some], length[some])
                row = stop
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool) & (weight > 0)
            best = np.where(letters, total.argmax(axis=1), -1)
            score = np.where(letters, total.max(axis=1) / np.maximum(weight, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1)), *batch.columns[3:]], names=["doc_id", *results, *columns])

    schema = f"doc_id long, `{results[0]}` string, `{results[1]}` double{fields}"
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text", _has_letter(), *[F.col(f"`{c}`") for c in columns]), run, schema)


def held_out(doc_id: Column) -> Column:
    """Documents that are not learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
