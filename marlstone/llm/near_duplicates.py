"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of word shingles.  Equal texts are one node.  MinHash values are
grouped into bands; texts that agree in a band are candidates.  For a candidate
pair MinHash values are compared a step at a time, and the pair is dropped when
the posterior probability that its similarity reaches the threshold falls below a
tolerance.  Survivors are verified exactly on their shingle sets.

No stage emits the pairs of a group: buckets emit the edges of a forest over their
survivors, whose components gather the texts to be verified, in blocks if there
are many; a block counts links and emits a forest over verified links again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import connected, cut, release, small_batches, tidy
from .wordcodes import gather
from .wordtable import hash_chunks, mix, order_by, runs, sequence_hash


@dataclass(frozen=True)
class Settings:
    """tolerance: posterior probability below which a pair is dropped, at each step of so many hashes.

    A pair at the threshold itself misses all bands with a probability of
    (1 - threshold ** rows) ** bands, 4e-7 with these.
    """

    words: int = 5
    threshold: float = 0.8
    bands: int = 28
    rows: int = 4
    step: int = 16
    tolerance: float = 1e-6

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


#: Members of a bucket in a block; texts of a component in a block, and bytes of their shingles, on average, in one.
BUCKET_BLOCK = 20_000
VERIFY_BLOCK, LEAST_BLOCK = 2048, 64
VERIFY_BYTES = 32 << 20
#: Texts, and bytes of shingle sets, of small groups that share a task.
SLOT_ROWS, SLOT_BYTES = 20_000, 64 << 20
BROADCAST_ROWS = 250_000
FEW = 8
SEEN = 100_000


def least_matches(s: Settings) -> list[tuple[int, int]]:
    """(hashes compared, fewest that may agree) for each step.

    With a uniform prior the posterior of a similarity after k of n agree is a beta
    distribution, whose tail is that of a binomial one: P(p >= t) = P(Bin(n + 1, t) <= k).
    t allows for one in 256 hashes that agree by chance, as a byte of each is kept.
    """
    t = s.threshold + (1 - s.threshold) / 256
    out = []
    for n in range(s.step, s.hashes + 1, s.step):
        logs = np.cumsum(np.log(np.arange(1, n + 2)))
        choose = logs[-1] - np.concatenate(([0], logs)) - np.concatenate(([0], logs))[::-1]
        tail = np.cumsum(np.exp(choose + np.arange(n + 2) * np.log(t) + (n + 1 - np.arange(n + 2)) * np.log1p(-t)))
        out.append((n, int(np.argmax(tail >= s.tolerance))))
    return out


def shingles(h: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, ascending, and where each document's begin; fewer words than a shingle has are one shingle.

    h: hashes of words; offsets: the first word of each document.
    """
    first, keys = runs(h, offsets, words)
    doc = np.searchsorted(offsets, first, side="right") - 1
    n = np.diff(offsets)
    short = np.flatnonzero((n > 0) & (n < words))
    if len(short):
        doc = np.concatenate((doc, short))
        keys = np.concatenate((keys, sequence_hash(h, offsets[short], offsets[short + 1])))
    order = order_by(doc, keys)
    doc, keys = doc[order], keys[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])
    doc, keys = doc[new], keys[new]
    return keys, np.searchsorted(doc, np.arange(len(n) + 1))


def _families(s: Settings) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(2 * s.hashes, dtype=np.uint64) + np.uint64(1000))
    return (seeds[: s.hashes] >> np.uint64(32)).astype(np.uint32), (seeds[s.hashes :] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def minhash(keys: np.ndarray, at: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the MinHash values and band keys of documents that have shingles."""
    full = np.flatnonzero(np.diff(at))
    x = (keys >> np.uint64(32)).astype(np.uint32)
    y = keys.astype(np.uint32)
    xor, odd = _families(s)
    values = np.empty((len(full), s.hashes), np.uint32)
    for i in range(s.hashes):
        values[:, i] = np.minimum.reduceat((x ^ xor[i]) * odd[i] + y, at[full])
    band = np.zeros((len(full), s.bands), np.uint64)
    for b in range(s.bands):
        h = np.full(len(full), b + 1, np.uint64)
        for r in range(s.rows):
            h = mix(h ^ (values[:, b * s.rows + r].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        band[:, b] = h
    return (mix(values.astype(np.uint64)) & np.uint64(255)).astype(np.uint8), band


def _unique_rows(u1: np.ndarray, u2: np.ndarray, seen: set) -> np.ndarray:
    """Rows whose (u1, u2) is new to ``seen``, which forgets all when it is large: later steps drop what slips through."""
    out = []
    if len(seen) > SEEN:
        seen.clear()
    for i, key in enumerate(zip(u1.tolist(), u2.tolist(), strict=True)):
        if key not in seen:
            seen.add(key)
            out.append(i)
    return np.array(out, np.int64)


def _identity(text: Column) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("u1"), F.xxhash64(F.lit(0x5EED), text, F.length(text)).alias("u2")]


@tidy
def _sign(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    seen: set = set()
    for batch in batches:
        rows = _unique_rows(batch.column(0).to_numpy(), batch.column(1).to_numpy(), seen)
        batch = batch.take(pa.array(rows))
        for a, b, h, offsets in hash_chunks(batch.column(2)):
            keys, at = shingles(h, offsets, s.words)
            full = np.flatnonzero(np.diff(at))
            if not len(full):
                continue
            sig, band = minhash(keys, at, s)
            part = batch.slice(a, b - a).take(pa.array(full))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1) * s.bands, pa.int32()), pa.array(band.reshape(-1).view(np.int64)))
            size = pa.array(np.diff(at)[full], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in sig], pa.binary()), bands, size], names=["u1", "u2", "sig", "bands", "size"])


def _matrix(column, s: Settings) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, s.hashes)


def _survive(a: np.ndarray, b: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Indices of pairs of rows of a and b that pass every step."""
    left, agreed, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, least in steps:
        agreed = agreed + (a[left, done:n] == b[left, done:n]).sum(axis=1)
        passes = agreed >= least
        left, agreed, done = left[passes], agreed[passes], n
    return left


def _near(sig: np.ndarray, some: np.ndarray, pool: np.ndarray, steps: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Surviving pairs of ``some`` x ``pool``."""
    n, least = steps[0]
    hits = (sig[some][:, None, :n] == sig[pool][None, :, :n]).sum(axis=2) >= least
    i, j = np.nonzero(hits)
    kept = _survive(sig[some[i]], sig[pool[j]], steps)
    return some[i[kept]], pool[j[kept]]


def _forest(sig: np.ndarray, steps: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A spanning forest of the survivors among all rows, by breadth: what is reached leaves the pool."""
    pool, edges = np.arange(len(sig)), []
    while len(pool):
        frontier, pool = pool[:1], pool[1:]
        while len(frontier) and len(pool):
            width = max(1, min(64, 4_000_000 // (len(pool) * 16)))
            some, frontier = frontier[:width], frontier[width:]
            i, j = _near(sig, some, pool, steps)
            j, at = np.unique(j, return_index=True)
            edges += zip(i[at].tolist(), j.tolist(), strict=True)
            pool = np.setdiff1d(pool, j, assume_unique=True)
            frontier = np.concatenate((frontier, j))
    return edges


def _groups(key: np.ndarray) -> Iterator[tuple[int, int]]:
    at = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)])) if len(key) else [0]
    yield from zip(at[:-1], at[1:], strict=True)


def _prune(table: pa.Table, s: Settings, steps: list[tuple[int, int]]) -> pa.Table:
    """Forest edges (u1 of both ends) over the survivors of each bucket."""
    key, u1 = table["bucket"].to_numpy(), table["u1"].to_numpy()
    order = np.lexsort((u1, key))
    key, u1, sig = key[order], u1[order], _matrix(table["sig"], s)[order]
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    size = np.array([b - a for a, b in _groups(key)])
    of = np.repeat(size, size)
    small = np.flatnonzero(of <= FEW)
    for d in range(1, FEW):
        i = small[small + d < len(key)]
        i = i[key[i] == key[i + d]]
        kept = i[_survive(sig[i], sig[i + d], steps)]
        ends.append((u1[kept], u1[kept + d]))
    for a, b in _groups(key):
        if b - a > FEW:
            edges = np.array(_forest(sig[a:b], steps), np.int64).reshape(-1, 2)
            ends.append((u1[a:b][edges[:, 0]], u1[a:b][edges[:, 1]]))
    release()
    return pa.table([pa.array(np.concatenate([np.zeros(0, np.int64), *(e[k] for e in ends)])) for k in (0, 1)], names=["a", "b"])


@tidy
def _shingled(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Signature and shingles of each different text of a task."""
    seen: set = set()
    for batch in batches:
        rows = _unique_rows(batch.column(0).to_numpy(), batch.column(1).to_numpy(), seen)
        batch = batch.take(pa.array(rows))
        for a, b, h, offsets in hash_chunks(batch.column(3)):
            keys, at = shingles(h, offsets, s.words)
            full = np.flatnonzero(np.diff(at))
            if not len(full):
                continue
            sig, _ = minhash(keys, at, s)
            part = batch.slice(a, b - a).take(pa.array(full))
            sets = [keys[at[d] : at[d + 1]].tobytes() for d in full]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array([r.tobytes() for r in sig], pa.binary()), pa.array(sets, pa.binary())], names=["u1", "u2", "label", "sig", "shingles"])


def _common(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Shingles that sets i and j share, for each pair."""
    if len(i) <= 64:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    # Products of incidence matrices, over the shingles that several sets hold, some columns at a time.
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    several = count[inverse] > 1
    owner, column = owner[several], number[inverse[several]]
    total = np.zeros((len(sets), len(sets)), np.float32)
    width = max(256, 4_000_000 // len(sets))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for c in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        a, b = np.searchsorted(column, [c, c + width])
        x = np.zeros((len(sets), width), np.float32)
        x[owner[a:b], column[a:b] - c] = 1
        total += x @ x.T
    return total[i, j].astype(np.int64)


def _verify(table: pa.Table, s: Settings, steps: list[tuple[int, int]]) -> pa.Table:
    """Links of each text, counted, and a forest over them: a row per text and block."""
    label, u1, u2 = (table[c].to_numpy() for c in ("task", "u1", "u2"))
    order = np.lexsort((u2, u1, label))
    new = np.ones(len(order), bool)
    x, y, z = label[order], u1[order], u2[order]
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1])
    order = order[new]
    label, u1, u2 = x[new], y[new], z[new]
    sig = _matrix(table["sig"].take(pa.array(order)), s)
    block, left, right = (table[c].to_numpy()[order] for c in ("block", "left", "right"))
    blobs = table["shingles"].take(pa.array(order)).to_pylist()
    out: list[list] = [[], [], [], [], [], []]
    component = table["label"].to_numpy()[order]
    for a, b in _groups(label):
        sets = [np.frombuffer(blobs[k], np.uint64) for k in range(a, b)]
        i, j = [], []
        width = max(1, 2_000_000 // ((b - a) * 16))
        for k in range(0, b - a, width):
            p, q = _near(sig[a:b], np.arange(k, min(b - a, k + width)), np.arange(b - a), steps)
            # Within a block, or between two: each pair of texts is in one task only.
            mine = (p < q) & ((left[a] == right[a]) | (block[a + p] != block[a + q]))
            i.append(p[mine])
            j.append(q[mine])
        i, j = np.concatenate(i), np.concatenate(j)
        links, root = np.zeros(b - a, np.int64), np.arange(b - a)
        if len(i):
            size = np.array([len(v) for v in sets])
            both = _common(sets, i, j)
            real = both * (1 + s.threshold) >= s.threshold * (size[i] + size[j]) - 1e-9
            i, j = i[real], j[real]
            np.add.at(links, i, 1)
            np.add.at(links, j, 1)
            changed = len(i) > 0
            while changed:
                low = np.minimum(root[i], root[j])
                before = root.copy()
                np.minimum.at(root, i, low)
                np.minimum.at(root, j, low)
                root = root[root]
                changed = bool((before != root).any())
        for column, values in zip(out, (component[a:b], u1[a:b], u2[a:b], links, u1[a:b][root], u2[a:b][root]), strict=True):
            column.append(values)
    release()
    names = ["label", "u1", "u2", "n_links", "r1", "r2"]
    return pa.table([pa.array(np.concatenate(c)) for c in out], names=names)


LINKS = "label long, u1 long, u2 long, n_links long, r1 long, r2 long"


def _blocks(n: Column, size: int | Column) -> Column:
    return F.ceil(n / size).cast("int")


def _block_tasks(rows: DataFrame, key: str, n: str, size: int | Column, tasks: int) -> DataFrame:
    """Rows with ``block, left, right, task, slot``: each pair of blocks of a group is one task; small groups share slots."""
    hashed = F.pmod(F.xxhash64("u1", F.lit(1)), F.col("nb")).cast("int")
    r = rows.withColumn("nb", _blocks(F.col(n), size)).withColumn("block", hashed)
    r = r.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    # A text of block b is in the tasks (b, x) and (x, b); (b, b) holds the pairs inside.
    r = r.withColumns({"left": F.least("block", "other"), "right": F.greatest("block", "other")})
    r = r.withColumn("task", F.when(F.col("nb") == 1, F.col(key)).otherwise(F.xxhash64(key, "left", "right")))
    slot = F.when(F.col("nb") == 1, F.pmod(F.xxhash64(key), F.lit(tasks))).otherwise(F.col("task"))
    return r.withColumn("slot", slot).drop("other")


def slots(amount: int | None, per_slot: int, least: int) -> int:
    """How many slots small groups share, so that one holds about ``per_slot``, however large the input is."""
    return max(least, -(-(amount or 0) // per_slot))


def links(docs: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Nodes of texts with links, ``u1, u2, n_links, r1, r2`` (root of the class), and ``docs`` ids with ``u1, u2``."""
    s = settings
    steps = least_matches(s)
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", *_identity(F.col("text")))
    signed = cut(texts.select("u1", "u2", "text").mapInArrow(lambda it: _sign(it, s), "u1 long, u2 long, sig binary, bands array<long>, size long").dropDuplicates(["u1", "u2"]))
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), signed.rdd.getNumPartitions()) * 2
    banded = signed.select("u1", "u2", F.explode("bands").alias("bucket"))
    shared = cut(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    tasks = slots(shared.agg(F.sum("n")).first()[0], SLOT_ROWS, least)
    met = banded.join(shared, "bucket").join(signed.select("u1", "u2", "sig"), ["u1", "u2"])
    met = _block_tasks(met, "bucket", "n", BUCKET_BLOCK, tasks).select("slot", F.col("task").alias("bucket"), "u1", "sig")
    edges = met.groupBy("slot").applyInArrow(lambda t: _prune(t, s, steps), "a long, b long")
    labels = cut(connected(cut(edges.distinct())))
    few = labels.count() <= BROADCAST_ROWS
    named = labels.withColumnRenamed("node", "u1")
    held = texts.join(F.broadcast(named) if few else named, "u1").select("u1", "u2", "label", "text")
    ready = held.mapInArrow(lambda it: _shingled(it, s), "u1 long, u2 long, label long, sig binary, shingles binary")
    each = labels.join(signed.select(F.col("u1").alias("node"), "size"), "node")
    block = F.floor(VERIFY_BYTES / (8 * F.avg("size")))
    sizes = cut(each.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.least(F.lit(VERIFY_BLOCK), F.greatest(F.lit(min(LEAST_BLOCK, VERIFY_BLOCK)), block)).alias("most")))
    tasks = slots(sizes.agg(F.sum(8 * F.col("total"))).first()[0], SLOT_BYTES, least)
    blocks = _block_tasks(ready.join(F.broadcast(sizes) if few else sizes, "label"), "label", "n", F.col("most"), tasks).select("slot", "task", "label", "block", "left", "right", "u1", "u2", "sig", "shingles")
    found = cut(blocks.groupBy("slot").applyInArrow(lambda t: _verify(t, s, steps), LINKS))
    counted = found.groupBy("u1", "u2").agg(F.sum("n_links").alias("n_links"), F.min(F.struct("r1", "r2")).alias("r"), F.first("label").alias("label"))
    nodes = counted.select("u1", "u2", "n_links", "r.*", "label")
    large = sizes.where("n > most").select("label")
    if large.take(1):
        # Components in several blocks: the forests of the blocks are joined.
        ends = found.join(large, "label", "left_semi").where("u1 <> r1 OR u2 <> r2").select(F.col("u1").alias("a"), F.col("r1").alias("b"))
        joined = connected(ends).select(F.col("node").alias("u1"), F.col("label").alias("root"))
        nodes = nodes.join(joined, "u1", "left")
        nodes = nodes.withColumns({"r1": F.coalesce("root", "r1"), "r2": F.when(F.col("root").isNull(), F.col("r2"))})
    return cut(nodes.select("u1", "u2", "n_links", "r1", "r2")), texts.select("doc_id", "u1", "u2")


def classes(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, class_id, n_links, n_copies, u1, u2, root`` of every document.

    class_id: the least id of the documents connected by links (a similarity of the
    threshold or more between different texts) or by equal texts; null if all its
    ids are.  n_links: other texts this one is similar to; n_copies: documents with
    this very text.  Texts are sets of shingles of consecutive words (runs of
    other bytes than x20, x09-x0D, unchanged); a text of fewer words is one shingle,
    one without words has none and no links.  A null text is empty.  Repeated rows
    are copies.  Columns other than ``doc_id`` and ``text`` are ignored; ``u1, u2``
    identify the text, ``root`` the class, as documents of one id may be of several.
    """
    nodes, ids = links(docs, settings)
    ids = cut(ids)
    copies = ids.groupBy("u1", "u2").agg(F.count(F.lit(1)).alias("n_copies"), F.min("doc_id").alias("least"))
    root = F.when(F.col("r1").isNull(), F.struct("u1", "u2")).otherwise(F.struct(F.col("r1").alias("u1"), F.col("r2").alias("u2")))
    per_text = copies.join(nodes, ["u1", "u2"], "left").select("u1", "u2", "n_copies", "least", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("root"))
    per_text = cut(per_text)
    per_class = per_text.groupBy("root").agg(F.min("least").alias("class_id"))
    same = F.col("root").eqNullSafe(F.col("of"))
    per_text = per_text.join(per_class.withColumnRenamed("root", "of"), same).select("u1", "u2", "n_copies", "n_links", "class_id", "root")
    return ids.join(per_text, ["u1", "u2"]).select("doc_id", "class_id", "n_links", "n_copies", "u1", "u2", "root")


def keep_one(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with one document of each class: that of the least id, of rows with that id the least text identity, of repeated rows one."""
    found = cut(classes(docs, settings))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "u1", "u2")
    lasting = found.groupBy("root").agg(F.min(key).alias("k")).select("k.doc_id", "k.u1", "k.u2")
    counts = found.groupBy("doc_id", "u1", "u2").agg(F.count(F.lit(1)).alias("n"))
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in ("doc_id", "u1", "u2")]
    gone = cut(counts.join(lasting, same(counts, lasting), "left_anti").select("doc_id", "u1", "u2"))
    repeated = cut(counts.where("n > 1").join(lasting, same(counts, lasting), "left_semi").select("doc_id", "u1", "u2"))
    names = {"doc_id": "__near_id", "u1": "__near_u1", "u2": "__near_u2"}
    u1, u2 = _identity(F.col("text"))
    keyed = docs.withColumns({"__near_id": F.col("doc_id").cast("long"), "__near_u1": u1, "__near_u2": u2})

    def match(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        few = keys.count() <= BROADCAST_ROWS
        keys = keys.withColumnsRenamed({k: f"{v}_k" for k, v in names.items()})
        return df.join(F.broadcast(keys) if few else keys, [df[v].eqNullSafe(F.col(f"{v}_k")) for v in names.values()], how)

    kept = match(keyed, gone, "left_anti")
    if repeated.take(1):
        once = match(kept, repeated, "left_semi").dropDuplicates(list(names.values()))
        kept = match(kept, repeated, "left_anti").unionByName(once)
    return kept.drop(*names.values())
