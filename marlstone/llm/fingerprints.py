"""Canonical exact digests of documents, on DataFrame functions only.

A text is made canonical (Unicode NFKC, full case folding, white space folded
to single spaces and trimmed), then grouped by a 128-bit xxhash.  Inside buckets
with several members the canonical bytes are compared; should different texts
share a bucket, each gets a number of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cluster import cut

#: Bits at most of the table of flags that tells which texts are read again, 16 for each key; 16 MB when broadcast. More keys are joined.
MOST_BITS = 1 << 27
#: Cells by bounds in an expression at most, parts of each at most by bounds in a broadcast table (8 MB), and ids sampled for each cell or part.
MOST_CELLS, MOST_PARTS, SAMPLED = 4096, 256, 64


def _static(cls: str, method: str, *args: Column) -> Column:
    return F.call_function("java_method", F.lit(cls), F.lit(method), *args)


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again, and white space as single spaces; a null is empty.

    The Unicode functions are those of the library that Spark itself uses for
    collations; pure ASCII needs none of them.
    """
    text = F.coalesce(text, F.lit(""))
    normal = lambda x: _static("com.ibm.icu.text.Normalizer", "compose", x, F.lit(True))
    wide = normal(_static("com.ibm.icu.lang.UCharacter", "foldCase", normal(text), F.lit(True)))
    folded = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(wide)
    return F.trim(F.regexp_replace(folded, r"[\s\x{85}\p{Z}]+", " "))


def _hashes(canon: Column) -> list[Column]:
    return [F.xxhash64(canon).alias("h1"), F.xxhash64(F.lit(0x5EED), canon, F.octet_length(canon)).alias("h2")]


def _bucket(h1: Column, h2: Column) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(h)), 16, "0") for h in (h1, h2)])


def digest(text: Column) -> Column:
    """The wide hash of the canonical text as 32 hex digits."""
    return _bucket(*_hashes(canonical(text)))


def _digested(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with the digest of a text; the canonical text is a column for a while, so that it is worked out once."""
    canon = f"__fp_{name}"
    return rows.withColumn(canon, canonical(F.col(text))).withColumn(name, _bucket(*_hashes(F.col(canon)))).drop(canon)


def fingerprint(texts: DataFrame, text_col: str = "text", bucket_of=_bucket) -> DataFrame:
    """``texts`` with a ``fingerprint`` column, equal just where canonical texts are equal.

    Input columns stay; one called ``fingerprint`` is replaced, names that begin
    with ``__fp_`` are reserved.  A null text counts as empty; empty texts share
    one fingerprint.  An empty table gives an empty one.

    Only hashes are shuffled for all rows.  Texts move only where a bucket has
    several members (and a few others, see ``_flagged``), and there a row for each different text and map task, as the
    comparison of bytes is a grouping on (bucket, text) that combines before it
    shuffles: a group of copies with a third of all rows costs a row a task.
    ``bucket_of`` is for tests, to force different texts into one bucket.
    """
    mine = texts.withColumn("__fp_canon", canonical(F.col(text_col)))
    mine = mine.withColumn("__fp_bucket", bucket_of(*_hashes(F.col("__fp_canon"))))
    stacked = mine.select(F.col("__fp_bucket").alias("bucket"), F.col("__fp_canon").alias("canon"))
    shared = _shared(stacked.select("bucket")).select(F.xxhash64("bucket").alias("key"))
    numbers = collisions(_flagged(stacked, F.xxhash64("bucket"), shared))
    return _numbered(mine, numbers, "__fp_bucket", "__fp_canon", "fingerprint").drop("__fp_bucket", "__fp_canon")


def collisions(rows: DataFrame) -> DataFrame | None:
    """Numbers of different texts that share a bucket, or None if there are none. rows: ``bucket, canon``, all members of shared buckets, maybe others."""
    texts = rows.groupBy("bucket", "canon").agg(F.count(F.lit(1)).alias("n"))
    mixed = cut(texts.groupBy("bucket").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("bucket"))
    if not mixed.take(1):
        return None
    order = W.partitionBy("bucket").orderBy("canon")
    return texts.join(mixed, "bucket").select("bucket", "canon", F.row_number().over(order).alias("number"))


def _shared(buckets: DataFrame) -> DataFrame:
    return cut(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket"))


def _flagged(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """Rows whose key (long) is among ``keys`` (column ``key``), and a few others.

    Hashes of the keys set bits in a table of 16 to 32 bits a key, which is broadcast in
    rows of 4 KB.  Where that would be more than ``MOST_BITS``, rows and keys meet in a
    semi-join instead, which shuffles each row once, and lets no others through; a key
    of very many rows is split by adaptive execution, as keys are distinct.
    """
    n = keys.count()
    bits = 1 << max(15, (16 * n).bit_length())
    if bits > MOST_BITS:
        return rows.withColumn("__fp_key", key).join(keys.select(F.col("key").alias("__fp_key")), "__fp_key", "left_semi").drop("__fp_key")
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    table = keys.select(slot(F.col("key")).alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("__fp_row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("__fp_bits"))
    asked = rows.withColumn("__fp_slot", slot(key)).withColumn("__fp_row", F.bitmap_bucket_number("__fp_slot"))
    place = F.bitmap_bit_position("__fp_slot")
    byte = F.conv(F.hex(F.substring(F.col("__fp_bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = asked.join(F.broadcast(table), "__fp_row").where(F.getbit(byte, (place % 8).cast("int")) == 1)
    return met.drop("__fp_row", "__fp_slot", "__fp_bits")


def _numbered(rows: DataFrame, numbers: DataFrame | None, bucket: str, canon: str, name: str) -> DataFrame:
    if numbers is None:
        return rows.withColumn(name, F.col(bucket))
    n = numbers.select(F.col("bucket").alias(bucket), F.col("canon").alias(canon), F.col("number").alias("__fp_number"))
    suffix = F.when(F.col("__fp_number") > 1, F.concat(F.lit("-"), F.col("__fp_number").cast("string"))).otherwise("")
    return rows.join(n, [bucket, canon], "left").withColumn(name, F.concat(bucket, suffix)).drop("__fp_number")


def _bounds(values: DataFrame, cells: int, rows: int) -> list[int]:
    """Ascending values of column ``v`` that part it into about equal cells, by a sample of ``SAMPLED`` a cell; several equal ones if a value fills cells."""
    if cells < 2:
        return []
    some = values.sample(min(1.0, SAMPLED * cells / max(rows, 1)), 7)
    return some.agg(F.percentile_approx("v", [k / cells for k in range(1, cells)], 10 * cells)).first()[0] or []


def _at(value: Column, bounds: list[int]) -> Column:
    """How many of the bounds are at most ``value``, by bisection."""
    if not bounds:
        return F.lit(0)
    steps = len(bounds).bit_length()
    padded = bounds + [(1 << 63) - 1] * ((1 << steps) - 1 - len(bounds))
    table = F.expr(f"array({', '.join(f'{b}L' if b > -(1 << 63) else 'bigint(-9223372036854775808)' for b in padded)})")
    found = F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(steps))]), F.lit(0), lambda low, step: F.when(F.element_at(table, low + step) <= value, low + step).otherwise(low))
    return F.least(found, F.lit(len(bounds)))


def _parts(values: DataFrame, bounds: list[int], cells: int, rows: int) -> DataFrame | None:
    """Bounds ``__fp_inner`` that part each coarse cell ``__fp_coarse`` further, or None if the coarse cells are enough; ``MOST_CELLS`` rows at most."""
    parts = min(MOST_PARTS, -(-cells // MOST_CELLS))
    if parts < 2 or not bounds:
        return None
    some = values.sample(min(1.0, SAMPLED * cells / max(rows, 1)), 11).select(_at(F.col("v"), bounds).alias("__fp_coarse"), "v")
    return cut(some.groupBy("__fp_coarse").agg(F.percentile_approx("v", [k / parts for k in range(1, parts)], 10 * parts).alias("__fp_inner")))


def with_next(docs: DataFrame, payload: list[str], id_col: str = "doc_id", per_cell: int = 1024, derive=lambda rows: rows) -> DataFrame:
    """``id_col`` and payload of every row, and ``next_<name>`` of the next row in descending id.

    After the last row comes the first.  Rows of one id follow each other by
    ascending payload, null ids come last; the first payload column is a string.
    Ids are dealt into cells of about ``per_cell`` rows by quantiles of a sample, so
    that their distribution does not matter.  Beyond ``MOST_CELLS`` each cell is
    parted by quantiles of its own, into ``MOST_PARTS`` at most, so a million cells
    in all.  An id, or null, that fills several coarse cells is dealt further by the
    first bytes of the payload.  Each cell is ordered by itself, and only the first row of each
    crosses to its neighbour: no step orders all rows in one task.  Places depend
    on the order alone, not on the sample.  ``derive`` adds columns that rows carry along; it is
    applied to each row once, and to the first rows of cells.
    """
    n, known = docs.agg(F.count(F.lit(1)), F.count(id_col)).first()
    wanted = int(max(1, -(-n // per_cell)))
    cells = min(MOST_CELLS, wanted)
    ids = docs.select(F.col(id_col).cast("long").alias("v")).where("v IS NOT NULL")
    bounds = _bounds(ids, cells, known)
    hot = sorted({a for a, b in zip(bounds[:-1], bounds[1:], strict=True) if a == b})
    crowded = (F.col(id_col).isin(hot) if hot else F.lit(False)) | (F.col(id_col).isNull() if (n - known) * cells > 2 * n else F.lit(False))
    head = F.conv(F.rpad(F.hex(F.substring(F.col(payload[0]).cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")
    inner: list[int] = []
    if hot or (n - known) * cells > 2 * n:
        inner = _bounds(docs.where(crowded).select(head.alias("v")), cells, n)
        inner = sorted(set(inner))
    part = F.when(crowded, _at(head, inner)).otherwise(-1)
    cell = F.when(F.col(id_col).isNull(), -1).otherwise(_at(F.col(id_col).cast("long"), bounds)).cast("long")
    rows = docs.select(F.col(id_col), *payload, cell.alias("__fp_coarse"))
    cell = F.col("__fp_coarse")
    if (finer := _parts(ids, bounds, wanted, known)) is not None:
        rows = rows.join(F.broadcast(finer), "__fp_coarse", "left")
        passed = F.size(F.filter(F.coalesce("__fp_inner", F.array().cast("array<long>")), lambda b: b <= F.col(id_col)))
        cell = cell * MOST_PARTS + passed
    rows = rows.select(F.col(id_col), *payload, (cell * (len(inner) + 2) + (len(inner) - part)).alias("__fp_cell"))
    order = [F.col(id_col).desc_nulls_last(), *[F.col(c).asc_nulls_first() for c in payload]]
    inside = W.partitionBy("__fp_cell").orderBy(*order)
    carried = derive(rows)
    names = [c for c in carried.columns if c not in (id_col, "__fp_cell")]
    ahead = F.struct(*[F.col(c) for c in names])
    placed = carried.withColumn("__fp_ahead", F.lead(ahead).over(inside))
    firsts = derive(rows.withColumn("__fp_place", F.row_number().over(inside)).where("__fp_place = 1").drop("__fp_place"))
    firsts = firsts.select(F.col("__fp_cell").alias("target"), ahead.alias("__fp_head"))
    down = W.orderBy(F.col("__fp_cell").desc())
    top = F.first("__fp_cell").over(down.rowsBetween(W.unboundedPreceding, 0))
    links = rows.select("__fp_cell").distinct().select("__fp_cell", F.coalesce(F.lead("__fp_cell").over(down), top).alias("target"))
    heads = links.join(firsts, "target").select("__fp_cell", "__fp_head")
    chosen = F.coalesce("__fp_ahead", "__fp_head")
    return placed.join(heads, "__fp_cell").select(id_col, *names, *[chosen[c].alias(f"next_{c}") for c in names])


def edited(text: Column, following: Column) -> Column:
    """The last third of the code points replaced by as many, or all, of the following text."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(following, F.lit(1), third))


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``.  A digest is alike (1.0) or not (0.0), as equal
    fingerprints mean equal canonical texts.  Null texts are empty; columns other
    than ``doc_id`` and ``text`` are ignored; repeated rows give repeated results.

    Texts are shuffled once, to meet their successors; what leaves that stage has
    no texts.  Each text and each edited text is made canonical once.  The comparison
    of bytes inside shared buckets reads texts again, but moves only those of the
    members: own texts from the scan, edited texts by (id, raw hash) of the two
    documents they are made of.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("raw"))
    pairs = with_next(base.withColumn("id", F.col("doc_id")), ["text", "raw", "id"], derive=lambda rows: _digested(rows, "text", "bucket"))
    pairs = _digested(pairs.withColumn("edited", edited(F.col("text"), F.col("next_text"))), "edited", "edited_bucket")
    like_next = F.when(F.col("bucket") == F.col("next_bucket"), canonical(F.col("text")) == canonical(F.col("next_text"))).otherwise(False)
    unchanged = F.when(F.col("bucket") == F.col("edited_bucket"), canonical(F.col("text")) == canonical(F.col("edited"))).otherwise(False)
    keys = ["doc_id", "raw", "next_id", "next_raw"]
    sheet = cut(pairs.select(
        *keys, "bucket", "edited_bucket", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        like_next.cast("double").alias("near_next"), unchanged.alias("unchanged"),
    ))
    other = F.when(~F.col("unchanged"), F.col("edited_bucket"))
    shared = _shared(sheet.select(F.explode(F.array("bucket", other)).alias("bucket")).where("bucket IS NOT NULL"))
    mine = sheet.join(shared, "bucket", "left_semi").select(F.col("raw").alias("key")).distinct()
    own = _flagged(base, F.col("raw"), cut(mine)).select("doc_id", "raw", canonical(F.col("text")).alias("canon"))
    own = own.select("doc_id", "raw", _bucket(*_hashes(F.col("canon"))).alias("bucket"), "canon")
    made = sheet.where(~F.col("unchanged")).select(*keys, F.col("edited_bucket").alias("bucket")).join(shared, "bucket", "left_semi")
    made = _edited_texts(base, made.select(*keys, "bucket").distinct())
    numbers = collisions(own.select("bucket", "canon").unionByName(made.select("bucket", "canon")))
    out = sheet.withColumns({"fingerprint": F.col("bucket"), "edited_fingerprint": F.col("edited_bucket")})
    if numbers is not None:
        suffix = lambda n: F.when(F.col(n) > 1, F.concat(F.lit("-"), F.col(n).cast("string"))).otherwise("")
        theirs = made.join(numbers, ["bucket", "canon"]).select(*keys, F.col("number").alias("made_number")).distinct()
        mine = own.join(numbers, ["bucket", "canon"]).select("doc_id", "raw", F.col("number").alias("own_number")).distinct()
        out = _null_safe_left(_null_safe_left(out, mine, ["doc_id", "raw"]), theirs, keys)
        out = out.withColumn("made_number", F.when(F.col("unchanged"), F.col("own_number")).otherwise(F.col("made_number")))
        out = out.withColumns({"fingerprint": F.concat("bucket", suffix("own_number")), "edited_fingerprint": F.concat("edited_bucket", suffix("made_number"))})
    near = (F.col("fingerprint") == F.col("edited_fingerprint")).cast("double")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near.alias("near_edited"), "near_next")


def _null_safe_left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    right = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    return left.join(right, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left").drop(*[f"__{k}" for k in keys])


def _edited_texts(base: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges with ``canon``, the canonical edited text of each."""
    edges = cut(edges)
    raws = cut(edges.select(F.explode(F.array("raw", "next_raw")).alias("key")).distinct())
    texts = _flagged(base, F.col("raw"), raws)
    first = texts.select(F.col("doc_id").alias("d1"), F.col("raw").alias("r1"), F.col("text").alias("t1")).distinct()
    second = texts.select(F.col("doc_id").alias("d2"), F.col("raw").alias("r2"), F.col("text").alias("t2")).distinct()
    both = edges.join(first, F.col("doc_id").eqNullSafe(F.col("d1")) & (F.col("raw") == F.col("r1"))).join(second, F.col("next_id").eqNullSafe(F.col("d2")) & (F.col("next_raw") == F.col("r2")))
    return both.select(*edges.columns, canonical(edited(F.col("t1"), F.col("t2"))).alias("canon"))
