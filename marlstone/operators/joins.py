"""Joins beyond equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Bytes of a block of queries that is broadcast.
BLOCK_BYTES = 128 << 20


def few_copies(queries: DataFrame, k: int) -> DataFrame:
    """The queries, equal rows ``k`` times at most: more change nothing in the first k results of an id. One shuffle, combined by map tasks."""
    counted = queries.groupBy(*queries.columns).agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("__copies"))
    return counted.select(*queries.columns, F.explode(F.sequence(F.lit(1), "__copies")).alias("__copy")).drop("__copy")


def in_blocks(queries: DataFrame, by: list[str], size: Column, most: int = BLOCK_BYTES) -> list[DataFrame]:
    """The queries in blocks of about ``most`` bytes, each with a broadcast hint; together they are all rows.

    size: bytes of a row, summed before anything is broadcast.  Rows are dealt by a hash of ``by``; with
    the id and the vector among them an id of very many different rows is dealt too.  Of rows equal in those there should be
    few, see ``few_copies``.
    """
    total = queries.agg(F.sum(size)).first()[0] or 0
    blocks = max(1, -(-int(total) // most))
    if blocks == 1:
        return [F.broadcast(queries)]
    return [F.broadcast(queries.where(F.pmod(F.xxhash64(*by), F.lit(blocks)) == b)) for b in range(blocks)]


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, tie: str, values: dict[str, str]) -> DataFrame:
    """Each left row with the last right row of its key at or before its time.

    values: new names of right columns.  Of right rows at one time the greatest
    ``tie`` wins.  Left rows without a match stay, with nulls.

    Both sides are united and swept in order of time: one shuffle on the key, one
    sort, and no pairs, however many rows a key has.
    """
    held = F.struct(*[F.col(c).alias(n) for c, n in values.items()])
    columns = left.columns
    a = left.select(F.col(key).alias("__key"), F.col(left_time).alias("__time"), F.lit(1).alias("__side"), F.lit(None).cast("long").alias("__tie"), F.struct(*columns).alias("__left"))
    b = right.select(F.col(key).alias("__key"), F.col(right_time).alias("__time"), F.lit(0).alias("__side"), F.col(tie).cast("long").alias("__tie"), held.alias("__right"))
    w = W.partitionBy("__key").orderBy("__time", "__side", "__tie").rowsBetween(W.unboundedPreceding, 0)
    swept = a.unionByName(b, allowMissingColumns=True).withColumn("__last", F.last("__right", ignorenulls=True).over(w))
    return swept.where("__side = 1").select("__left.*", *[F.col("__last")[n].alias(n) for n in values.values()])


def interval_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, seconds: int) -> DataFrame:
    """Pairs of rows of one key, the right one at most ``seconds`` after the left one, and not before.

    Times are cut into buckets of that length, so that a row meets only rows of its
    own and the next bucket: an equi-join on (key, bucket), however long a key's
    history is.  Columns of the two sides must have different names, but for the key.
    """
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (seconds * 1_000_000)).cast("long")
    a = left.withColumn("__bucket", F.explode(F.array(bucket(left_time), bucket(left_time) + 1)))
    b = right.withColumn("__bucket", bucket(right_time))
    near = F.col(right_time).between(F.col(left_time), F.col(left_time) + F.expr(f"INTERVAL {seconds} SECONDS"))
    return a.join(b, [key, "__bucket"]).where(near).drop("__bucket")


def band_join(points: DataFrame, bands: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Points and the bands [low, high) that hold them, met in cells of ``width``."""
    cell = lambda c: F.floor(c / width).cast("long")
    b = bands.withColumn("__cell", F.explode(F.sequence(cell(F.col(low)), cell(F.col(high)))))
    p = points.withColumn("__cell", cell(F.col(value)))
    return p.join(b, "__cell").where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("__cell")


def null_equal(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)
