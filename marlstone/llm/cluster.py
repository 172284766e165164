"""What the operators share about running on a cluster."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import time

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session.

    Where none is named a temporary one is set in local mode, as in tests; on a
    cluster that is an error, as executors would not share it.
    """
    named = spark.sparkContext.getCheckpointDir()
    if named is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="marlstone-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that lost executors cost no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def connected(edges: DataFrame) -> DataFrame:
    """``node, label`` (long) of every node of an edge; the label is the least node it is connected to.

    edges: ``a, b`` (long).  Alternates large and small stars until nothing changes,
    in rounds that grow with the logarithm of the size; each round is kept in the
    shared folder.  Neither edges nor components reach the driver.
    """
    ordered = lambda df: df.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi > lo").distinct()
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
    now = cut(ordered(edges))
    before, after = None, state(now)
    while before != after:
        both = now.select(F.col("hi").alias("a"), F.col("lo").alias("b")).unionByName(now.select(F.col("lo").alias("a"), F.col("hi").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("hi"), F.col("m").alias("lo")).distinct()
        floor = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(floor, "hi").select(F.explode(F.array(F.struct(F.col("hi").alias("a"), F.col("m").alias("b")), F.struct(F.col("lo").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = cut(ordered(small))
        before, after = after, state(now)
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("label")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct())


def small_batches(spark: SparkSession, rows: int = 2000, mb: int = 16) -> None:
    """Lower the session's Arrow batches to ``rows`` rows and ``mb`` MB if they are larger: texts can be long, and a batch is held whole on both sides.

    A frame reads these settings when it runs, so they stay in the session.
    """
    units = {"b": 0, "k": 10, "m": 20, "g": 30}
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", mb << 20)):
        number, unit = re.match(r"(-?\d+)([bkmg]?)", spark.conf.get(f"spark.sql.execution.arrow.{key}").lower()).groups()
        if not 0 < int(number) << units.get(unit, 0) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def map_batches(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInArrow`` for columns of any name: ``run`` sees them in order, called c0, c1 and so on."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]).mapInArrow(run, schema)


def release() -> None:
    """Give freed memory back to the system, as Python workers stay for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def tidy(f):
    """A generator over batches that releases memory every second or so, and at its end."""

    @functools.wraps(f)
    def run(*args, **more):
        last = time.monotonic()
        try:
            for item in f(*args, **more):
                yield item
                del item
                if time.monotonic() - last > 1:
                    release()
                    last = time.monotonic()
        finally:
            release()

    return run
