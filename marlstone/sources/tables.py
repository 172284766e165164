"""Batch sources and sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a dataset folder; filters and columns chosen later reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: under ``spark.checkpoint.dir``, or a temporary one where that is unset in local mode, as in tests; on a cluster that is an error."""
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="marlstone-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """``df`` written to the shared folder and read again: computed once however often it is used, and not lost with an executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def csv_round_trip(df: DataFrame) -> DataFrame:
    """``df`` written as CSV with a header and read with its schema."""
    path = scratch(df.sparkSession, "csv")
    df.write.option("header", True).option("escape", '"').option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)
    return df.sparkSession.read.schema(df.schema).option("header", True).option("escape", '"').option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)


def json_round_trip(df: DataFrame) -> DataFrame:
    """``df`` written as JSON lines and read with its schema."""
    path = scratch(df.sparkSession, "json")
    df.write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)
    return df.sparkSession.read.schema(df.schema).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)


def partitioned_sink(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` written as Parquet in a folder per value of ``columns``, and read again; filters on them prune folders."""
    path = scratch(df.sparkSession, "partitioned")
    # Rebalancing keeps the number of files per folder small and splits hot values.
    df.hint("rebalance", *columns).write.partitionBy(*columns).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
