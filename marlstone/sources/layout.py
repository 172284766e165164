"""Tables laid out for the joins that read them: buckets by key, folders that a join prunes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import scratch


def bucketed(df: DataFrame, key: str, buckets: int, name: str = "bucketed") -> DataFrame:
    """``df`` as a table of ``buckets`` buckets by ``key``, each sorted and one file: joins and groups on the key read it without a shuffle.

    The files are in the shared folder, the table's name is new in the session's catalog.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", scratch(spark, name)).saveAsTable(table)
    return spark.table(table)


def by_folder(df: DataFrame, column: str, name: str = "folders") -> DataFrame:
    """``df`` in a folder for each value of ``column``: a join with few of the values reads their folders only, found while it runs."""
    path = scratch(df.sparkSession, name)
    df.hint("rebalance", column).write.partitionBy(column).parquet(path)
    fields = [f for f in df.schema.fields if f.name != column]
    return df.sparkSession.read.schema(type(df.schema)([*fields, df.schema[column]])).parquet(path).select(*[F.col(c) for c in df.columns])
