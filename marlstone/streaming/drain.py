"""File streams that are run until all input is used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch


def file_stream(spark: SparkSession, folder: str, name: str, schema=None) -> DataFrame:
    """A stream over the Parquet files called ``name`` in a folder, or over the files of a folder called so."""
    schema = spark.read.parquet(f"{folder}/{name}").schema if schema is None else schema
    reader = spark.readStream.schema(schema)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{folder}/{name}")
    return reader.option("pathGlobFilter", name).parquet(folder)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream; watermarks need a timestamp with a zone."""
    return file_stream(spark, sf_dir, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str = "append", checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Run a stream over all there is, into Parquet, and read the result. The same folders continue a run."""
    spark = stream.sparkSession
    out, checkpoint = out or scratch(spark, "stream-out"), checkpoint or scratch(spark, "stream-state")
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
