"""Duplicate removal within a watermark that keeps, beside, what it would drop as late."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch
from .drain import drain


@dataclass(frozen=True)
class Split:
    """A stream of rows in two: rows in time, each key once, and rows that came too late.

    The folders, in the shared one, hold the rows of each batch, the batches' latest
    times, and the state; the same ``Split`` continues after a stop.
    """

    key: str
    time: str
    seconds: int
    folder: str

    @classmethod
    def new(cls, spark: SparkSession, key: str, time: str, seconds: int) -> Split:
        return cls(key, time, seconds, scratch(spark, "split"))

    def run(self, stream: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Take all that the stream has: rows in time with each key once within the delay, and late rows, both of all runs so far.

        The line is the latest time of all earlier batches less the delay, as for a
        watermark.  A batch writes into folders of its own number, so one that runs again
        replaces what it wrote.  Rows without a time are late.
        """
        spark, schema = stream.sparkSession, stream.schema

        def write(batch: DataFrame, number: int) -> None:
            batch = batch.persist()
            try:
                marks = self._read(spark, "marks", "number long, latest timestamp").where(F.col("number") < number)
                line = marks.agg((F.max("latest") - F.expr(f"INTERVAL {self.seconds} SECONDS")).alias("line")).first()["line"]
                late = F.col(self.time).isNull() | (F.lit(False) if line is None else F.coalesce(F.col(self.time) < F.lit(line), F.lit(True)))
                for name, rows in (("late", batch.where(late)), ("timely", batch.where(~late))):
                    rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/number={number}")
                batch.agg(F.max(self.time).alias("latest")).select(F.lit(number).cast("long").alias("number"), "latest").write.mode("overwrite").parquet(f"{self.folder}/marks/batch={number}")
            finally:
                batch.unpersist()

        q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{self.folder}/split-state").trigger(availableNow=True).start()
        q.awaitTermination()
        for name in ("timely", "late"):
            self._read(spark, name, schema).limit(0).write.mode("append").parquet(f"{self.folder}/{name}/number=-1")  # there, if no batch came
        timely = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.folder}/timely")
        once = timely.withWatermark(self.time, f"{self.seconds} seconds").dropDuplicatesWithinWatermark([self.key])
        return drain(once, checkpoint=f"{self.folder}/once-state", out=f"{self.folder}/once"), self._read(spark, "late", schema)

    def _read(self, spark: SparkSession, name: str, schema) -> DataFrame:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.folder}/{name}")
