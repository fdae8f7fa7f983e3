"""Incremental loading of call tables, each micro-batch compared with what is known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_calls(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(events: DataFrame, time: str, kind: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by window and kind; rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def append_new(batch: DataFrame, target: str, keys: list[str]) -> None:
    """Appends the rows whose keys the table at target hasn't; for foreachBatch, and safe to repeat."""
    spark = batch.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    known = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    fresh = batch.dropDuplicates(keys)
    (fresh.join(spark.read.parquet(target).select(*keys), keys, "left_anti") if known else fresh).write.mode("append").parquet(target)
