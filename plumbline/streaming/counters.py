"""Running counters and windows over a stream of requests, with checkpoints so that a run can go on after a failure."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``folder`` (a file or a folder) as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    one_file = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    reader = spark.readStream.schema(schema).format("parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").load(folder) if one_file else reader.load(f"{folder}/{name}.parquet")


def running(requests: DataFrame) -> DataFrame:
    """Counters by kind since the stream began (complete mode)."""
    return requests.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("largest"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def windowed(requests: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counters by window of event time; rows later than the watermark are left out (an extension)."""
    by = F.window(F.col("at"), width)
    return requests.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).groupBy(by, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def drain(result: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there now and give its result (a bounded aggregate) as a table."""
    spark = result.sparkSession
    name = f"drain_{uuid.uuid4().hex}"
    root = spark.conf.get("spark.checkpoint.dir", None)
    writer = result.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    if root:
        writer = writer.option("checkpointLocation", f"{root}/{name}")
    writer.start().awaitTermination()
    return spark.table(name)
