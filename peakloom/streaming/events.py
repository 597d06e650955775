"""Extension (the analysed system has no streams): file streams over scored events; a drained stream equals the batch result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream over a parquet file or folder; the schema is the files' own."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def _drain(stream: DataFrame, mode: str) -> DataFrame:
    spark, name = stream.sparkSession, f"drained_{uuid.uuid4().hex}"
    at = scratch(spark, name)
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", at).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def _drain_files(stream: DataFrame, path: str, at: str, by: str | None = None) -> DataFrame:
    """The stream's finished rows as parquet files at path, each batch committed once, read back by the schema that it has."""
    spark = stream.sparkSession
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", at).trigger(availableNow=True)
    (writer.partitionBy(by) if by else writer).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def drained_counts(spark: SparkSession, path: str, least: float) -> DataFrame:
    """(event_type, day, n) of events whose value reaches least: a stateless filter, then a stateful count."""
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    day = F.floor(seconds / 86_400)
    return _drain(read_events(spark, path).filter(F.col("value") >= least).groupBy("event_type", day.alias("day")).agg(F.count("*").alias("n")), "complete")


def drained_sessions(spark: SparkSession, path: str, gap: str = "2 days", late: str = "10 days") -> DataFrame:
    """(user_id, start, end, n): gap clusters of each user as session windows, with a watermark, drained to files. Sessions that end after the watermark, the
    latest event less `late`, could still grow and aren't there."""
    events = read_events(spark, path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    got = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    root = scratch(spark, "sessions")
    return _drain_files(got.select("user_id", "w.start", "w.end", "n"), f"{root}/rows", f"{root}/checkpoint")


def split_stream(spark: SparkSession, path: str, out: str, halves: int = 2) -> DataFrame:
    """Writes each event to the folder of its user's half, by md5; bounded memory, one pass. Gives what was written."""
    half = F.conv(F.substring(F.md5(F.col("user_id").cast("string")), 1, 2), 16, 10).cast("int") % halves
    return _drain_files(read_events(spark, path).withColumn("half", half), out, f"{out}/_checkpoint", by="half")
