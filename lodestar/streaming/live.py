"""Live logs: Structured Streaming over the folders that logs are appended to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import times


def tail(spark: SparkSession, path: str, schema: StructType, files: int | None = None) -> DataFrame:
    """New rows of a Parquet folder, as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def counts(rows: DataFrame, ts: str = "Timestamp", bucket: str = "1 hour", late: str = "1 day", by: str | None = None) -> DataFrame:
    """Counts per time bucket; rows later than the watermark are dropped, as retention does."""
    keys = [F.window(ts, bucket)] + ([F.col(by)] if by else [])
    out = rows.withWatermark(ts, late).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    return out.select(F.col("window.start").alias("bucket"), *([by] if by else []), "count")


def ingest(rows: DataFrame, out: str, checkpoint: str, ts: str = "Timestamp", once: bool = True):
    """Append a stream to a log's day folders."""
    writer = rows.withColumn("_day", F.to_date(ts)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).partitionBy("_day")
    return (writer.trigger(availableNow=True) if once else writer).start()


def upserts(rows: DataFrame, merge, checkpoint: str, once: bool = True):
    """Give each micro-batch to merge(batch, id): periodic merging of batches."""
    writer = rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def auto_merge(rows: DataFrame, store, checkpoint: str, every: str = "1 HOUR", once: bool = False):
    """A stream of rows with _shard, _ID and fields: each micro-batch adds a segment to its shards and merges these alone."""

    def merge(batch: DataFrame, _: int) -> None:
        shards = [r[0] for r in batch.select("_shard").distinct().collect()]  # names of shards
        for s in shards:
            store.add(batch.where(F.col("_shard") == s).drop("_shard"), s)
        if shards:
            store.merge(*shards)

    writer = rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{int(times.frequency(every).total_seconds())} seconds")).start()
