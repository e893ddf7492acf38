"""Incremental tables over a landing folder: windowed counts with a watermark, duplicates dropped within it, and keyed tables by batch."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import buckets


def landing(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "2 days", at: str = "ts", kind: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums per window and kind; the same expression serves batch and stream, where late rows beyond the watermark are left out."""
    rows = events.withColumn("__at", F.col(at).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("__at", late)
    out = rows.groupBy(F.window("__at", size).alias("w"), kind).agg(F.count(F.lit(1)).alias("n_events"), F.round(F.sum(value), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), kind, "n_events", "total")


def newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the one with the largest order, ties by the whole row. Rows without a key are one key."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(F.col(key).alias("__key")).agg(F.max_by(whole, F.struct(order, F.xxhash64(*rows.columns))).alias("__row")).select("__row.*")


def first_reviews(rows: DataFrame, key: str, at: str, late: str = "2 days") -> DataFrame:
    """The first row of each key that comes in. A stream forgets a key once the watermark has passed its time by late, so that its state stays bounded: a key that comes again within that time is dropped, and so are rows that are later. A batch keeps one row a key, the earliest."""
    if rows.isStreaming:
        return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    order = F.struct(at, F.xxhash64(*rows.columns))
    return rows.groupBy(F.col(key).alias("__key")).agg(F.min_by(F.struct(*rows.columns), order).alias("__row")).select("__row.*")


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not among done's. Rows without a key are kept."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


class StopRequested(Exception):
    """Ends a stream between two batches."""


def _stop_asked(spark: SparkSession, marker: str | None) -> bool:
    if marker is None:
        return False
    p = spark._jvm.org.apache.hadoop.fs.Path(marker)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def collect_stream(stream: DataFrame, path: str, key: str, order: str, checkpoint: str, stop_marker: str | None = None, bucket_count: int = buckets.BUCKETS):
    """Adds to the table below path the rows of a stream whose keys it does not have, one of each key (the least by order).

    Keys that are done already are skipped by a join with the buckets that the batch touches, so a restart with a new checkpoint
    repeats nothing. Where a file is at stop_marker, the stream ends before its next batch: that batch's offsets stay planned in the checkpoint
    and are read first when it is started again. awaited() tells that end from a failure.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        if _stop_asked(batch.sparkSession, stop_marker):
            raise StopRequested(stop_marker)
        buckets.write(batch, path, key, buckets.keep_first(key, order), buckets=bucket_count)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def awaited(query, seconds: int = 600) -> bool:
    """Whether a stream ran to its end; False if it was stopped by its marker. Other failures are raised."""
    try:
        return bool(query.awaitTermination(seconds))
    except StreamingQueryException as e:
        if StopRequested.__name__ in str(e):
            return False
        raise


def upsert_stream(stream: DataFrame, path: str, key: str, order: str, checkpoint: str, bucket_count: int = buckets.BUCKETS):
    """Keeps the newest row of each key (by order) of a stream in a table of buckets below path. A batch rewrites only the buckets that it touches, and one that is run again after a failure changes nothing. A missing key is a key. latest() reads the table."""

    def write(batch: DataFrame, epoch: int) -> None:
        buckets.write(batch, path, key, lambda old, new: newest(old.unionByName(new), key, order), buckets=bucket_count)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table that upsert_stream or collect_stream keeps, as of its last batch."""
    return buckets.read(spark, path, schema)
