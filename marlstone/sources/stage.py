"""Tables written once to the shared checkpoint folder and read again: they cut lineage, are computed once, and survive lost executors."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch

#: Spark's setting by which an execution deletes its shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Paths of tables that are not deleted yet, by application.
_written: dict[str, set[str]] = {}


def saved(df: DataFrame) -> DataFrame:
    """df, computed once, written as Parquet in the shared folder and read again. What was shuffled for it is deleted at once; else it stays until the driver happens to collect garbage, and steps add up on disk."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_path = path
    _written.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes tables of saved() that no later step reads."""
    for df in frames:
        _deleted(df.sparkSession, df._saved_path)


def _deleted(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _written.get(spark.sparkContext.applicationId, set()).discard(path)


def swept(spark: SparkSession, keep: set[str] | frozenset[str] = frozenset()) -> None:
    """Deletes all tables of saved() in this application but those of keep. Results of operators read such tables, so call it when these results are written."""
    for path in sorted(_written.get(spark.sparkContext.applicationId, set()) - keep):
        _deleted(spark, path)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What make returns, written, without the tables that were saved on the way."""
    before = set(_written.get(spark.sparkContext.applicationId, set()))
    out = saved(make())
    swept(spark, before | {out._saved_path})
    return out
