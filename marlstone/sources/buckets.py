"""Keyed tables in buckets: a batch rewrites only the buckets that its keys fall in, and old versions stay readable until new ones are whole.

Below a table's folder, data/<version>/bucket=<n> has the rows of one bucket, and manifest/<version> says in which version each
bucket was last written. A batch reads the buckets that it touches, writes them under its own version, and then the
manifest, whose _SUCCESS file is the last that it writes: a batch that is lost before that changes nothing, and one that is run again
finds its version done. The folder of a version is left alone as long as one of the last two manifests names it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import io
from .stage import dropped, saved

#: Buckets of a new table. Their number is kept in its manifest; a bucket should stay well below a task's memory.
BUCKETS = 64
#: From rows of a bucket and those of a batch to the bucket's new rows.
Rule = Callable[[DataFrame, DataFrame], DataFrame]


def keep_first(key: str, order: str) -> Rule:
    """A key's first row stays, old ones before new ones."""
    return lambda old, new: io.merged(old, new, key, order)


def replace(key: str) -> Rule:
    """Rows whose key comes again go, and all of the batch are added."""
    return lambda old, new: io.upserted(old, new, key)


def add_counters(key: str, counters: Sequence[str]) -> Rule:
    """Counters of a key are added up; a missing one counts as zero."""
    return lambda old, new: io.counters_added(old, new, key, counters)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions whose manifest was written to its end."""
    p, fs = _path(spark, f"{path}/manifest/*/_SUCCESS")
    return sorted(int(x.getPath().getParent().getName()) for x in fs.globStatus(p) or [])


def _manifest(spark: SparkSession, path: str, version: int) -> tuple[int, dict[int, int]]:
    """The number of buckets, and the version of each that has rows."""
    rows = spark.read.schema("bucket int, version long").json(f"{path}/manifest/{version:012d}").collect()
    return next(r["version"] for r in rows if r["bucket"] < 0), {r["bucket"]: r["version"] for r in rows if r["bucket"] >= 0}


def _folders(path: str, table: dict[int, int]) -> list[str]:
    return [f"{path}/data/{v:012d}/bucket={b}" for b, v in sorted(table.items())]


def read(spark: SparkSession, path: str, schema, version: int | None = None) -> DataFrame:
    """The table as of a version, the last one if none is given; empty where nothing is written."""
    done = versions(spark, path)
    if not done:
        return spark.createDataFrame([], schema)
    _, table = _manifest(spark, path, done[-1] if version is None else version)
    return _rows(spark, path, schema, table)


def _rows(spark: SparkSession, path: str, schema, table: dict[int, int]) -> DataFrame:
    """Rows are written as one struct beside their bucket, so that columns of any name can stand."""
    none = spark.createDataFrame([], schema)
    kind = T.StructType([T.StructField("row", none.schema)])
    return spark.read.schema(kind).parquet(*_folders(path, table)).select("row.*") if table else none


def write(batch: DataFrame, path: str, key: str, rule: Rule, version: int | None = None, buckets: int = BUCKETS) -> int:
    """Merges a batch into the table below path by rule, and returns its version (the next one if none is given). A version that is done already is not written again. Rows without a key are in one bucket."""
    spark = batch.sparkSession
    done = versions(spark, path)
    version = (done[-1] + 1 if done else 0) if version is None else version
    if done and version <= done[-1]:
        return version
    buckets, table = _manifest(spark, path, done[-1]) if done else (buckets, {})
    of = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    new = saved(batch)
    touched = sorted(r["b"] for r in new.select(of.alias("b")).distinct().collect())
    have = {b: table[b] for b in touched if b in table}
    rows = rule(_rows(spark, path, batch.schema, have), new)
    rows = rows.select(F.struct(*(F.col(f"`{c}`") for c in batch.columns)).alias("row"), of.alias("bucket"))
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/{version:012d}")
    dropped(new)
    p, fs = _path(spark, f"{path}/data/{version:012d}/bucket=*")
    written = {int(x.getPath().getName().split("=")[1]) for x in fs.globStatus(p) or []}
    table = {b: v for b, v in table.items() if b not in touched} | dict.fromkeys(written, version)
    spark.createDataFrame([(-1, buckets), *sorted(table.items())], "bucket int, version long").coalesce(1).write.mode("overwrite").json(f"{path}/manifest/{version:012d}")
    _cleaned(spark, path, done[-1:], version, table)
    return version


def _cleaned(spark: SparkSession, path: str, before: list[int], version: int, table: dict[int, int]) -> None:
    """Deletes data that neither this version nor the one before names, and the manifests before them."""
    named = {version, *table.values()}
    for v in before:
        named |= set(_manifest(spark, path, v)[1].values())
    for folder, keep in (("data", named), ("manifest", {version, *before})):
        p, fs = _path(spark, f"{path}/{folder}/*")
        for x in fs.globStatus(p) or []:
            if int(x.getPath().getName()) < version and int(x.getPath().getName()) not in keep:
                fs.delete(x.getPath(), True)
