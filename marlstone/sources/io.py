"""Readers and writers: text tables without inference, landing folders, JSON settings, keyed upserts."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _files(spark: SparkSession, path: str) -> list[str]:
    """The files that a path, folder or glob names, asked of Spark's own file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for status in system.globStatus(p) or []:
        inner = system.listStatus(status.getPath()) if status.isDirectory() else [status]
        out += [x.getPath().toString() for x in inner if x.isFile() and not x.getPath().getName().startswith(("_", "."))]
    return sorted(out)


def _header(spark: SparkSession, file: str) -> tuple[str, ...]:
    """The names in a file's first line, without a byte order mark or blanks around them; none for an empty file. Only that line is read."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(file)
    stream = p.getFileSystem(conf).open(p)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(p)
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8")).readLine()
    finally:
        stream.close()
    return tuple(x.replace("\ufeff", "").strip() for x in next(csv.reader([line.replace("\ufeff", "")]), [])) if line else ()


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | Sequence[str]) -> DataFrame:
    """Quoted CSV with a header and newlines in fields, bound by name: columns may be in any order and differ between the files of a glob; those that a file lacks are NULL, others are left out.

    A list of names reads all as strings. Fields of other types are read as Spark's casts read them, what can't be read
    as NULL; empty fields are NULL. Files of one header are read together, so there is one scan for each header.
    """
    if not isinstance(schema, T.StructType):
        schema = T.StructType([T.StructField(c, T.StringType()) for c in schema])
    files = [f for one in ([path] if isinstance(path, str) else path) for f in _files(spark, one)]
    options = {"header": True, "multiLine": True, "escape": '"', "mode": "PERMISSIVE"}
    by_head: dict[tuple[str, ...], list[str]] = {}
    for f in files:
        by_head.setdefault(_header(spark, f), []).append(f)
    by_head.pop((), None)
    out = spark.createDataFrame([], schema)
    for head, mine in by_head.items():
        raw = spark.read.schema(T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(head))])).options(**options).csv(mine)
        at = {name.lower(): i for i, name in reversed(list(enumerate(head)))}
        rows = raw.select(*((F.col(f"c{at[f.name.lower()]}").try_cast(f.dataType) if f.name.lower() in at else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema))
        out = out.unionByName(rows)
    return out


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The CSV table at path, or an empty one of the schema where there is none."""
    return read_csv(spark, path, schema)


def read_first(spark: SparkSession, paths: Sequence[str], schema: T.StructType) -> DataFrame:
    """The first of paths that has files."""
    return read_csv(spark, next((p for p in paths if _files(spark, p)), []), schema)


def read_settings(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document over several lines."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def reindexed(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Exactly these columns, in order; those that are missing are NULL strings."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", mark: bool = False) -> None:
    """CSV with a header in each file; mark puts a byte order mark before it, as spreadsheets like it."""
    if mark:
        first, *rest = df.columns
        df = df.select(F.col(first).alias("\ufeff" + first), *rest)
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def append_csv(df: DataFrame, path: str, fields: Sequence[str]) -> None:
    """Adds df's rows to the table of CSV files at path, with exactly these columns. Every file has the header once, so any of them can be read alone and all of them together."""
    write_csv(reindexed(df, fields), path, "append")


def merged(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """All rows of both, the first of each key: old ones before new ones."""
    from ..operators.within import first_by

    both = old.withColumn("__p", F.lit(0)).unionByName(new.withColumn("__p", F.lit(1)), allowMissingColumns=True)
    return first_by(both, [key], [F.col("__p"), F.col(order)]).drop("__p")


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of old whose key is not in new, and all of new."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def counters_added(old: DataFrame, new: DataFrame, key: str, counters: Sequence[str]) -> DataFrame:
    right = new.select(key, *(F.col(c).alias(f"__{c}") for c in counters))
    return old.join(right, key, "full").select(key, *((F.coalesce(c, F.lit(0)) + F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in counters))


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text a row, NULL fields kept and NaN as NULL."""
    cols = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))
