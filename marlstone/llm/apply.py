"""Row-wise work on a text column over Arrow batches: columns in, columns out, nothing shuffled."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .store import shipped


def trimmed() -> None:
    """Gives freed memory back to the system, since workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def quoted(name: str) -> Column:
    """The column of that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(docs: DataFrame, name: str = "row") -> Column:
    """All columns of docs in one struct, beside which columns of any name can stand; select("row.*") gives them back."""
    return F.struct(*map(quoted, docs.columns)).alias(name)


def annotated(docs: DataFrame, text_col: str, keep: list[str], fields: str, make: Callable[[], Callable[[pa.Array], list]]) -> DataFrame:
    """The columns keep of docs, and fields that the function made by make (once a task) derives from slices of text_col. Kept columns that are named like a field, in any case of letters, give way to it."""
    new = T.StructType.fromDDL(fields)
    keep = [c for c in keep if c.lower() not in {n.lower() for n in new.names}]
    rows = docs.select(*(quoted(c).alias(f"k{i}") for i, c in enumerate(keep)), quoted(text_col).alias("text"))
    schema = T.StructType([*rows.schema.fields[:-1], *(T.StructField(f"v{i}", f.dataType) for i, f in enumerate(new))])
    arrow = [arrow_type(f.dataType) for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            text = batch.column(len(keep))
            for at, end in words.batches(text):
                out = work(text.slice(at, end - at))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, end - at) for i in range(len(keep))), *(x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(out, arrow, strict=True))], schema.names)
            trimmed()

    shipped(docs.sparkSession)
    return rows.mapInArrow(run, schema).toDF(*keep, *new.names)


def gathered(docs: DataFrame, text_col: str, keep: list[str], schema: str, make: Callable[[], Callable[..., dict]]) -> DataFrame:
    """Rows of another schema that the function made by make derives from slices of text_col and the columns keep."""
    rows = docs.select(*(quoted(c).alias(f"k{i}") for i, c in enumerate(keep)), quoted(text_col).alias("text"))
    arrow = [(f.name, arrow_type(f.dataType)) for f in T.StructType.fromDDL(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            text = batch.column(len(keep))
            for at, end in words.batches(text):
                out = work(text.slice(at, end - at), *(batch.column(i).slice(at, end - at) for i in range(len(keep))))
                yield pa.RecordBatch.from_arrays([x if isinstance(x := out[n], pa.Array) else pa.array(x, t) for n, t in arrow], [n for n, _ in arrow])
            trimmed()

    shipped(docs.sparkSession)
    return rows.mapInArrow(run, schema)


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
