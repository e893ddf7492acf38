"""Array expressions that stay within a row and take time in proportion to the array, or nearly so."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def counted(values: Column) -> Column:
    """The distinct values of an array with their counts, as structs (term, n) in order of term; an array for NULL is NULL."""
    # Equal values lie together once sorted; a run's length is the way to the next run's start.
    starts = lambda a: F.filter(F.transform(a, lambda t, i: F.when((i == 0) | (F.get(a, i - 1) != t), i)), lambda i: i.isNotNull())
    runs = lambda z: F.transform(z["s"], lambda i, k: F.struct(F.get(z["a"], i).alias("term"), (F.coalesce(F.get(z["s"], k + 1), F.size(z["a"])) - i).cast("long").alias("n")))
    return let(F.array_sort(values), lambda a: let(F.struct(a.alias("a"), starts(a).alias("s")), runs))


def letter_set(text: Column) -> Column:
    """The characters of a text, each with its number among equal ones, as a set: two texts share as many of these as their multisets of characters do."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.flatten(F.transform(counted(chars), lambda g: F.transform(F.sequence(F.lit(1), g["n"].cast("int")), lambda k: F.concat(g["term"], k.cast("string")))))
