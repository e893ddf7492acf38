"""Global order without a global window: rows are dealt by ranges of their whole order, and what the ranges before hold is added."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.stage import saved


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def along(df: DataFrame, order: Sequence[str], new: Mapping[str, str | None], descending: bool = False, ranges: int | None = None) -> DataFrame:
    """df with new columns that run in the order of its columns (NULL first; descending: of the first of them only, its NULLs last): the row's number from 1 (None), or the sum of a column up to the row.

    Rows are written once in ranges of the whole order, whose bounds are sampled from all its columns, so that texts with
    a common beginning, NULLs and ties of the first column are split by the later ones; rows equal in all of them may
    lie in any order, and are split too. A range is sorted apart; the ranges' totals, one row each, are all that is
    looked at together. Columns of df may have any names but those that are new, which they give way to.
    """
    kept = [c for c in df.columns if c.lower() not in {n.lower() for n in new}]
    names = [f"k{i}" for i in range(len(order))]
    keys = [F.desc_nulls_last("k0") if descending else F.asc_nulls_first("k0"), *map(F.asc_nulls_first, names[1:]), F.asc("nth")]
    rows = df.select(F.struct(*map(_quoted, df.columns)).alias("row"), *(_quoted(c).alias(k) for c, k in zip(order, names, strict=True))).withColumn("nth", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(*([ranges] if ranges else []), *keys)
    dealt = saved(dealt.withColumn("part", F.spark_partition_id()))
    value = lambda c: F.lit(1) if c is None else F.coalesce(F.col("row")[c], F.lit(0))
    totals = dealt.groupBy("part").agg(*(F.sum(value(c)).alias(f"t{i}") for i, c in enumerate(new.values())))
    past = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", *(F.coalesce(F.sum(f"t{i}").over(past), F.lit(0)).alias(f"t{i}") for i in range(len(new))))
    here = Window.partitionBy("part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(totals), "part")
    return out.select(*(F.col("row")[c].alias(c) for c in kept), *((F.col(f"t{i}") + F.sum(value(c)).over(here)).alias(name) for i, (name, c) in enumerate(new.items())))


def numbered(df: DataFrame, order: Sequence[str], out: str, descending: bool = False, ranges: int | None = None) -> DataFrame:
    """df with out, the row's number from 1 in the order of its columns (descending: of the first of them only); the last should be unique."""
    return along(df, order, {out: None}, descending, ranges)


def mean_ranks(df: DataFrame, value: str, times: str | None = None) -> DataFrame:
    """(value, ties, rank): each distinct value with its rows and their mean rank among all. Rows are counted before anything is sorted; times: a column that says how many rows a row stands for.

    Join the result only with rows that were saved: a mean of doubles that is computed again may differ in its last bit.
    """
    many = F.count(F.lit(1)) if times is None else F.sum(_quoted(times))
    counts = df.filter(_quoted(value).isNotNull()).groupBy(_quoted(value).alias(value)).agg(many.alias("ties"))
    return along(counts, [value], {"rank": "ties"}).select(_quoted(value), "ties", (F.col("rank") - (F.col("ties") - 1) / 2).alias("rank"))
