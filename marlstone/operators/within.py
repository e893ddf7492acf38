"""Features of a row within its group, indices over groups, and top rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .quantiles import exact_quantiles


def group_median(value: str, group: str) -> Column:
    return F.percentile(value, F.lit(0.5)).over(Window.partitionBy(group))


def tie_percent_rank(value: str, group: str) -> Column:
    """The mean rank of ties over the non-missing rows of the group; NULL stays NULL."""
    by = Window.partitionBy(group).orderBy(F.col(value).asc_nulls_last())
    ties = F.count(F.lit(1)).over(Window.partitionBy(group, value))
    return F.when(F.col(value).isNotNull(), (F.rank().over(by) + (ties - 1) / 2) / F.count(value).over(Window.partitionBy(group)))


def min_max(value: str, *group: str) -> Column:
    """0 to 100 between the least and the largest; 50 where all are equal."""
    w = Window.partitionBy(*group)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(F.col(value).isNotNull(), F.when(high == low, 50.0).otherwise(100 * (F.col(value) - low) / (high - low)))


def available_mean(parts: Sequence[tuple[Column, float]], least: int = 1) -> Column:
    """The weighted mean of the parts that are not missing; NULL with fewer than least of them."""
    have = sum((F.when(c.isNotNull(), 1).otherwise(0) for c, _ in parts), F.lit(0))
    mass = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for c, w in parts), F.lit(0.0))
    return F.when((have >= least) & (mass > 0), sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts), F.lit(0.0)) / mass)


def quadrant(df: DataFrame, x: str, y: str, labels: tuple[str, str, str, str], out: str = "quadrant") -> DataFrame:
    """High x and y, high x only, high y only, neither, against the exact medians over complete rows (one broadcast row); NULL where either is missing. df is read three times; save it first if it is costly."""
    mid = exact_quantiles(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), {"__x": (x, 0.5), "__y": (y, 0.5)})
    hx, hy = F.col(x) >= F.col("__x"), F.col(y) >= F.col("__y")
    label = F.when(hx & hy, labels[0]).when(hx & ~hy, labels[1]).when(~hx & hy, labels[2]).when(~hx & ~hy, labels[3])
    return df.crossJoin(F.broadcast(mid)).withColumn(out, label).drop("__x", "__y")


def top_k(df: DataFrame, k: int, order: Sequence[Column], group: Sequence[str] = (), rank: str = "rn") -> DataFrame:
    """The first k rows of each group; order should end with a unique key."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(rank) <= k)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in order."""
    return top_k(df, 1, order, keys, "__rn").drop("__rn")


def share(value: str, *group: str) -> Column:
    total = F.sum(value).over(Window.partitionBy(*group))
    return F.when(total > 0, F.col(value) / total)


def running_share(value: str, order: Sequence[Column], *group: str) -> Column:
    w = Window.partitionBy(*group)
    return F.sum(value).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) / F.sum(value).over(w)


def top_text(df: DataFrame, group: str, name: str, value: str, k: int) -> DataFrame:
    """The k largest names of each group as 'name:value%|...', ties by name."""
    top = top_k(df, k, [F.col(value).desc(), F.col(name)], [group])
    items = F.sort_array(F.collect_list(F.struct("rn", F.concat(F.col(name), F.lit(":"), F.format_string("%.1f", F.col(value)), F.lit("%")).alias("t"))))
    return top.groupBy(group).agg(F.array_join(F.transform(items, lambda s: s["t"]), "|").alias("top"))


def masked_rank(value: str, eligible: Column) -> Column:
    """The rank from the largest on, ties at their first, among eligible rows that have a value; NULL for others. For tables of one row a group."""
    counts = eligible & F.col(value).isNotNull()
    return F.when(counts, F.rank().over(Window.partitionBy(counts).orderBy(F.desc(value))))


def indices(df: DataFrame, components: Mapping[str, tuple[str, bool]], weights: Mapping[str, tuple[Mapping[str, float], int]]) -> DataFrame:
    """df, one row a group, with its components and indices.

    A component is a column from 0 to 100 between its least and largest, turned round where asked. An index is the mean
    of its components by weight, over those that are not missing, and NULL with fewer than it needs.
    """
    out = df.withColumns({name: (100 - min_max(c)) if turned else min_max(c) for name, (c, turned) in components.items()})
    return out.withColumns({name: available_mean([(F.col(c), w) for c, w in parts.items()], least) for name, (parts, least) in weights.items()})
