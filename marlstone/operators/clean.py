"""Cleaning: coercions that turn what they cannot read into NULL, guarded ratios, labels and flags."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def to_number(c: Column) -> Column:
    """A finite double or NULL; NaN counts as missing."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def to_integer(c: Column) -> Column:
    """Whole numbers only; anything else is NULL."""
    x = to_number(c)
    return F.when(x % 1 == 0, x.cast("long"))


def to_iso_date(c: Column, fmt: str = "yyyy-MM-dd") -> Column:
    return F.date_format(F.try_to_timestamp(c, F.lit(fmt)), "yyyy-MM-dd")


def safe_ratio(num: Column, den: Column, scale: float = 1.0) -> Column:
    """scale * num / den where den is positive, else NULL."""
    return F.when(den > 0, F.lit(scale) * num / den)


def first_label(rules: Sequence[tuple[Column, str]], default: str | None = None) -> Column:
    """The label of the first rule that holds."""
    return reduce(lambda rest, r: F.when(r[0], F.lit(r[1])).otherwise(rest), reversed(list(rules)), F.lit(default))


def banded(c: Column, edges: Sequence[float], labels: Sequence[str], right: bool = True) -> Column:
    """The label of the band of c, between -inf and +inf; right: a band holds its upper edge. NULL stays NULL."""
    return F.when(c.isNotNull(), first_label([((c <= e) if right else (c < e), x) for e, x in zip(edges, labels, strict=False)], labels[-1]))


def flags_text(flags: Sequence[tuple[Column, str]], none: str = "OK") -> Column:
    """The names of the flags that hold, joined by ';'."""
    return F.coalesce(F.nullif(F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in flags))), ";"), F.lit("")), F.lit(none))


def recoded(c: Column, table: dict[str, str], default: str | None = None) -> Column:
    pairs = F.create_map(*(F.lit(x) for k, v in table.items() for x in (k, v)))
    return F.coalesce(F.element_at(pairs, c), F.lit(default))


def swapped_number(c: Column, digits: int = 2) -> Column:
    """A number with '.' between thousands and ',' before decimals; a dash for NULL."""
    return F.coalesce(F.translate(F.format_number(c, digits), ",.", ".,"), F.lit("—"))


def strength(rho: Column) -> Column:
    """Five bands of a correlation's size, with its direction."""
    size = first_label([(F.abs(rho) >= 0.8, "very strong"), (F.abs(rho) >= 0.6, "strong"), (F.abs(rho) >= 0.4, "moderate"), (F.abs(rho) >= 0.2, "weak")], "very weak")
    return F.when(rho.isNotNull(), F.concat_ws(" ", size, first_label([(rho > 0, "positive"), (rho < 0, "negative")], "flat")))


def coercion_report(df: DataFrame, columns: Sequence[str], parse) -> DataFrame:
    """One row per column: rows that a coercion newly made missing, in one pass."""
    lost = df.agg(*(F.count_if(F.col(c).isNotNull() & parse(F.col(c)).isNull()).alias(c) for c in columns))
    return unpivoted(lost, list(columns), "column", "newly_missing")


def unpivoted(df: DataFrame, columns: Sequence[str], name: str, value: str, ids: Sequence[str] = ()) -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def small_folded(c: str, least: int, other: str = "Other") -> Column:
    """Categories of fewer rows than least become other."""
    from pyspark.sql.window import Window

    return F.when(F.count(F.lit(1)).over(Window.partitionBy(c)) < least, F.lit(other)).otherwise(F.col(c))


def shrunk(df: DataFrame, rating: str, votes: str, out: str = "weighted") -> DataFrame:
    """Ratings drawn to the overall mean: v / (v + m) of the rating, m the exact median of votes; the two scalars come as one broadcast row. df is read three times; save it first if it is costly."""
    scalars = df.agg(F.avg(rating).alias("__mean")).crossJoin(exact_quantiles(df, {"__m": (votes, 0.5)}))
    weight = F.col(votes) / (F.col(votes) + F.col("__m"))
    return df.crossJoin(F.broadcast(scalars)).withColumn(out, weight * F.col(rating) + (1 - weight) * F.col("__mean")).drop("__mean", "__m")
