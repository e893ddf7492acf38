"""Statistics: guarded correlations, rank tests, trends, fences and concentration."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from ..session import shipped
from ..sources.stage import saved
from .quantiles import exact_quantiles
from .ranks import mean_ranks


def pearson(x: Column, y: Column, least: int = 3) -> Column:
    """Pairwise complete; NULL for fewer than least rows or a constant side. Built from moments, since corr raises on constants."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when((F.count(a) >= least) & (F.count_distinct(a) >= 2) & (F.count_distinct(b) >= 2) & (spread > 0), F.try_divide(F.covar_pop(a, b), spread))


def pearson_test(df: DataFrame, x: str, y: str, *group: str) -> DataFrame:
    """n of complete pairs, r and its two-sided p, for each group."""
    shipped(df.sparkSession)
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    out = df.groupBy(*group).agg(F.count(F.when(a.isNotNull() & b.isNotNull(), 1)).alias("n"), pearson(a, b).alias("r"))
    return out.withColumn("p", correlation_p_of(F.col("r"), F.col("n")))


def mean_rank(value: str, group: str, *groups: str) -> Column:
    """The mean rank within a group. See ranks.mean_ranks for whole tables."""
    by = (group, *groups)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (ties - 1) / 2


def spearman(df: DataFrame, x: str, y: str, *group: str) -> DataFrame:
    """n, rho and its two-sided p for each group, over complete rows and mean ranks. Without groups, ranks come from counted values, so no task sees the whole table."""
    shipped(df.sparkSession)
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    if group:
        ranked = rows.withColumns({"__x": mean_rank(x, *group), "__y": mean_rank(y, *group)}).withColumn("__n", F.lit(1))
    else:
        # Saved, since each side of the joins must have the same values: means of doubles vary with the order of their rows.
        counts = saved(rows.groupBy(x, y).agg(F.count(F.lit(1)).alias("__n")))
        ranked = counts.join(mean_ranks(counts, x, "__n").select(x, F.col("rank").alias("__x")), x).join(mean_ranks(counts, y, "__n").select(y, F.col("rank").alias("__y")), y)
    n = F.sum("__n")
    mean = lambda c: F.sum(c * F.col("__n")) / n
    a, b = F.col("__x"), F.col("__y")
    va, vb, cov = mean(a * a) - mean(a) * mean(a), mean(b * b) - mean(b) * mean(b), mean(a * b) - mean(a) * mean(b)
    rho = F.when((n >= 3) & (F.count_distinct(a) >= 2) & (F.count_distinct(b) >= 2), F.try_divide(cov, F.sqrt(va * vb)))
    out = ranked.groupBy(*group).agg(n.cast("long").alias("n"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho)).alias("rho"))
    return out.withColumn("p", correlation_p_of(F.col("rho"), F.col("n")))


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """H with tie correction, groups, n, p and epsilon squared; one row, NULL for fewer than two groups."""
    shipped(df.sparkSession)
    cells = saved(df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("m")))
    ranks = mean_ranks(cells, value, "m")
    c = F.col("ties").cast("double")
    ties = ranks.agg(F.sum(c * c * c - c).alias("t"))
    sums = cells.join(ranks, value).groupBy(group).agg(F.sum(F.col("m") * F.col("rank")).alias("s"), F.sum("m").alias("m")).agg(F.sum(F.col("s") * F.col("s") / F.col("m")).alias("q"), F.sum("m").alias("n"), F.count(F.lit(1)).alias("groups"))
    n, k = F.col("n").cast("double"), F.col("groups")
    h = F.when(k >= 2, F.try_divide(12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1), 1 - F.col("t") / (n * n * n - n)))
    out = sums.crossJoin(F.broadcast(ties)).select("groups", "n", h.alias("h"))
    return out.select("groups", "n", "h", chi2_p_of(F.col("h"), F.col("groups") - 1).alias("p"), (F.col("h") / ((F.col("n") * F.col("n") - 1) / (F.col("n") + 1))).alias("epsilon2"))


def mann_whitney(df: DataFrame, group: str, value: str, a: str, b: str) -> DataFrame:
    """U of group a against b, the sizes and the two-sided p (normal, with ties and continuity); one row."""
    shipped(df.sparkSession)
    cells = saved(df.filter(F.col(group).isin(a, b) & F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("m")))
    ranks = mean_ranks(cells, value, "m")
    one = F.col(group) == a
    n_a, n_b, m = F.sum(F.when(one, F.col("m")).otherwise(0)), F.sum(F.when(one, 0).otherwise(F.col("m"))), F.col("m")
    sums = cells.join(ranks, value).agg(n_a.alias("n_a"), n_b.alias("n_b"), (F.sum(F.when(one, m * F.col("rank"))) - n_a * (n_a + 1) / 2).alias("u"))
    c = F.col("ties").cast("double")
    out = sums.crossJoin(F.broadcast(ranks.agg(F.sum(c * c * c - c).alias("t"))))
    x, y, n = F.col("n_a").cast("double"), F.col("n_b").cast("double"), (F.col("n_a") + F.col("n_b")).cast("double")
    spread = F.sqrt(x * y / 12 * ((n + 1) - F.col("t") / (n * (n - 1))))
    z = F.try_divide(F.greatest(F.abs(F.col("u") - x * y / 2) - 0.5, F.lit(0.0)), spread)
    return out.select("n_a", "n_b", "u", normal_p_of(z).alias("p"))


def fences(df: DataFrame, *values: str, k: float = 1.5) -> DataFrame:
    """One row: low_<value> and high_<value> for each column, k times the distance of the exact quartiles beyond them. df is read three times; save it first if it is costly."""
    row = exact_quantiles(df, {f"{v}{i}": (v, q) for v in values for i, q in ((1, 0.25), (3, 0.75))})
    far = lambda v: k * (F.col(f"{v}3") - F.col(f"{v}1"))
    return row.select(*(c for v in values for c in ((F.col(f"{v}1") - far(v)).alias(f"low_{v}"), (F.col(f"{v}3") + far(v)).alias(f"high_{v}"))))


def outside_fences(df: DataFrame, value: str, k: float = 1.5) -> DataFrame:
    """The rows of df whose value lies beyond the fences of the whole table."""
    out = df.crossJoin(F.broadcast(fences(df.select(value), value, k=k)))
    return out.filter((F.col(value) < F.col(f"low_{value}")) | (F.col(value) > F.col(f"high_{value}"))).select(*df.columns)


def sample_skewness(value: str) -> Column:
    n = F.count(value).cast("double")
    return F.when(n > 2, F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, out = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300), 0.0
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def correlation_p(r: float, n: int) -> float:
    """Two-sided p of a correlation, by Student's t with n - 2 degrees."""
    if n < 3:
        return float("nan")
    if abs(r) >= 1:
        return 0.0
    t2 = r * r * (n - 2) / (1 - r * r)
    return incomplete_beta((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def chi2_tail(x: float, k: int) -> float:
    """P(chi-squared with k degrees > x), by the series of the incomplete gamma function or its continued fraction."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for i in range(1, 1000):
            term *= x / (a + i)
            total += term
            if term < total * 1e-16:
                break
        return 1 - front * total
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        b += 2
        d = 1 / (b - i * (i - a) * d)
        c = b - i * (i - a) / c
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def _each(f, *columns: pd.Series) -> pd.Series:
    return pd.Series([None if any(pd.isna(v) for v in row) else f(*row) for row in zip(*columns, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def _correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    return _each(correlation_p, r, n)


@F.pandas_udf(DoubleType())
def _chi2_p(x: pd.Series, k: pd.Series) -> pd.Series:
    return _each(chi2_tail, x, k)


@F.pandas_udf(DoubleType())
def _normal_p(z: pd.Series) -> pd.Series:
    return _each(lambda v: math.erfc(abs(v) / math.sqrt(2)), z)


def correlation_p_of(r: Column, n: Column) -> Column:
    """correlation_p of aggregated rows; NULL and fewer than three rows give NULL."""
    return F.when(r.isNotNull() & (n >= 3), _correlation_p(r, n))


def chi2_p_of(x: Column, k: Column) -> Column:
    return F.when(x.isNotNull() & (k >= 1), _chi2_p(x, k))


def normal_p_of(z: Column) -> Column:
    """The two-sided p of a standard score."""
    return F.when(z.isNotNull(), _normal_p(z))
