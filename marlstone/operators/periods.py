"""Audits of a table of periods against itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .clean import safe_ratio


def reconciled(df: DataFrame, period: str, parts: Sequence[str], total: str, running: dict[str, str], share: tuple[str, str]) -> DataFrame:
    """df with total_difference (parts less total), for each of running (column: its running sum) derived_ and difference_, and the share (part, written share in per cent) recomputed. A period's value is its running sum less the one before; the first is that itself. One row a period, so a window over all is small."""
    by = Window.orderBy(period)
    out = df.withColumn("total_difference", sum((F.col(p) for p in parts), F.lit(0)) - F.col(total))
    for c, r in running.items():
        derived = F.col(r) - F.when(F.row_number().over(by) == 1, F.lit(0)).otherwise(F.lag(r).over(by))
        out = out.withColumn(f"derived_{c}", derived).withColumn(f"difference_{c}", F.col(f"derived_{c}") - F.col(c))
    part, written = share
    return out.withColumn("share_difference_pp", F.col(written) - safe_ratio(F.col(part), F.col(total), 100.0))


def audited(df: DataFrame, period: str, parts: Sequence[str], total: str, running: dict[str, str], share: tuple[str, str], expected: int) -> DataFrame:
    """Nine checks of one table of periods: check, value, status (PASS, FAIL, REVIEW)."""
    rows = reconciled(df, period, parts, total, running, share)
    counted = [*parts, total, *running.values()]
    count = lambda ps: sum((F.coalesce(F.sum(p.cast("int")), F.lit(0)) for p in ps), F.lit(0))
    differs = lambda c: F.count_if(F.coalesce(F.col(c) != 0, F.lit(True)))
    missing = [F.col(c).isNull() for c in df.columns]
    last = F.max_by(running[total], period)
    checks = [
        ("row_count", F.count(F.lit(1)), F.count(F.lit(1)) == expected, "FAIL"),
        ("unique_period", F.count_distinct(period), F.count_distinct(period) == F.count(F.lit(1)), "FAIL"),
        ("missing_cells", count(missing), count(missing) == 0, "REVIEW"),
        ("negative_values", count([F.col(c) < 0 for c in counted]), count([F.col(c) < 0 for c in counted]) == 0, "FAIL"),
        ("total_mismatch_rows", differs("total_difference"), differs("total_difference") == 0, "FAIL"),
        *((f"running_{c}_mismatch_rows", differs(f"difference_{c}"), differs(f"difference_{c}") == 0, "FAIL") for c in running),
        ("sum_minus_last_running", F.sum(total) - last, F.coalesce(F.sum(total) == last, F.lit(False)), "FAIL"),
    ]
    row = [F.struct(F.lit(n).alias("check"), v.cast("long").alias("value"), F.when(ok, "PASS").otherwise(bad).alias("status")) for n, v, ok, bad in checks]
    return rows.agg(F.array(*row).alias("r")).select(F.inline("r"))
