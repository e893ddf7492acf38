"""Checks: required columns, joins of asserted cardinality, PASS/FAIL reports in one pass, tolerant comparison and table hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def require_columns(df: DataFrame, columns: Sequence[str], name: str = "table") -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{name} lacks {', '.join(missing)}")


def joined_once(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """A join whose right side must have one row a key: a second row raises when it is read."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*on))
    once = right.withColumn("__n", n).withColumn("__ok", F.when(F.col("__n") > 1, F.raise_error(F.lit("the right side has a repeated key")).cast("int")).otherwise(F.lit(1)))
    return left.join(once.filter("__ok = 1").drop("__n", "__ok"), list(on), how)


def report(df: DataFrame, rules: Sequence[tuple[str, Column, str]]) -> DataFrame:
    """Rules (name, predicate of a bad row, severity) counted in one pass: check_name, bad_rows, status (PASS, or the severity)."""
    counts = df.agg(*(F.count_if(F.coalesce(p, F.lit(False))).alias(n) for n, p, _ in rules))
    severity = F.create_map(*(F.lit(x) for n, _, s in rules for x in (n, s)))
    long = counts.unpivot([], [n for n, _, _ in rules], "check_name", "bad_rows")
    return long.withColumn("status", F.when(F.col("bad_rows") > 0, F.element_at(severity, F.col("check_name"))).otherwise("PASS"))


def compared(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, atol: float = 1e-9, rtol: float = 1e-9) -> DataFrame:
    """A full comparison of long tables: keys, both values and status."""
    both = left.select(*keys, F.col(value).alias("expected")).join(right.select(*keys, F.col(value).alias("actual")), list(keys), "full")
    near = F.abs(F.col("expected") - F.col("actual")) <= atol + rtol * F.abs(F.col("expected"))
    status = F.when(F.col("expected").isNull() & F.col("actual").isNull(), "BOTH_MISSING").when(F.col("expected").isNull(), "ONLY_ACTUAL").when(F.col("actual").isNull(), "ONLY_EXPECTED").when(near, "MATCH").otherwise("DIFFERENT")
    return both.withColumn("status", status)


def fingerprint(df: DataFrame) -> DataFrame:
    """Rows and an order-free hash of all of them, to hold tables against themselves before and after. Hashes are summed, so that repeated rows count each."""
    row = F.xxhash64(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("hash"))


def column_profile(df: DataFrame) -> DataFrame:
    """For each column: non-null, missing and distinct values, in one pass."""
    wide = df.agg(*(F.struct(F.count(c).alias("non_null"), F.count_if(F.col(c).isNull()).alias("missing"), F.count_distinct(F.col(c)).alias("distinct_values")).alias(c) for c in df.columns))
    return wide.unpivot([], df.columns, "column_name", "s").select("column_name", "s.*")


#: The dimensions of the quality score and what each weighs.
DIMENSIONS = (("Completeness", 0.30), ("Uniqueness", 0.20), ("Validity", 0.25), ("Consistency", 0.15), ("Source coverage", 0.10))


def quality_score(df: DataFrame, unique: Sequence[Column], valid: Sequence[Column], consistent: Sequence[Column], covered: Sequence[Column]) -> DataFrame:
    """dimension, score (0 to 100), weight, weighted and label, with a row TOTAL.

    Completeness is the share of cells that are not missing. Uniqueness is the mean share of rows that are the first of
    their kind, and of those whose key (each of unique; NULL is a key) no other row has. The others are mean shares of
    rows for which a predicate holds; NULL does not.
    """
    cells = [F.col(c).isNotNull() for c in df.columns]
    share = lambda ps: 100 * sum((F.avg(F.coalesce(p, F.lit(False)).cast("double")) for p in ps), F.lit(0.0)) / len(ps)
    flat = df.agg(share(cells).alias("Completeness"), share(valid).alias("Validity"), share(consistent).alias("Consistency"), share(covered).alias("Source coverage"))
    whole = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n")).agg((F.count(F.lit(1)) / F.sum("n")).alias("u0"))
    alone = [df.groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n")).agg((F.sum(F.when(F.col("n") == 1, 1).otherwise(0)) / F.sum("n")).alias(f"u{i}")) for i, k in enumerate(unique, 1)]
    for one in (whole, *alone):
        flat = flat.crossJoin(F.broadcast(one))
    kinds = [f"u{i}" for i in range(len(unique) + 1)]
    flat = flat.withColumn("Uniqueness", 100 * sum((F.col(c) for c in kinds), F.lit(0.0)) / len(kinds))
    total = sum((F.col(n) * w for n, w in DIMENSIONS), F.lit(0.0))
    label = F.when(total >= 90, "Excellent").when(total >= 80, "Good").when(total >= 70, "Acceptable").when(total >= 60, "Needs Improvement").otherwise("Poor")
    row = lambda n, v, w, x: F.struct(F.lit(n).alias("dimension"), v.alias("score"), F.lit(w).alias("weight"), (v * w).alias("weighted"), x.cast("string").alias("label"))
    return flat.select(F.inline(F.array(*(row(n, F.col(n), w, F.lit(None)) for n, w in DIMENSIONS), row("TOTAL", total, 1.0, label))))
