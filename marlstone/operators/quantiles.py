"""Exact quantiles by distributed selection: no task ever holds more than a bracket of rows around the ranks wanted.

A sketch of fixed size gives a bracket around each rank that is wanted. One scan then counts the rows below each bracket
and the distinct values inside it. While a bracket is still expected to hold more than FEW rows, rounds of the same kind
narrow it: a sketch of the rows inside it and counts against it. The sketch's error is bounded, so that the ranks wanted
lie inside; the exact counts prove it. What remains is a walk along some FEW distinct values.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows in a bracket that are looked at one by one, the sketch's accuracy, and the parts that a round cuts a bracket in.
FEW, ACCURACY, PARTS = 100_000, 10_000, 100

#: Columns or names, each with the fraction wanted.
Wanted = Mapping[str, tuple[Column | str, float]]


def _values(df: DataFrame, wanted: Wanted) -> DataFrame:
    return df.select(*((F.col(c) if isinstance(c, str) else c).cast("double").alias(f"v{i}") for i, (c, _) in enumerate(wanted.values())))


def _brackets(rows: DataFrame, fractions: list[float], few: int) -> list[tuple[int, float, float] | None]:
    """For each column v0, v1, ...: its rows, and the least and largest value of a bracket that holds the ranks wanted; None without rows."""
    k, margin = range(len(fractions)), 2 / ACCURACY
    ends = lambda i: F.percentile_approx(f"v{i}", [max(0.0, fractions[i] - margin), min(1.0, fractions[i] + margin)], ACCURACY)
    seen = rows.agg(*(F.struct(F.count(f"v{i}").alias("n"), F.min(f"v{i}").alias("low"), F.max(f"v{i}").alias("high"), ends(i).alias("ends")).alias(f"b{i}") for i in k)).first()
    whole = [seen[f"b{i}"] for i in k]
    out: list = [(b["n"], *b["ends"]) if b["n"] else None for b in whole]
    # The rows that a bracket is expected to hold; one with few is never counted apart.
    expect = [4 * margin * b["n"] if b["n"] > few else 0 for b in whole]
    if any(b["n"] <= few for b in whole):
        out = [(b["n"], b["low"], b["high"]) if b["n"] and b["n"] <= few else o for b, o in zip(whole, out, strict=True)]
    sure = [(b["low"], b["high"]) for b in whole]
    todo = {i for i in k if out[i] and expect[i] > few}
    slack, held = dict.fromkeys(todo, 1), {i: whole[i]["n"] for i in todo}
    while todo:
        cells = []
        for i in todo:
            _, low, high = out[i]
            v = F.col(f"v{i}")
            inside = F.when((v >= low) & (v <= high), v)
            cells.append(F.struct(F.count_if(v < low).alias("below"), F.count(inside).alias("n"), F.percentile_approx(inside, [p / PARTS for p in range(PARTS + 1)], ACCURACY).alias("ends")).alias(f"b{i}"))
        seen = rows.agg(*cells).first()
        for i in sorted(todo):
            b, (n, low, high) = seen[f"b{i}"], out[i]
            first, last = _ranks(n, fractions[i])
            if not (b["below"] <= first and last < b["below"] + b["n"]):
                out[i], slack[i] = (n, *sure[i]), 4 * slack[i]  # the sketch missed: begin again from what is sure, with more room
                continue
            if sure[i] != (low, high) and b["n"] >= held[i]:
                todo.discard(i)  # ties, or a sketch too coarse to part what is left
                continue
            sure[i], held[i] = (low, high), b["n"]
            step = b["n"] / PARTS
            at, to = (first - b["below"]) / step, (last - b["below"]) / step
            new = (b["ends"][max(0, math.floor(at) - slack[i])], b["ends"][min(PARTS, math.ceil(to) + slack[i])])
            if new == (low, high) or b["n"] <= few:
                todo.discard(i)
            else:
                out[i] = (n, *new)
    return out


def _ranks(n: int, fraction: float) -> tuple[int, int]:
    """The ranks, from 0, between which a fraction of n sorted rows lies."""
    at = fraction * (n - 1)
    return math.floor(at), min(math.floor(at) + 1, n - 1)


def exact_quantiles(df: DataFrame, wanted: Wanted, few: int = FEW) -> DataFrame:
    """One row with a column for each name of wanted: the quantile at that fraction of a column's values as doubles, interpolated between its two neighbours.

    NULLs are left out; a column without values gives NULL. df is scanned three times, or a little more often if it has
    more than some 10^8 rows; save it first if it is costly to compute.
    """
    rows = _values(df, wanted)
    fractions = [q for _, q in wanted.values()]
    brackets = _brackets(rows, fractions, few)
    cells, picks = [], []
    for i, (name, q, b) in enumerate(zip(wanted, fractions, brackets, strict=True)):
        if b is None:
            continue
        n, low, high = b
        v = F.col(f"v{i}")
        # What lies below the bracket is counted as one row without a value.
        cells.append(F.when(v <= high, F.struct(F.lit(i).alias("i"), F.when(v >= low, v).alias("v"))))
        first, last = _ranks(n, q)
        at = lambda r, i=i: F.min(F.when((F.col("i") == i) & (F.col("upto") > r), F.col("v")))
        below = F.max(F.when((F.col("i") == i) & F.col("v").isNull(), F.col("upto")))
        picks.append((name, at(first), at(last), F.coalesce(below, F.lit(0)), i, first, q * (n - 1) - first))
    if not picks:
        return rows.limit(0).agg(F.count(F.lit(1)).alias("n")).select(*(F.lit(None).cast("double").alias(name) for name in wanted))
    counts = rows.select(F.explode(F.array_compact(F.array(*cells))).alias("x")).groupBy("x.i", "x.v").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("i").orderBy(F.asc_nulls_first("v")))
    walked = counts.withColumn("upto", upto)
    found = walked.agg(*(F.struct(a.alias("a"), b.alias("b"), below.alias("below")).alias(f"q{i}") for _, a, b, below, i, _, _ in picks))
    sure = lambda i, first: (F.col(f"q{i}.below") <= first) & F.col(f"q{i}.b").isNotNull()
    value = lambda i, part: F.col(f"q{i}.a") + F.lit(part) * (F.col(f"q{i}.b") - F.col(f"q{i}.a"))
    values = {name: F.when(sure(i, first), value(i, part)).otherwise(F.raise_error("the table changed between two scans")) for name, _, _, _, i, first, part in picks}
    return found.select(*(values[name].alias(name) if name in values else F.lit(None).cast("double").alias(name) for name in wanted))


def with_quantiles(df: DataFrame, wanted: Wanted, few: int = FEW) -> DataFrame:
    """df with the exact quantiles of its columns in every row; they are one broadcast row."""
    return df.crossJoin(F.broadcast(exact_quantiles(df, wanted, few)))
