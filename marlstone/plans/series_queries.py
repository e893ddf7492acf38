"""Queries over period series: reconciliation, year on year, indices, seasonality, peaks, lags, and streams as batches."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import checks, clean, stats, within
from ..operators.quantiles import with_quantiles
from ..sources.stage import saved
from ..streaming import incremental
from .frames import MON, SHIP, monthly, r6, shipped_monthly, table
from .registry import query

M = f"WITH {MON} "
MS = f"WITH {MON}, {SHIP} "
YEAR = M + ", y AS (SELECT year, sum(total)::BIGINT AS total, sum(a)::BIGINT AS a, sum(value) AS value FROM mon GROUP BY 1) "


def _years(s, d):
    return monthly(s, d).groupBy("year").agg(F.sum("total").alias("total"), F.sum("a").alias("a"), F.sum("value").alias("value"))


@query("ts02_jn01_joint", MS + "SELECT period, total, n, round(100 * total / avg(total) OVER (), 6) AS total_index, round(100 * n / avg(n) OVER (), 6) AS n_index, round(CASE WHEN total > 0 THEN n / total END, 6) AS ratio FROM mon JOIN ship USING (period)")
def joint(s, d):
    j = checks.joined_once(monthly(s, d), shipped_monthly(s, d), ["period"], "inner")
    w = Window.partitionBy()
    return j.select("period", "total", "n", r6(100 * F.col("total") / F.avg("total").over(w)).alias("total_index"), r6(100 * F.col("n") / F.avg("n").over(w)).alias("n_index"), r6(clean.safe_ratio(F.col("n"), F.col("total"))).alias("ratio"))


@query("ts03_seasonality", M + ", m AS (SELECT month, sum(total) AS v FROM mon GROUP BY 1), r AS (SELECT v, v / sum(v) OVER () AS s, row_number() OVER (ORDER BY v DESC, month) AS r FROM m) SELECT round(max(v) / min(v), 6) AS peak_low, round(100 * sum(s) FILTER (r <= 3), 6) AS top3_pct, round(stddev_samp(v) / avg(v), 6) AS cv, round(sum(s * s), 6) AS hhi FROM r")
def seasonality(s, d):
    m = monthly(s, d).groupBy("month").agg(F.sum("total").alias("v"))
    r = m.select("v", within.share("v").alias("s"), F.row_number().over(Window.orderBy(F.desc("v"), "month")).alias("r"))
    return r.agg(r6(clean.safe_ratio(F.max("v"), F.min("v"))).alias("peak_low"), r6(100 * F.sum(F.when(F.col("r") <= 3, F.col("s")))).alias("top3_pct"), r6(F.stddev_samp("v") / F.avg("v")).alias("cv"), r6(F.sum(F.col("s") * F.col("s"))).alias("hhi"))


@query("ts04_nb17_peaks", M + ", l AS (SELECT period, 'a' AS metric, a::DOUBLE AS v FROM mon UNION ALL SELECT period, 'b', b FROM mon UNION ALL SELECT period, 'value', value FROM mon) SELECT metric, period AS peak, round(v, 2) AS peak_value FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY v DESC, period) AS r FROM l) WHERE r = 1")
def peaks(s, d):
    m = monthly(s, d).select("period", *(F.col(c).cast("double").alias(c) for c in ("a", "b", "value")))
    long = clean.unpivoted(m, ["a", "b", "value"], "metric", "v", ["period"])
    return within.first_by(long, ["metric"], [F.desc("v"), F.col("period")]).select("metric", F.col("period").alias("peak"), F.round("v", 2).alias("peak_value"))


@query("ts05_correlations", MS + "SELECT round(corr(total, n), 6) AS total_n, round(corr(a, quantity), 6) AS a_quantity, round(corr(value, quantity), 6) AS value_quantity FROM mon JOIN ship USING (period)")
def correlations(s, d):
    j = monthly(s, d).join(shipped_monthly(s, d), "period")
    pair = lambda x, y: r6(stats.pearson(F.col(x).cast("double"), F.col(y).cast("double"))).alias(f"{x}_{y}")
    return j.agg(pair("total", "n"), pair("a", "quantity"), pair("value", "quantity"))


@query("ts06_jn24_lags", MS + ", j AS (SELECT total, n AS n0, lead(n) OVER (ORDER BY period) AS n1 FROM mon JOIN ship USING (period)) SELECT 0 AS lag, count(n0) AS n, round(corr(total, n0), 6) AS r FROM j UNION ALL SELECT 1, count(n1), round(corr(total, n1), 6) FROM j")
def lags(s, d):
    j = monthly(s, d).join(shipped_monthly(s, d), "period").withColumn("n1", F.lead("n").over(Window.orderBy("period")))
    one = lambda k, c: j.agg(F.lit(k).alias("lag"), F.count(c).alias("n"), r6(stats.pearson(F.col("total").cast("double"), F.col(c).cast("double"))).alias("r"))
    return one(0, "n").unionByName(one(1, "n1"))


@query("ts08_wn14_annual", YEAR + "SELECT year, total, round(100 * (total / lag(total) OVER (ORDER BY year) - 1), 6) AS yoy_pct, round(100.0 * a / total - lag(100.0 * a / total) OVER (ORDER BY year), 6) AS a_change_pp, round(100.0 * total / (SELECT total FROM y WHERE year = 1997), 6) AS base_index, CASE WHEN year < 1997 THEN 'BEFORE' WHEN year = 1997 THEN 'BASE' ELSE 'AFTER' END AS regime FROM y")
def annual(s, d):
    y, w = _years(s, d), Window.orderBy("year")
    base = F.broadcast(y.filter("year = 1997").select(F.col("total").alias("base")))
    pct = 100 * F.col("a") / F.col("total")
    return y.join(base, how="left").select("year", "total", r6(100 * (F.try_divide("total", F.lag("total").over(w)) - 1)).alias("yoy_pct"), r6(pct - F.lag(pct).over(w)).alias("a_change_pp"), r6(100 * F.col("total") / F.col("base")).alias("base_index"), F.when(F.col("year") < 1997, "BEFORE").when(F.col("year") == 1997, "BASE").otherwise("AFTER").alias("regime"))


@query("ts09_wn23_monthly", M + ", q AS (SELECT quantile_cont(total, 1/3.0) AS a3, quantile_cont(total, 2/3.0) AS b3 FROM mon) SELECT period, round(100.0 * total / sum(total) OVER (PARTITION BY year), 6) AS year_share, round(100.0 * total / max(total) OVER (), 6) AS max_index, CASE WHEN total <= a3 THEN 'LOW' WHEN total <= b3 THEN 'SHOULDER' ELSE 'PEAK' END AS season FROM mon, q")
def monthly_features(s, d):
    v = F.col("total")
    return with_quantiles(saved(monthly(s, d)), {"lo": ("total", 1 / 3), "hi": ("total", 2 / 3)}).select("period", r6(100 * within.share("total", "year")).alias("year_share"), r6(100 * v / F.max("total").over(Window.partitionBy())).alias("max_index"), F.when(v <= F.col("lo"), "LOW").when(v <= F.col("hi"), "SHOULDER").otherwise("PEAK").alias("season"))


@query("ts10_part_of_whole", YEAR + "SELECT round(100.0 * sum(a) / sum(total), 6) AS a_pct, round(100 * max(value) / sum(value), 6) AS top_year_value_pct FROM y")
def part_of_whole(s, d):
    return _years(s, d).agg(r6(100 * F.sum("a") / F.sum("total")).alias("a_pct"), r6(100 * F.max("value") / F.sum("value")).alias("top_year_value_pct"))


@query("ts11_nb19_divergence", MS + ", j AS (SELECT period, 100.0 * total / max(total) OVER () - 100.0 * n / max(n) OVER () AS gap FROM mon JOIN ship USING (period)) SELECT period, round(gap, 6) AS gap FROM j ORDER BY abs(gap) DESC, period LIMIT 1")
def divergence(s, d):
    w = Window.partitionBy()
    j = monthly(s, d).join(shipped_monthly(s, d), "period").select("period", (100 * F.col("total") / F.max("total").over(w) - 100 * F.col("n") / F.max("n").over(w)).alias("gap"))
    return j.orderBy(F.abs("gap").desc(), "period").limit(1).select("period", r6(F.col("gap")).alias("gap"))


@query("ts12_ag09_granularity", M + "SELECT 'YEAR' AS granularity, year AS k, sum(total)::BIGINT AS n FROM mon GROUP BY 2 UNION ALL SELECT 'MONTH', month, sum(total)::BIGINT FROM mon GROUP BY 2")
def granularity(s, d):
    m = monthly(s, d)
    one = lambda label, c: m.groupBy(F.lit(label).alias("granularity"), F.col(c).alias("k")).agg(F.sum("total").alias("n"))
    return one("YEAR", "year").unionByName(one("MONTH", "month"))


@query("ts14_period_pivot", M + "SELECT month, sum(a)::BIGINT AS \"F\", sum(b)::BIGINT AS other FROM mon GROUP BY 1")
def period_pivot(s, d):
    o = table(s, d, "orders").select(F.month("o_orderdate").alias("month"), F.when(F.col("o_orderstatus") == "F", "F").otherwise("other").alias("k"))
    return o.groupBy("month").pivot("k", ["F", "other"]).count().fillna(0)


@query("jn14_month_spine", "SELECT m AS month, count(o_orderkey) AS n FROM range(1, 13) t(m) LEFT JOIN orders ON month(o_orderdate) = m AND o_orderstatus = 'P' AND year(o_orderdate) = 1995 GROUP BY 1")
def month_spine(s, d):
    o = table(s, d, "orders").filter("o_orderstatus = 'P' AND year(o_orderdate) = 1995").groupBy(F.month("o_orderdate").alias("m")).agg(F.count(F.lit(1)).alias("c"))
    return s.range(1, 13).join(o, F.col("id") == F.col("m"), "left").select(F.col("id").alias("month"), F.coalesce("c", F.lit(0)).alias("n"))


@query("set02_period_coverage", MS + "SELECT count(*) FILTER (m.period IS NOT NULL AND s.period IS NOT NULL) AS matched, count(*) FILTER (s.period IS NULL) AS left_only, coalesce(string_agg(s.period, ',' ORDER BY s.period) FILTER (m.period IS NULL), '') AS right_only FROM mon m FULL JOIN ship s ON m.period = s.period")
def period_coverage(s, d):
    a = monthly(s, d).select("period", F.lit(1).alias("x"))
    b = shipped_monthly(s, d).select("period", F.lit(1).alias("y"))
    x, y = F.col("x").isNotNull(), F.col("y").isNotNull()
    return a.join(b, "period", "full").agg(F.count_if(x & y).alias("matched"), F.count_if(~y).alias("left_only"), F.array_join(F.sort_array(F.collect_set(F.when(~x, F.col("period")))), ",").alias("right_only"))


@query("nb16_metric_summary", M + ", l AS (SELECT period, 'total' AS metric, total::DOUBLE AS v FROM mon UNION ALL SELECT period, 'value', value FROM mon) SELECT metric, count(*) AS n, round(avg(v), 4) AS mean, round(quantile_cont(v, 0.5), 4) AS median, arg_min(period, (v, period)) AS low_period, arg_max(period, (v, period)) AS high_period FROM l GROUP BY 1")
def metric_summary(s, d):
    m = monthly(s, d).select("period", F.col("total").cast("double").alias("total"), "value")
    by = F.struct("v", "period")
    return clean.unpivoted(m, ["total", "value"], "metric", "v", ["period"]).groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 4).alias("mean"), F.round(F.percentile("v", F.lit(0.5)), 4).alias("median"), F.min_by("period", by).alias("low_period"), F.max_by("period", by).alias("high_period"))


@query("dt07_lag_days", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_shipdate >= o_orderdate THEN epoch(l_shipdate - o_orderdate) / 86400.0 END, 6) AS lag_days FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def lag_days(s, d):
    j = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    lag = (F.unix_micros(F.col("l_shipdate").cast("timestamp")) - F.unix_micros(F.col("o_orderdate").cast("timestamp"))) / 86400e6
    return j.select("l_orderkey", "l_linenumber", r6(F.when(lag >= 0, lag)).alias("lag_days"))


@query("dt05_calendar", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, strftime(o_orderdate, '%Y-%m') AS period FROM orders")
def calendar(s, d):
    return table(s, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.date_format("o_orderdate", "yyyy-MM").alias("period"))


@query("stream_windowed_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_counts(s, d):
    return incremental.windowed_counts(table(s, d, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("prj_json_settings", "SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_settings(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))
