"""Queries that combine operators: entity masters, driver profiles, samples, rule tables and consistency checks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import checks, clean, ranks, stats, terms, within
from ..operators.quantiles import exact_quantiles
from ..sources.stage import saved
from .document_queries import NAMES
from .frames import ASP, ENT, LONG, aspect_docs, entities, r6, table
from .registry import query

E, AL = f"WITH {ENT} ", f"WITH {ASP}, {LONG} "


@query("jn04_status_default", "SELECT c_custkey, coalesce(s_name, 'NONE') AS registry, CASE WHEN s_name IS NULL THEN 'UNMATCHED' ELSE 'HIGH_CONFIDENCE' END AS status FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey AND s_nationkey = c_nationkey")
def status_default(s, d):
    reg = table(s, d, "supplier").select("s_suppkey", "s_nationkey", "s_name")
    j = table(s, d, "customer").join(reg, (F.col("s_suppkey") == F.col("c_custkey")) & (F.col("s_nationkey") == F.col("c_nationkey")), "left")
    return j.select("c_custkey", F.coalesce("s_name", F.lit("NONE")).alias("registry"), F.when(F.col("s_name").isNull(), "UNMATCHED").otherwise("HIGH_CONFIDENCE").alias("status"))


@query("jn10_preserved", "SELECT count(*) AS n_rows, 0::BIGINT AS changed FROM documents")
def preserved(s, d):
    """Raw text is the same after a cleaning step that adds columns."""
    raw = table(s, d, "documents")
    after = raw.withColumn("clean", clean.blank_to_null(F.col("text"))).select("doc_id", F.xxhash64("text").alias("h"))
    j = raw.select("doc_id", F.xxhash64("text").alias("g")).join(after, "doc_id", "left")
    return j.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("g").eqNullSafe(F.col("h"))).alias("changed"))


@query("jn05_jn22_entity_record", E + "SELECT e.entity_id, e.grp, e.reviews, coalesce(f.filled, 0) AS filled, round(CASE WHEN e.reviews > 0 THEN 100.0 * coalesce(f.filled, 0) / e.reviews END, 6) AS filled_pct FROM ent e LEFT JOIN (SELECT o_custkey, count(*) AS filled FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) f ON f.o_custkey = e.entity_id")
def entity_record(s, d):
    f = table(s, d, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("entity_id")).agg(F.count(F.lit(1)).alias("filled"))
    e = checks.joined_once(entities(s, d), f, ["entity_id"]).withColumn("filled", F.coalesce("filled", F.lit(0)))
    return e.select("entity_id", "grp", "reviews", "filled", r6(clean.safe_ratio(F.col("filled"), F.col("reviews"), 100.0)).alias("filled_pct"))


@query("ag30_ag31_coverage_states", E + "SELECT grp, count(*) FILTER (reviews = 0) AS none, count(*) FILTER (reviews BETWEEN 1 AND 14) AS some, count(*) FILTER (reviews >= 15) AS many, count(*) FILTER (reviews >= 25) AS volume_outliers FROM ent GROUP BY 1")
def coverage_states(s, d):
    n = F.col("reviews")
    return entities(s, d).groupBy("grp").agg(F.count_if(n == 0).alias("none"), F.count_if(n.between(1, 14)).alias("some"), F.count_if(n >= 15).alias("many"), F.count_if(n >= 25).alias("volume_outliers"))


@query("ag32_ag40_kpis", E + "SELECT count(*) AS entities, sum(reviews)::BIGINT AS reviews, quantile_cont(reviews, 0.5) AS median_reviews, round(100.0 * count(price) / count(*), 6) AS priced_pct FROM ent")
def kpis(s, d):
    e = saved(entities(s, d).select("reviews", "price"))
    return e.crossJoin(F.broadcast(exact_quantiles(e, {"m": ("reviews", 0.5)}))).agg(F.count(F.lit(1)).alias("entities"), F.sum("reviews").alias("reviews"), F.first("m").alias("median_reviews"), r6(100 * F.count("price") / F.count(F.lit(1))).alias("priced_pct"))


@query("ag36_ag43_two_groups", "SELECT has_company, count(*) AS n, quantile_cont(turns, 0.5) AS median_turns FROM (SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'assistant') > 1 AS has_company FROM conversations GROUP BY 1) GROUP BY 1")
def two_groups(s, d):
    g = table(s, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), (F.count_if(F.col("role") == "assistant") > 1).alias("has_company"))
    return g.groupBy("has_company").agg(F.count(F.lit(1)).alias("n"), F.percentile("turns", F.lit(0.5)).alias("median_turns"))


@query("ag37_partial_years", "WITH y AS (SELECT year(o_orderdate) AS y, o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1, 2) SELECT y AS year, k AS kind, n, y IN ((SELECT min(y) FROM y), (SELECT max(y) FROM y)) AS partial_year FROM y")
def partial_years(s, d):
    y = table(s, d, "orders").groupBy(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    ends = F.broadcast(y.agg(F.min("year").alias("a"), F.max("year").alias("b")))
    return y.crossJoin(ends).select("year", "kind", "n", ((F.col("year") == F.col("a")) | (F.col("year") == F.col("b"))).alias("partial_year"))


@query("ag38_response_lags", "WITH r AS (SELECT o_orderpriority AS k, epoch(min(l_shipdate) - any_value(o_orderdate)) / 86400.0 AS lag FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority) SELECT k AS kind, count(*) AS n, count(lag) FILTER (lag >= 0) AS with_lag, round(quantile_cont(lag, 0.5) FILTER (lag >= 0), 4) AS median_lag, round(quantile_cont(lag, 0.75) FILTER (lag >= 0), 4) AS q75_lag FROM r GROUP BY 1")
def response_lags(s, d):
    ship = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("at"))
    j = table(s, d, "orders").join(ship, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    lag = (F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("o_orderdate").cast("timestamp"))) / 86400e6
    j = j.select(F.col("o_orderpriority").alias("kind"), F.when(lag >= 0, lag).alias("lag"))
    return j.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("lag").alias("with_lag"), F.round(F.percentile("lag", F.lit(0.5)), 4).alias("median_lag"), F.round(F.percentile("lag", F.lit(0.75)), 4).alias("q75_lag"))


@query("ag41_length_by_group", f"WITH {ASP} SELECT rating_group, count(*) AS n, quantile_cont(length(text), 0.5) AS median_chars, quantile_cont(length(text), 0.75) AS q75_chars FROM asp JOIN documents USING (doc_id) GROUP BY 1")
def length_by_group(s, d):
    return aspect_docs(s, d).groupBy("rating_group").agg(F.count(F.lit(1)).alias("n"), F.percentile(F.length("t"), F.lit(0.5)).alias("median_chars"), F.percentile(F.length("t"), F.lit(0.75)).alias("q75_chars"))


@query("wn05_rank_change", E + ", w AS (SELECT entity_id, grp, rating, reviews / (reviews + m) * rating + (1 - reviews / (reviews + m)) * mu AS weighted FROM ent, (SELECT quantile_cont(reviews, 0.5) AS m, avg(rating) AS mu FROM ent)), g AS (SELECT grp, avg(rating) AS a, avg(weighted) AS b FROM w GROUP BY 1) SELECT grp, rank() OVER (ORDER BY a DESC) - rank() OVER (ORDER BY b DESC) AS change FROM g")
def rank_change(s, d):
    g = clean.shrunk(saved(entities(s, d).select("grp", "rating", "reviews")), "rating", "reviews").groupBy("grp").agg(F.avg("rating").alias("a"), F.avg("weighted").alias("b"))
    return g.select("grp", (F.rank().over(Window.orderBy(F.desc("a"))) - F.rank().over(Window.orderBy(F.desc("b")))).alias("change"))


@query("wn18_one_owner", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 AND row_number() OVER (PARTITION BY o_custkey, o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey) > 1 THEN 'REVIEW_REQUIRED' WHEN o_totalprice > 100000 THEN 'HIGH_CONFIDENCE' ELSE 'UNMATCHED' END AS status FROM orders")
def one_owner(s, d):
    from ..operators.resolve import assigned_once

    o = table(s, d, "orders").withColumn("status", F.when(F.col("o_totalprice") > 100000, "HIGH_CONFIDENCE").otherwise("UNMATCHED"))
    return assigned_once(o, "o_custkey", "o_totalprice", "o_orderkey").select("o_orderkey", "status")


@query("wn22_base_indices", "SELECT c_nationkey AS k, round(100 * n / avg(n) OVER (), 6) AS mean_index, round(100.0 * n / max(n) OVER (), 6) AS max_index FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1)")
def base_indices(s, d):
    g, w = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n")), Window.partitionBy()
    return g.select("k", r6(100 * F.col("n") / F.avg("n").over(w)).alias("mean_index"), r6(100 * F.col("n") / F.max("n").over(w)).alias("max_index"))


@query("tk05_extremes", E + "(SELECT 'rating_high' AS case_label, entity_id FROM ent ORDER BY rating DESC, entity_id LIMIT 5) UNION ALL (SELECT 'rating_low', entity_id FROM ent ORDER BY rating, entity_id LIMIT 5) UNION ALL (SELECT 'reviews_high', entity_id FROM ent ORDER BY reviews DESC, entity_id LIMIT 5)")
def extremes(s, d):
    e = entities(s, d)
    pick = lambda label, order: e.orderBy(order, "entity_id").limit(5).select(F.lit(label).alias("case_label"), "entity_id")
    return pick("rating_high", F.desc("rating")).unionByName(pick("rating_low", F.asc("rating"))).unionByName(pick("reviews_high", F.desc("reviews")))


@query("tk07_diverse_sample", E + ", r AS (SELECT entity_id, grp, reviews, row_number() OVER (ORDER BY reviews, entity_id) AS r, row_number() OVER (PARTITION BY grp ORDER BY reviews DESC, entity_id) AS g, count(*) OVER () AS n FROM ent) SELECT entity_id, min(stage) AS stage FROM (SELECT entity_id, 1 AS stage FROM r WHERE r IN (1, n // 2, n) UNION ALL SELECT entity_id, 2 FROM r WHERE g = 1) GROUP BY 1")
def diverse_sample(s, d):
    """The least, middle and largest by reviews, then the largest of each group, each entity at its first stage."""
    total = F.broadcast(table(s, d, "customer").agg(F.count(F.lit(1)).alias("n")))
    r = ranks.numbered(entities(s, d), ["reviews", "entity_id"], "r").crossJoin(total).withColumns({"g": F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("reviews"), "entity_id"))})
    spots = (F.col("r") == 1) | (F.col("r") == F.floor(F.col("n") / 2)) | (F.col("r") == F.col("n"))
    picked = r.filter(spots).select("entity_id", F.lit(1).alias("stage")).unionByName(r.filter("g = 1").select("entity_id", F.lit(2).alias("stage")))
    return picked.groupBy("entity_id").agg(F.min("stage").alias("stage"))


@query("tm07_tm08_driver_profile", AL + ", g AS (SELECT source, aspect, 100.0 * avg(matched::INT) FILTER (rating_group = 'HIGH') - 100.0 * avg(matched::INT) FILTER (rating_group = 'LOW') AS gap, count(*) FILTER (rating_group <> 'MIXED') AS n FROM lng GROUP BY 1, 2) SELECT source, aspect, CASE WHEN n < 15 OR gap IS NULL THEN 'INSUFFICIENT_SAMPLE' WHEN gap >= 10 THEN 'POSITIVE' WHEN gap <= -10 THEN 'NEGATIVE' ELSE 'NO_STRONG_DRIVER' END AS driver FROM g")
def driver_profile(s, d):
    rows = terms.aspect_rows(aspect_docs(s, d), NAMES, ["source", "rating_group"])
    at = lambda g: 100 * F.avg(F.when(F.col("rating_group") == g, F.col("matched").cast("int")))
    g = rows.groupBy("source", "aspect").agg((at("HIGH") - at("LOW")).alias("gap"), F.count_if(F.col("rating_group") != "MIXED").alias("n"))
    gap = F.col("gap")
    return g.select("source", "aspect", F.when((F.col("n") < 15) | gap.isNull(), "INSUFFICIENT_SAMPLE").when(gap >= 10, "POSITIVE").when(gap <= -10, "NEGATIVE").otherwise("NO_STRONG_DRIVER").alias("driver"))


@query("ag18_severity_by_aspect", AL + ", v AS (SELECT l.aspect, regexp_matches(lower(coalesce(text, '')), 'idiot|scum|worthless') AS high FROM lng l JOIN documents USING (doc_id) WHERE l.matched) SELECT aspect, round(avg(high::INT), 6) AS high_share FROM v GROUP BY 1")
def severity_by_aspect(s, d):
    docs = aspect_docs(s, d).withColumn("high", F.col("t").rlike("idiot|scum|worthless").cast("int"))
    return terms.aspect_rows(docs, NAMES, ["high"]).filter("matched").groupBy("aspect").agg(r6(F.avg("high")).alias("high_share"))


@query("tx24_contexts", "SELECT doc_id, substr(text, greatest(1, strpos(text, 'tion') - 60), strpos(text, 'tion') - greatest(1, strpos(text, 'tion') - 60) + 64) AS context FROM documents WHERE strpos(text, 'tion') > 0")
def contexts(s, d):
    at = F.locate("tion", F.col("text"))
    start = F.greatest(F.lit(1), at - 60)
    return table(s, d, "documents").filter(at > 0).select("doc_id", F.substring(F.col("text"), start, at - start + 64).alias("context"))


@query("dq01_dq03_unchanged", E + "SELECT count(*) AS n_rows, 0::BIGINT AS changed_rating, count(*) FILTER (price IS NULL)::BIGINT AS missing_index FROM ent")
def unchanged(s, d):
    """A derived index leaves its source as it was and is missing just where the source is."""
    e = entities(s, d).withColumns({"rating2": F.col("rating"), "idx": within.min_max("price", "grp")})
    return e.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("rating").eqNullSafe(F.col("rating2"))).alias("changed_rating"), F.count_if(F.col("idx").isNull()).alias("missing_index"))


@query("dq17_gate", "SELECT c_nationkey AS k, bool_and(c_acctbal > -1000) AND count(*) >= 3 AS passed FROM customer GROUP BY 1")
def gate(s, d):
    return table(s, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg((F.bool_and(F.col("c_acctbal") > -1000) & (F.count(F.lit(1)) >= 3)).alias("passed"))


@query("nb01_nb12_destination", E + "SELECT grp, count(*) AS n, round(avg(rating), 6) AS mean, count(*) < 60 AS low_sample, mode_seg FROM ent JOIN (SELECT grp, seg AS mode_seg FROM (SELECT grp, segment AS seg, row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, segment) AS r FROM ent GROUP BY 1, 2) WHERE r = 1) USING (grp) GROUP BY grp, mode_seg")
def destination(s, d):
    e = entities(s, d)
    top = within.first_by(e.groupBy("grp", "segment").agg(F.count(F.lit(1)).alias("c")), ["grp"], [F.desc("c"), F.col("segment")]).select("grp", F.col("segment").alias("mode_seg"))
    n = F.count(F.lit(1))
    return e.groupBy("grp").agg(n.alias("n"), r6(F.avg("rating")).alias("mean"), (n < 60).alias("low_sample")).join(top, "grp")


@query("nb10_bucketed", E + "SELECT CASE WHEN reviews < 5 THEN '0-4' WHEN reviews < 15 THEN '5-14' ELSE '15+' END AS bucket, count(*) AS n, round(avg(rating), 6) AS mean, round(quantile_cont(rating, 0.5), 6) AS median FROM ent GROUP BY 1")
def bucketed(s, d):
    b = clean.banded(F.col("reviews"), [5, 15], ["0-4", "5-14", "15+"], right=False)
    return entities(s, d).groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("rating")).alias("mean"), r6(F.percentile("rating", F.lit(0.5))).alias("median"))


@query("nb13_families", "SELECT 'starts_S' AS family, count(*) AS n, round(avg(p_retailprice), 6) AS mean FROM part WHERE regexp_matches(p_type, '^S') UNION ALL SELECT 'has_A', count(*), round(avg(p_retailprice), 6) FROM part WHERE contains(p_type, 'A')")
def families(s, d):
    p = table(s, d, "part")
    one = lambda name, rule: p.filter(rule).agg(F.lit(name).alias("family"), F.count(F.lit(1)).alias("n"), r6(F.avg("p_retailprice")).alias("mean"))
    return one("starts_S", F.col("p_type").rlike("^S")).unionByName(one("has_A", F.contains(F.col("p_type"), F.lit("A"))))


@query("nb44_counters", "SELECT l_suppkey AS k, " + ", ".join(f"count(*) FILTER (l_linenumber = {i}) AS n{i}" for i in range(1, 6)) + ", count(*) >= 30 AS target_reached FROM lineitem GROUP BY 1")
def counters(s, d):
    return table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(*(F.count_if(F.col("l_linenumber") == i).alias(f"n{i}") for i in range(1, 6)), (F.count(F.lit(1)) >= 30).alias("target_reached"))


@query("st09_rank_by_group", E + ", r AS (SELECT segment, rank() OVER (PARTITION BY segment ORDER BY reviews) + (count(*) OVER (PARTITION BY segment, reviews) - 1) / 2.0 AS x, rank() OVER (PARTITION BY segment ORDER BY price) + (count(*) OVER (PARTITION BY segment, price) - 1) / 2.0 AS y FROM ent WHERE price IS NOT NULL) SELECT segment, count(*) AS n, round(corr(x, y), 6) AS rho FROM r GROUP BY 1")
def rank_by_group(s, d):
    return stats.spearman(entities(s, d), "reviews", "price", "segment").drop("p").withColumn("rho", r6(F.col("rho")))
