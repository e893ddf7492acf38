"""Queries over entities and groups: cleaning, aggregates, within-group features, joins, top rows, sets, statistics, checks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import checks, clean, ranks, stats, within
from ..operators.quantiles import exact_quantiles, with_quantiles
from ..sources.stage import saved
from .frames import ENT, entities, r6, table
from .registry import query

W = Window.partitionBy
E = f"WITH {ENT} "
MEDIAN = "quantile_cont({}, 0.5)"


@query("ag01_group_metrics", E + """SELECT n_name AS grp, count(entity_id) AS entities, round(avg(rating), 6) AS mean_rating, round(quantile_cont(rating, 0.5), 6) AS median_rating,
  sum(reviews)::BIGINT AS total_reviews, quantile_cont(reviews, 0.5) AS median_reviews, count(price) AS price_count, round(quantile_cont(price, 0.5), 6) AS median_price, round(avg(price), 6) AS mean_price,
  round(100.0 * count(entity_id) / sum(count(entity_id)) OVER (), 6) AS share_pct, round(CASE WHEN count(entity_id) > 0 THEN 100.0 * count(price) / count(entity_id) END, 6) AS price_coverage_pct
  FROM nation LEFT JOIN ent ON grp = n_name GROUP BY 1""")
def group_metrics(s, d):
    spine = table(s, d, "nation").select(F.col("n_name").alias("grp"))
    g = entities(s, d).groupBy("grp").agg(F.count("entity_id").alias("entities"), r6(F.avg("rating")).alias("mean_rating"), r6(F.percentile("rating", F.lit(0.5))).alias("median_rating"), F.sum("reviews").alias("total_reviews"), F.percentile("reviews", F.lit(0.5)).alias("median_reviews"), F.count("price").alias("price_count"), r6(F.percentile("price", F.lit(0.5))).alias("median_price"), r6(F.avg("price")).alias("mean_price"))
    g = spine.join(g, "grp", "left").fillna(0, ["entities", "price_count"])
    return g.withColumns({"share_pct": r6(100 * within.share("entities")), "price_coverage_pct": r6(clean.safe_ratio(F.col("price_count"), F.col("entities"), 100.0))})


@query("prj01_trim_blank", "SELECT count(*) FILTER (trim(name) <> name) AS changed, count(*) FILTER (trim(name) = '') AS blank FROM (SELECT CASE WHEN n_nationkey % 3 = 0 THEN ' ' || n_name || ' ' WHEN n_nationkey % 3 = 1 THEN '  ' ELSE n_name END AS name FROM nation)")
def trim_blank(s, d):
    k = F.col("n_nationkey") % 3
    n = table(s, d, "nation").select(F.when(k == 0, F.concat(F.lit(" "), "n_name", F.lit(" "))).when(k == 1, "  ").otherwise(F.col("n_name")).alias("name"))
    x = clean.blank_to_null(F.col("name"))
    return n.agg(F.count_if(~F.col("name").eqNullSafe(F.coalesce(x, F.lit("")))).alias("changed"), F.count_if(x.isNull()).alias("blank"))


@query("prj02_prj03_coercion", "SELECT 'as_number' AS \"column\", count(*) FILTER (TRY_CAST(v AS DOUBLE) IS NULL) AS newly_missing FROM (SELECT CASE WHEN p_size % 4 = 0 THEN 'n/a' ELSE p_size / 2.0 || '' END AS v FROM part) UNION ALL SELECT 'as_integer', count(*) FILTER (TRY_CAST(v AS DOUBLE) IS NULL OR TRY_CAST(v AS DOUBLE) % 1 <> 0) FROM (SELECT CASE WHEN p_size % 4 = 0 THEN 'n/a' ELSE p_size / 2.0 || '' END AS v FROM part)")
def coercion(s, d):
    p = table(s, d, "part").select(F.when(F.col("p_size") % 4 == 0, "n/a").otherwise((F.col("p_size") / 2.0).cast("string")).alias("v"))
    out = p.agg(F.count_if(clean.to_number(F.col("v")).isNull()).alias("as_number"), F.count_if(clean.to_integer(F.col("v")).isNull()).alias("as_integer"))
    return clean.unpivoted(out, ["as_number", "as_integer"], "column", "newly_missing")


@query("prj04_iso_date", "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 28 THEN '2024-02-' || lpad(p_size::VARCHAR, 2, '0') WHEN p_size = 29 THEN '2024-02-29' END AS iso FROM part")
def iso_date(s, d):
    raw = F.concat(F.lit("2024-02-"), F.lpad(F.col("p_size").cast("string"), 2, "0"))
    return table(s, d, "part").select("p_partkey", clean.to_iso_date(raw).alias("iso"))


@query("prj05_safe_ratio", E + "SELECT entity_id, round(CASE WHEN reviews > 0 THEN 1000.0 * rating / reviews END, 6) AS ratio FROM ent")
def safe_ratio(s, d):
    return entities(s, d).select("entity_id", r6(clean.safe_ratio(F.col("rating"), F.col("reviews"), 1000.0)).alias("ratio"))


@query("prj06_prj07_flags_log", E + "SELECT entity_id, price IS NOT NULL AS has_price, round(ln(1 + reviews), 6) AS log_reviews FROM ent")
def flags_log(s, d):
    return entities(s, d).select("entity_id", F.col("price").isNotNull().alias("has_price"), r6(F.log1p("reviews")).alias("log_reviews"))


@query("prj08_shrunk_rating", E + "SELECT entity_id, round(reviews / (reviews + m) * rating + (1 - reviews / (reviews + m)) * mu, 4) AS weighted FROM ent, (SELECT quantile_cont(reviews, 0.5) AS m, avg(rating) AS mu FROM ent)")
def shrunk_rating(s, d):
    return clean.shrunk(saved(entities(s, d).select("entity_id", "rating", "reviews")), "rating", "reviews").select("entity_id", F.round("weighted", 4).alias("weighted"))


@query("prj09_first_label", E + "SELECT entity_id, CASE WHEN reviews = 0 THEN 'NONE' WHEN rating < 0 THEN 'NEGATIVE' WHEN rating > 5000 THEN 'LARGE' ELSE 'USUAL' END AS label FROM ent")
def first_label(s, d):
    return entities(s, d).select("entity_id", clean.first_label([(F.col("reviews") == 0, "NONE"), (F.col("rating") < 0, "NEGATIVE"), (F.col("rating") > 5000, "LARGE")], "USUAL").alias("label"))


@query("prj10_prj11_bands", E + "SELECT entity_id, CASE WHEN rating <= 0 THEN 'LOW' WHEN rating <= 5000 THEN 'MID' WHEN rating IS NOT NULL THEN 'HIGH' END AS right_closed, CASE WHEN reviews < 5 THEN 'FEW' WHEN reviews < 15 THEN 'SOME' ELSE 'MANY' END AS left_closed FROM ent")
def bands(s, d):
    return entities(s, d).select("entity_id", clean.banded(F.col("rating"), [0, 5000], ["LOW", "MID", "HIGH"]).alias("right_closed"), clean.banded(F.col("reviews"), [5, 15], ["FEW", "SOME", "MANY"], right=False).alias("left_closed"))


@query("prj13_fold_small", "SELECT CASE WHEN n < 10 THEN 'Other' ELSE p_type END AS kind, sum(n)::BIGINT AS n FROM (SELECT p_type, count(*) AS n FROM part GROUP BY 1) GROUP BY 1")
def fold_small(s, d):
    return table(s, d, "part").select(clean.small_folded("p_type", 10).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("prj14_validity", E + "SELECT count(*) FILTER (price IS NOT NULL AND NOT price BETWEEN 1000 AND 200000) AS out_of_range, count(*) FILTER (rating <= 0) AS not_positive FROM ent")
def validity(s, d):
    p = F.col("price")
    return entities(s, d).agg(F.count_if(p.isNotNull() & ~p.between(1000, 200000)).alias("out_of_range"), F.count_if(F.col("rating") <= 0).alias("not_positive"))


@query("prj17_prj19_coalesce_recode", "SELECT o_orderkey, coalesce(CASE WHEN o_totalprice > 100000 THEN o_orderpriority END, 'NONE') AS a, CASE o_orderstatus WHEN 'F' THEN 'FILLED' WHEN 'O' THEN 'OPEN' ELSE 'OTHER' END AS b FROM orders")
def coalesce_recode(s, d):
    return table(s, d, "orders").select("o_orderkey", F.coalesce(F.when(F.col("o_totalprice") > 100000, F.col("o_orderpriority")), F.lit("NONE")).alias("a"), clean.recoded(F.col("o_orderstatus"), {"F": "FILLED", "O": "OPEN"}, "OTHER").alias("b"))


@query("prj20_flag_text", E + "SELECT entity_id, coalesce(nullif(concat_ws(';', CASE WHEN reviews = 0 THEN 'NO_REVIEWS' END, CASE WHEN rating < 0 THEN 'NEGATIVE' END, CASE WHEN price > 150000 THEN 'DEAR' END), ''), 'OK') AS flags FROM ent")
def flag_text(s, d):
    return entities(s, d).select("entity_id", clean.flags_text([(F.col("reviews") == 0, "NO_REVIEWS"), (F.col("rating") < 0, "NEGATIVE"), (F.col("price") > 150000, "DEAR")]).alias("flags"))


@query("prj21_prj23_tiers", E + "SELECT entity_id, CASE WHEN reviews < q THEN 'LOW' WHEN reviews < m THEN 'MODERATE' ELSE 'STRONGER' END AS denominator, CASE WHEN reviews >= 15 THEN 'HIGH' WHEN reviews >= 5 THEN 'MEDIUM' WHEN reviews >= 1 THEN 'LOW' ELSE 'NONE' END AS support FROM ent, (SELECT quantile_cont(reviews, 0.25) AS q, quantile_cont(reviews, 0.5) AS m FROM ent)")
def tiers(s, d):
    e, n = saved(entities(s, d).select("entity_id", "reviews")), F.col("reviews")
    return with_quantiles(e, {"q": ("reviews", 0.25), "m": ("reviews", 0.5)}).select("entity_id", clean.first_label([(n < F.col("q"), "LOW"), (n < F.col("m"), "MODERATE")], "STRONGER").alias("denominator"), clean.first_label([(n >= 15, "HIGH"), (n >= 5, "MEDIUM"), (n >= 1, "LOW")], "NONE").alias("support"))


@query("prj24_rating_group", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 2 THEN 'LOW' WHEN l_linenumber = 3 THEN 'MIXED' WHEN l_linenumber <= 5 THEN 'HIGH' END AS g FROM lineitem")
def rating_group(s, d):
    n = F.col("l_linenumber")
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(n.between(1, 2), "LOW").when(n == 3, "MIXED").when(n.between(4, 5), "HIGH").alias("g"))


@query("prj29_strength", E + ", c AS (SELECT segment, corr(reviews, price) AS r FROM ent GROUP BY 1) SELECT segment, CASE WHEN abs(r) >= 0.8 THEN 'very strong' WHEN abs(r) >= 0.6 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate' WHEN abs(r) >= 0.2 THEN 'weak' ELSE 'very weak' END || ' ' || CASE WHEN r > 0 THEN 'positive' WHEN r < 0 THEN 'negative' ELSE 'flat' END AS label FROM c")
def strength(s, d):
    g = entities(s, d).groupBy("segment").agg(stats.pearson(F.col("reviews").cast("double"), F.col("price")).alias("r"))
    return g.select("segment", clean.strength(F.col("r")).alias("label"))


@query("prj28_number_format", "SELECT p_partkey, translate(format('{:,.2f}', p_retailprice), ',.', '.,') AS shown FROM part")
def number_format(s, d):
    return table(s, d, "part").select("p_partkey", clean.swapped_number(F.col("p_retailprice")).alias("shown"))


@query("jn09_full_counts", "SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS suppliers, coalesce(b.n, 0) AS customers FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) a FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) b ON a.k = b.k")
def full_counts(s, d):
    a = table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    b = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    return a.join(b, "k", "full").fillna(0)


@query("jn11_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def semi(s, d):
    return table(s, d, "customer").join(table(s, d, "orders").filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("jn12_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def anti(s, d):
    """Customers without a pending order."""
    return table(s, d, "customer").join(table(s, d, "orders").filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("jn13_name_lookup", "SELECT s_suppkey, CASE WHEN n_name IS NULL THEN 'UNMATCHED' ELSE 'EXACT_NAME_MATCH' END AS status FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey < 3")
def name_lookup(s, d):
    n = table(s, d, "nation").filter("n_regionkey < 3").select(F.lower(F.trim("n_name")).alias("k"))
    sup = table(s, d, "supplier").join(F.broadcast(table(s, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).withColumn("k", F.lower(F.trim("n_name")))
    return sup.join(F.broadcast(n.withColumn("hit", F.lit(1))), "k", "left").select("s_suppkey", F.when(F.col("hit").isNull(), "UNMATCHED").otherwise("EXACT_NAME_MATCH").alias("status"))


@query("jn15_spine", "SELECT p_size AS size, m.n_name AS grp, count(x) AS n FROM (SELECT DISTINCT p_size FROM part) CROSS JOIN nation m LEFT JOIN (SELECT p_size AS ps, s_nationkey AS nk, 1 AS x FROM part JOIN supplier ON s_suppkey = p_partkey) j ON j.ps = p_size AND j.nk = m.n_nationkey GROUP BY 1, 2")
def spine(s, d):
    grid = table(s, d, "part").select(F.col("p_size").alias("size")).distinct().crossJoin(F.broadcast(table(s, d, "nation").select("n_nationkey", F.col("n_name").alias("grp"))))
    have = table(s, d, "part").join(table(s, d, "supplier"), F.col("s_suppkey") == F.col("p_partkey")).groupBy(F.col("p_size").alias("size"), F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(have, ["size", "n_nationkey"], "left").select("size", "grp", F.coalesce("n", F.lit(0)).alias("n"))


@query("ag02_conditional", E + "SELECT grp, count(*) FILTER (segment = 'BUILDING') AS building, count(*) FILTER (reviews = 0) AS quiet, round(sum(price), 2) AS price_sum, round(quantile_cont(price, 0.5), 6) AS price_median FROM ent GROUP BY 1")
def conditional(s, d):
    return entities(s, d).groupBy("grp").agg(F.count_if(F.col("segment") == "BUILDING").alias("building"), F.count_if(F.col("reviews") == 0).alias("quiet"), F.round(F.sum("price"), 2).alias("price_sum"), r6(F.percentile("price", F.lit(0.5))).alias("price_median"))


@query("ag03_group_master", E + ", g AS (SELECT grp, count(*) AS n, count(price) AS priced, quantile_cont(price, 0.5) AS mp FROM ent GROUP BY 1) SELECT grp, round(100.0 * priced / n, 6) AS coverage_pct, round(100 * mp / (SELECT quantile_cont(mp, 0.5) FROM g), 6) AS price_index, CASE WHEN n >= 70 THEN 'HIGH' WHEN n >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM g")
def group_master(s, d):
    g = entities(s, d).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count("price").alias("priced"), F.percentile("price", F.lit(0.5)).alias("mp"))
    mid = exact_quantiles(g, {"mid": ("mp", 0.5)})
    n = F.col("n")
    return g.crossJoin(F.broadcast(mid)).select("grp", r6(100 * F.col("priced") / n).alias("coverage_pct"), r6(100 * F.col("mp") / F.col("mid")).alias("price_index"), clean.first_label([(n >= 70, "HIGH"), (n >= 50, "MEDIUM")], "LOW").alias("confidence"))


@query("ag04_coverage_long", E + "SELECT metric, v AS n, round(100.0 * v / t, 6) AS pct FROM (SELECT count(*) AS t, count(price) AS price, count(*) FILTER (reviews > 0) AS reviewed, count(rating) AS rating FROM ent) UNPIVOT (v FOR metric IN (price, reviewed, rating))")
def coverage_long(s, d):
    a = entities(s, d).agg(F.count(F.lit(1)).alias("t"), F.count("price").alias("price"), F.count_if(F.col("reviews") > 0).alias("reviewed"), F.count("rating").alias("rating"))
    return clean.unpivoted(a, ["price", "reviewed", "rating"], "metric", "n", ["t"]).select("metric", "n", r6(100 * F.col("n") / F.col("t")).alias("pct"))


@query("ag05_class_summary", "SELECT p_size AS class, count(*) AS n, round(avg(p_retailprice), 6) AS mean, round(stddev_samp(p_retailprice), 6) AS std, min(p_retailprice) AS low, max(p_retailprice) AS high, round(quantile_cont(p_retailprice, 0.25), 6) AS q25, round(quantile_cont(p_retailprice, 0.75), 6) AS q75, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share_pct FROM part GROUP BY 1")
def class_summary(s, d):
    p, v = table(s, d, "part"), "p_retailprice"
    g = p.groupBy(F.col("p_size").alias("class")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(v)).alias("mean"), r6(F.stddev_samp(v)).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"), r6(F.percentile(v, F.lit(0.25))).alias("q25"), r6(F.percentile(v, F.lit(0.75))).alias("q75"))
    return g.withColumn("share_pct", r6(100 * within.share("n")))


@query("ag06_st08_tercile_groups", "WITH q AS (SELECT quantile_cont(p_retailprice, 1/3.0) AS a, quantile_cont(p_retailprice, 2/3.0) AS b FROM part) SELECT CASE WHEN p_retailprice <= a THEN 'SMALL' WHEN p_retailprice <= b THEN 'MEDIUM' ELSE 'LARGE' END AS g, count(*) AS n, round(avg(p_size), 6) AS mean_size FROM part, q GROUP BY 1")
def tercile_groups(s, d):
    p = table(s, d, "part")
    v = F.col("p_retailprice")
    return with_quantiles(p, {"a": ("p_retailprice", 1 / 3), "b": ("p_retailprice", 2 / 3)}).groupBy(F.when(v <= F.col("a"), "SMALL").when(v <= F.col("b"), "MEDIUM").otherwise("LARGE").alias("g")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("p_size")).alias("mean_size"))


@query("ag07_type_summary", "SELECT p_type AS kind, count(*) AS n, round(quantile_cont(p_retailprice, 0.5), 6) AS median_price FROM part GROUP BY 1")
def type_summary(s, d):
    return table(s, d, "part").groupBy(F.col("p_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), r6(F.percentile("p_retailprice", F.lit(0.5))).alias("median_price")).orderBy(F.desc("n"), "kind")


@query("ag08_capacity", E + "SELECT grp, coalesce(round(sum(CASE WHEN reviews > 20 THEN price END), 2), 0) AS capacity FROM ent GROUP BY 1")
def capacity(s, d):
    return entities(s, d).groupBy("grp").agg(F.coalesce(F.round(F.sum(F.when(F.col("reviews") > 20, F.col("price"))), 2), F.lit(0.0)).alias("capacity"))


@query("ag10_ag12_entity_summary", "SELECT o_custkey AS entity_id, count(*) AS n, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day, round(quantile_cont(o_totalprice, 0.5), 6) AS median_price, count(*) FILTER (o_orderstatus = 'F') AS filled, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS filled_pct, count(*) < 5 AS small_n FROM orders GROUP BY 1")
def entity_summary(s, d):
    f = F.count_if(F.col("o_orderstatus") == "F")
    n = F.count(F.lit(1))
    return table(s, d, "orders").groupBy(F.col("o_custkey").alias("entity_id")).agg(n.alias("n"), F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_day"), r6(F.percentile("o_totalprice", F.lit(0.5))).alias("median_price"), f.alias("filled"), r6(100 * f / n).alias("filled_pct"), (n < 5).alias("small_n"))


@query("ag11_ag21_status_pivot", "SELECT c_mktsegment AS segment, count(DISTINCT c_custkey) AS entities, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def status_pivot(s, d):
    j = table(s, d, "orders").join(table(s, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    p = j.groupBy(F.col("c_mktsegment").alias("segment")).pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)
    return j.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count_distinct("c_custkey").alias("entities")).join(p, "segment")


@query("ag13_reply_metrics", "SELECT conv_id, count(*) AS total, count(*) FILTER (role = 'assistant') AS company, count(*) FILTER (role = 'user') AS by_user, min(turn) AS first_turn, max(turn) AS last_turn, count(*) FILTER (role = 'assistant') > 0 AS has_company FROM conversations GROUP BY 1")
def reply_metrics(s, d):
    role = F.col("role")
    return table(s, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(role == "assistant").alias("company"), F.count_if(role == "user").alias("by_user"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), (F.count_if(role == "assistant") > 0).alias("has_company"))


@query("ag19_value_counts", "SELECT o_orderpriority AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1")
def value_counts(s, d):
    return table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("share", r6(within.share("n")))


@query("ag22_row_shares", "SELECT l_shipmode, a, round(100.0 * a / (a + b), 6) AS a_pct FROM (SELECT l_returnflag AS l_shipmode, count(*) FILTER (l_linestatus = 'F') AS a, count(*) FILTER (l_linestatus <> 'F') AS b FROM lineitem GROUP BY 1)")
def row_shares(s, d):
    g = table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("l_shipmode")).agg(F.count_if(F.col("l_linestatus") == "F").alias("a"), F.count_if(F.col("l_linestatus") != "F").alias("b"))
    return g.select("l_shipmode", "a", r6(clean.safe_ratio(F.col("a"), F.col("a") + F.col("b"), 100.0)).alias("a_pct"))


@query("ag23_dominant", "SELECT grp, segment FROM (SELECT n_name AS grp, c_mktsegment AS segment, row_number() OVER (PARTITION BY n_name ORDER BY count(*) DESC, c_mktsegment) AS r FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2) WHERE r = 1")
def dominant(s, d):
    g = entities(s, d).groupBy("grp", "segment").agg(F.count(F.lit(1)).alias("n"))
    return within.first_by(g, ["grp"], [F.col("n").desc(), F.col("segment")]).select("grp", "segment")


@query("ag24_ag25_percentiles", "SELECT stat, v AS value FROM (SELECT count(o_totalprice)::DOUBLE AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS low, round(quantile_cont(o_totalprice, 0.25), 4) AS p25, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.95), 4) AS p95, max(o_totalprice) AS high FROM orders) UNPIVOT (v FOR stat IN (n, mean, std, low, p25, p50, p95, high))")
def percentiles(s, d):
    v = "o_totalprice"
    o = table(s, d, "orders").select(v)
    a = o.agg(F.count(v).cast("double").alias("n"), F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_samp(v), 4).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"))
    p = exact_quantiles(o, {f"p{int(q * 100)}": (v, q) for q in (0.25, 0.5, 0.95)})
    a = a.crossJoin(p.select(*(F.round(c, 4).alias(c) for c in p.columns)))
    return clean.unpivoted(a, a.columns, "stat", "value")


@query("ag26_skewness", "SELECT round(skewness(l_quantity), 6) AS skew FROM lineitem")
def skewness(s, d):
    return table(s, d, "lineitem").agg(r6(stats.sample_skewness("l_quantity")).alias("skew"))


@query("ag27_wn15_concentration", "WITH g AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT k, n, row_number() OVER (ORDER BY n DESC, k) AS r, sum(n) OVER (ORDER BY n DESC, k) / sum(n) OVER () AS c, n / sum(n) OVER () AS s FROM g) SELECT round(sum(s) FILTER (r <= 3), 6) AS top3, round(sum(s) FILTER (r <= 10), 6) AS top10, min(r) FILTER (c >= 0.8) AS to_80, round(sum(s * s), 6) AS hhi FROM r")
def concentration(s, d):
    g = table(s, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(g.agg(F.sum("n").alias("all")))
    r = ranks.along(g, ["n", "k"], {"r": None, "upto": "n"}, descending=True).crossJoin(total).withColumns({"c": F.col("upto") / F.col("all"), "s": F.col("n") / F.col("all")})
    return r.agg(r6(F.sum(F.when(F.col("r") <= 3, F.col("s")))).alias("top3"), r6(F.sum(F.when(F.col("r") <= 10, F.col("s")))).alias("top10"), F.min(F.when(F.col("c") >= 0.8, F.col("r"))).alias("to_80"), r6(F.sum(F.col("s") * F.col("s"))).alias("hhi"))


@query("ag28_dq19_column_profile", "SELECT 'doc_id' AS column_name, count(doc_id) AS non_null, count(*) - count(doc_id) AS missing, count(DISTINCT doc_id) AS distinct_values FROM labels UNION ALL SELECT 'quality', count(quality), count(*) - count(quality), count(DISTINCT quality) FROM labels UNION ALL SELECT 'toxic', count(toxic), count(*) - count(toxic), count(DISTINCT toxic) FROM labels")
def column_profile(s, d):
    return checks.column_profile(table(s, d, "labels").select("doc_id", "quality", "toxic"))


@query("ag42_wn20_top_text", "WITH g AS (SELECT n_name AS grp, c_mktsegment AS seg, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY n_name) AS p FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY p DESC, seg) AS r FROM g) SELECT grp, string_agg(seg || ':' || format('{:.1f}', p) || '%', '|' ORDER BY r) AS top FROM r WHERE r <= 3 GROUP BY 1")
def top_text(s, d):
    g = entities(s, d).groupBy("grp", "segment").agg(F.count(F.lit(1)).alias("n")).withColumn("p", 100 * within.share("n", "grp"))
    return within.top_text(g, "grp", "segment", "p", 3)


@query("wn01_wn03_within_group", E + ", m AS (SELECT grp, quantile_cont(rating, 0.5) AS med FROM ent GROUP BY 1) SELECT entity_id, count(*) OVER g AS group_size, round(rating - med, 6) AS gap, round(rating / nullif(med, 0), 6) AS ratio, round(CASE WHEN price IS NOT NULL THEN (rank() OVER (PARTITION BY grp ORDER BY price NULLS LAST) + (count(*) OVER (PARTITION BY grp, price) - 1) / 2.0) / count(price) OVER g END, 6) AS price_rank FROM ent JOIN m USING (grp) WINDOW g AS (PARTITION BY grp)")
def within_group(s, d):
    e = entities(s, d).withColumn("med", within.group_median("rating", "grp"))
    return e.select("entity_id", F.count(F.lit(1)).over(W("grp")).alias("group_size"), r6(F.col("rating") - F.col("med")).alias("gap"), r6(F.when(F.col("med") != 0, F.col("rating") / F.col("med"))).alias("ratio"), r6(within.tie_percent_rank("price", "grp")).alias("price_rank"))


GRP = E + ", g AS (SELECT grp, avg(rating) AS rating, quantile_cont(price, 0.5) AS price, count(*) AS n FROM ent GROUP BY 1), x AS (SELECT grp, rating, price, n, 100 * (rating - min(rating) OVER ()) / (max(rating) OVER () - min(rating) OVER ()) AS q, 100 * (price - min(price) OVER ()) / (max(price) OVER () - min(price) OVER ()) AS p FROM g) "


def _groups(s, d):
    g = entities(s, d).groupBy("grp").agg(F.avg("rating").alias("rating"), F.percentile("price", F.lit(0.5)).alias("price"), F.count(F.lit(1)).alias("n"))
    return g.withColumns({"q": within.min_max("rating"), "p": within.min_max("price")})


@query("wn09_jn03_sensitivity", GRP + ", sc AS (SELECT * FROM (VALUES ('even', 0.5), ('quality', 0.8), ('price', 0.2)) t(scenario, w)), r AS (SELECT grp, scenario, rank() OVER (PARTITION BY scenario ORDER BY w * q + (1 - w) * (100 - p) DESC) AS rnk FROM x, sc) SELECT grp, scenario, rnk, max(rnk) OVER (PARTITION BY grp) - min(rnk) OVER (PARTITION BY grp) >= 4 AS sensitive FROM r")
def sensitivity(s, d):
    sc = s.createDataFrame([("even", 0.5), ("quality", 0.8), ("price", 0.2)], "scenario string, w double")
    v = F.col("w") * F.col("q") + (1 - F.col("w")) * (100 - F.col("p"))
    r = _groups(s, d).crossJoin(F.broadcast(sc)).withColumn("v", v).withColumn("rnk", F.rank().over(W("scenario").orderBy(F.desc("v"))))
    return r.select("grp", "scenario", "rnk", (F.max("rnk").over(W("grp")) - F.min("rnk").over(W("grp")) >= 4).alias("sensitive"))


@query("wn10_wn12_quadrants", GRP + ", m AS (SELECT quantile_cont(rating, 0.5) AS a, quantile_cont(price, 0.5) AS b FROM g WHERE price IS NOT NULL) SELECT grp, CASE WHEN price IS NULL THEN NULL WHEN rating >= a AND price >= b THEN 'PREMIUM' WHEN rating >= a THEN 'VALUE' WHEN price >= b THEN 'DEAR' ELSE 'BASIC' END AS quadrant FROM g, m")
def quadrants(s, d):
    return within.quadrant(saved(_groups(s, d)), "rating", "price", ("PREMIUM", "VALUE", "DEAR", "BASIC")).select("grp", "quadrant")


@query("wn11_archetypes", GRP + ", t AS (SELECT quantile_cont(q, 0.75) AS hq, quantile_cont(p, 0.75) AS hp, quantile_cont(n, 0.5) AS mn FROM x) SELECT grp, CASE WHEN q >= hq AND p >= hp THEN 'LUXURY' WHEN q >= hq THEN 'QUALITY' WHEN n >= mn THEN 'VOLUME' ELSE 'NICHE' END AS archetype FROM x, t")
def archetypes(s, d):
    g = saved(_groups(s, d))
    t = exact_quantiles(g, {"hq": ("q", 0.75), "hp": ("p", 0.75), "mn": ("n", 0.5)})
    rules = [((F.col("q") >= F.col("hq")) & (F.col("p") >= F.col("hp")), "LUXURY"), (F.col("q") >= F.col("hq"), "QUALITY"), (F.col("n") >= F.col("mn"), "VOLUME")]
    return g.crossJoin(F.broadcast(t)).select("grp", clean.first_label(rules, "NICHE").alias("archetype"))


@query("wn16_occurrence", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS occurrence FROM orders")
def occurrence(s, d):
    return table(s, d, "orders").select("o_orderkey", F.row_number().over(W("o_custkey").orderBy("o_orderkey")).alias("occurrence"))


@query("wn17_wn25_first_row", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def first_row(s, d):
    return within.first_by(table(s, d, "orders"), ["o_custkey"], [F.col("o_orderstatus"), F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("wn19_arg_max", "SELECT o_custkey, max(o_totalprice) AS top_price, max_by(o_orderkey, o_totalprice) AS top_order FROM orders GROUP BY 1")
def arg_max(s, d):
    return table(s, d, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("top_price"), F.max_by("o_orderkey", "o_totalprice").alias("top_order"))


@query("wn24_runner_up", "SELECT o_custkey, round(a - b, 4) AS lead, CASE WHEN b IS NULL THEN 'ONLY' WHEN a - b < 1000 THEN 'AMBIGUOUS' ELSE 'CLEAR' END AS label FROM (SELECT o_custkey, o_totalprice AS a, lead(o_totalprice) OVER w AS b, row_number() OVER w AS r FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)) WHERE r = 1")
def runner_up(s, d):
    w = W("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    x = table(s, d, "orders").select("o_custkey", F.col("o_totalprice").alias("a"), F.lead("o_totalprice").over(w).alias("b"), F.row_number().over(w).alias("r")).filter("r = 1")
    gap = F.col("a") - F.col("b")
    return x.select("o_custkey", F.round(gap, 4).alias("lead"), F.when(F.col("b").isNull(), "ONLY").when(gap < 1000, "AMBIGUOUS").otherwise("CLEAR").alias("label"))


@query("wn26_first_reply", "SELECT conv_id, min_by(text, turn) AS first_reply FROM conversations WHERE role = 'assistant' AND text IS NOT NULL GROUP BY 1")
def first_reply(s, d):
    return table(s, d, "conversations").filter("role = 'assistant' AND text IS NOT NULL").groupBy("conv_id").agg(F.min_by("text", "turn").alias("first_reply"))


@query("tk01_tk03_top", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def top(s, d):
    return table(s, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(10)


@query("tk02_priority", "SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS priority FROM supplier")
def priority(s, d):
    return ranks.numbered(table(s, d, "supplier").select("s_suppkey", "s_acctbal"), ["s_acctbal", "s_suppkey"], "priority", descending=True).select("s_suppkey", "priority")


@query("tk04_tk06_cases", E + "(SELECT 'dear' AS case_label, entity_id FROM ent WHERE price > (SELECT quantile_cont(price, 0.95) FROM ent) ORDER BY price DESC, entity_id LIMIT 5) UNION ALL (SELECT 'busy', entity_id FROM ent WHERE reviews > (SELECT quantile_cont(reviews, 0.95) FROM ent) ORDER BY reviews DESC, entity_id LIMIT 5)")
def cases(s, d):
    e = saved(entities(s, d).select("entity_id", "price", "reviews"))
    x = with_quantiles(e, {"qp": ("price", 0.95), "qr": ("reviews", 0.95)})
    pick = lambda label, col, cut: x.filter(F.col(col) > F.col(cut)).orderBy(F.desc(col), "entity_id").limit(5).select(F.lit(label).alias("case_label"), "entity_id")
    return pick("dear", "price", "qp").unionByName(pick("busy", "reviews", "qr"))


@query("tk11_tk12_duplicates", "SELECT c_nationkey, c_mktsegment, count(*) AS n, count(*) - 1 AS excess, min(c_custkey) AS first_id FROM customer GROUP BY 1, 2 HAVING count(*) > 1")
def duplicates(s, d):
    return table(s, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - 1).alias("excess"), F.min("c_custkey").alias("first_id")).filter("n > 1")


@query("tk15_collisions", "SELECT p_brand FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 3")
def collisions(s, d):
    return table(s, d, "part").groupBy("p_brand").agg(F.count_distinct("p_type").alias("k")).filter("k > 3").select("p_brand")


@query("set01_set05_coverage", "SELECT count(*) FILTER (o AND p) AS both_sets, count(*) FILTER (o AND NOT p) AS only_orders, count(*) FILTER (NOT o AND p) AS only_positive, count(*) FILTER (NOT o AND NOT p) AS neither FROM (SELECT c_custkey IN (SELECT o_custkey FROM orders) AS o, c_acctbal > 0 AS p FROM customer)")
def coverage_sets(s, d):
    e = entities(s, d).select((F.col("reviews") > 0).alias("o"), (F.col("rating") > 0).alias("p"))
    o, p = F.col("o"), F.col("p")
    return e.agg(F.count_if(o & p).alias("both_sets"), F.count_if(o & ~p).alias("only_orders"), F.count_if(~o & p).alias("only_positive"), F.count_if(~o & ~p).alias("neither"))


@query("set04_union", "SELECT s_suppkey AS id, s_name AS name, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def union(s, d):
    a = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return a.unionByName(table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), allowMissingColumns=True)


RANKED = E + ", r AS (SELECT rank() OVER (ORDER BY reviews) + (count(*) OVER (PARTITION BY reviews) - 1) / 2.0 AS x, rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0 AS y FROM ent WHERE price IS NOT NULL) "


@query("st02_spearman", RANKED + "SELECT count(*) AS n, round(corr(x, y), 6) AS rho FROM r")
def spearman(s, d):
    return stats.spearman(entities(s, d), "reviews", "price").select("n", r6(F.col("rho")).alias("rho"))


@query("st05_trend", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem")
def trend(s, d):
    return table(s, d, "lineitem").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 2).alias("intercept"))


@query("st06_nb08_outliers", "WITH o AS (SELECT o_orderkey, CASE o_orderkey % 97 WHEN 0 THEN 9 * o_totalprice WHEN 1 THEN -o_totalprice ELSE o_totalprice END AS price FROM orders), q AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM o) SELECT o_orderkey, price FROM o, q WHERE price < a - 1.5 * (b - a) OR price > b + 1.5 * (b - a)")
def outliers(s, d):
    """Orders beyond the fences; some prices are written wrongly, so that there are any."""
    k, v = F.col("o_orderkey") % 97, F.col("o_totalprice")
    return stats.outside_fences(table(s, d, "orders").select("o_orderkey", F.when(k == 0, 9 * v).when(k == 1, -v).otherwise(v).alias("price")), "price")


@query("st07_neighbour_premium", "WITH g AS (SELECT p_size AS k, quantile_cont(p_retailprice, 0.5) AS m FROM part GROUP BY 1) SELECT a.k, round(100 * (a.m / b.m - 1), 6) AS premium_pct FROM g a JOIN g b ON a.k = b.k + 1")
def neighbour_premium(s, d):
    g = table(s, d, "part").groupBy(F.col("p_size").alias("k")).agg(F.percentile("p_retailprice", F.lit(0.5)).alias("m"))
    return g.join(g.select((F.col("k") + 1).alias("k"), F.col("m").alias("b")), "k").select("k", r6(100 * (F.col("m") / F.col("b") - 1)).alias("premium_pct"))


@query("dq02_dq06_report", "SELECT 'negative_balance' AS check_name, count(*) FILTER (c_acctbal < 0) AS bad_rows, CASE WHEN count(*) FILTER (c_acctbal < 0) > 0 THEN 'WARNING' ELSE 'PASS' END AS status FROM customer UNION ALL SELECT 'missing_name', count(*) FILTER (c_name IS NULL), CASE WHEN count(*) FILTER (c_name IS NULL) > 0 THEN 'FAIL' ELSE 'PASS' END FROM customer UNION ALL SELECT 'odd_segment', count(*) FILTER (length(c_mktsegment) < 8), CASE WHEN count(*) FILTER (length(c_mktsegment) < 8) > 0 THEN 'FAIL' ELSE 'PASS' END FROM customer")
def dq_report(s, d):
    return checks.report(table(s, d, "customer"), [("negative_balance", F.col("c_acctbal") < 0, "WARNING"), ("missing_name", F.col("c_name").isNull(), "FAIL"), ("odd_segment", F.length("c_mktsegment") < 8, "FAIL")])


@query("dq07_compare", "SELECT k, round(a.v, 2) AS expected, round(b.v, 2) AS actual, CASE WHEN a.v IS NULL THEN 'ONLY_ACTUAL' WHEN b.v IS NULL THEN 'ONLY_EXPECTED' WHEN abs(a.v - b.v) <= 1e-6 + 1e-9 * abs(a.v) THEN 'MATCH' ELSE 'DIFFERENT' END AS status FROM (SELECT c_nationkey AS k, sum(c_acctbal) AS v FROM customer GROUP BY 1) a FULL JOIN (SELECT c_nationkey AS k, sum(c_acctbal) AS v FROM customer WHERE c_nationkey % 5 > 0 OR c_acctbal > 0 GROUP BY 1) b USING (k)")
def compare(s, d):
    c = table(s, d, "customer").withColumnRenamed("c_nationkey", "k")
    a, b = c.groupBy("k").agg(F.sum("c_acctbal").alias("v")), c.filter("k % 5 > 0 OR c_acctbal > 0").groupBy("k").agg(F.sum("c_acctbal").alias("v"))
    return checks.compared(a, b, ["k"], "v", 1e-6).withColumns({"expected": F.round("expected", 2), "actual": F.round("actual", 2)})


@query("dq16_orphans", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def orphans(s, d):
    return table(s, d, "lineitem").join(table(s, d, "orders").filter("o_orderstatus <> 'P'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("l_orderkey", "l_linenumber")


@query("nb09_area_correlation", E + ", g AS (SELECT grp, avg(rating) AS a, sum(reviews)::DOUBLE AS b FROM ent GROUP BY 1) SELECT round(corr(a, b), 4) AS r FROM g")
def area_correlation(s, d):
    g = entities(s, d).groupBy("grp").agg(F.avg("rating").alias("a"), F.sum("reviews").cast("double").alias("b"))
    return g.agg(F.round(stats.pearson(F.col("a"), F.col("b")), 4).alias("r"))


@query("nb34_grand_total", "SELECT coalesce(c_mktsegment, 'OVERALL') AS entity, count(*) AS n, round(avg(c_acctbal), 6) AS mean FROM customer GROUP BY GROUPING SETS ((c_mktsegment), ())")
def grand_total(s, d):
    return table(s, d, "customer").rollup("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("c_acctbal")).alias("mean")).select(F.coalesce("c_mktsegment", F.lit("OVERALL")).alias("entity"), "n", "mean")
