"""Audits, summaries and coverage tables: columns, rules, statistics, key figures, spines and reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import checks, clean, stats, terms, within
from ..operators.quantiles import exact_quantiles, with_quantiles
from ..sources.stage import saved
from .frames import ASP, ENT, LONG, MON, aspect_docs, entities, monthly, r6, table
from .registry import query

E, AL = f"WITH {ENT} ", f"WITH {ASP}, {LONG} "


def _stacked(df, names):
    """One row from a wide aggregate of structs: name and the struct's fields."""
    return df.unpivot([], names, "name", "s").select("name", "s.*")


@query("nb02_nb45_class_audit", E + "SELECT name, n, missing, missing_pct, CASE WHEN missing_pct >= 30 THEN 'HIGH' WHEN missing_pct >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS n, count(*) - count({c}) AS missing, round(100.0 * (count(*) - count({c})) / count(*), 2) AS missing_pct FROM ent" for c in ("rating", "reviews", "price")) + ")")
def class_audit(s, d):
    cols = ["rating", "reviews", "price"]
    n = F.count(F.lit(1))
    one = entities(s, d).agg(*(F.struct(n.alias("n"), (n - F.count(c)).alias("missing"), F.round(100.0 * (n - F.count(c)) / n, 2).alias("missing_pct")).alias(c) for c in cols))
    return _stacked(one, cols).withColumn("priority", clean.first_label([(F.col("missing_pct") >= 30, "HIGH"), (F.col("missing_pct") >= 5, "MEDIUM")], "LOW"))


@query("nb03_nb05_source_audit", r"SELECT count(*) AS n, count(*) FILTER (regexp_matches(url, '^https?://')) AS well_formed, count(url) - count(DISTINCT url) AS repeated, round(count(DISTINCT url) / count(*), 6) AS unique_ratio, count(*) FILTER (contains(url, page_id::VARCHAR)) AS with_own_id, count(*) FILTER (length(url) < 20) AS short FROM pages")
def source_audit(s, d):
    n, u = F.count(F.lit(1)), F.count_distinct("url")
    return table(s, d, "pages").select("page_id", "url").agg(n.alias("n"), F.count_if(F.col("url").rlike("^https?://")).alias("well_formed"), (F.count("url") - u).alias("repeated"), r6(u / n).alias("unique_ratio"), F.count_if(F.contains("url", F.col("page_id").cast("string"))).alias("with_own_id"), F.count_if(F.length("url") < 20).alias("short"))


@query("nb04_snapshot_audit", "SELECT count(*) - count(ts) AS missing, count(DISTINCT ts::DATE) AS n_days, count(DISTINCT ts::DATE) = 1 AS single_snapshot, strftime(min(ts), '%Y-%m-%d') AS first_day, strftime(max(ts), '%Y-%m-%d') AS last_day FROM events")
def snapshot_audit(s, d):
    day = F.to_date("ts")
    return table(s, d, "events").agg((F.count(F.lit(1)) - F.count("ts")).alias("missing"), F.count_distinct(day).alias("n_days"), (F.count_distinct(day) == 1).alias("single_snapshot"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day"))


RULES = [("negative_quantity", "l_quantity < 0", "FAIL"), ("discount_over_tenth", "l_discount > 0.1", "WARNING"), ("no_part", "l_partkey IS NULL", "FAIL"), ("returned_but_open", "l_returnflag = 'R' AND l_linestatus = 'O'", "WARNING"), ("free_of_price", "l_extendedprice <= 0", "FAIL"), ("shipped_before_1992", "l_shipdate < TIMESTAMP '1992-01-01 00:00:00'", "WARNING")]


@query("nb06_dq10_rule_table", " UNION ALL ".join(f"SELECT '{n}' AS check_name, count(*) FILTER ({p}) AS bad_rows, CASE WHEN count(*) FILTER ({p}) > 0 THEN '{v}' ELSE 'PASS' END AS status FROM lineitem" for n, p, v in RULES))
def rule_table(s, d):
    """Rules as (name, predicate of a bad row, severity): one scan counts all."""
    return checks.report(table(s, d, "lineitem"), [(n, F.expr(p), v) for n, p, v in RULES])


@query("nb07_nb08_statistics", E + " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS n, count(*) - count({c}) AS missing, round(min({c}), 4)::DOUBLE AS low, round(max({c}), 4)::DOUBLE AS high, round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)), 4) AS lower_fence, round(quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)), 4) AS upper_fence FROM ent" for c in ("rating", "reviews", "price")))
def statistics(s, d):
    cols = ["rating", "reviews", "price"]
    r4 = lambda c: F.round(c, 4)

    e = saved(entities(s, d).select(*cols))
    ends = stats.fences(e, *cols).crossJoin(exact_quantiles(e, {f"mid_{c}": (c, 0.5) for c in cols}))

    def of(c):
        return F.struct(F.count(c).alias("n"), (F.count(F.lit(1)) - F.count(c)).alias("missing"), r4(F.min(c).cast("double")).alias("low"), r4(F.max(c).cast("double")).alias("high"), r4(F.avg(c)).alias("mean"), r4(F.first(f"mid_{c}")).alias("median"), r4(F.first(f"low_{c}")).alias("lower_fence"), r4(F.first(f"high_{c}")).alias("upper_fence")).alias(c)

    return _stacked(e.crossJoin(F.broadcast(ends)).agg(*(of(c) for c in cols)), cols)


@query("nb11_extremes", E + "SELECT entity_id, rating <= 0 AS low_rated, coalesce(reviews > r95, false) AS busy, coalesce(price > p95, false) AS dear FROM ent, (SELECT quantile_cont(reviews, 0.95) AS r95, quantile_cont(price, 0.95) AS p95 FROM ent) WHERE rating <= 0 OR reviews > r95 OR price > p95")
def extremes(s, d):
    e = saved(entities(s, d).select("entity_id", "rating", "reviews", "price"))
    low, busy, dear = F.col("rating") <= 0, F.coalesce(F.col("reviews") > F.col("r95"), F.lit(False)), F.coalesce(F.col("price") > F.col("p95"), F.lit(False))
    return with_quantiles(e, {"r95": ("reviews", 0.95), "p95": ("price", 0.95)}).filter(low | busy | dear).select("entity_id", low.alias("low_rated"), busy.alias("busy"), dear.alias("dear"))


@query("nb14_nb26_context_medians", E + "SELECT segment, count(*) AS n, count(price) AS priced, round(count(price) / count(*), 6) AS coverage, round(quantile_cont(price, 0.5), 4) AS median_price, round(quantile_cont(rating, 0.5), 4) AS median_rating FROM ent GROUP BY 1")
def context_medians(s, d):
    n = F.count(F.lit(1))
    return entities(s, d).groupBy("segment").agg(n.alias("n"), F.count("price").alias("priced"), r6(F.count("price") / n).alias("coverage"), F.round(F.percentile("price", F.lit(0.5)), 4).alias("median_price"), F.round(F.percentile("rating", F.lit(0.5)), 4).alias("median_rating"))


PAIRS = [("rating", "reviews"), ("rating", "price"), ("reviews", "price")]


@query("nb15_nb27_correlation_set", E + " UNION ALL ".join(f"SELECT '{a}:{b}' AS name, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, round(corr({a}, {b}), 6) AS r FROM ent" for a, b in PAIRS))
def correlation_set(s, d):
    """Several pairs in one aggregate, each over its own complete rows."""
    of = lambda a, b: F.struct(F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("n"), r6(stats.pearson(F.col(a), F.col(b))).alias("r")).alias(f"{a}:{b}")
    return _stacked(entities(s, d).agg(*(of(a, b) for a, b in PAIRS)), [f"{a}:{b}" for a, b in PAIRS])


@query("nb18_input_checks", f"WITH {MON} SELECT 'no_missing_period' AS name, count(*) FILTER (period IS NULL) = 0 AS passed FROM mon UNION ALL SELECT 'period_once', count(*) = count(DISTINCT period) FROM mon UNION ALL SELECT 'parts_make_total', count(*) FILTER (a + b <> total) = 0 FROM mon UNION ALL SELECT 'values_positive', count(*) FILTER (value <= 0) = 0 FROM mon UNION ALL SELECT 'full_years', count(*) % 12 = 0 FROM mon")
def input_checks(s, d):
    n = F.count(F.lit(1))
    c = {"no_missing_period": F.count_if(F.col("period").isNull()) == 0, "period_once": n == F.count_distinct("period"), "parts_make_total": F.count_if(F.col("a") + F.col("b") != F.col("total")) == 0, "values_positive": F.count_if(F.col("value") <= 0) == 0, "full_years": n % 12 == 0}
    return monthly(s, d).agg(*(v.alias(k) for k, v in c.items())).unpivot([], list(c), "name", "passed")


@query("nb20_er14_key_findings", E + "SELECT row_number() OVER (ORDER BY o) AS finding_id, line FROM (SELECT 1 AS o, 'Entities: ' || count(*) AS line FROM ent UNION ALL SELECT 2, 'Groups: ' || count(DISTINCT grp) FROM ent UNION ALL SELECT 3, 'Without orders: ' || count(*) FILTER (reviews = 0) FROM ent UNION ALL SELECT 4, 'Most orders: ' || max(reviews) FROM ent)")
def key_findings(s, d):
    one = entities(s, d).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("grp").alias("g"), F.count_if(F.col("reviews") == 0).alias("z"), F.max("reviews").alias("m"))
    lines = F.array(F.format_string("Entities: %d", "n"), F.format_string("Groups: %d", "g"), F.format_string("Without orders: %d", "z"), F.format_string("Most orders: %d", "m"))
    return one.select(F.posexplode(lines).alias("i", "line")).select((F.col("i") + 1).cast("long").alias("finding_id"), "line")


@query("nb21_nb22_area_coverage", E + ", o AS (SELECT o_custkey, o_orderstatus FROM orders) SELECT grp, count(DISTINCT entity_id) AS entities, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p, round(100.0 * count(DISTINCT o_custkey) / count(DISTINCT entity_id), 6) AS covered_pct FROM ent LEFT JOIN o ON o_custkey = entity_id GROUP BY 1")
def area_coverage(s, d):
    """Orders are counted by customer before the join, so that it stays one row an entity."""
    k = F.col("o_orderstatus")
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("entity_id")).agg(*(F.count_if(k == v).alias(v) for v in "FOP"))
    g = entities(s, d).join(o, "entity_id", "left").groupBy("grp")
    z = lambda v: F.coalesce(F.sum(v), F.lit(0)).alias(f"n_{v.lower()}")
    return g.agg(F.count(F.lit(1)).alias("entities"), z("F"), z("O"), z("P"), r6(100.0 * F.count("F") / F.count(F.lit(1))).alias("covered_pct"))


@query("nb23_nb25_ag39_corpus_summary", "SELECT 'documents' AS metric, count(*)::BIGINT AS n, 100.0 AS share FROM documents UNION ALL SELECT 'empty', count(*) FILTER (length(coalesce(text, '')) = 0), round(100.0 * count(*) FILTER (length(coalesce(text, '')) = 0) / count(*), 4) FROM documents UNION ALL SELECT 'short', count(*) FILTER (length(text) < 200), round(100.0 * count(*) FILTER (length(text) < 200) / count(*), 4) FROM documents UNION ALL SELECT 'without_lang', count(*) FILTER (lang IS NULL), round(100.0 * count(*) FILTER (lang IS NULL) / count(*), 4) FROM documents")
def corpus_summary(s, d):
    size = F.length(F.coalesce("text", F.lit("")))
    c = {"documents": F.lit(True), "empty": size == 0, "short": F.length("text") < 200, "without_lang": F.col("lang").isNull()}
    one = table(s, d, "documents").agg(*(F.struct(F.count_if(v).alias("n"), F.round(100.0 * F.count_if(v) / F.count(F.lit(1)), 4).alias("share")).alias(k) for k, v in c.items()))
    return one.unpivot([], list(c), "metric", "s").select("metric", "s.*")


@query("nb24_dq08_expected_counts", "WITH e(name, expected) AS (VALUES ('nation', 25), ('region', 5), ('labels', 1)), a AS (SELECT 'nation' AS name, count(*) AS actual FROM nation UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'labels', count(*) FROM labels) SELECT name, expected::BIGINT AS expected, actual, actual - expected AS difference, CASE WHEN actual = expected THEN 'PASS' ELSE 'WARNING' END AS status FROM e JOIN a USING (name)")
def expected_counts(s, d):
    out = None
    for name, expected in (("nation", 25), ("region", 5), ("labels", 1)):
        one = table(s, d, name).agg(F.count(F.lit(1)).alias("actual")).select(F.lit(name).alias("name"), F.lit(expected).cast("long").alias("expected"), "actual")
        out = one if out is None else out.unionByName(one)
    gap = F.col("actual") - F.col("expected")
    return out.select("*", gap.alias("difference"), F.when(gap == 0, "PASS").otherwise("WARNING").alias("status"))


REPLY = "r AS (SELECT conv_id, count(*) FILTER (role = 'assistant') AS replies, count(*) AS turns FROM conversations GROUP BY 1)"


def _replies(s, d):
    return table(s, d, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("replies"), F.count(F.lit(1)).alias("turns"))


@query("nb28_reply_distribution", f"WITH {REPLY} SELECT replies, count(*) AS n, quantile_cont(turns, 0.5) AS median_turns, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share FROM r GROUP BY 1")
def reply_distribution(s, d):
    g = _replies(s, d).groupBy("replies").agg(F.count(F.lit(1)).alias("n"), F.percentile("turns", F.lit(0.5)).alias("median_turns"))
    total = g.agg(F.sum("n").alias("all"))
    return g.crossJoin(F.broadcast(total)).select("replies", "n", "median_turns", r6(100.0 * F.col("n") / F.col("all")).alias("share"))


@query("nb29_tk03_longest", "SELECT o_orderkey, date_diff('day', o_orderdate, max(l_shipdate)) AS days FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate ORDER BY days DESC, o_orderkey LIMIT 8")
def longest(s, d):
    last = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("at"))
    days = F.date_diff(F.to_date("at"), F.to_date("o_orderdate"))
    return table(s, d, "orders").join(last, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", days.cast("long").alias("days")).orderBy(F.desc("days"), "o_orderkey").limit(8)


@query("nb33_response_terms", r"WITH w AS (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS term FROM conversations WHERE role = 'assistant') SELECT term, count(*) AS n_docs FROM w GROUP BY 1 HAVING count(*) >= 2")
def response_terms(s, d):
    c = table(s, d, "conversations").filter("role = 'assistant'")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))
    return c.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_docs")).filter("n_docs >= 2")


@query("nb35_group_profiles", f"WITH {ASP} SELECT a.rating_group, count(*) AS n, round(avg(n_chars), 4) AS mean_chars, min(a.doc_id) AS first_id, max(a.doc_id) AS last_id, count(DISTINCT a.source) AS sources FROM asp a JOIN documents d ON d.doc_id = a.doc_id GROUP BY 1")
def group_profiles(s, d):
    size = table(s, d, "documents").select("doc_id", "n_chars", "source")
    lab = table(s, d, "labels").select("doc_id", "quality")
    g = F.when(F.col("quality") == 0, "LOW").when(F.col("quality") == 1, "HIGH").otherwise("MIXED").alias("rating_group")
    return size.join(lab, "doc_id", "left").groupBy(g).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count_distinct("source").alias("sources"))


@query("nb37_case_features", AL + ", r AS (SELECT source, aspect, avg(matched::INT) FILTER (rating_group = 'HIGH') - avg(matched::INT) FILTER (rating_group = 'LOW') AS gap, avg(matched::INT) AS rate FROM lng GROUP BY 1, 2) SELECT source, round(max(rate) FILTER (aspect = 'motion'), 6) AS motion_rate, round(max(rate) FILTER (aspect = 'place'), 6) AS place_rate, round(max(gap), 6) AS top_gap FROM r GROUP BY 1")
def case_features(s, d):
    from .frames import ASPECTS

    rows = terms.aspect_rows(aspect_docs(s, d), list(ASPECTS), ["doc_id", "source", "rating_group"])
    hit = F.col("matched").cast("int")
    r = rows.groupBy("source", "aspect").agg((F.avg(F.when(F.col("rating_group") == "HIGH", hit)) - F.avg(F.when(F.col("rating_group") == "LOW", hit))).alias("gap"), F.avg(hit).alias("rate"))
    at = lambda a: r6(F.max(F.when(F.col("aspect") == a, F.col("rate")))).alias(f"{a}_rate")
    return r.groupBy("source").agg(at("motion"), at("place"), r6(F.max("gap")).alias("top_gap"))


@query("nb38_label_rank_pivot", "SELECT o_custkey, max(CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 ELSE 1 END) FILTER (o_orderstatus = 'F') AS f_rank, max(CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 ELSE 1 END) FILTER (o_orderstatus = 'O') AS o_rank FROM orders GROUP BY 1")
def label_rank_pivot(s, d):
    rank = clean.recoded(F.col("o_orderpriority"), {"1-URGENT": "3", "2-HIGH": "2"}, "1").cast("int")
    at = lambda v: F.max(F.when(F.col("o_orderstatus") == v, rank)).alias(f"{v.lower()}_rank")
    return table(s, d, "orders").groupBy("o_custkey").agg(at("F"), at("O"))


@query("ag45_nb39_final_master", E + ", s AS (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1) SELECT grp, count(DISTINCT entity_id) AS entities, count(*) FILTER (reviews > 0) AS active, count(*) FILTER (rating < 0) AS in_debt, max(suppliers) AS suppliers FROM ent JOIN customer ON c_custkey = entity_id LEFT JOIN s ON s_nationkey = c_nationkey GROUP BY 1")
def final_master(s, d):
    n = table(s, d, "nation").select("n_nationkey", F.col("n_name").alias("grp"))
    sup = table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("suppliers"))
    g = entities(s, d).groupBy("grp").agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("reviews") > 0).alias("active"), F.count_if(F.col("rating") < 0).alias("in_debt"))
    return g.join(n.join(sup, "n_nationkey", "left").select("grp", "suppliers"), "grp", "left")


@query("nb40_sample_reports", E + "SELECT coalesce(grp, 'ALL') AS area, count(*) AS entities, sum(reviews)::BIGINT AS reviews, round(CASE WHEN sum(reviews) > 0 THEN count(*) / sum(reviews) END, 6) AS fraction FROM ent GROUP BY ROLLUP (grp)")
def sample_reports(s, d):
    g = entities(s, d).rollup("grp").agg(F.count(F.lit(1)).alias("entities"), F.sum("reviews").alias("reviews"))
    return g.select(F.coalesce("grp", F.lit("ALL")).alias("area"), "entities", "reviews", r6(clean.safe_ratio(F.col("entities"), F.col("reviews"))).alias("fraction"))


TOPS = "r AS (SELECT source, aspect, round(100 * (coalesce(avg(matched::INT) FILTER (rating_group = 'HIGH'), 0) - coalesce(avg(matched::INT) FILTER (rating_group = 'LOW'), 0)), 6) AS gap FROM lng GROUP BY 1, 2)"


@query("nb41_top_rates", AL + f", {TOPS} SELECT source, aspect, gap FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY gap DESC, aspect) AS rn FROM r) WHERE rn <= 3 AND gap > 0")
def top_rates(s, d):
    """The first three by rate, of which only positive ones are kept afterwards."""
    from .frames import ASPECTS

    rows = terms.aspect_rows(aspect_docs(s, d), list(ASPECTS), ["doc_id", "source", "rating_group"])
    rate = lambda g: F.coalesce(F.avg(F.when(F.col("rating_group") == g, F.col("matched").cast("int"))), F.lit(0.0))
    r = rows.groupBy("source", "aspect").agg(r6(100 * (rate("HIGH") - rate("LOW"))).alias("gap"))
    return within.top_k(r, 3, [F.desc("gap"), F.col("aspect")], ["source"]).filter("gap > 0").select("source", "aspect", "gap")


@query("nb42_universe", "SELECT c_custkey AS target, coalesce(cap, 5)::BIGINT AS cap FROM customer LEFT JOIN (SELECT s_suppkey, least(75, 10 + s_suppkey) AS cap FROM supplier) ON s_suppkey = c_custkey")
def universe(s, d):
    """Every target has a row; a cap comes from the lookup where it has one."""
    caps = table(s, d, "supplier").select(F.col("s_suppkey").alias("target"), F.least(F.lit(75), 10 + F.col("s_suppkey")).alias("cap"))
    return checks.joined_once(table(s, d, "customer").select(F.col("c_custkey").alias("target")), caps, ["target"]).select("target", F.coalesce("cap", F.lit(5)).cast("long").alias("cap"))


@query("nb43_fallback_import", "SELECT s_suppkey, o_orderkey, 'ORDERS' AS provenance FROM (SELECT s_suppkey, o_orderkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY o_orderkey) AS rn FROM supplier JOIN customer ON lower(replace(s_name, 'Supplier', 'customer')) = lower(c_name) JOIN orders ON o_custkey = c_custkey) WHERE rn <= 5")
def fallback_import(s, d):
    """Rows of a sibling corpus under the same name, so many an owner."""
    left = table(s, d, "supplier").select("s_suppkey", F.lower(F.replace("s_name", F.lit("Supplier"), F.lit("customer"))).alias("k"))
    right = table(s, d, "customer").select("c_custkey", F.lower("c_name").alias("k"))
    rows = left.join(right, "k").join(table(s, d, "orders").select("o_custkey", "o_orderkey"), F.col("o_custkey") == F.col("c_custkey"))
    return within.top_k(rows, 5, [F.col("o_orderkey")], ["s_suppkey"]).select("s_suppkey", "o_orderkey", F.lit("ORDERS").alias("provenance"))


@query("nb46_nb47_classified", "SELECT CASE WHEN contains(url, '/en/') THEN 'english' WHEN regexp_matches(url, '/(de|fr|es)/') THEN 'foreign' WHEN contains(url, '?') THEN 'query' ELSE 'other' END AS kind, count(*) AS stated, count(html) AS with_html, (SELECT count(*) FROM pages) AS total FROM pages GROUP BY 1")
def classified(s, d):
    kind = clean.first_label([(F.contains("url", F.lit("/en/")), "english"), (F.col("url").rlike("/(de|fr|es)/"), "foreign"), (F.contains("url", F.lit("?")), "query")], "other")
    p = table(s, d, "pages")
    return p.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("stated"), F.count("html").alias("with_html")).crossJoin(F.broadcast(p.agg(F.count(F.lit(1)).alias("total"))))


INVENTORY = [("customer", "c_custkey"), ("supplier", "s_suppkey"), ("orders", "o_orderkey"), ("documents", "doc_id")]


@query("nb50_src21_inventory", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows, '{k}' AS key, count(*) = count(DISTINCT {k}) AS unique_key FROM {t}" for t, k in INVENTORY))
def inventory(s, d):
    out = None
    for t, k in INVENTORY:
        one = table(s, d, t).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(k).alias("u")).select(F.lit(t).alias("name"), "n_rows", F.lit(k).alias("key"), (F.col("n_rows") == F.col("u")).alias("unique_key"))
        out = one if out is None else out.unionByName(one)
    return out


@query("dq04_dictionary", "SELECT column_name AS name, CASE column_type WHEN 'BIGINT' THEN 'bigint' ELSE 'string' END AS type FROM (DESCRIBE SELECT doc_id, text, lang, source, n_chars FROM documents)")
def dictionary(s, d):
    return s.createDataFrame(table(s, d, "documents").dtypes, "name string, type string")


@query("dq13_ts07_state_quality", " UNION ALL ".join(f"SELECT '{n}' AS check_name, count(*) FILTER ({p}) AS issues, count(*) AS denominator, round(100.0 * count(*) FILTER ({p}) / count(*), 4) AS issue_pct FROM documents" for n, p in (("text_missing", "text IS NULL OR text = ''"), ("lang_missing", "lang IS NULL"), ("source_missing", "source IS NULL"), ("size_differs", "n_chars <> length(text)"), ("very_long", "n_chars > 50000"))))
def state_quality(s, d):
    rules = [("text_missing", "text IS NULL OR text = ''"), ("lang_missing", "lang IS NULL"), ("source_missing", "source IS NULL"), ("size_differs", "n_chars <> length(text)"), ("very_long", "n_chars > 50000")]
    n = F.count(F.lit(1))
    one = table(s, d, "documents").agg(*(F.struct(F.count_if(F.expr(p)).alias("issues"), n.alias("denominator"), F.round(100.0 * F.count_if(F.expr(p)) / n, 4).alias("issue_pct")).alias(k) for k, p in rules))
    return one.unpivot([], [k for k, _ in rules], "check_name", "s").select("check_name", "s.*")


@query("dq14_dq15_drop_log", "SELECT reason, count(*) AS n_rows FROM (SELECT CASE WHEN coalesce(trim(text), '') = '' THEN 'EMPTY' WHEN row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 THEN 'DUPLICATE' ELSE 'KEPT' END AS reason FROM documents) GROUP BY 1")
def drop_log(s, d):
    """Rows travel by a digest of their text."""
    rows = table(s, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"), (F.trim(F.coalesce("text", F.lit(""))) == "").alias("empty"))
    again = F.row_number().over(Window.partitionBy("h").orderBy("doc_id")) > 1
    return rows.select(F.when(F.col("empty"), "EMPTY").when(again, "DUPLICATE").otherwise("KEPT").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"))


@query("dq11_dq12_reply_consistency", "WITH r AS (SELECT conv_id, max(turn) + 1 AS stated, count(*) AS counted, bool_or(role = 'assistant') AS flag, bool_or(role = 'assistant' AND length(coalesce(text, '')) > 0) AS has_text FROM conversations GROUP BY 1) SELECT conv_id, stated <> counted AS count_mismatch, flag <> has_text AS response_mismatch FROM r")
def reply_consistency(s, d):
    a = F.col("role") == "assistant"
    r = table(s, d, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).alias("stated"), F.count(F.lit(1)).alias("counted"), F.bool_or(a).alias("flag"), F.bool_or(a & (F.length(F.coalesce("text", F.lit(""))) > 0)).alias("has_text"))
    return r.select("conv_id", (F.col("stated") != F.col("counted")).alias("count_mismatch"), (F.col("flag") != F.col("has_text")).alias("response_mismatch"))


@query("dq18_dq09_metric_compare", "SELECT o_custkey AS id, count(*) AS stated, coalesce(any_value(n), 0) AS audited, CASE WHEN count(*) = coalesce(any_value(n), 0) THEN 'MATCH' ELSE 'DIFFERENT' END AS status FROM orders LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_totalprice > 0 GROUP BY 1) ON k = o_custkey GROUP BY 1")
def metric_compare(s, d):
    """Figures of a text report, read back by pattern, against a fresh count."""
    o = table(s, d, "orders")
    report = o.groupBy(F.col("o_custkey").alias("id")).agg(F.format_string("orders: %d (all)", F.count(F.lit(1))).alias("line"))
    stated = report.select("id", F.nullif(F.regexp_extract("line", "orders: (\\d+)", 1), F.lit("")).try_cast("long").alias("stated"))
    audit = o.filter("o_totalprice > 0").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    j = stated.join(audit, "id", "left").withColumn("audited", F.coalesce("n", F.lit(0)))
    return j.select("id", "stated", "audited", F.when(F.col("stated") == F.col("audited"), "MATCH").otherwise("DIFFERENT").alias("status"))


@query("ag20_crosstab", "SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '2-HIGH') AS high, count(*) FILTER (o_orderpriority = '5-LOW') AS low, count(*) AS total FROM orders GROUP BY 1")
def crosstab(s, d):
    k = F.col("o_orderpriority")
    return table(s, d, "orders").groupBy("o_orderstatus").agg(F.count_if(k == "1-URGENT").alias("urgent"), F.count_if(k == "2-HIGH").alias("high"), F.count_if(k == "5-LOW").alias("low"), F.count(F.lit(1)).alias("total"))


@query("ag44_reply_visibility", "SELECT role, count(*) AS n, count(*) FILTER (turn <= 1) AS early, round(100.0 * count(*) FILTER (length(text) > 0) / count(*), 6) AS visible_pct FROM conversations GROUP BY 1")
def reply_visibility(s, d):
    return table(s, d, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("turn") <= 1).alias("early"), r6(100.0 * F.count_if(F.length("text") > 0) / F.count(F.lit(1))).alias("visible_pct"))


@query("ag46_denominator_audit", E + "SELECT grp, 'priced of all' AS basis, count(price) AS numerator, count(*) AS denominator FROM ent GROUP BY 1")
def denominator_audit(s, d):
    return entities(s, d).groupBy("grp").agg(F.count("price").alias("numerator"), F.count(F.lit(1)).alias("denominator")).withColumn("basis", F.lit("priced of all"))


@query("set03_expected_set", "WITH x AS (SELECT unnest(['ALGERIA', 'BRAZIL', 'ATLANTIS']) AS name), n AS (SELECT n_name AS name, count(*) AS c FROM nation GROUP BY 1) SELECT name, CASE WHEN n.name IS NULL THEN 'MISSING' WHEN x.name IS NULL THEN 'EXTRA' WHEN c > 1 THEN 'REPEATED' ELSE 'OK' END AS state FROM x FULL JOIN n USING (name)")
def expected_set(s, d):
    x = s.createDataFrame([("ALGERIA",), ("BRAZIL",), ("ATLANTIS",)], "name string").withColumn("wanted", F.lit(1))
    n = table(s, d, "nation").groupBy(F.col("n_name").alias("name")).agg(F.count(F.lit(1)).alias("c"))
    return x.join(n, "name", "full").select("name", F.when(F.col("c").isNull(), "MISSING").when(F.col("wanted").isNull(), "EXTRA").when(F.col("c") > 1, "REPEATED").otherwise("OK").alias("state"))


@query("ts13_overlay", f"WITH {MON} SELECT period, round(100.0 * value / max(value) OVER (PARTITION BY year), 6) AS index_of_peak FROM mon")
def overlay(s, d):
    return monthly(s, d).select("period", r6(100.0 * F.col("value") / F.max("value").over(Window.partitionBy("year"))).alias("index_of_peak"))


@query("snk06_report_lines", E + "SELECT grp, '- ' || grp || ': ' || count(*) || ' entities, ' || coalesce(sum(reviews), 0)::BIGINT || ' orders' AS line FROM ent GROUP BY 1")
def report_lines(s, d):
    return entities(s, d).groupBy("grp").agg(F.format_string("- %s: %d entities, %d orders", F.first("grp"), F.count(F.lit(1)), F.coalesce(F.sum("reviews"), F.lit(0))).alias("line"))
