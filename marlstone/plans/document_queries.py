"""Queries over documents, pages and replies: text scalars, terms, aspects, severity, drivers, duplicates, resolution."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import composites, pages, resolve, terms, within
from ..operators.quantiles import exact_quantiles
from ..session import shipped
from ..sources import io
from ..sources.stage import saved
from .frames import ASP, ASPECTS, ENT, HIGH, LONG, MEDIUM, SEVERITY, aspect_docs, entities, r6, table
from .registry import query

A, AL = f"WITH {ASP} ", f"WITH {ASP}, {LONG} "
NAMES = list(ASPECTS)
TOK = r"WITH w AS (SELECT doc_id, lang, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: length(x) >= 2) AS ws FROM documents) "


def _tokens(s, d):
    t = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^\\p{L}\\s]", " "), "\\s+", " "))
    return table(s, d, "documents").select("doc_id", "lang", X.tokens(t).alias("ws"))


@query("tx01_folded", "SELECT c_custkey, nullif(trim(regexp_replace(lower(translate(c_name, 'çğıöşüÇĞİÖŞÜ', 'cgiosuCGIOSU')), '[^a-z0-9_]+', ' ', 'g')), '') AS folded FROM customer")
def folded(s, d):
    return table(s, d, "customer").select("c_custkey", X.folded(F.col("c_name")).alias("folded"))


@query("tx02_core_name", "SELECT s_suppkey, trim(replace(lower(replace(s_name, '#', ' ')), 'supplier', '')) AS core FROM supplier")
def core_name(s, d):
    return table(s, d, "supplier").select("s_suppkey", X.core_name(F.col("s_name"), ["supplier"]).alias("core"))


@query("tx08_truth", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN TRUE END AS v FROM part")
def truth(s, d):
    k = F.col("p_size") % 4
    return table(s, d, "part").select("p_partkey", X.truth(F.when(k == 0, " Evet ").when(k == 1, "no").when(k == 2, "1").otherwise("maybe")).alias("v"))


@query("tx09_count_value", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_size * 1000 WHEN 1 THEN p_size * 1000 + 500 WHEN 2 THEN p_size * 1000000 END::BIGINT AS v FROM part")
def count_value(s, d):
    k, n = F.col("p_size") % 4, F.col("p_size").cast("string")
    return table(s, d, "part").select("p_partkey", X.count_value(F.when(k == 0, F.concat(n, F.lit(".000"))).when(k == 1, F.concat(n, F.lit(",5 B"))).when(k == 2, F.concat(n, F.lit("M"))).otherwise("many")).alias("v"))


@query("tx11_tx12_contact_data", "SELECT count(*) FILTER (regexp_matches(text, '[\\w.+-]+@[\\w-]+\\.[\\w.]+')) AS with_mail FROM documents")
def contact_data(s, d):
    return table(s, d, "documents").agg(F.count_if(F.col("text").rlike(X.EMAIL)).alias("with_mail"))


@query("tx12_masked")
def masked(s, d):
    return table(s, d, "documents").select("doc_id", X.masked(F.col("text")).alias("masked"))


@query("tx13_nlp_text")
def nlp_text(s, d):
    return table(s, d, "documents").select("doc_id", X.nlp_text(F.col("text")).alias("normalized"))


@query("tx06_tx07_raw_clean")
def raw_clean(s, d):
    shipped(s)
    return table(s, d, "pages").select("page_id", X.duplicate_key(X.raw_clean(F.col("html"))).alias("key"))


@query("tx17_ngrams_tm01", TOK + ", g AS (SELECT doc_id, ws[i] || ' ' || ws[i + 1] AS term FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM w)) SELECT term, count(*) AS n_tokens, count(DISTINCT doc_id) AS n_docs, round(100.0 * count(DISTINCT doc_id) / (SELECT count(*) FROM w), 6) AS doc_share_pct FROM g GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5")
def bigram_table(s, d):
    return terms.term_table(_tokens(s, d), F.col("ws"), 2, 5).withColumn("doc_share_pct", r6(F.col("doc_share_pct")))


@query("tm01_terms", TOK + ", g AS (SELECT doc_id, unnest(ws) AS term FROM w) SELECT term, count(*) AS n_tokens, count(DISTINCT doc_id) AS n_docs, round(100.0 * count(DISTINCT doc_id) / (SELECT count(*) FROM w), 6) AS doc_share_pct FROM g GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3")
def term_table(s, d):
    return terms.term_table(_tokens(s, d), F.col("ws"), 1, 3).withColumn("doc_share_pct", r6(F.col("doc_share_pct")))


@query("tm03_distinctive", TOK + ", g AS (SELECT DISTINCT doc_id, lang, unnest(ws) AS term FROM w), t AS (SELECT term, 100.0 * count(*) FILTER (lang = 'en') / (SELECT count(*) FROM w WHERE lang = 'en') - 100.0 * count(*) FILTER (lang <> 'en') / (SELECT count(*) FROM w WHERE lang <> 'en') AS diff, count(*) AS n FROM g GROUP BY 1) SELECT term, round(diff, 6) AS diff_pp FROM t WHERE n >= 20")
def distinctive(s, d):
    w = _tokens(s, d)
    sizes = F.broadcast(w.agg(F.count_if(F.col("lang") == "en").alias("e"), F.count_if(F.col("lang") != "en").alias("o")))
    g = w.select("doc_id", "lang", F.explode(F.array_distinct("ws")).alias("term")).groupBy("term").agg(F.count_if(F.col("lang") == "en").alias("x"), F.count_if(F.col("lang") != "en").alias("y"), F.count(F.lit(1)).alias("n"))
    return g.filter("n >= 20").crossJoin(sizes).select("term", r6(100 * F.col("x") / F.col("e") - 100 * F.col("y") / F.col("o")).alias("diff_pp"))


@query("tm04_tf_idf", TOK + ", n AS (SELECT count(*) AS n FROM w), tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM w) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), x AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS v FROM tf JOIN df USING (term), n WHERE df >= 3 AND df <= 0.9 * n), u AS (SELECT doc_id, term, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS weight FROM x), m AS (SELECT lang, term, sum(weight) / (SELECT count(*) FROM w o WHERE o.lang = w.lang) AS mean FROM u JOIN w USING (doc_id) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY mean DESC, term) AS r FROM m) SELECT lang, term, round(mean, 6) AS mean_weight FROM r WHERE r <= 10")
def tf_idf(s, d):
    w = _tokens(s, d)
    u = terms.tf_idf(w, F.col("ws")).join(w.select("doc_id", "lang"), "doc_id").groupBy("lang", "term").agg(F.sum("weight").alias("s"))
    m = u.join(F.broadcast(w.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))), "lang").withColumn("mean", F.col("s") / F.col("n"))
    return within.top_k(m, 10, [F.desc("mean"), F.col("term")], ["lang"]).select("lang", "term", r6(F.col("mean")).alias("mean_weight"))


@query("tm09_ag39_features", TOK + "SELECT doc_id, len(ws) AS n_tokens, len(list_distinct(ws)) AS n_unique, round(CASE WHEN len(ws) > 0 THEN len(list_distinct(ws)) / len(ws) END, 6) AS diversity FROM w")
def features(s, d):
    n, u = F.size("ws"), F.size(F.array_distinct("ws"))
    return _tokens(s, d).select("doc_id", n.alias("n_tokens"), u.alias("n_unique"), r6(F.when(n > 0, u / n)).alias("diversity"))


@query("tx19_tx22_aspects", A + "SELECT doc_id, " + ", ".join(NAMES) + ", " + " + ".join(f"{a}::INT" for a in NAMES) + " AS aspect_count, concat_ws('|', " + ", ".join(f"CASE WHEN {a} THEN '{a}' END" for a in NAMES) + ") AS aspects FROM asp")
def aspects(s, d):
    a = aspect_docs(s, d)
    return a.select("doc_id", *NAMES, sum((F.col(x).cast("int") for x in NAMES), F.lit(0)).alias("aspect_count"), F.concat_ws("|", *(F.when(F.col(x), x) for x in NAMES)).alias("aspects"))


@query("tx21_ag17_severity", f"WITH v AS (SELECT {SEVERITY} AS tier, count(*) AS n FROM documents GROUP BY 1) SELECT t.tier, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT sum(n) FROM v), 6) AS share FROM (VALUES ('HIGH'), ('MEDIUM'), ('BASELINE')) t(tier) LEFT JOIN v ON v.tier = t.tier")
def severity(s, d):
    v = table(s, d, "documents").groupBy(terms.severity(F.lower(F.coalesce("text", F.lit(""))), HIGH, MEDIUM).alias("tier")).agg(F.count(F.lit(1)).alias("n"))
    tiers = s.createDataFrame([("HIGH",), ("MEDIUM",), ("BASELINE",)], "tier string")
    return tiers.join(v, "tier", "left").fillna(0).withColumn("share", r6(within.share("n")))


@query("tx23_ag14_frequency", AL + "SELECT aspect, count(*) FILTER (matched) AS docs, round(100.0 * count(*) FILTER (matched) / count(*), 6) AS mention_pct, count(DISTINCT source) FILTER (matched) AS sources FROM lng GROUP BY 1")
def frequency(s, d):
    rows = terms.aspect_rows(aspect_docs(s, d), NAMES, ["doc_id", "source", "lang", "rating_group"])
    m = F.count_if("matched")
    return rows.groupBy("aspect").agg(m.alias("docs"), r6(100 * m / F.count(F.lit(1))).alias("mention_pct"), F.count_distinct(F.when(F.col("matched"), F.col("source"))).alias("sources"))


@query("ag15_group_matrix", AL + "SELECT lang, aspect, count(*) FILTER (matched) AS docs, round(100.0 * count(*) FILTER (matched) / count(*), 6) AS rate, count(*) < 30 AS small_n FROM lng GROUP BY 1, 2")
def group_matrix(s, d):
    rows = terms.aspect_rows(aspect_docs(s, d), NAMES, ["lang"])
    m, n = F.count_if("matched"), F.count(F.lit(1))
    return rows.groupBy("lang", "aspect").agg(m.alias("docs"), r6(100 * m / n).alias("rate"), (n < 30).alias("small_n"))


@query("ag16_nb32_cooccurrence", AL + "SELECT a.aspect AS aspect_a, b.aspect AS aspect_b, count(*) FILTER (a.matched AND b.matched) AS n_both, round(100.0 * count(*) FILTER (a.matched AND b.matched) / count(*), 6) AS both_pct, round(count(*) FILTER (a.matched AND b.matched) / nullif(count(*) FILTER (a.matched OR b.matched), 0), 6) AS jaccard FROM lng a JOIN lng b ON a.doc_id = b.doc_id AND a.aspect < b.aspect GROUP BY 1, 2 HAVING count(*) FILTER (a.matched AND b.matched) >= 1")
def cooccurrence(s, d):
    return terms.cooccurrence(aspect_docs(s, d), NAMES).withColumns({"both_pct": r6(F.col("both_pct")), "jaccard": r6(F.col("jaccard"))})


DRIVER = AL + ", g AS (SELECT aspect, 100.0 * count(*) FILTER (matched AND rating_group = 'LOW') / nullif(count(*) FILTER (rating_group = 'LOW'), 0) AS low, 100.0 * count(*) FILTER (matched AND rating_group = 'HIGH') / nullif(count(*) FILTER (rating_group = 'HIGH'), 0) AS high, count(*) FILTER (matched) AS support FROM lng GROUP BY 1) "


@query("tm05_tm06_drivers", DRIVER + "SELECT aspect, round(low, 6) AS low_pct, round(high, 6) AS high_pct, round(high - low, 6) AS gap_pp, CASE WHEN support < 5 THEN 'INSUFFICIENT_SUPPORT' WHEN low >= 30 AND high >= 30 THEN 'EXPERIENCE_DEFINING' WHEN high - low >= 10 THEN 'POSITIVE_DRIVER' WHEN high - low <= -10 THEN 'NEGATIVE_DRIVER' WHEN low < 10 AND high < 10 THEN 'MINOR' ELSE 'MIXED' END AS driver FROM g")
def drivers(s, d):
    rows = terms.aspect_rows(aspect_docs(s, d), NAMES, ["rating_group"])
    pct = lambda g: 100 * F.avg(F.when(F.col("rating_group") == g, F.col("matched").cast("int")))
    g = rows.groupBy("aspect").agg(pct("LOW").alias("low"), pct("HIGH").alias("high"), F.count_if("matched").alias("support"))
    gap = F.col("high") - F.col("low")
    return g.select("aspect", r6(F.col("low")).alias("low_pct"), r6(F.col("high")).alias("high_pct"), r6(gap).alias("gap_pp"), terms.driver_class(gap, F.col("support"), F.col("low"), F.col("high")).alias("driver"))


@query("ag33_readiness", A + "SELECT source, count(*) AS n, count(*) FILTER (rating_group = 'LOW') AS low, count(*) FILTER (rating_group = 'HIGH') AS high, count(*) >= 15 AND count(*) FILTER (rating_group = 'LOW') >= 10 AND count(*) FILTER (rating_group = 'HIGH') >= 10 AS ready FROM asp GROUP BY 1")
def readiness(s, d):
    low, high, n = F.count_if(F.col("rating_group") == "LOW"), F.count_if(F.col("rating_group") == "HIGH"), F.count(F.lit(1))
    return aspect_docs(s, d).groupBy("source").agg(n.alias("n"), low.alias("low"), high.alias("high"), ((n >= 15) & (low >= 10) & (high >= 10)).alias("ready"))


@query("ag34_ag35_entity_aspects", AL + "SELECT source, aspect, round(100.0 * avg(matched::INT), 6) AS rate, round(100.0 * avg(matched::INT) FILTER (rating_group = 'LOW'), 6) AS low_rate, round(100.0 * avg(matched::INT) FILTER (rating_group = 'HIGH'), 6) AS high_rate, round(CASE WHEN count(*) FILTER (rating_group = 'LOW') >= 10 AND count(*) FILTER (rating_group = 'HIGH') >= 10 THEN 100.0 * avg(matched::INT) FILTER (rating_group = 'HIGH') - 100.0 * avg(matched::INT) FILTER (rating_group = 'LOW') END, 6) AS gap FROM lng GROUP BY 1, 2")
def entity_aspects(s, d):
    rows = terms.aspect_rows(aspect_docs(s, d), NAMES, ["source", "rating_group"])
    at = lambda g: 100 * F.avg(F.when(F.col("rating_group") == g, F.col("matched").cast("int")))
    n = lambda g: F.count_if(F.col("rating_group") == g)
    return rows.groupBy("source", "aspect").agg(r6(100 * F.avg(F.col("matched").cast("int"))).alias("rate"), r6(at("LOW")).alias("low_rate"), r6(at("HIGH")).alias("high_rate"), r6(F.when((n("LOW") >= 10) & (n("HIGH") >= 10), at("HIGH") - at("LOW"))).alias("gap"))


@query("wn21_nb31_lift", AL + ", o AS (SELECT aspect, 100.0 * avg(matched::INT) AS base FROM lng GROUP BY 1) SELECT lang, aspect, round(100.0 * avg(matched::INT) - any_value(base), 6) AS lift_pp FROM lng JOIN o USING (aspect) GROUP BY 1, 2")
def lift(s, d):
    rows = terms.aspect_rows(aspect_docs(s, d), NAMES, ["lang"]).groupBy("lang", "aspect").agg(F.sum(F.col("matched").cast("int")).alias("m"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("aspect")
    return rows.select("lang", "aspect", r6(100 * F.col("m") / F.col("n") - 100 * F.sum("m").over(w) / F.sum("n").over(w)).alias("lift_pp"))


@query("nb30_aspect_coverage", A + "SELECT count(*) FILTER (k > 0) AS with_any, count(*) FILTER (k = 0) AS without_any, round(avg(k), 6) AS mean_aspects, quantile_cont(k, 0.5) AS median_aspects FROM (SELECT " + " + ".join(f"{a}::INT" for a in NAMES) + " AS k FROM asp)")
def aspect_coverage(s, d):
    k = saved(aspect_docs(s, d).select(sum((F.col(x).cast("int") for x in NAMES), F.lit(0)).alias("k")))
    return k.crossJoin(F.broadcast(exact_quantiles(k, {"m": ("k", 0.5)}))).agg(F.count_if(F.col("k") > 0).alias("with_any"), F.count_if(F.col("k") == 0).alias("without_any"), r6(F.avg("k")).alias("mean_aspects"), F.first("m").alias("median_aspects"))


@query("nb36_cell_sizes", A + ", g AS (SELECT * FROM (SELECT DISTINCT source FROM asp), (VALUES ('LOW'), ('MIXED'), ('HIGH')) t(rating_group)) SELECT g.source, g.rating_group, count(a.doc_id) AS n, CASE WHEN count(a.doc_id) >= 30 THEN 'STRONG' WHEN count(a.doc_id) >= 10 THEN 'LIMITED' ELSE 'SMALL' END AS tier FROM g LEFT JOIN asp a USING (source, rating_group) GROUP BY 1, 2")
def cell_sizes(s, d):
    have = aspect_docs(s, d).groupBy("source", "rating_group").agg(F.count(F.lit(1)).alias("n"))
    grid = have.select("source").distinct().crossJoin(F.broadcast(s.createDataFrame([("LOW",), ("MIXED",), ("HIGH",)], "rating_group string")))
    n = F.coalesce("n", F.lit(0))
    return grid.join(have, ["source", "rating_group"], "left").select("source", "rating_group", n.alias("n"), F.when(n >= 30, "STRONG").when(n >= 10, "LIMITED").otherwise("SMALL").alias("tier"))


@query("tx25_text_counts", r"WITH c AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\v]+')) AS n_words FROM documents), q AS (SELECT greatest(1, least(40, floor(quantile_cont(n_words, 0.05)))) AS cut FROM c) SELECT doc_id, n_chars, n_words, n_words <= cut AS very_short FROM c, q")
def text_counts(s, d):
    c = saved(table(s, d, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n_chars"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^ \t\n\r\f\x0B]+")).alias("n_words")))
    return c.crossJoin(F.broadcast(composites.short_threshold(c, "n_words", "cut"))).select("doc_id", "n_chars", "n_words", (F.col("n_words") <= F.col("cut")).alias("very_short"))


@query("tx26_artifacts", "WITH k AS (SELECT doc_id, text, count(*) OVER (PARTITION BY text) > 1 AS rep FROM documents) SELECT count(*) FILTER (rep) AS boilerplate, count(*) FILTER (regexp_matches(text, '<[A-Za-z/][^>]*>')) AS with_tags FROM k")
def artifacts(s, d):
    docs = table(s, d, "documents").select("text", (F.count(F.lit(1)).over(Window.partitionBy(F.xxhash64("text"), "text")) > 1).alias("rep"))
    return docs.agg(F.count_if("rep").alias("boilerplate"), F.count_if(F.col("text").rlike("<[A-Za-z/][^>]*>")).alias("with_tags"))


@query("tx27_urls", "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(trim(url), '^https?://[^/]+', ''), '[?#].*$', ''), '/+$', '') AS path FROM pages")
def urls(s, d):
    return table(s, d, "pages").select("page_id", X.canonical_url(F.col("url"), "").alias("path"))


@query("tx30_stable_id", "SELECT c_custkey, 'ent_' || left(sha256(trim(c_name) || chr(1) || coalesce(c_mktsegment, '')), 24) AS id FROM customer")
def stable_id(s, d):
    return table(s, d, "customer").select("c_custkey", X.stable_id("ent_", F.col("c_name"), F.col("c_mktsegment")).alias("id"))


@query("dt01_date_pattern", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'ISO' WHEN 1 THEN 'DAY_MONTH_YEAR' WHEN 2 THEN 'RELATIVE' ELSE 'UNRECOGNIZED' END AS pattern FROM part")
def date_pattern(s, d):
    k = F.col("p_size") % 4
    return table(s, d, "part").select("p_partkey", X.date_pattern(F.when(k == 0, "2025-08-05").when(k == 1, "5 Ağustos 2025 09:58").when(k == 2, "2 hafta önce").otherwise("?")).alias("pattern"))


@query("dt02_dt03_written_dates", "SELECT p_partkey, CASE WHEN p_size <= 31 THEN make_timestamp(2025, 8, p_size, 9, 58, 0) END AS at, make_timestamp(2025, 9, 1, 0, 0, 0) - to_days((p_size * 7)::INT) AS ago FROM part")
def written_dates(s, d):
    now, n = F.lit("2025-09-01 12:00:00").cast("timestamp"), F.col("p_size").cast("string")
    return table(s, d, "part").select("p_partkey", X.written_date(F.concat(n, F.lit(" Ağustos 2025 09:58")), now)["at"].cast("timestamp_ntz").alias("at"), X.relative_date(F.concat(n, F.lit(" hafta önce")), now).cast("timestamp_ntz").alias("ago"))


@query("tk13_duplicate_audit", "SELECT 'same_segment_nation' AS definition, c_custkey, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS occurrence FROM customer WINDOW w AS (PARTITION BY c_mktsegment, c_nationkey) QUALIFY count(*) OVER w > 1")
def duplicate_audit(s, d):
    return resolve.duplicate_audit(table(s, d, "customer"), {"same_segment_nation": ["c_mktsegment", "c_nationkey"]}, "c_custkey")


@query("snk03_snk05_merge", "SELECT k, sum(n)::BIGINT AS n FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, count(*) FROM supplier GROUP BY 1) GROUP BY 1")
def merge(s, d):
    a = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    b = table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return io.counters_added(a, b, "k", ["n"])


@query("snk04_upsert", "SELECT c_custkey AS k, CASE WHEN c_custkey <= 100 THEN 'new' ELSE 'old' END AS v FROM customer")
def upsert(s, d):
    old = table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("old").alias("v"))
    return io.upserted(old, old.filter("k <= 100").withColumn("v", F.lit("new")), "k")


@query("snk07_json")
def json_rows(s, d):
    return io.as_json(entities(s, d))
