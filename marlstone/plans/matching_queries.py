"""Queries that match and resolve: joins of entity tables, similarity joins, candidates and their classes, samples, parsed fields, sources."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import checks, clean, ranks, resolve, similar, stats, terms, within
from .document_queries import TOK, _tokens
from .frames import ASP, ASPECTS, ENT, LONG, MON, SHIP, aspect_docs, entities, monthly, r6, shipped_monthly, table
from .registry import query

E, AL = f"WITH {ENT} ", f"WITH {ASP}, {LONG} "


@query("jn01_jn24_period_join", f"WITH {MON}, {SHIP} SELECT mon.period, mon.total, ship.n AS shipped, lead(ship.n) OVER (ORDER BY mon.period) AS shipped_next FROM mon JOIN ship ON ship.period = mon.period")
def period_join(s, d):
    """Two period tables one to one; a repeated period raises."""
    j = checks.joined_once(monthly(s, d).select("period", "total"), shipped_monthly(s, d).select("period", F.col("n").alias("shipped")), ["period"], "inner")
    return j.withColumn("shipped_next", F.lead("shipped").over(Window.orderBy("period")))


@query("jn02_jn03_group_context", E + ", g AS (SELECT grp, count(*) AS entities, avg(rating) AS mean_rating FROM ent GROUP BY 1), m AS (SELECT n_name AS grp, count(*) AS suppliers, min(s_acctbal) AS low, max(s_acctbal) AS high FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1) SELECT g.grp, entities, round(mean_rating, 6) AS mean_rating, suppliers, round(high - low, 6) AS spread FROM g LEFT JOIN m ON m.grp = g.grp")
def group_context(s, d):
    g = entities(s, d).groupBy("grp").agg(F.count(F.lit(1)).alias("entities"), r6(F.avg("rating")).alias("mean_rating"))
    n = table(s, d, "nation").select("n_nationkey", F.col("n_name").alias("grp"))
    m = table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("suppliers"), r6(F.max("s_acctbal") - F.min("s_acctbal")).alias("spread"))
    return checks.joined_once(g, n.join(m, "n_nationkey").select("grp", "suppliers", "spread"), ["grp"])


@query("jn06_jn07_doc_master", "SELECT l_orderkey, l_linenumber, o_custkey, coalesce(n, 0) AS replies, coalesce(n, 0) > 0 AS has_reply FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1) ON user_id = o_custkey")
def doc_master(s, d):
    """Every document finds its entity once: a repeated order raises, and so does a repeated count."""
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    ev = table(s, d, "events").filter("event_type = 'purchase'").groupBy(F.col("user_id").alias("o_custkey")).agg(F.count(F.lit(1)).alias("n"))
    j = checks.joined_once(checks.joined_once(table(s, d, "lineitem").select("l_orderkey", "l_linenumber"), o, ["l_orderkey"], "inner"), ev, ["o_custkey"])
    return j.select("l_orderkey", "l_linenumber", "o_custkey", F.coalesce("n", F.lit(0)).alias("replies"), (F.coalesce("n", F.lit(0)) > 0).alias("has_reply"))


@query("jn08_reply_pivot", "SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1")
def reply_pivot(s, d):
    """The aggregate and its pivot in one pass instead of a join of both."""
    k = F.col("event_type")
    return table(s, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(k == "click").alias("clicks"), F.count_if(k == "view").alias("views"), F.count_if(k == "error").alias("errors"))


@query("jn17_alike_within")
def alike_within(s, d):
    """Near copies of part names within a brand; string similarity has no SQL, so a test holds it against all pairs."""
    p = table(s, d, "part").select("p_partkey", "p_brand", F.concat_ws(" ", "p_name", "p_type", F.col("p_size").cast("string")).alias("t"))
    return similar.alike_within(p, "p_partkey", "p_brand", "t")


COS = r"""n AS (SELECT count(*) AS n FROM r), tf AS (SELECT id, w, count(*) AS tf FROM (SELECT id, unnest(ws) AS w FROM r) GROUP BY 1, 2),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1), x AS (SELECT id, tf.w, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS v FROM tf JOIN df ON df.w = tf.w, n WHERE df >= 1 AND df <= 0.9 * n),
u AS (SELECT id, w, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS v FROM x)
SELECT a.id AS a, b.id AS b, round(sum(a.v * b.v), 5) AS cosine FROM u a JOIN u b ON a.w = b.w AND a.id < b.id GROUP BY 1, 2 HAVING sum(a.v * b.v) >= 0.8"""


@query("jn18_cosine_pairs", r"WITH r AS (SELECT min(doc_id) AS id, regexp_extract_all(lower(text), '[a-z]{3,}') AS ws FROM documents WHERE text IS NOT NULL GROUP BY text), " + COS)
def cosine_pairs(s, d):
    """Pairs of different texts at a cosine of 0.8 or more; copies are folded into their least id first."""
    return similar.cosine_texts(table(s, d, "documents"), "doc_id", "text").select("a", "b", F.round("cosine", 5).alias("cosine"))


@query("jn20_jn21_divergence", "WITH a AS (SELECT o_custkey AS k, 100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*) AS x FROM orders GROUP BY 1), b AS (SELECT user_id AS k, 100.0 * count(*) FILTER (event_type = 'error') / count(*) AS y FROM events GROUP BY 1) SELECT c_custkey, c_name, round(x, 4) AS x, round(y, 4) AS y, round(abs(x - y), 4) AS gap FROM a JOIN b ON a.k = b.k JOIN customer ON c_custkey = a.k WHERE abs(x - y) >= 50")
def divergence(s, d):
    a = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg((100.0 * F.count_if(F.col("o_orderstatus") == "F") / F.count(F.lit(1))).alias("x"))
    b = table(s, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg((100.0 * F.count_if(F.col("event_type") == "error") / F.count(F.lit(1))).alias("y"))
    gap = F.abs(F.col("x") - F.col("y"))
    j = a.join(b, "c_custkey").filter(gap >= 50).join(table(s, d, "customer").select("c_custkey", "c_name"), "c_custkey")
    return j.select("c_custkey", "c_name", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round(gap, 4).alias("gap"))


@query("jn23_failures", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'")
def failures(s, d):
    f = table(s, d, "orders").filter("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return f.join(table(s, d, "customer").select("c_custkey", "c_name"), "c_custkey", "left").select("o_orderkey", "c_name")


CAND = """cand AS (SELECT DISTINCT o_custkey AS k, l_suppkey AS c, 1 - abs(c_acctbal - s_acctbal) / 11000 AS sim, c_nationkey = s_nationkey AS area, (o_custkey + l_suppkey) % 2 = 0 AS contact
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey),
sc AS (SELECT *, 0.70 * sim + 0.15 * area::INT + 0.15 * contact::INT AS score FROM cand)"""


def _candidates(s, d):
    """Candidates are the suppliers that a customer's orders name: as many rows as line items at most, never a product."""
    pairs = table(s, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("c")).join(table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("k")), "l_orderkey").select("k", "c").distinct()
    j = pairs.join(table(s, d, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal", "c_nationkey"), "k").join(table(s, d, "supplier").select(F.col("s_suppkey").alias("c"), "s_acctbal", "s_nationkey"), "c")
    j = j.select("k", "c", (1 - F.abs(F.col("c_acctbal") - F.col("s_acctbal")) / 11000).alias("sim"), (F.col("c_nationkey") == F.col("s_nationkey")).alias("area"), ((F.col("k") + F.col("c")) % 2 == 0).alias("contact"))
    return j.withColumn("score", resolve.candidate_score(F.col("sim"), F.col("area"), F.col("contact")))


@query("er06_er08_er09_candidate_class", f"WITH {CAND}, r AS (SELECT *, score - lead(score) OVER w AS gap, row_number() OVER w AS rn FROM sc WINDOW w AS (PARTITION BY k ORDER BY score DESC, c)) SELECT k, c, round(score, 6) AS score, round(gap, 6) AS gap, CASE WHEN sim < 0.3 THEN 'REVIEW_CONFLICT' WHEN gap < 0.05 THEN 'AMBIGUOUS' WHEN sim >= 0.99 AND score >= 0.90 THEN 'EXACT' WHEN score >= 0.75 THEN 'ACCEPTED' WHEN score >= 0.45 THEN 'REVIEW' ELSE 'NONE' END AS status FROM r WHERE rn = 1")
def candidate_class(s, d):
    best = resolve.classified_candidates(_candidates(s, d), "k", "score", "c", F.col("sim") >= 0.99, F.col("sim") < 0.3)
    return best.select("k", "c", r6(F.col("score")).alias("score"), r6(F.col("gap")).alias("gap"), "status")


@query("jn26_top_candidates", f"WITH {CAND} SELECT k, string_agg(c::VARCHAR, '|' ORDER BY rn) AS best FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, c) AS rn FROM sc) WHERE rn <= 3 GROUP BY 1")
def top_candidates(s, d):
    top = within.top_k(_candidates(s, d), 3, [F.desc("score"), F.col("c")], ["k"])
    items = F.sort_array(F.collect_list(F.struct("rn", F.col("c").cast("string").alias("c"))))
    return top.groupBy("k").agg(F.array_join(F.transform(items, lambda x: x["c"]), "|").alias("best"))


@query("er11_tx37_identity", f"WITH {CAND} SELECT k, c, CASE WHEN contact AND sim >= 0.84 THEN 'VERIFIED_BY_ID' WHEN sim >= 0.92 THEN 'VERIFIED_BY_NAME' ELSE 'NOT_VERIFIED' END AS identity, CASE WHEN sim >= 0.90 THEN 'merge after a look' WHEN sim >= 0.75 THEN 'compare contact data' WHEN sim >= 0.55 THEN 'look again later' ELSE 'leave apart' END AS action FROM sc")
def identity(s, d):
    c = _candidates(s, d)
    return c.select("k", "c", resolve.identity_status(F.col("contact"), F.col("sim")).alias("identity"), resolve.suggestion(F.col("sim")).alias("action"))


@query("er04_unique_key", "SELECT c_custkey, CASE WHEN count(*) OVER (PARTITION BY right(round(c_acctbal)::BIGINT::VARCHAR, 4)) = 1 THEN right(round(c_acctbal)::BIGINT::VARCHAR, 4) END AS proof FROM customer")
def unique_key(s, d):
    key = F.right(F.round("c_acctbal", 0).cast("long").cast("string"), F.lit(4))
    return resolve.unique_only(table(s, d, "customer").select("c_custkey", key.alias("key")), "key", "proof").select("c_custkey", "proof")


@query("er05_derived_status", "SELECT s_suppkey, CASE WHEN n > 1 THEN 'CONFLICT' WHEN n = 1 THEN 'MATCHED' ELSE 'UNMATCHED' END AS status FROM (SELECT s_suppkey, (SELECT count(*) FROM customer WHERE c_nationkey = s_nationkey AND c_mktsegment = 'BUILDING' AND c_custkey % 100 = s_suppkey) AS n FROM supplier)")
def derived_status(s, d):
    c = table(s, d, "customer").filter("c_mktsegment = 'BUILDING'").groupBy(F.col("c_nationkey").alias("s_nationkey"), (F.col("c_custkey") % 100).alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n"))
    j = table(s, d, "supplier").select("s_suppkey", "s_nationkey").join(c, ["s_nationkey", "s_suppkey"], "left")
    return j.select("s_suppkey", F.when(F.col("n") > 1, "CONFLICT").when(F.col("n") == 1, "MATCHED").otherwise("UNMATCHED").alias("status"))


@query("er07_negative_conflict", f"WITH {CAND} SELECT k, c, max(sim) OVER (PARTITION BY k, area) - sim > 0.10 AND NOT contact AS conflict FROM sc")
def negative_conflict(s, d):
    """A sibling of the same block matches better by more than 0.10, and the row lacks its own mark."""
    better = F.max("sim").over(Window.partitionBy("k", "area")) - F.col("sim") > 0.10
    return _candidates(s, d).select("k", "c", (better & ~F.col("contact")).alias("conflict"))


@query("er12_decisions", "WITH v(s_suppkey, decision) AS (VALUES (0, 'ACCEPT'), (1, 'REJECT'), (3, 'ACCEPT')) SELECT s.s_suppkey, coalesce(decision, 'OPEN') AS decision, s_name || ' -> ' || coalesce(decision, 'OPEN') AS evidence FROM supplier s LEFT JOIN v USING (s_suppkey)")
def decisions(s, d):
    """Curated decisions are a table that is joined, with a line of evidence."""
    v = s.createDataFrame([(0, "ACCEPT"), (1, "REJECT"), (3, "ACCEPT")], "s_suppkey long, decision string")
    j = checks.joined_once(table(s, d, "supplier").select("s_suppkey", "s_name"), v, ["s_suppkey"])
    what = F.coalesce("decision", F.lit("OPEN"))
    return j.select("s_suppkey", what.alias("decision"), F.concat_ws(" -> ", "s_name", what).alias("evidence"))


@query("er15_tm10_readiness", f"WITH {ASP}, g AS (SELECT count(*) FILTER (rating_group = 'LOW') AS low, count(*) FILTER (rating_group = 'HIGH') AS high FROM asp) SELECT 'low_documents' AS check_name, low AS value, low >= 10 AS ready FROM g UNION ALL SELECT 'high_documents', high, high >= 10 FROM g UNION ALL SELECT 'topic_model', least(low, high), least(low, high) >= 500 FROM g")
def readiness(s, d):
    lab = table(s, d, "labels").select("doc_id", "quality")
    docs = table(s, d, "documents").select("doc_id").join(lab, "doc_id", "left")
    g = docs.agg(F.count_if(F.col("quality") == 0).alias("low"), F.count_if(F.col("quality") == 1).alias("high"))
    row = lambda n, v, least: F.struct(F.lit(n).alias("check_name"), v.alias("value"), (v >= least).alias("ready"))
    return g.select(F.inline(F.array(row("low_documents", F.col("low"), 10), row("high_documents", F.col("high"), 10), row("topic_model", F.least("low", "high"), 500))))


@query("tk14_registry_duplicates", "WITH g AS (SELECT p_name, p_type, count(*) AS n, count(DISTINCT p_brand) > 1 AS brand_conflict, count(DISTINCT p_size) > 1 AS size_conflict FROM part GROUP BY 1, 2 HAVING count(*) > 1) SELECT p_name, p_type, n, CASE WHEN brand_conflict AND size_conflict THEN 'BRAND;SIZE' WHEN brand_conflict THEN 'BRAND' WHEN size_conflict THEN 'SIZE' ELSE 'OK' END AS conflicts, dense_rank() OVER (ORDER BY p_name, p_type) AS group_id FROM g")
def registry_duplicates(s, d):
    g = table(s, d, "part").groupBy("p_name", "p_type").agg(F.count(F.lit(1)).alias("n"), (F.count_distinct("p_brand") > 1).alias("b"), (F.count_distinct("p_size") > 1).alias("z")).filter("n > 1")
    flags = clean.flags_text([(F.col("b"), "BRAND"), (F.col("z"), "SIZE")])
    return ranks.numbered(g.select("p_name", "p_type", "n", flags.alias("conflicts")), ["p_name", "p_type"], "group_id")


@query("tk10_quotes", AL + ", q AS (SELECT aspect, rating_group, lng.doc_id, length(text) BETWEEN 40 AND 260 AS fits FROM lng JOIN documents d ON d.doc_id = lng.doc_id WHERE matched) SELECT aspect, rating_group, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY aspect, rating_group ORDER BY fits DESC, sha256(doc_id::VARCHAR), doc_id) AS rn FROM q) WHERE rn <= 2")
def quotes(s, d):
    """Two quotes of each aspect and group in the order of a digest; fitting ones first, others as a fallback."""
    docs = aspect_docs(s, d)
    size = F.length("t").between(40, 260)
    rows = terms.aspect_rows(docs.withColumn("fits", size), list(ASPECTS), ["doc_id", "rating_group", "fits"]).filter("matched")
    order = [F.desc("fits"), F.sha2(F.col("doc_id").cast("string"), 256), F.col("doc_id")]
    return within.top_k(rows, 2, order, ["aspect", "rating_group"]).select("aspect", "rating_group", "doc_id")


@query("wn02_wn03_group_gap", E + ", m AS (SELECT grp, quantile_cont(rating, 0.5) AS med FROM ent GROUP BY 1) SELECT entity_id, round(rating - med, 6) AS gap, round(CASE WHEN med <> 0 THEN rating / med END, 6) AS ratio FROM ent JOIN m USING (grp)")
def group_gap(s, d):
    """Medians by group and a broadcast of one row a group (groups are a fixed list) instead of a window over all rows."""
    e = entities(s, d)
    m = e.groupBy("grp").agg(F.percentile("rating", F.lit(0.5)).alias("med"))
    return e.join(m, "grp").select("entity_id", r6(F.col("rating") - F.col("med")).alias("gap"), r6(F.when(F.col("med") != 0, F.col("rating") / F.col("med"))).alias("ratio"))


@query("wn06_wn07_available_index", E + ", g AS (SELECT grp, avg(rating) AS a, CASE WHEN count(*) >= 50 THEN avg(price) END AS b FROM ent GROUP BY 1), z AS (SELECT grp, 100 * (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) AS x, CASE WHEN max(b) OVER () = min(b) OVER () AND b IS NOT NULL THEN 50 ELSE 100 * (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) END AS y FROM g) SELECT grp, round((0.6 * x + coalesce(0.4 * y, 0)) / (0.6 + CASE WHEN y IS NULL THEN 0 ELSE 0.4 END), 6) AS idx FROM z")
def available_index(s, d):
    g = entities(s, d).groupBy("grp").agg(F.avg("rating").alias("a"), F.when(F.count(F.lit(1)) >= 50, F.avg("price")).alias("b"))
    z = g.select("grp", within.min_max("a").alias("x"), within.min_max("b").alias("y"))
    return z.select("grp", r6(within.available_mean([(F.col("x"), 0.6), (F.col("y"), 0.4)])).alias("idx"))


@query("prj12_prj18_price_bands", E + "SELECT entity_id, CASE WHEN price <= 100000 THEN 'low' WHEN price <= 200000 THEN 'middle' WHEN price IS NOT NULL THEN 'high' END AS band, 'a snapshot, not an average over time' AS caution FROM ent")
def price_bands(s, d):
    return entities(s, d).select("entity_id", clean.banded(F.col("price"), [100000, 200000], ["low", "middle", "high"]).alias("band"), F.lit("a snapshot, not an average over time").alias("caution"))


@query("prj15_prj16_sample", "SELECT o_orderkey AS id, TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS level, o_totalprice AS amount FROM orders WHERE o_orderstatus = 'P'")
def sample(s, d):
    o = table(s, d, "orders").filter("o_orderstatus = 'P'")
    return o.withColumn("level", clean.to_number(F.substring("o_orderpriority", 1, 1))).withColumnsRenamed({"o_orderkey": "id", "o_totalprice": "amount"}).select("id", "level", "amount")


@query("prj22_prj23_support", E + "SELECT entity_id, CASE WHEN reviews >= 15 THEN 'STRONG' WHEN reviews >= 5 THEN 'MODERATE' WHEN reviews >= 1 THEN 'WEAK' ELSE 'NONE' END AS support FROM ent")
def support(s, d):
    n = F.col("reviews")
    return entities(s, d).select("entity_id", clean.first_label([(n >= 15, "STRONG"), (n >= 5, "MODERATE"), (n >= 1, "WEAK")], "NONE").alias("support"))


@query("prj25_prj26_candidates", "SELECT conv_id, turn FROM conversations WHERE length(text) BETWEEN 40 AND 260 AND NOT (len(string_split(trim(text), chr(10))) = 2 AND regexp_matches(trim(string_split(trim(text), chr(10))[2]), '^\\d{4}-\\d{2}-\\d{2}$'))")
def quote_candidates(s, d):
    lines = F.split(F.trim("text"), "\n")
    artifact = (F.size(lines) == 2) & F.coalesce(F.trim(F.get(lines, F.lit(1))).rlike("^\\d{4}-\\d{2}-\\d{2}$"), F.lit(False))
    return table(s, d, "conversations").filter(F.length("text").between(40, 260) & ~artifact).select("conv_id", "turn")


@query("prj27_prj30_guarded", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity > 0 AND l_extendedprice > 0 THEN l_extendedprice / l_quantity END, 8) AS unit FROM lineitem WHERE l_returnflag NOT IN ('R', 'N')")
def guarded(s, d):
    a, b = F.col("l_extendedprice"), F.col("l_quantity")
    return table(s, d, "lineitem").filter(~F.col("l_returnflag").isin("R", "N")).select("l_orderkey", "l_linenumber", F.round(F.when((a > 0) & (b > 0), a / b), 8).alias("unit"))


@query("tx05_containment", "SELECT p_partkey, len(list_filter(string_split(p_name, ' '), lambda x: contains(lower(p_type || ' ' || p_name || p_brand), x))) / len(string_split(p_name, ' ')) AS share FROM part WHERE p_name <> ''")
def containment(s, d):
    hay = F.lower(F.concat(F.concat_ws(" ", "p_type", "p_name"), F.col("p_brand")))
    return table(s, d, "part").filter("p_name <> ''").select("p_partkey", X.token_containment(F.col("p_name"), hay).alias("share"))


@query("tx04_name_similarity")
def name_similarity(s, d):
    """Sequence similarity of two names a row; it has no SQL."""
    from ..session import shipped

    shipped(s)
    return table(s, d, "part").select("p_partkey", X.sequence_ratio("p_name", F.lower("p_type")).alias("similarity"))


@query("tx10_tx14_minimal", r"SELECT conv_id, turn, length(trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS n FROM conversations")
def minimal(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", F.length(X.minimal_clean(F.col("text"))).cast("long").alias("n"))


@query("tx15_tx16_stopwords", TOK + ", stop AS (SELECT DISTINCT unnest(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z]{3,}')) AS w FROM part UNION SELECT unnest(['the', 'der', 'la'])), t AS (SELECT doc_id, unnest(ws) AS w FROM w) SELECT doc_id, count(*) AS n_left FROM t WHERE w NOT IN (SELECT w FROM stop) GROUP BY 1")
def stopwords(s, d):
    """Names of entities are stopwords: a table that is anti-joined, whatever its size."""
    p = table(s, d, "part")
    names = p.select(F.explode(F.regexp_extract_all(F.lower(F.concat_ws(" ", "p_name", "p_type")), F.lit("[a-z]{3,}"), F.lit(0))).alias("w"))
    stop = names.unionByName(s.createDataFrame([("the",), ("der",), ("la",)], "w string")).distinct()
    words = _tokens(s, d).select("doc_id", F.explode("ws").alias("w"))
    return words.join(stop, "w", "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_left"))


@query("tx20_substring_aspects", "SELECT doc_id, contains(lower(coalesce(text, '')), 'tion') AS motion, contains(lower(coalesce(text, '')), 'over') OR contains(lower(coalesce(text, '')), 'in ') AS place FROM documents")
def substring_aspects(s, d):
    t = F.lower(F.coalesce("text", F.lit("")))
    return table(s, d, "documents").select("doc_id", F.contains(t, F.lit("tion")).alias("motion"), (F.contains(t, F.lit("over")) | F.contains(t, F.lit("in "))).alias("place"))


@query("tx32_rating", "SELECT event_id, CASE WHEN round_even(value, 0) BETWEEN 1 AND 5 THEN round_even(value, 0)::INT END AS rating FROM events")
def rating(s, d):
    """Ratings as they are written ('3,5/5') back to whole stars of 1 to 5."""
    written = F.concat(F.translate(F.col("value").cast("string"), ".", ","), F.lit("/5"))
    return table(s, d, "events").select("event_id", X.star_rating(written).alias("rating"))


@query("tx33_brand_tokens", "SELECT p_partkey, array_to_string(list_filter(list_distinct(string_split(lower(p_name), ' ')), lambda x: x NOT IN ('small', 'large')), ' ') = '' AS nameless, len(list_distinct(list_filter(string_split(lower(p_name), ' '), lambda x: x NOT IN ('small', 'large')))) AS n FROM part")
def brand_tokens(s, d):
    words = F.array_distinct(F.filter(F.split(F.lower("p_name"), " "), lambda w: ~w.isin("small", "large")))
    return table(s, d, "part").select("p_partkey", (F.array_join(words, " ") == "").alias("nameless"), F.size(words).cast("long").alias("n"))


@query("dt06_dt08_future", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS period, o_orderdate > TIMESTAMP '1998-01-01 00:00:00' + INTERVAL 1 DAY AS future FROM orders")
def future(s, d):
    late = F.col("o_orderdate") > F.expr("TIMESTAMP '1998-01-01 00:00:00' + INTERVAL 1 DAY")
    return table(s, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("period"), late.alias("future"))


@query("st10_group_lengths", f"WITH {ASP}, x AS (SELECT rating_group, length(text) AS v FROM asp JOIN documents USING (doc_id) WHERE text IS NOT NULL), r AS (SELECT rating_group, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS r FROM x), q AS (SELECT sum(s * s / m) AS q, sum(m) AS n FROM (SELECT sum(r) AS s, count(*) AS m FROM r GROUP BY rating_group)), t AS (SELECT sum(c * c * c - c) AS t FROM (SELECT count(*)::DOUBLE AS c FROM r GROUP BY v)) SELECT n::BIGINT AS n, round(h, 4) AS h, round(exp(-h / 2), 6) AS p, round(h / ((n * n - 1) / (n + 1)), 6) AS epsilon2 FROM (SELECT n, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n * n * n - n)) AS h FROM q, t)")
def group_lengths(s, d):
    lab = table(s, d, "labels").select("doc_id", "quality")
    docs = table(s, d, "documents").select("doc_id", F.length("text").alias("v")).join(lab, "doc_id", "left")
    g = F.when(F.col("quality") == 0, "LOW").when(F.col("quality") == 1, "HIGH").otherwise("MIXED")
    return stats.kruskal(docs.withColumn("g", g), "g", "v").select("n", F.round("h", 4).alias("h"), r6(F.col("p")).alias("p"), r6(F.col("epsilon2")).alias("epsilon2"))


@query("src07_src05_value_set", "SELECT DISTINCT source FROM documents WHERE source IS NOT NULL AND source <> ''")
def value_set(s, d):
    return table(s, d, "documents").select("source").filter("source <> ''").distinct()


@query("src11_src15_capped", r"SELECT page_id FROM (SELECT page_id, row_number() OVER (PARTITION BY regexp_extract(u, '^https?://([^/]+)', 1) ORDER BY page_id) AS rn FROM (SELECT regexp_replace(url, '[?#].*$', '') AS u, min(page_id) AS page_id FROM pages GROUP BY 1)) WHERE rn <= 3")
def capped(s, d):
    """The first page of each address without its query, and a collection cap of three a host."""
    first = table(s, d, "pages").groupBy(F.regexp_replace("url", "[?#].*$", "").alias("u")).agg(F.min("page_id").alias("page_id"))
    return within.top_k(first.withColumn("host", F.regexp_extract("u", "^https?://([^/]+)", 1)), 3, [F.col("page_id")], ["host"]).select("page_id")


@query("src20_chunks", "SELECT s_suppkey, (row_number() OVER (ORDER BY s_suppkey) - 1) // ceil(count(*) OVER () / 5)::BIGINT AS chunk FROM supplier")
def chunks(s, d):
    """Five equal slices of a list of targets, all of one size but the last."""
    n = table(s, d, "supplier").agg(F.ceil(F.count(F.lit(1)) / 5).alias("size"))
    rows = ranks.numbered(table(s, d, "supplier").select("s_suppkey"), ["s_suppkey"], "at")
    return rows.crossJoin(F.broadcast(n)).select("s_suppkey", F.floor((F.col("at") - 1) / F.col("size")).alias("chunk"))


@query("src16_src17_slugs", r"SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^/?#]*)', 1) AS slug, regexp_matches(url, 'page=\d+') AS paged, len(regexp_extract_all(url, '/')) - 2 AS depth FROM pages")
def slugs(s, d):
    url = F.col("url")
    return table(s, d, "pages").select("page_id", F.regexp_extract(url, "^https?://[^/]+/([^/?#]*)", 1).alias("slug"), url.rlike("page=\\d+").alias("paged"), (F.size(F.regexp_extract_all(url, F.lit("/"), F.lit(0))) - 2).cast("long").alias("depth"))


@query("er02_match_class", f"WITH {CAND} SELECT k, c, CASE WHEN sim >= 0.95 AND area THEN 'HIGH_CONFIDENCE' WHEN score >= 0.55 THEN 'REVIEW_REQUIRED' ELSE 'UNMATCHED' END AS status FROM sc")
def match_class(s, d):
    """Without an equal phone only a near-identical name in the same area is accepted."""
    status = resolve.match_class(F.col("score"), F.col("sim"), F.lit(None).cast("boolean"), F.col("area"))
    return _candidates(s, d).select("k", "c", status.alias("status"))


@query("tm11_driver_score", AL + "SELECT aspect, round(100.0 * (avg(matched::INT) FILTER (rating_group = 'HIGH') - avg(matched::INT) FILTER (rating_group = 'LOW')), 6) AS score FROM lng GROUP BY 1")
def driver_score(s, d):
    rows = terms.aspect_rows(aspect_docs(s, d), list(ASPECTS), ["doc_id", "rating_group"])
    share = lambda g: F.avg(F.when(F.col("rating_group") == g, F.col("matched").cast("int")))
    return rows.groupBy("aspect").agg(r6(100.0 * (share("HIGH") - share("LOW"))).alias("score"))


@query("jn25_matrix_join", f"WITH {ASP}, m AS (SELECT source, count(*) FILTER (motion) AS motion, count(*) FILTER (place) AS place FROM asp GROUP BY 1), e AS (SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1) SELECT e.source, n, chars, motion, place FROM e JOIN m ON m.source = e.source")
def matrix_join(s, d):
    """Both sides are aggregates by source, so the join meets one row a key."""
    m = aspect_docs(s, d).groupBy("source").agg(F.count_if("motion").alias("motion"), F.count_if("place").alias("place"))
    e = table(s, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    return checks.joined_once(e, m, ["source"], "inner")


@query("ag29_date_patterns", "WITH x AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 3 = 1 THEN '3 gün önce' ELSE 'bugün' END AS w FROM orders) SELECT CASE WHEN regexp_matches(w, '^\\d{4}-') THEN 'ISO' WHEN contains(w, 'önce') THEN 'RELATIVE' ELSE 'TODAY' END AS pattern, count(*) AS n_rows, count(*) FILTER (regexp_matches(w, '^\\d{4}-')) AS parsed, min(w) AS example FROM x GROUP BY 1")
def date_patterns(s, d):
    """Rows, rows read as a date, and the least example of each form of written dates."""
    k = F.col("o_orderkey") % 3
    w = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, "3 gün önce").otherwise("bugün")
    x = table(s, d, "orders").select(w.alias("w"))
    return x.groupBy(X.date_pattern(F.col("w")).alias("pattern")).agg(F.count(F.lit(1)).alias("n_rows"), F.count(clean.to_iso_date(F.col("w"))).alias("parsed"), F.min("w").alias("example"))
