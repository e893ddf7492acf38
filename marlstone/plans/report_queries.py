"""Queries of report files, rules by source, page identities, and keyed tables that batches and streams keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import clean, pages, reports, resolve, stats, within
from ..sources import buckets
from ..streaming import incremental
from .cleaning_queries import _STUDENT
from .frames import ENT, entities, table
from .registry import query
from .source_queries import _folder

E = f"WITH {ENT}"
NOTE = "- Orders are not visits.\n- Missing prices are left out, never zero."


@query(
    "snk06_reports",
    E + f""", g AS (SELECT grp, count(*) AS n, sum(reviews)::BIGINT AS orders, count(price) AS priced FROM ent GROUP BY 1),
k AS (SELECT grp, segment, count(*) AS n, row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, segment) AS r FROM ent GROUP BY 1, 2),
lines AS (SELECT grp, 0 AS s, 0 AS pos, grp AS line FROM g UNION ALL SELECT grp, 0, 1, repeat('=', length(grp)) FROM g
UNION ALL SELECT grp, 1, 0, '' FROM g UNION ALL SELECT grp, 1, 1, 'COVERAGE' FROM g UNION ALL SELECT grp, 1, 2, '- Entities: ' || n FROM g UNION ALL SELECT grp, 1, 3, '- Orders: ' || orders || ' (' || (orders // n) || ' or more each)' FROM g
UNION ALL SELECT grp, 2, 0, '' FROM g UNION ALL SELECT grp, 2, 1, 'SEGMENTS' FROM g UNION ALL SELECT grp, 2, 1 + r, '- ' || segment || ': ' || n FROM k WHERE r <= 3
UNION ALL SELECT grp, 3, 0, '' FROM g UNION ALL SELECT grp, 3, 1, 'DEBTS' FROM g UNION ALL SELECT grp, 3, 2, '- ' || name || ' owes ' || printf('%.2f', -rating) FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY rating, entity_id) AS r FROM ent WHERE rating < -900) WHERE r = 1
UNION ALL SELECT grp, 3, 2, '- no data' FROM g WHERE grp NOT IN (SELECT grp FROM ent WHERE rating < -900)
UNION ALL SELECT grp, 4, 0, '' FROM g UNION ALL SELECT grp, 4, 1, 'LIMITATIONS' FROM g UNION ALL SELECT grp, 4, i, string_split('{NOTE}', chr(10))[i - 1] FROM g, range(2, 4) t(i))
SELECT grp AS report, (row_number() OVER (PARTITION BY grp ORDER BY s, pos))::INTEGER AS number, line FROM lines""",
)
def report_files(s: SparkSession, d: str) -> DataFrame:
    """A report for each nation, written as one file each and read back line by line."""
    e = entities(s, d)
    n, orders = F.count(F.lit(1)), F.sum("reviews")
    g = e.groupBy(F.col("grp").alias("report")).agg(n.alias("n"), orders.alias("orders"))
    cover = g.select("report", F.inline(F.array(F.struct(F.lit(1).alias("order"), F.format_string("- Entities: %d", "n").alias("line")), F.struct(F.lit(2).alias("order"), F.format_string("- Orders: %d (%d or more each)", "orders", F.floor(F.col("orders") / F.col("n"))).alias("line")))))
    segments = within.top_k(e.groupBy(F.col("grp").alias("report"), "segment").agg(n.alias("n")), 3, [F.desc("n"), F.col("segment")], ["report"], "order").select("report", "order", F.format_string("- %s: %d", "segment", "n").alias("line"))
    debts = within.first_by(e.filter("rating < -900").withColumnRenamed("grp", "report"), ["report"], [F.col("rating"), F.col("entity_id")])
    debts = debts.select("report", F.lit(1).alias("order"), F.format_string("- %s owes %.2f", "name", -F.col("rating")).alias("line"))
    at = _folder(s)
    reports.write_reports(reports.report_lines(g.select("report"), [("COVERAGE", cover), ("SEGMENTS", segments), ("DEBTS", debts), ("LIMITATIONS", NOTE)]), at)
    return reports.read_reports(s, at)


#: Patterns that a source's rules are taken from, by the source's length.
PATTERNS = ["(^| )the [a-z]+tion( |$)", "(^| )(und|et) ", "[0-9]{4}", "(^| )la [a-z]", "over", "(?i)LICENSE"]


@query(
    "tx35_source_rules",
    "WITH r AS (SELECT DISTINCT source, k AS priority, " + f"[{', '.join(repr(p) for p in PATTERNS)}]" + "[1 + (length(source) * 2 + ascii(right(source, 1)) + 2 * k) % 6] AS pattern, source || ':' || k AS entity FROM documents, range(0, 3) t(k) WHERE source IS NOT NULL AND ascii(right(source, 1)) % 4 > 0), "
    "h AS (SELECT doc_id, arg_min(entity, (priority, r.pattern)) AS entity, arg_min(r.pattern, (priority, r.pattern)) AS pattern FROM documents JOIN r USING (source) WHERE regexp_matches(text, r.pattern) GROUP BY 1) "
    "SELECT d.doc_id, entity, pattern, CASE WHEN d.source IS NULL OR d.source NOT IN (SELECT source FROM r) THEN 'NO_RULES' WHEN entity IS NULL THEN 'NO_RULE_HOLDS' ELSE 'RESOLVED' END AS status FROM documents d LEFT JOIN h USING (doc_id)",
)
def source_rules(s, d):
    """Three of the patterns in an order of its own for each source; some sources have no rules."""
    docs = table(s, d, "documents")
    last = F.ascii(F.right("source", F.lit(1)))
    one = docs.select("source").filter("source is not null").distinct().filter(last % 4 > 0).select("source", (F.length("source") * 2 + last).alias("from"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("priority"))
    rules = one.select("source", "priority", F.get(F.array(*map(F.lit, PATTERNS)), ((F.col("from") + 2 * F.col("priority")) % len(PATTERNS)).cast("int")).alias("pattern"), F.concat_ws(":", "source", "priority").alias("entity"))
    return resolve.resolved_by_source(docs, rules, "doc_id", "source", F.col("text"))


_PAGE = "WITH p AS (SELECT s_suppkey AS page_id, s_suppkey % 4 AS k, 'hotel-' || s_suppkey AS slug, s_name AS name, s_nationkey AS n FROM supplier) "


@query(
    "src16_identities",
    _PAGE + "SELECT page_id, CASE k WHEN 3 THEN 'arama' ELSE slug END AS slug, k < 2 AS exists, CASE k WHEN 2 THEN 'About ' || name ELSE name || ' ' || CASE WHEN page_id % 8 < 4 THEN 'Şikayetleri - Site' ELSE 'sikayet ve Yorumları' END END AS page_title, "
    "CASE WHEN k < 2 THEN name END AS company_name, CASE k WHEN 0 THEN 2 WHEN 1 THEN 0 END AS own_cards, CASE k WHEN 0 THEN '' WHEN 1 THEN 'chain-' || n || '|' || slug || '-spa' END AS related FROM p",
)
def identities(s, d):
    """Every supplier as a page: with cards of its own, or with others' cards only, or no company's page, or an address that it was sent away to."""
    key = F.col("s_suppkey")
    k, slug = key % 4, F.concat(F.lit("hotel-"), key.cast("string"))
    link = lambda *c: F.concat(F.lit("<article><a class=c href='"), *c, F.lit("'>x</a></article>"))
    chain = F.concat(F.lit("https://h/chain-"), F.col("s_nationkey").cast("string"))
    others = [link(chain, F.lit("/a?x=1")), link(F.lit("/"), slug, F.lit("-spa/b")), link(chain, F.lit("/c"))]
    own = [link(F.lit("/"), slug, F.lit("/a")), link(F.lit("https://h/"), slug, F.lit("/b#top")), link(F.lit("/"), slug, F.lit("/a?again"))]
    title = F.when(k == 2, F.concat(F.lit("About "), F.col("s_name"))).otherwise(F.concat(F.col("s_name"), F.lit(" "), F.when(key % 8 < 4, "Şikayetleri - Site").otherwise("sikayet ve Yorumları")))
    body = F.concat(*others, F.when(k == 0, F.concat(*own)).otherwise(""), F.lit("<a href='/about'>about</a>"))
    made = table(s, d, "supplier").select(key.alias("page_id"), F.when(k == 3, "https://h/arama?q=x").otherwise(F.concat(F.lit("https://h/"), slug, F.lit("?page=2"))).alias("url"), F.concat(F.lit("<html><title>\n "), title, F.lit(" </title>"), body).alias("html"))
    return pages.identities(made).select("page_id", "slug", "exists", "page_title", "company_name", F.col("own_cards").cast("int").alias("own_cards"), F.array_join("related_slugs", "|").alias("related"))


@query(
    "st10_rating_words",
    r"WITH x AS (SELECT quality AS q, len(regexp_extract_all(text, '[^ \t\n\r\f\v]+')) AS w FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL AND quality IS NOT NULL), r AS (SELECT rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2.0 AS a, rank() OVER (ORDER BY w) + (count(*) OVER (PARTITION BY w) - 1) / 2.0 AS b FROM x), "
    "c AS (SELECT corr(a, b) AS r, count(*)::DOUBLE AS n FROM r), z AS (SELECT abs(r) * sqrt((n - 2) / (1 - r * r)) AS z, n - 2 AS v FROM c) SELECT n::BIGINT AS n, round(r, 6) AS rho, round(" + _STUDENT + ", 6) AS p FROM c",
)
def rating_words(s, d):
    """Rating against words, without rows that lack either."""
    rows = table(s, d, "documents").join(table(s, d, "labels"), "doc_id").select(F.col("quality").alias("q"), F.regexp_count("text", F.lit(r"[^ \t\n\r\f\x0B]+")).alias("w"))
    return stats.spearman(rows, "q", "w").select("n", F.round("rho", 6).alias("rho"), F.round("p", 6).alias("p"))


@query("snk03_snk05_buckets", "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS v, CASE WHEN c_custkey % 5 = 0 THEN 3 ELSE 1 END::BIGINT AS n, CASE WHEN c_custkey % 7 = 0 THEN c_custkey ELSE c_custkey + 1 END AS first FROM customer")
def bucketed(s, d):
    """Three tables of customers in buckets, each by another rule, after a second batch that has some of their keys again."""
    c = table(s, d, "customer").select(F.col("c_custkey").alias("k"))

    def kept(rule, *batches):
        at = _folder(s)
        for b in batches:
            buckets.write(b, at, "k", rule, buckets=16)
        return buckets.read(s, at, batches[0].schema)

    replaced = kept(buckets.replace("k"), c.withColumn("v", F.lit("old")), c.filter("k % 3 = 0").withColumn("v", F.lit("new")))
    added = kept(buckets.add_counters("k", ["n"]), c.withColumn("n", F.lit(1).cast("long")), c.filter("k % 5 = 0").withColumn("n", F.lit(2).cast("long")))
    first = kept(buckets.keep_first("k", "first"), c.filter("k % 7 = 0").withColumn("first", F.col("k")), c.withColumn("first", F.col("k") + 1))
    return replaced.join(added, "k").join(first, "k")


@query("stream_collected", "SELECT event_id, event_type, value FROM events")
def collected(s, d):
    """Events as a stream in which many come again, into a table that has some of them already: each is in it once."""
    at, landing, schema = _folder(s), _folder(s), "event_id long, event_type string, value double"
    e = table(s, d, "events").select(F.col("event_id").cast("long").alias("event_id"), "event_type", "value")
    buckets.write(e.filter("event_id % 4 = 0"), at, "event_id", buckets.keep_first("event_id", "value"), buckets=16)
    e.unionByName(e.filter("event_id % 3 = 0")).write.parquet(landing)
    incremental.awaited(incremental.collect_stream(incremental.landing(s, landing, schema), at, "event_id", "value", _folder(s), bucket_count=16))
    return incremental.latest(s, at, schema)
