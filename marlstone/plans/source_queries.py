"""Queries that write tables in other forms and read them back, and that read pages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import checks, pages, within
from ..session import scratch
from ..sources import io
from .frames import table
from .registry import query


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return f"{scratch(spark)}/{uuid.uuid4().hex}"


def _typed(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


@query("src01_src02_texts", "SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment, c_nationkey::VARCHAR AS c_nationkey FROM customer")
def texts(s, d):
    """A file with a byte order mark, whose columns are in another order than asked for, all as texts."""
    at = _folder(s)
    io.write_csv(table(s, d, "customer").select("c_mktsegment", "c_nationkey", "c_custkey", "c_name"), at, mark=True)
    return io.read_csv(s, at, ["c_custkey", "c_name", "c_mktsegment", "c_nationkey"])


@query("src03_src04_dates", "SELECT o_orderkey, o_orderdate, o_totalprice, CASE WHEN o_orderstatus = 'F' THEN o_orderstatus END AS o_orderstatus FROM orders")
def dates(s, d):
    """Two folders under one glob with columns in different orders, one of which lacks a column; dates and numbers are parsed."""
    at, o = _folder(s), table(s, d, "orders")
    io.write_csv(o.filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus"), f"{at}/a")
    io.write_csv(o.filter("o_orderstatus <> 'F'").select("o_totalprice", "o_orderkey", "o_orderdate"), f"{at}/b")
    schema = _typed(("o_orderkey", T.LongType()), ("o_orderdate", T.TimestampType()), ("o_totalprice", T.DoubleType()), ("o_orderstatus", T.StringType()))
    return io.read_csv(s, f"{at}/*", schema).withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


@query("src06_src09_fallback", "SELECT r_regionkey, r_name FROM region")
def fallback(s, d):
    """The first source that is there, and nothing from one that isn't."""
    at = _folder(s)
    io.write_csv(table(s, d, "region").select("r_regionkey", "r_name"), f"{at}/clean")
    schema = _typed(("r_regionkey", T.LongType()), ("r_name", T.StringType()))
    return io.read_first(s, [f"{at}/enriched", f"{at}/features", f"{at}/clean"], schema).unionByName(io.read_or_empty(s, f"{at}/more", schema))


@query("src08_settings", "SELECT n_name, 'alias of ' || lower(n_name) AS alias, n_regionkey / 10.0 AS threshold FROM nation")
def settings(s, d):
    """A JSON document over several lines, with a list for each name."""
    at = _folder(s)
    entry = F.struct(F.array(F.concat(F.lit("alias of "), F.lower("n_name"))).alias("aliases"), (F.col("n_regionkey") / 10).alias("threshold"))
    one = table(s, d, "nation").agg(F.map_from_entries(F.collect_list(F.struct("n_name", entry))).alias("entities"))
    one.select(F.regexp_replace(F.to_json(F.struct("entities")), "(?<=[{,])", "\n").alias("value")).write.text(at)
    read = io.read_settings(s, at, "entities map<string, struct<aliases: array<string>, threshold: double>>")
    rows = read.select(F.explode("entities").alias("n_name", "x"))
    return rows.select("n_name", F.explode("x.aliases").alias("alias"), F.col("x.threshold").alias("threshold"))


@query("snk01_snk02_nb48_appended", "SELECT s_suppkey, s_name, NULL AS note FROM supplier UNION ALL SELECT c_custkey, c_name, 'customer' FROM customer")
def appended(s, d):
    """Two batches added to one table of files, each with the header once and the same columns, of which the first batch lacks one and has one more."""
    at, fields = _folder(s), ["s_suppkey", "s_name", "note"]
    io.append_csv(table(s, d, "supplier"), at, fields)
    io.append_csv(table(s, d, "customer").select(F.lit("customer").alias("note"), F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("s_name")), at, fields)
    return io.read_csv(s, at, _typed(("s_suppkey", T.LongType()), ("s_name", T.StringType()), ("note", T.StringType())))


@query("snk08_unchanged", "SELECT 'copy' AS name, count(*) AS n_rows, TRUE AS unchanged FROM customer UNION ALL SELECT 'one_row_twice', count(*) + 2, FALSE FROM customer")
def unchanged(s, d):
    """A table against a copy of it in another order, and against one in which a row is repeated twice."""
    c = table(s, d, "customer")
    was = F.broadcast(checks.fingerprint(c).select(F.col("hash").alias("was")))
    twice = c.filter("c_custkey = 1")
    rows = [("copy", c.repartition(7)), ("one_row_twice", c.unionByName(twice).unionByName(twice))]
    out = [checks.fingerprint(x).crossJoin(was).select(F.lit(n).alias("name"), "n_rows", (F.col("hash") == F.col("was")).alias("unchanged")) for n, x in rows]
    return out[0].unionByName(out[1])


@query("src12_cards", "SELECT n_nationkey + 25 * (s_suppkey // 1250) AS page_id, '/' || lower(n_name) || '/' || s_suppkey AS href, min(s_name) AS title FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2")
def cards(s, d):
    """Each nation as listings of its suppliers, some 50 to a page, each twice and with a query, between links that are no cards."""
    j = table(s, d, "supplier").join(F.broadcast(table(s, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    href = F.concat(F.lit("/"), F.lower("n_name"), F.lit("/"), F.col("s_suppkey").cast("string"))
    card = F.concat(F.lit("<article><h3><a class='x' href='"), href, F.lit("?ref=1#top'>\n<b>"), F.col("s_name"), F.lit("</b></a></h3></article><a href='"), href, F.lit("'>more</a>"))
    g = j.groupBy((F.col("n_nationkey") + 25 * F.floor(F.col("s_suppkey") / 1250)).alias("page_id"), "n_name").agg(F.array_join(F.collect_list(card), "").alias("c"))
    return pages.cards(g.select("page_id", F.concat(F.lit("<a href='/about'>About</a><a href='/other/9'>other</a>"), F.col("c")).alias("html")), prefix="/nation")


@query("src12_links")
def page_links(s, d):
    return pages.links(table(s, d, "pages"))


@query("src13_detail")
def detail(s, d):
    return pages.detail(table(s, d, "pages")).drop("replies")


def _escaped(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _complaint_pages(s: SparkSession, d: str) -> DataFrame:
    """Each conversation as a page of a complaint: its first turn is the text, the others are messages."""
    c = table(s, d, "conversations")
    mark = F.when(F.col("role") == "assistant", '<i data-ga-element="Complaint_Answer_Brand"></i>').otherwise("")
    message = F.concat(F.lit('<div id="message-'), F.col("turn"), F.lit('">'), mark, F.lit('<div class="min-w-0"><b>x</b> 5 Ağustos 2025 09:58 </div><p>'), _escaped(F.coalesce("text", F.lit(""))), F.lit("</p></div>"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))), lambda x: x["m"])
    g = c.groupBy(F.col("conv_id").alias("page_id")).agg(F.array_join(parts, "\n").alias("m"), F.min_by(_escaped(F.coalesce("text", F.lit(""))), "turn").alias("first"))
    head = F.concat(F.lit("<a data-ga-element='Breadcrumb_Link'>home</a><a data-ga-element='Breadcrumb_Link'>stays</a><a data-ga-element='Breadcrumb_Link'>rooms</a><article><h1>brand <span>case "), F.col("page_id"), F.lit("</span></h1><div>7 Mart 11:05 <span><svg><use href='#ic-view'></use></svg><span>1.2K</span></span></div><div class='x selection-share'><p>"))
    return g.select("page_id", F.concat(head, F.col("first"), F.lit("<p>second</div><div data-ga-element='Complaint_Content_End'></div><button data-ga-element='Engagement_Card_Upvote'>like</button></article><div id='messages'>"), F.col("m"), F.lit("</div>")).alias("html"))


SQUEEZED = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"


REPLIES = f"SELECT conv_id AS page_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS reply_order, CASE WHEN role = 'assistant' THEN 'COMPANY' ELSE 'USER' END AS reply_author_type, '5 Ağustos 2025 09:58' AS reply_date_raw, {SQUEEZED} AS reply_text FROM conversations"


@query("src13_src14_replies", REPLIES)
def replies(s, d):
    return pages.replies(pages.detail(_complaint_pages(s, d)))


@query("src13_reply_rows", REPLIES)
def reply_rows(s, d):
    """The same by a table function, a row at a time."""
    return pages.reply_rows(_complaint_pages(s, d))


@query(
    "src14_fields",
    f"WITH r AS (SELECT *, {SQUEEZED} AS t FROM conversations), g AS (SELECT conv_id AS page_id, min_by(t, turn) AS first, count(*) FILTER (role <> 'assistant') AS users, min_by(t, turn) FILTER (role = 'assistant') AS company, min_by(t, turn) FILTER (role <> 'assistant') AS a_user FROM r GROUP BY 1) "
    "SELECT page_id, 'case ' || page_id AS title, CASE WHEN first = '' THEN 'second' ELSE first || chr(10) || 'second' END AS body, '7 Mart 11:05' AS date_raw, '1.2K' AS view_count, NULL AS support_count, 'rooms' AS category, NULL AS product, company IS NOT NULL AS company_response_exists, company AS company_response_text, users AS user_reply_count, a_user AS first_user_reply_text FROM g",
)
def fields(s, d):
    """The fields of made-up complaint pages, a paragraph of which is never closed; the button has no number, which is not zero."""
    return pages.detail(_complaint_pages(s, d)).select("page_id", "title", "body", "date_raw", "view_count", "support_count", "category", "product", "company_response_exists", "company_response_text", "user_reply_count", "first_user_reply_text")


@query(
    "src16_src17_search",
    r'''WITH l AS (SELECT page_id, unnest(range(1, len(h) + 1)) AS position, unnest(h) AS href, string_split(lower(regexp_extract(html, '<article>(.*?)</article>', 1)), ' ') AS words FROM (SELECT page_id, html, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages)), k AS (SELECT page_id, href[2:] AS slug, min(position) AS position FROM l WHERE len(regexp_extract_all(href, '/')) = 1 AND len(href) > 1 AND len(list_intersect(string_split(lower(href[2:]), '-'), words)) > 0 GROUP BY 1, 2) SELECT page_id, slug FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY position) AS r FROM k) WHERE r <= 5''',
)
def search(s, d):
    """Of a page's links of one level, the first five whose slug shares a word with the page's article."""
    p = table(s, d, "pages")
    words = F.split(F.lower(F.regexp_extract("html", "<article>(.*?)</article>", 1)), " ")
    found = p.select("page_id", words.alias("words"), F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("position", "href"))
    one = found.filter((F.size(F.regexp_extract_all("href", F.lit("/"), F.lit(0))) == 1) & (F.length("href") > 1))
    slug = F.expr("substr(href, 2)")
    one = one.filter(F.arrays_overlap(F.split(F.lower(slug), "-"), "words")).groupBy("page_id", slug.alias("slug")).agg(F.min("position").alias("position"))
    return within.top_k(one, 5, [F.col("position")], ["page_id"]).select("page_id", "slug")


@query("nb49_src18_src19_collected", "WITH t(target, prio, kind) AS (VALUES ('a', 0, 'purchase'), ('b', 1, 'click')), l AS (SELECT user_id, target, prio, min(event_id) AS first_id FROM events JOIN t ON kind = event_type GROUP BY 1, 2, 3), o AS (SELECT user_id, min_by(target, prio) AS target, min_by(first_id, prio) AS first_id FROM l GROUP BY 1), w AS (SELECT user_id, max(CASE WHEN r = 1 THEN event_id END) AS reply_1, max(CASE WHEN r = 2 THEN event_id END) AS reply_2, max(CASE WHEN r = 5 THEN event_id END) AS reply_5 FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events WHERE event_type = 'view') WHERE r <= 5 GROUP BY 1) SELECT o.user_id, target, first_id, CASE WHEN reply_1 IS NULL THEN 'NO_DETAIL' ELSE 'DONE' END AS status, reply_1, reply_2, reply_5 FROM o LEFT JOIN w ON w.user_id = o.user_id")
def collected(s, d):
    """A collection by targets: a link that several targets find is the first's; its details are laid wide up to five; the status is upserted."""
    e = table(s, d, "events")
    targets = F.broadcast(s.createDataFrame([("a", 0, "purchase"), ("b", 1, "click")], "target string, prio int, event_type string"))
    links = e.join(targets, "event_type").groupBy("user_id", "target", "prio").agg(F.min("event_id").alias("first_id"))
    owned = within.first_by(links, ["user_id"], [F.col("prio")]).select("user_id", "target", "first_id")
    views = within.top_k(e.filter("event_type = 'view'").select("user_id", "event_id"), 5, [F.col("event_id")], ["user_id"])
    wide = views.groupBy("user_id").agg(*(F.max(F.when(F.col("rn") == k, F.col("event_id"))).alias(f"reply_{k}") for k in (1, 2, 5)))
    status = owned.select("user_id", F.lit("NO_DETAIL").alias("status"))
    status = io.upserted(status, owned.join(wide, "user_id", "left_semi").select("user_id", F.lit("DONE").alias("status")), "user_id")
    return owned.join(status, "user_id").join(wide, "user_id", "left").select("user_id", "target", "first_id", "status", "reply_1", "reply_2", "reply_5")
