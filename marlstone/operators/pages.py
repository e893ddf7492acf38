"""Tables from web pages: links, titles, paragraphs and counts, by Spark's own expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markup import PageReplies, page_detail
from ..session import shipped


def _text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), "\\s+", " "))


def links(pages: DataFrame, html: str = "html", prefix: str = "") -> DataFrame:
    """page_id, position, href and title of each link whose path starts with prefix; href without query and fragment."""
    found = F.regexp_extract_all(F.col(html), F.lit("(?is)<a\\b[^>]*href=[\"']([^\"'#?]*)[^>]*>.*?</a>"), F.lit(0))
    rows = pages.select("page_id", F.posexplode(found).alias("position", "link"))
    rows = rows.select("page_id", "position", F.regexp_extract("link", "(?is)href=[\"']([^\"'#?]*)", 1).alias("href"), _text(F.col("link")).alias("title"))
    return rows.filter(F.col("href").startswith(prefix))


def detail(pages: DataFrame, html: str = "html", brand_links: Sequence[str] = ()) -> DataFrame:
    """One row a page: page_id, title, body (paragraphs by line), n_paragraphs, date_raw, view_count, support_count, category, product, replies, and of these the first of the company, how many are users' and the first of them. Missing is NULL, not 0; a reply is the company's if it is marked so or links to one of brand_links."""
    shipped(pages.sparkSession)
    d = pages.select("page_id", page_detail(F.coalesce(F.col(html), F.lit(""))).alias("d")).select("page_id", "d.*")
    n = F.size("crumbs")
    company = lambda r: r["by_brand"] | (F.arrays_overlap(r["links"], F.array(*map(F.lit, brand_links))) if brand_links else F.lit(False))
    replies = F.transform("replies", lambda r: F.struct(r["reply_order"].alias("reply_order"), F.when(company(r), "COMPANY").otherwise("USER").alias("reply_author_type"), r["reply_date_raw"].alias("reply_date_raw"), r["reply_text"].alias("reply_text")))
    d = d.withColumn("replies", replies).withColumns({"__c": F.filter("replies", lambda r: r["reply_author_type"] == "COMPANY"), "__u": F.filter("replies", lambda r: r["reply_author_type"] == "USER")})
    one = lambda c, f: F.get(c, F.lit(0))[f]
    return d.select(
        "page_id",
        "title",
        F.nullif(F.array_join("paragraphs", "\n"), F.lit("")).alias("body"),
        F.size("paragraphs").alias("n_paragraphs"),
        "date_raw",
        "view_count",
        "support_count",
        F.when(n >= 4, F.get("crumbs", n - 2)).when(n == 3, F.get("crumbs", n - 1)).alias("category"),
        F.when(n >= 4, F.get("crumbs", n - 1)).alias("product"),
        "replies",
        (F.size("__c") > 0).alias("company_response_exists"),
        one("__c", "reply_date_raw").alias("company_response_date"),
        one("__c", "reply_text").alias("company_response_text"),
        F.size("__u").alias("user_reply_count"),
        one("__u", "reply_date_raw").alias("first_user_reply_date"),
        one("__u", "reply_text").alias("first_user_reply_text"),
    )


def replies(details: DataFrame) -> DataFrame:
    """A row for each reply of pages from detail()."""
    return details.select("page_id", F.inline("replies"))


def reply_rows(pages: DataFrame, html: str = "html", brand_links: Sequence[str] = ()) -> DataFrame:
    """The same rows as replies(detail(pages)), straight from pages by a lateral join with a table function: for pages with so many replies that one row should not hold them."""
    shipped(pages.sparkSession)
    company = F.col("by_brand") | (F.arrays_overlap("links", F.array(*map(F.lit, brand_links))) if brand_links else F.lit(False))
    rows = pages.select("page_id", F.coalesce(F.col(html), F.lit("")).alias("__html")).lateralJoin(PageReplies(F.col("__html").outer()))
    return rows.select("page_id", "reply_order", F.when(company, "COMPANY").otherwise("USER").alias("reply_author_type"), "reply_date_raw", "reply_text")


def cards(pages: DataFrame, html: str = "html", prefix: str = "") -> DataFrame:
    """page_id, href and title of links two levels deep or more whose path starts with prefix; a link's first place stands."""
    rows = links(pages, html, prefix).filter((F.length("href") - F.length(F.replace(F.col("href"), F.lit("/"), F.lit("")))) >= 2)
    return rows.groupBy("page_id", "href").agg(F.min_by("title", "position").alias("title"))


#: What a company's page has in its title, and addresses that a missing page leads to.
TITLE, ELSEWHERE = "[Şşs]ikayet", "/sikayetler|/arama|/search"


def identities(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """One row a page (page_id, and the address at which it was found): exists, slug, page_title, company_name, own_cards, related_slugs.

    A page exists as a company's if its title says so and its address is none that missing pages lead to. The company's name is the
    title up to that word. Cards are its own if they lie below its slug; where it has none, the slugs of others' cards
    on it are leads, in order of their first place. What is unknown is NULL; a page that is no company's has neither name nor cards.
    """
    path = lambda c: F.regexp_replace(F.regexp_replace(c, "^https?://[^/]+", ""), "[?#].*$", "")
    slug = lambda c: F.regexp_extract(path(c), "^/*([^/]*)", 1)
    title = F.coalesce(_text(F.regexp_extract(F.col(html), "(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
    head = pages.select("page_id", F.coalesce(slug(F.col(url)), F.lit("")).alias("slug"), title.alias("page_title"), F.col(url).rlike(ELSEWHERE).alias("elsewhere"))
    head = head.withColumn("exists", ~F.coalesce("elsewhere", F.lit(True)) & F.col("page_title").rlike("(?i)" + TITLE))
    found = links(pages, html).withColumn("path", path(F.col("href"))).filter(F.size(F.regexp_extract_all("path", F.lit("/"), F.lit(0))) >= 2)
    card = found.groupBy("page_id", "path").agg(F.min("position").alias("position")).withColumn("to", slug(F.col("path"))).filter("to <> ''")
    by_slug = card.groupBy("page_id", "to").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("position"))
    mine = by_slug.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("position", "to", "n"))).alias("cards"))
    rows = head.join(mine, "page_id", "left").withColumn("cards", F.coalesce("cards", F.expr("cast(array() as array<struct<position:int,to:string,n:bigint>>)")))
    own = F.aggregate(F.filter("cards", lambda x: x["to"] == F.col("slug")), F.lit(0).cast("long"), lambda n, x: n + x["n"])
    leads = F.transform(F.filter("cards", lambda x: x["to"] != F.col("slug")), lambda x: x["to"])
    name = F.nullif(F.trim(F.get(F.split("page_title", "\\s+" + TITLE, 2), F.lit(0))), F.lit(""))
    rows = rows.withColumn("own", own)
    there = lambda c: F.when(F.col("exists"), c)
    return rows.select("page_id", "slug", "exists", "page_title", there(name).alias("company_name"), there(F.col("own")).alias("own_cards"), there(F.when(F.col("own") == 0, leads).otherwise(F.array().cast("array<string>"))).alias("related_slugs"))
