"""The tables that queries start from, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c, 6)


def entities(spark: SparkSession, d: str) -> DataFrame:
    """One row a customer: rating (balance), reviews (orders), price (mean order price; NULL without orders), grp (nation)."""
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("price"))
    nation = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("grp"))
    cust = table(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    cust = cust.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return cust.select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"), "grp", F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("rating"), F.coalesce("n", F.lit(0)).alias("reviews"), "price")


ENT = """ent AS (SELECT c_custkey AS entity_id, c_name AS name, n_name AS grp, c_mktsegment AS segment, c_acctbal AS rating,
  coalesce(n, 0) AS reviews, price FROM customer JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS price FROM orders GROUP BY 1) o ON o_custkey = c_custkey)"""


def monthly(spark: SparkSession, d: str) -> DataFrame:
    """Orders by month: period, year, month, a (status F), b (others), total, value."""
    o = table(spark, d, "orders").withColumn("period", F.date_format("o_orderdate", "yyyy-MM"))
    return o.groupBy("period").agg(F.count_if(F.col("o_orderstatus") == "F").alias("a"), F.count_if(F.col("o_orderstatus") != "F").alias("b"), F.count(F.lit(1)).alias("total"), F.sum("o_totalprice").alias("value")).withColumns({"year": F.substring("period", 1, 4).cast("int"), "month": F.substring("period", 6, 2).cast("int")})


MON = """mon AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus <> 'F') AS b,
  count(*) AS total, sum(o_totalprice) AS value, any_value(year(o_orderdate)) AS year, any_value(month(o_orderdate)) AS month FROM orders GROUP BY 1)"""


def shipped_monthly(spark: SparkSession, d: str) -> DataFrame:
    """Line items by month of shipping: period, n, quantity."""
    return table(spark, d, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("period")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


SHIP = "ship AS (SELECT strftime(l_shipdate, '%Y-%m') AS period, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1)"

#: Our own small vocabularies over the synthetic words.
ASPECTS = {"motion": ["tion", "ontion"], "article": ["the", "der", "la"], "joiner": ["and", "und", "et"], "place": ["in", "on at", "over"], "short": ["er", "en"]}
HIGH, MEDIUM = ["idiot", "scum", "worthless"], ["pathetic", "disgusting", "stupid"]


def aspect_docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a flag for each aspect, and rating group by quality label (0 LOW, 1 HIGH, none MIXED)."""
    from ..operators.terms import aspect_flags

    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    text = F.lower(F.coalesce("text", F.lit("")))
    docs = docs.select("doc_id", "source", "lang", F.when(F.col("quality") == 0, "LOW").when(F.col("quality") == 1, "HIGH").otherwise("MIXED").alias("rating_group"), text.alias("t"))
    return docs.withColumns(aspect_flags(F.col("t"), ASPECTS))


def _sql_pattern(words: list[str]) -> str:
    return "(^|[^\\p{L}])(" + "|".join(f"{k}\\p{{L}}{{0,10}}" if " " not in k and len(k) >= 4 else k for k in words) + ")([^\\p{L}]|$)"


ASP = (
    "asp AS (SELECT d.doc_id, source, lang, CASE quality WHEN 0 THEN 'LOW' WHEN 1 THEN 'HIGH' ELSE 'MIXED' END AS rating_group, "
    + ", ".join(f"regexp_matches(lower(coalesce(text, '')), '{_sql_pattern(k)}') AS {a}" for a, k in ASPECTS.items())
    + " FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"
)
LONG = "lng AS (" + " UNION ALL ".join(f"SELECT doc_id, source, lang, rating_group, '{a}' AS aspect, {a} AS matched FROM asp" for a in ASPECTS) + ")"
SEVERITY = f"CASE WHEN regexp_matches(lower(coalesce(text, '')), '{_sql_pattern(HIGH)}') THEN 'HIGH' WHEN regexp_matches(lower(coalesce(text, '')), '{_sql_pattern(MEDIUM)}') THEN 'MEDIUM' ELSE 'BASELINE' END"
