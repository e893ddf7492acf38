"""Whole-table cleaning: complaints, their replies, and reviews, with the audits that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import shipped
from ..sources.stage import saved
from . import clean
from .quantiles import exact_quantiles

#: What betrays leftovers of a page, of its markup and of a wrong encoding, and personal data.
BOILERPLATE = "(?iu)devamını oku|marka profilini gör|şikayetin çözümü"
MARKUP, ENCODING = "(?i)<[^>]+>|&(?:nbsp|amp|quot|lt|gt);", "\\uFFFD|Ã.|Â."
PERSONAL = "(?i)(?:[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,})|(?:\\+?\\d[\\d\\s().-]{8,}\\d)"
MAIL, MOBILE = "(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}\\b", "(?<!\\d)(?:\\+?90\\s*)?(?:0?5\\d{2})[\\s().-]*\\d{3}[\\s.-]*\\d{2}[\\s.-]*\\d{2}(?!\\d)"
SHORT = 40


#: Second names under which the same flags are given.
ALIASES = {"missing_text_flag": "complaint_text_missing_flag", "missing_title_flag": "complaint_title_missing_flag", "very_short_text_flag": "complaint_text_very_short_flag", "date_parse_failed_flag": "complaint_date_parse_failed_flag", "date_is_approximate_flag": "complaint_date_is_approximate"}


def _or_null(df: DataFrame, names: list[str]) -> DataFrame:
    """df with those of names (fixed values, the columns of the raw table) that it lacks, as NULL texts."""
    return df.withColumns({c: F.lit(None).cast("string") for c in names if c not in df.columns})


def _sizes(c: Column, prefix: str) -> dict[str, Column]:
    return {f"{prefix}_char_count": F.length(c), f"{prefix}_word_count": F.regexp_count(c, F.lit("\\S+"))}


def short_threshold(df: DataFrame, words: str, out: str, cap: int = SHORT) -> DataFrame:
    """One row: the exact 5th percentile of word counts as a whole number from 1 to cap; cap without any. df is read three times."""
    q = F.when(F.col("q").isNotNull(), F.greatest(F.lit(1), F.least(F.lit(cap), F.floor("q"))))
    return exact_quantiles(df.select(words), {"q": (words, 0.05)}).select(F.coalesce(q, F.lit(cap)).cast("long").alias(out))


def prepared_complaints(df: DataFrame) -> DataFrame:
    """Complaints with clean texts, their sizes, parsed dates, counts and truth values, and quality flags; raw columns stay.

    Read are complaint_title, complaint_text, company_response_text, progress_text, complaint_date_raw,
    company_response_date, progress_date, collected_at, view_count, support_count, user_reply_count,
    company_response_exists and progress_exists, all texts; those that are missing are NULL. What cannot be read is NULL
    and flagged, never zero. very_short_threshold is the same in all rows. Texts that occur twice are counted by
    digest, so that a text in very many rows is one small group.

    Cleaning runs once: its rows are written to the checkpoint folder, and the threshold and the repeated texts are read from two
    narrow columns of these.
    """
    shipped(df.sparkSession)
    texts = {"complaint": "complaint_text", "title": "complaint_title", "company_response": "company_response_text", "progress": "progress_text"}
    dates = {"company_response_date": "company_response_date_parsed", "progress_date": "progress_date_parsed"}
    counts = ("view_count", "support_count", "user_reply_count")
    df = _or_null(df, [*texts.values(), *dates, *counts, "complaint_date_raw", "collected_at", "company_response_exists", "progress_exists"])
    out = df.withColumns({f"{c}_clean": X.raw_clean(F.col(c)) for c in texts.values()})
    for prefix, c in texts.items():
        out = out.withColumns(_sizes(F.col(f"{c}_clean"), prefix))
    collected = F.try_to_timestamp(F.col("collected_at"))
    out = out.withColumns({"collected_at_parsed": collected, "__date": X.display_date(F.col("complaint_date_raw"), collected), "__digest": F.sha2(X.duplicate_key(F.col("complaint_text_clean")), 256)})
    out = out.withColumns(
        {
            "complaint_text_missing_flag": F.col("complaint_text_clean").isNull(),
            "complaint_title_missing_flag": F.col("complaint_title_clean").isNull(),
            "complaint_text_html_artifact_flag": F.coalesce(F.col("complaint_text").rlike(MARKUP), F.lit(False)),
            "complaint_text_encoding_artifact_flag": F.coalesce(F.col("complaint_text").rlike(ENCODING), F.lit(False)),
            "complaint_date": F.col("__date.at"),
            "complaint_date_is_approximate": F.col("__date.approximate"),
            "complaint_date_pattern": F.col("__date.pattern"),
            "complaint_date_parse_failed_flag": F.col("__date.at").isNull(),
            "complaint_date_future_flag": F.coalesce(F.col("__date.at") > F.col("collected_at_parsed") + F.expr("interval 1 day"), F.lit(False)),
            "complaint_year": F.year("__date.at"),
            "complaint_month": F.month("__date.at"),
            "complaint_year_month": F.date_format("__date.at", "yyyy-MM"),
            **{to: X.display_date(F.col(c), F.col("collected_at_parsed"))["at"] for c, to in dates.items()},
            **{f"{c}_numeric": X.count_value(F.col(c)) for c in counts},
            "company_response_exists_clean": X.truth(F.col("company_response_exists")),
            "progress_exists_clean": X.truth(F.col("progress_exists")),
            "potential_pii_flag": F.coalesce(F.col("complaint_text_clean").rlike(PERSONAL), F.lit(False)),
        }
    ).withColumn("view_count_parse_failed_flag", clean.blank_to_null(F.col("view_count")).isNotNull() & F.col("view_count_numeric").isNull())
    out = saved(out)
    cut = short_threshold(out, "complaint_word_count", "very_short_threshold")
    repeated = out.filter(F.col("__digest").isNotNull()).groupBy("__digest").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    out = out.join(repeated, "__digest", "left").crossJoin(F.broadcast(cut))
    return out.withColumns(
        {
            "complaint_text_very_short_flag": F.coalesce(F.col("complaint_word_count") <= F.col("very_short_threshold"), F.lit(False)),
            "complaint_text_possible_boilerplate_flag": F.col("__n").isNotNull() | F.coalesce(F.col("complaint_text_clean").rlike(BOILERPLATE), F.lit(False)),
        }
    ).withColumns({to: F.col(c) for to, c in ALIASES.items()}).drop("__digest", "__date", "__n")


def prepared_replies(df: DataFrame, references: DataFrame, key: str = "canonical_complaint_url") -> DataFrame:
    """Replies (key, reply_order, reply_text, reply_author_type, reply_date_raw) with clean texts, parsed dates and stable ids; references has the time (collected_at_parsed) from which a complaint's relative dates count, one row a key."""
    shipped(df.sparkSession)
    out = df.join(references.select(key, F.col("collected_at_parsed").alias("__reference")), key, "left")
    order = X.count_value(F.col("reply_order"))
    text = X.raw_clean(F.col("reply_text"))
    parts = [F.trim(F.coalesce(F.col(key), F.lit(""))), F.coalesce(order.cast("string"), F.lit("")), F.coalesce(X.duplicate_key(text), F.lit(""))]
    out = out.withColumns({"reply_text_clean": text, "reply_author_type_clean": X.author_type(F.col("reply_author_type")), "reply_order_numeric": order, "__date": X.display_date(F.col("reply_date_raw"), F.col("__reference")), "reply_id": F.sha2(F.concat_ws("|", *parts), 256)})
    fields = {"reply_date": F.col("__date.at"), "reply_date_is_approximate": F.col("__date.approximate"), "reply_date_pattern": F.col("__date.pattern"), "reply_date_parse_failed_flag": F.col("__date.at").isNull()}
    return out.withColumns(fields).drop("__date", "__reference")


def _reviews(raw: DataFrame) -> DataFrame:
    number = clean.to_number(F.col("review_rating"))
    whole = F.when(number % 1 == 0, number)
    text = F.coalesce(F.col("review_text"), F.lit(""))
    out = raw.withColumns({"__number": whole, "review_text": text, "review_text_clean": F.trim(F.regexp_replace(F.regexp_replace(text, "\\u200B", ""), "\\s+", " "))})
    rating = F.when(F.col("__number").between(1, 5), F.col("__number").cast("int"))
    out = out.withColumns({"__invalid": F.col("__number").isNotNull() & rating.isNull(), "review_rating": rating, "__date": X.review_date(F.col("review_date_raw"), F.col("collected_at").cast("timestamp"))})
    body = F.col("review_text_clean")
    own = X.stable_id("gma_", F.col("hotel_id"), F.col("review_rating"), F.col("review_date_raw"), F.lower(body))
    return out.withColumns(
        {
            "rating_group": F.when(F.col("review_rating") <= 2, "LOW").when(F.col("review_rating") == 3, "MIXED").when(F.col("review_rating") >= 4, "HIGH"),
            "is_rating_only": F.col("review_rating").isNotNull() & (body == ""),
            "potential_pii_flag": F.col("review_text").rlike(MAIL) | F.col("review_text").rlike(MOBILE),
            "review_char_count": F.length(body),
            "review_word_count": F.regexp_count(body, F.lit("\\S+")),
            "review_date": F.col("__date.at"),
            "review_date_is_approximate": F.col("__date.approximate"),
            "review_is_edited": F.col("__date.edited"),
            "review_date_parse_status": F.col("__date.status"),
            "review_id": F.coalesce(clean.blank_to_null(F.col("review_id")), own),
        }
    ).drop("__date", "__number")


def cleaned_reviews(raw: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Reviews (hotel_id, review_id, review_rating, review_text, review_date_raw, collected_at; texts but for collected_at) without repeated ids, the first by order staying, and the audit as one row.

    Ratings that are no whole stars of 1 to 5 are NULL, rows without an id get one from their content, the reviewer's name goes.
    """
    rows = _reviews(raw)
    first = rows.groupBy("review_id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "review_id"]), order).alias("__row")).select("review_id", "__row.*")
    seen = rows.agg(F.count(F.lit(1)).alias("input_row_n"), F.count_if("__invalid").alias("invalid_rating_n"))
    kept = first.agg(F.count(F.lit(1)).alias("clean_row_n"), F.count_if("is_rating_only").alias("rating_only_n"), F.count_if(F.col("review_text_clean") != "").alias("text_review_n"), F.count_if("potential_pii_flag").alias("potential_pii_n"), F.count("review_date").alias("date_parsed_n"))
    audit = seen.crossJoin(F.broadcast(kept)).withColumn("exact_duplicate_n", F.col("input_row_n") - F.col("clean_row_n"))
    return first.drop("__invalid", "reviewer_name_raw"), audit
