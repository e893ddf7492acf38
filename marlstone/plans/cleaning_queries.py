"""Queries of whole-table cleaning, keyword rules, names and slugs, entity terms, audits of a table against itself, and p-values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import checks, composites, periods, resolve, stats, terms, within
from .frames import ASP, ASPECTS, ENT, LONG, MON, aspect_docs, entities, monthly, r6, table
from .registry import query

E, AL = f"WITH {ENT} ", f"WITH {ASP}, {LONG} "


def _pick(key, values):
    """values by the remainder of key; None is NULL."""
    k = F.pmod(key, F.lit(len(values)))
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        out = F.when(k == i, v if not (v is None or isinstance(v, str)) else F.lit(v).cast("string")).otherwise(out)
    return out


def _case(key: str, values) -> str:
    """The same as SQL; values are SQL."""
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


@query("tx03_phone_key", "SELECT o_orderkey, CASE WHEN length(x) >= 7 THEN right(x, 10) END AS phone FROM (SELECT o_orderkey, regexp_replace(" + _case("o_orderkey", ["'+90 (252) ' || lpad(o_custkey::VARCHAR, 7, '0')", "'0252.' || o_custkey || '-' || lpad(o_custkey::VARCHAR, 4, '0')", "'ext. 123'", "NULL"]) + ", '[^0-9]', '', 'g') AS x FROM orders)")
def phone_key(s, d):
    n = F.col("o_custkey").cast("string")
    raw = _pick(F.col("o_orderkey"), [F.concat(F.lit("+90 (252) "), F.lpad(n, 7, "0")), F.concat(F.lit("0252."), n, F.lit("-"), F.lpad(n, 4, "0")), "ext. 123", None])
    return table(s, d, "orders").select("o_orderkey", X.phone_key(raw).alias("phone"))


#: Sentences with inflected, compound and ambiguous keywords, one of which is added to each document.
SENTENCES = ["odalar temizdi", "odam küçük", "odacı geldi", "ses yok", "sesler vardı", "sesli masa", "checkin saati", "checkinler", "servis yavaş", "servis aracı geldi", "servis iyi, araç servisi geç", "kirliydi her yer", "yemekler iyi", "koy güzel", "koyu renk", "muhatap yok", "oda temizliği yok", "a.b"]
STAYS = {"STAFF": ["servis", "muhatap yok", "personel"], "ROOM": ["oda", "oda temizliği"], "NOISE": ["ses"], "CLEAN": ["kirli", "temiz"], "FOOD": ["yemek"], "SEA": ["koy"], "DESK": ["checkin"], "ODD": ["a.b"]}
UNLESS = {"STAFF": {"servis": ["servis aracı", "araç servisi"]}}
_SAID = "(SELECT doc_id, lower(coalesce(text, '')) || ' ' || " + _case("doc_id", [f"'{x}'" for x in SENTENCES]) + " AS t FROM documents)"


def _said(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.concat(F.lower(F.coalesce("text", F.lit(""))), F.lit(" "), _pick(F.col("doc_id"), SENTENCES)).alias("t"))


def _has(forms: str) -> str:
    return f"regexp_matches(t, '(^|[^\\p{{L}}])({forms})([^\\p{{L}}]|$)')"


ODA = "oda(da|dan|ya|yı|nın|sı|mız|lar|ları|m|n)?"
_FOUND = {
    "STAFF": [("muhatap yok", _has("muhatap yok")), ("personel", _has("personel\\p{L}{0,10}")), ("servis", _has("servis\\p{L}{0,10}") + " AND NOT " + _has("servis aracı|araç servisi"))],
    "ROOM": [("oda temizliği", _has("oda temizliği")), ("oda", _has(ODA))],
    "NOISE": [("ses", _has("ses(i|in|ler|leri|siz|inden)?"))],
    "CLEAN": [("kirli", _has("kirli\\p{L}{0,10}")), ("temiz", _has("temiz\\p{L}{0,10}"))],
    "FOOD": [("yemek", _has("yemek\\p{L}{0,10}"))],
    "SEA": [("koy", _has("koy"))],
    "DESK": [("checkin", _has("checkin"))],
    "ODD": [("a.b", _has("a\\.b"))],
}


@query("tx18_tx19_keyword_rule", "SELECT doc_id, concat_ws('|', " + ", ".join(f"CASE WHEN {' OR '.join(f'({c})' for _, c in _FOUND[a])} THEN '{a}' END" for a in sorted(_FOUND)) + ") AS aspects, concat_ws('|', " + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for a in STAYS for k, c in _FOUND[a]) + f") AS keywords FROM {_SAID}")
def keyword_rule(s, d):
    """Matched aspects in order of name and their keywords, phrases first; 'servis' counts for the staff only where no vehicle is meant."""
    x = _said(s, d)
    order = s.createDataFrame([(i, j, a, k) for i, a in enumerate(STAYS) for j, k in enumerate(terms.by_phrase(STAYS[a]))], "i int, j int, aspect string, keyword string")
    found = terms.keyword_rows(x, "doc_id", F.col("t"), STAYS, UNLESS).join(F.broadcast(order), ["aspect", "keyword"])
    found = found.groupBy("doc_id").agg(F.array_sort(F.collect_set("aspect")).alias("aspects"), F.array_sort(F.collect_list(F.struct("i", "j", "keyword"))).alias("keywords"))
    text = lambda c: F.coalesce(F.array_join(c, "|"), F.lit(""))
    return x.select("doc_id").join(found, "doc_id", "left").select("doc_id", text(F.col("aspects")).alias("aspects"), text(F.col("keywords.keyword")).alias("keywords"))


@query("tm02_dictionary", " UNION ALL ".join(f"SELECT '{a}' AS aspect, '{k}' AS keyword, '{'PHRASE' if ' ' in k else 'UNIGRAM'}' AS kind, '{'DISCOVERED' if k == 'muhatap yok' else 'SEED'}' AS origin, count(*) FILTER ({c.partition(' AND NOT ')[0]}) AS n_docs FROM {_SAID}" for a in STAYS for k, c in _FOUND[a]))
def dictionary(s, d):
    """Documents with each keyword of the dictionary by the keyword rule, all in one scan."""
    k = F.col("keyword")
    return terms.keyword_counts(_said(s, d), "doc_id", F.col("t"), STAYS).select("aspect", "keyword", F.when(F.contains(k, F.lit(" ")), "PHRASE").otherwise("UNIGRAM").alias("kind"), F.when(k == "muhatap yok", "DISCOVERED").otherwise("SEED").alias("origin"), "n_docs")


_HOTEL = "(SELECT s_suppkey, " + _case("s_suppkey", ["s_name || ' & Spa Hotel'", "'Hotel ' || n_name || ' ' || s_suppkey", "'Şato  Bodrum ' || s_suppkey", "s_name"]) + " AS name, n_name AS area FROM supplier JOIN nation ON n_nationkey = s_nationkey)"


def _hotels(s: SparkSession, d: str) -> DataFrame:
    n, key = F.col("s_name"), F.col("s_suppkey").cast("string")
    rows = table(s, d, "supplier").join(F.broadcast(table(s, d, "nation")), F.col("n_nationkey") == F.col("s_nationkey"))
    return rows.select("s_suppkey", _pick(F.col("s_suppkey"), [F.concat(n, F.lit(" & Spa Hotel")), F.concat(F.lit("Hotel "), F.col("n_name"), F.lit(" "), key), F.concat(F.lit("Şato  Bodrum "), key), n]).alias("name"), F.col("n_name").alias("area"))


_SLUG = "trim(regexp_replace(replace(regexp_replace(strip_accents(replace(lower({0}), 'ı', 'i')), '[^\\x00-\\x7F]', '', 'g'), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '-')"
_SLUGS = (
    f"WITH h AS {_HOTEL}, f AS (SELECT *, {_SLUG.format('name')} AS full_, {_SLUG.format('area')} AS near, " + _SLUG.format("replace(name, '&', '')") + " AS plain FROM h), w AS (SELECT *, string_split(full_, '-') AS ws FROM f), "
    "o AS (SELECT *, array_to_string(list_filter(ws, lambda x: x NOT IN ('hotel', 'spa')), '-') AS a, CASE WHEN NOT list_contains(ws, 'bodrum') THEN full_ || '-bodrum' END AS b, CASE WHEN NOT list_contains(ws, near) THEN full_ || '-' || near END AS c FROM w), "
    "l AS (SELECT s_suppkey, name, area, list_filter([full_, nullif(a, ''), b, plain, c], lambda x: x IS NOT NULL) AS xs FROM o) "
)


@query("tx28_slug_candidates", _SLUGS + ", u AS (SELECT s_suppkey, name, area, list_filter(xs, lambda x, i: list_position(xs, x) = i) AS xs FROM l), q AS (SELECT *, [name, CASE WHEN NOT contains(lower(name), lower(area)) THEN name || ' ' || area END, CASE WHEN NOT contains(lower(name), 'bodrum') THEN name || ' Bodrum' END, name || ' Reviews'] AS qs FROM u) SELECT s_suppkey, array_to_string(xs[1:5], '|') AS slugs, array_to_string(list_filter(qs, lambda x: x IS NOT NULL)[1:4], '|') AS queries FROM q")
def slug_candidates(s, d):
    slugs = X.slug_candidates(F.col("name"), F.col("area"), "bodrum", ("hotel", "spa"))
    return _hotels(s, d).select("s_suppkey", F.array_join(slugs, "|").alias("slugs"), F.array_join(X.search_queries(F.col("name"), F.col("area"), "Bodrum", "Reviews"), "|").alias("queries"))


@query("tx29_match_key", "SELECT doc_id, regexp_replace(strip_accents(lower(coalesce(text, ''))), '[^\\x00-\\x7F]', '', 'g') AS key FROM documents")
def match_key(s, d):
    return table(s, d, "documents").select("doc_id", X.match_key(F.col("text")).alias("key"))


@query("tx36_variants", "SELECT key, string_agg(DISTINCT raw, '|' ORDER BY raw) AS variants, count(DISTINCT raw) AS n FROM (SELECT lower(p_type) AS key, " + _case("p_partkey", ["p_type", "CASE WHEN p_type = 'PROMO' THEN p_type ELSE lower(p_type) END", "p_type"]) + " AS raw FROM part) GROUP BY 1 HAVING count(DISTINCT raw) > 1")
def variants(s, d):
    """Ways to write one value that differ but for case and marks; values that are always written alike are left out."""
    raw = F.col("p_type")
    rows = table(s, d, "part").select(_pick(F.col("p_partkey"), [raw, F.when(raw == "PROMO", raw).otherwise(F.lower(raw)), raw]).alias("raw")).withColumn("key", X.folded(F.col("raw")))
    return rows.groupBy("key").agg(F.sort_array(F.collect_set("raw")).alias("v")).filter(F.size("v") > 1).select("key", F.array_join("v", "|").alias("variants"), F.size("v").cast("long").alias("n"))


@query("dt04_display_key", "SELECT p_partkey, " + _case("p_partkey", ["'2025-8-' || (p_size % 28 + 1) || '-13-45'", "'2023-12-21-9-5'", "NULL", "NULL", "NULL"]) + " AS key FROM part")
def display_key(s, d):
    day = (F.col("p_size") % 28 + 1).cast("string")
    raw = _pick(F.col("p_partkey"), [F.concat(F.lit("posted "), day, F.lit(" Ağustos 13:45")), "21 Aralık 2023 9:05 x", "5 Foo 10:00", "dün", None])
    key = X.display_key(raw, F.lit(2025))
    return table(s, d, "part").select("p_partkey", F.when(key.isNotNull(), F.concat_ws("-", *(key[f].cast("string") for f in ("year", "month", "day", "hour", "minute")))).alias("key"))


VIEWS, DONE = ["1.234", "1,2 B", None, "3M", "çok", "7", "1.234,5 B", "-4"], ["Evet", "0", None, "belki"]


def _complaints(s: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    day = F.concat((k % 28 + 1).cast("string"), F.lit(" Ocak"))
    raw = [
        ("complaint_title", [F.concat(F.lit("<b>Case</b> &amp; "), F.col("source")), "  ", None, F.col("source")]),
        ("complaint_text", [F.col("text"), F.concat(F.lit("a​b "), F.col("text")), F.concat(F.lit("mail x.y@z.co <br/> "), F.col("text")), "Devamını oku", "same old text", "Ã¶ tel 0252 123 45 67"]),
        ("company_response_text", ["Sayın müşteri", None]),
        ("complaint_date_raw", ["5 Ağustos 2025 09:58", day, "31 Şubat 2024", "Bugün 10:30", "dün", F.concat((k % 50).cast("string"), F.lit(" gün önce")), None, "yesterday", "9 Eylül 2025"]),
        ("company_response_date", ["6 Ağustos 2025", "?"]),
        ("collected_at", ["2025-09-01 12:00:00", "2025-01-10 00:30:00"]),
        ("view_count", VIEWS),
        ("company_response_exists", DONE),
    ]
    return table(s, d, "documents").select("doc_id", *(_pick(k, v).alias(n) for n, v in raw))


_CLEAN = "nullif(trim(regexp_replace(x, '\\s+', ' ', 'g')), '')"
_COMPLAINTS = (
    "WITH r AS (SELECT doc_id, " + _case("doc_id", ["'Case & ' || source", "NULL", "NULL", "source"]) + " AS title, "
    + _case("doc_id", ["text", "'ab ' || text", "'mail x.y@z.co ' || text", "'Devamını oku'", "'same old text'", "'Ã¶ tel 0252 123 45 67'"]) + " AS x, "
    + "doc_id % 6 = 2 AND text IS NOT NULL AS markup, doc_id % 6 = 5 AS encoding, CASE doc_id % 2 WHEN 0 THEN TIMESTAMP '2025-09-01 12:00:00' ELSE TIMESTAMP '2025-01-10 00:30:00' END AS ref, "
    + _case("doc_id", ["'DAY_MONTH_YEAR_TIME'", "'DAY_MONTH_TIME_NO_YEAR'", "'INVALID_CALENDAR_DATE'", "'RELATIVE_TODAY'", "'RELATIVE_YESTERDAY'", "'RELATIVE_DAYS_AGO'", "'MISSING'", "'UNRECOGNIZED'", "'DAY_MONTH_YEAR_TIME'"]) + " AS pattern, "
    + _case("doc_id", ["1234", "1200", "NULL", "3000000", "NULL", "7", "1234500", "NULL"]) + " AS views, doc_id % 8 IN (4, 7) AS views_failed, " + _case("doc_id", ["TRUE", "FALSE", "NULL", "NULL"]) + " AS answered FROM documents), "
    "c AS (SELECT *, " + _CLEAN + " AS t, make_timestamp(2025, 1, (doc_id % 28 + 1)::BIGINT, 0, 0, 0) AS jan FROM r), "
    "p AS (SELECT *, CASE doc_id % 9 WHEN 0 THEN TIMESTAMP '2025-08-05 09:58:00' WHEN 1 THEN CASE WHEN jan > ref + INTERVAL 1 DAY THEN jan - INTERVAL 1 YEAR ELSE jan END WHEN 3 THEN date_trunc('day', ref)::TIMESTAMP + INTERVAL 630 MINUTE WHEN 4 THEN date_trunc('day', ref)::TIMESTAMP - INTERVAL 1 DAY WHEN 5 THEN date_trunc('day', ref)::TIMESTAMP - to_days((doc_id % 50)::INT) WHEN 8 THEN TIMESTAMP '2025-09-09 00:00:00' END AS moment, "
    "len(regexp_extract_all(t, '\\S+')) AS words, trim(regexp_replace(lower(t), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS same FROM c), "
    "q AS (SELECT greatest(1, least(40, floor(quantile_cont(words, 0.05))))::BIGINT AS cut FROM p WHERE t IS NOT NULL), n AS (SELECT same FROM p WHERE same <> '' GROUP BY 1 HAVING count(*) > 1) "
)


@query("dq20_prepared_complaints", _COMPLAINTS + "SELECT doc_id, title AS complaint_title_clean, length(t) AS complaint_char_count, CASE WHEN t IS NOT NULL THEN words END AS complaint_word_count, t IS NULL AS complaint_text_missing_flag, title IS NULL AS complaint_title_missing_flag, coalesce(words <= cut AND t IS NOT NULL, FALSE) AS complaint_text_very_short_flag, n.same IS NOT NULL OR doc_id % 6 = 3 AS complaint_text_possible_boilerplate_flag, markup AS complaint_text_html_artifact_flag, encoding AS complaint_text_encoding_artifact_flag, moment AS complaint_date, pattern IN ('DAY_MONTH_TIME_NO_YEAR') OR starts_with(pattern, 'RELATIVE') AS complaint_date_is_approximate, pattern AS complaint_date_pattern, moment IS NULL AS complaint_date_parse_failed_flag, coalesce(moment > ref + INTERVAL 1 DAY, FALSE) AS complaint_date_future_flag, strftime(moment, '%Y-%m') AS complaint_year_month, CASE WHEN doc_id % 2 = 0 THEN TIMESTAMP '2025-08-06 00:00:00' END AS company_response_date_parsed, views AS view_count_numeric, views_failed AS view_count_parse_failed_flag, answered AS company_response_exists_clean, NULL AS progress_exists_clean, coalesce(regexp_matches(t, '(?i)(?:[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,})|(?:\\+?\\d[\\d\\s().-]{8,}\\d)'), FALSE) AS potential_pii_flag, cut AS very_short_threshold FROM p CROSS JOIN q LEFT JOIN n ON n.same = p.same")
def prepared_complaints(s, d):
    c = composites.prepared_complaints(_complaints(s, d))
    ntz = lambda n: F.col(n).cast("timestamp_ntz").alias(n)
    plain = ["doc_id", "complaint_title_clean", "complaint_char_count", "complaint_word_count", "complaint_text_missing_flag", "complaint_title_missing_flag", "complaint_text_very_short_flag", "complaint_text_possible_boilerplate_flag", "complaint_text_html_artifact_flag", "complaint_text_encoding_artifact_flag"]
    rest = ["complaint_date_is_approximate", "complaint_date_pattern", "complaint_date_parse_failed_flag", "complaint_date_future_flag", "complaint_year_month"]
    last = ["view_count_numeric", "view_count_parse_failed_flag", "company_response_exists_clean", "progress_exists_clean", "potential_pii_flag", "very_short_threshold"]
    return c.select(*plain, ntz("complaint_date"), *rest, ntz("company_response_date_parsed"), *last)


_AUTHOR = ["'COMPANY'", "'COMPANY'", "'USER'", "'USER'", "'UNKNOWN'", "'UNKNOWN'"]


@query("dq20_prepared_replies", "WITH r AS (SELECT *, nullif(trim(regexp_replace(text, '\\s+', ' ', 'g')), '') AS t, 'u/' || conv_id AS url FROM conversations) SELECT conv_id, turn, t AS reply_text_clean, " + _case("(conv_id + turn)", _AUTHOR) + " AS reply_author_type_clean, turn AS reply_order_numeric, CASE turn % 3 WHEN 0 THEN TIMESTAMP '2025-08-05 09:58:00' WHEN 1 THEN date_trunc('day', CASE conv_id % 2 WHEN 0 THEN TIMESTAMP '2025-09-01 12:00:00' END)::TIMESTAMP END AS reply_date, sha256(url || '|' || turn || '|' || coalesce(trim(regexp_replace(lower(t), '[^\\p{L}\\p{N}]+', ' ', 'g')), '')) AS reply_id FROM r")
def prepared_replies(s, d):
    """Conversations as replies; of every second one the complaint is unknown, so that its relative dates can't be read."""
    c = table(s, d, "conversations")
    url = F.concat(F.lit("u/"), F.col("conv_id").cast("string")).alias("canonical_complaint_url")
    known = c.filter("conv_id % 2 = 0").select(url).distinct().withColumn("collected_at_parsed", F.lit("2025-09-01 12:00:00").cast("timestamp"))
    raw = c.select("conv_id", "turn", url, F.col("turn").cast("string").alias("reply_order"), F.col("text").alias("reply_text"), _pick(F.col("conv_id") + F.col("turn"), ["Firma", " brand ", "Müşteri", "user", "robot", None]).alias("reply_author_type"), _pick(F.col("turn"), ["5 Ağustos 2025 09:58", "bugün", "?"]).alias("reply_date_raw"))
    out = composites.prepared_replies(raw, known)
    return out.select("conv_id", "turn", "reply_text_clean", "reply_author_type_clean", "reply_order_numeric", F.col("reply_date").cast("timestamp_ntz").alias("reply_date"), "reply_id")


def _reviews(s: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    number = lambda n: F.floor(k / n).cast("string")
    return table(s, d, "events").select(
        "event_id",
        F.col("user_id").alias("hotel_id"),
        _pick(k, [None, F.concat(F.lit("n"), number(10)), F.concat(F.lit("e"), k.cast("string")), F.concat(F.lit("e"), k.cast("string")), " "]).alias("review_id"),
        _pick(k, ["1", "2", "3", "4.0", "5", "9", "x", "2.5", None]).alias("review_rating"),
        _pick(k, ["", " call +90 532 123 45 67 ", "mail a@b.co", F.col("props")]).alias("review_text"),
        _pick(k, ["3 gün önce", "bir hafta önce düzenlendi", None, "dün", "Google üzerinde 2 ay önce", "5 saat önce"]).alias("review_date_raw"),
        F.col("ts").cast("timestamp").alias("collected_at"),
        F.lit("somebody").alias("reviewer_name_raw"),
    )


_REVIEWS = (
    "WITH r AS (SELECT event_id, user_id AS hotel_id, " + _case("event_id", ["NULL", "'n' || (event_id // 10)", "'e' || event_id", "'e' || event_id", "NULL"]) + " AS rid, " + _case("event_id", ["1", "2", "3", "4", "5", "NULL", "NULL", "NULL", "NULL"]) + " AS rating, event_id % 9 = 5 AS invalid, "
    + _case("event_id", ["''", "'call +90 532 123 45 67'", "'mail a@b.co'", "trim(regexp_replace(coalesce(props, ''), '\\s+', ' ', 'g'))"]) + " AS t, event_id % 4 IN (1, 2) AS pii, "
    + _case("event_id", ["'3 gün önce'", "'bir hafta önce düzenlendi'", "NULL", "'dün'", "'Google üzerinde 2 ay önce'", "'5 saat önce'"]) + " AS raw, "
    "CASE event_id % 6 WHEN 0 THEN date_trunc('day', ts)::TIMESTAMP - INTERVAL 3 DAY WHEN 1 THEN date_trunc('day', ts)::TIMESTAMP - INTERVAL 7 DAY WHEN 4 THEN date_trunc('day', ts)::TIMESTAMP - INTERVAL 60 DAY WHEN 5 THEN date_trunc('day', ts - INTERVAL 5 HOUR)::TIMESTAMP END AS moment, "
    + _case("event_id", ["'RELATIVE_PARSED'", "'RELATIVE_PARSED'", "'MISSING'", "'UNRECOGNIZED'", "'RELATIVE_PARSED'", "'RELATIVE_PARSED'"]) + " AS status FROM events), "
    "i AS (SELECT *, coalesce(rid, 'gma_' || left(sha256(hotel_id || chr(1) || coalesce(rating::VARCHAR, '') || chr(1) || coalesce(raw, '') || chr(1) || lower(t)), 24)) AS review_id FROM r), "
    "f AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY event_id) = 1) "
)


@query("dq21_cleaned_reviews", _REVIEWS + "SELECT event_id, review_id, rating AS review_rating, CASE WHEN rating <= 2 THEN 'LOW' WHEN rating = 3 THEN 'MIXED' WHEN rating >= 4 THEN 'HIGH' END AS rating_group, t AS review_text_clean, rating IS NOT NULL AND t = '' AS is_rating_only, pii AS potential_pii_flag, len(regexp_extract_all(t, '\\S+')) AS review_word_count, moment AS review_date, event_id % 6 = 1 AS review_is_edited, status AS review_date_parse_status FROM f")
def cleaned_reviews(s, d):
    clean_rows, _ = composites.cleaned_reviews(_reviews(s, d), "event_id")
    return clean_rows.select("event_id", "review_id", "review_rating", "rating_group", "review_text_clean", "is_rating_only", "potential_pii_flag", F.col("review_word_count").cast("long").alias("review_word_count"), F.col("review_date").cast("timestamp_ntz").alias("review_date"), "review_is_edited", "review_date_parse_status")


@query("dq21_review_audit", _REVIEWS + "SELECT (SELECT count(*) FROM i) AS input_row_n, count(*) AS clean_row_n, (SELECT count(*) FROM i) - count(*) AS exact_duplicate_n, (SELECT count(*) FILTER (invalid) FROM i) AS invalid_rating_n, count(*) FILTER (rating IS NOT NULL AND t = '') AS rating_only_n, count(*) FILTER (t <> '') AS text_review_n, count(*) FILTER (pii) AS potential_pii_n, count(moment) AS date_parsed_n FROM f")
def review_audit(s, d):
    return composites.cleaned_reviews(_reviews(s, d), "event_id")[1]


AIR = f"WITH {MON}, c AS (SELECT period, a, b, total, sum(a) OVER w + CASE WHEN month = 5 THEN 1 ELSE 0 END AS ca, sum(b) OVER w AS cb, sum(total) OVER w AS ct, CASE WHEN month <> 7 THEN 100.0 * b / total END AS pct FROM mon WINDOW w AS (ORDER BY period)), x AS (SELECT *, ca - coalesce(lag(ca) OVER o, 0) AS da, cb - coalesce(lag(cb) OVER o, 0) AS db, ct - coalesce(lag(ct) OVER o, 0) AS dt, pct - 100.0 * b / nullif(total, 0) AS dp FROM c WINDOW o AS (ORDER BY period)) "


def _air(s: SparkSession, d: str) -> DataFrame:
    """Months with running sums, of which one is off by one each May, and a share that is missing each July."""
    w = Window.orderBy("period")
    m = monthly(s, d)
    off = F.when(F.col("month") == 5, 1).otherwise(0)
    return m.select("period", "a", "b", "total", (F.sum("a").over(w) + off).alias("ca"), F.sum("b").over(w).alias("cb"), F.sum("total").over(w).alias("ct"), F.when(F.col("month") != 7, 100 * F.col("b") / F.col("total")).alias("pct"))


PERIOD = {"period": "period", "parts": ("a", "b"), "total": "total", "running": {"a": "ca", "b": "cb", "total": "ct"}, "share": ("b", "pct")}


@query("ts01_audit", AIR + "SELECT 'row_count' AS \"check\", count(*) AS value, CASE WHEN count(*) = 80 THEN 'PASS' ELSE 'FAIL' END AS status FROM x UNION ALL SELECT 'unique_period', count(DISTINCT period), CASE WHEN count(DISTINCT period) = count(*) THEN 'PASS' ELSE 'FAIL' END FROM x UNION ALL SELECT 'missing_cells', count(*) FILTER (pct IS NULL), CASE WHEN count(*) FILTER (pct IS NULL) = 0 THEN 'PASS' ELSE 'REVIEW' END FROM x UNION ALL SELECT 'negative_values', 0, 'PASS' UNION ALL " + " UNION ALL ".join(f"SELECT '{n}', count(*) FILTER ({c}), CASE WHEN count(*) FILTER ({c}) = 0 THEN 'PASS' ELSE 'FAIL' END FROM x" for n, c in (("total_mismatch_rows", "a + b <> total"), ("running_a_mismatch_rows", "da <> a"), ("running_b_mismatch_rows", "db <> b"), ("running_total_mismatch_rows", "dt <> total"))) + " UNION ALL SELECT 'sum_minus_last_running', (sum(total) - max_by(ct, period))::BIGINT, CASE WHEN sum(total) = max_by(ct, period) THEN 'PASS' ELSE 'FAIL' END FROM x")
def audit(s, d):
    return periods.audited(_air(s, d), expected=80, **PERIOD)


@query("ts01_wn13_reconciled", AIR + "SELECT period, (a + b - total)::BIGINT AS total_difference, (da - a)::BIGINT AS difference_a, (db - b)::BIGINT AS difference_b, (dt - total)::BIGINT AS difference_total, round(dp, 6) AS share_difference_pp FROM x")
def reconciled(s, d):
    return periods.reconciled(_air(s, d), **PERIOD).select("period", "total_difference", "difference_a", "difference_b", "difference_total", r6(F.col("share_difference_pp")).alias("share_difference_pp"))


COMPONENTS = {"q": ("rating", False), "p1": ("intensity", False), "p2": ("reviews", False), "l1": ("star_share", False), "l2": ("star_n", False), "l3": ("price", False), "v2": ("price", True), "s1": ("n", False), "s2": ("reviews", False), "s3": ("spread", False)}
INDICES = {"quality": ({"q": 1.0}, 1), "popularity": ({"p1": 0.5, "p2": 0.5}, 2), "luxury": ({"l1": 0.4, "l2": 0.3, "l3": 0.3}, 2), "value": ({"q": 0.5, "v2": 0.5}, 2), "supply": ({"s1": 1 / 3, "s2": 1 / 3, "s3": 1 / 3}, 2)}
_MM = "100.0 * ({0} - min({0}) OVER ()) / (max({0}) OVER () - min({0}) OVER ())"
SUB = (
    E + ", g AS (SELECT grp, avg(rating) AS rating, sum(reviews)::DOUBLE / count(*) AS intensity, sum(reviews)::DOUBLE AS reviews, avg((segment = 'BUILDING')::INT) AS star_share, (count(*) FILTER (segment = 'BUILDING'))::DOUBLE AS star_n, CASE WHEN count(*) % 3 > 0 THEN quantile_cont(price, 0.5) END AS price, count(*)::DOUBLE AS n, CASE WHEN count(*) % 2 = 0 THEN max(rating) - min(rating) END AS spread FROM ent GROUP BY 1), "
    "m AS (SELECT grp, n, " + ", ".join(f"{'100 - ' if t else ''}{_MM.format(c)} AS {k}" for k, (c, t) in COMPONENTS.items()) + " FROM g), "
    "i AS (SELECT grp, n, q AS quality, 0.5 * p1 + 0.5 * p2 AS popularity, (0.4 * l1 + 0.3 * l2 + coalesce(0.3 * l3, 0)) / (0.7 + CASE WHEN l3 IS NULL THEN 0 ELSE 0.3 END) AS luxury, 0.5 * q + 0.5 * v2 AS value_index, (s1 + s2 + coalesce(s3, 0)) / (2 + CASE WHEN s3 IS NULL THEN 0 ELSE 1 END) AS supply, n % 4 > 0 AS eligible FROM m) "
)


@query("wn04_wn08_indices", SUB + "SELECT grp, " + ", ".join(f"round({c}, 4) AS {c}" for c in ("quality", "popularity", "luxury", "value_index", "supply")) + ", CASE WHEN eligible THEN rank() OVER (PARTITION BY eligible ORDER BY luxury DESC) END AS luxury_rank FROM i")
def indices(s, d):
    """Five indices over groups, of which some lack a component, and the rank by one of them among groups that are large enough to count."""
    n, star = F.count(F.lit(1)), F.col("segment") == "BUILDING"
    g = entities(s, d).groupBy("grp").agg(F.avg("rating").alias("rating"), (F.sum("reviews") / n).alias("intensity"), F.sum("reviews").cast("double").alias("reviews"), F.avg(star.cast("int")).alias("star_share"), F.count_if(star).cast("double").alias("star_n"), F.when(n % 3 > 0, F.percentile("price", F.lit(0.5))).alias("price"), n.cast("double").alias("n"), F.when(n % 2 == 0, F.max("rating") - F.min("rating")).alias("spread"))
    out = within.indices(g, COMPONENTS, INDICES).withColumn("luxury_rank", within.masked_rank("luxury", F.col("n") % 4 > 0))
    return out.select("grp", *(F.round(c, 4).alias("value_index" if c == "value" else c) for c in INDICES), "luxury_rank")


_DQ = "(SELECT c_custkey, CASE WHEN c_custkey % 7 > 0 THEN c_name END AS c_name, c_nationkey, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END AS c_acctbal, c_mktsegment FROM customer UNION ALL SELECT * FROM customer WHERE c_custkey % 10 = 1)"


@query(
    "dq05_quality_score",
    f"WITH t AS {_DQ}, a AS (SELECT 100 * (avg((c_custkey IS NOT NULL)::INT) + avg((c_name IS NOT NULL)::INT) + avg((c_nationkey IS NOT NULL)::INT) + avg((c_acctbal IS NOT NULL)::INT) + avg((c_mktsegment IS NOT NULL)::INT)) / 5 AS c, 100 * (avg(coalesce(c_acctbal >= 0, TRUE)::INT) + avg((c_nationkey BETWEEN 0 AND 24)::INT)) / 2 AS v, 100 * (avg((length(c_mktsegment) <= 9)::INT) + avg(coalesce(starts_with(c_name, 'Customer'), FALSE)::INT)) / 2 AS k, 100 * avg((c_name IS NOT NULL AND c_acctbal IS NOT NULL)::INT) AS s, (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) / count(*) AS u0 FROM t), "
    "u AS (SELECT (SELECT sum(n) FILTER (n = 1) / sum(n) FROM (SELECT count(*) AS n FROM t GROUP BY c_custkey)) AS u1, (SELECT sum(n) FILTER (n = 1) / sum(n) FROM (SELECT count(*) AS n FROM t GROUP BY c_name)) AS u2), "
    "l AS (SELECT c, 100 * (u0 + u1 + u2) / 3 AS u, v, k, s, 0.3 * c + 0.2 * (100 * (u0 + u1 + u2) / 3) + 0.25 * v + 0.15 * k + 0.1 * s AS total FROM a, u) "
    "SELECT dimension, round(score, 6) AS score, weight, round(score * weight, 6) AS weighted, label FROM (SELECT 'Completeness' AS dimension, c AS score, 0.3 AS weight, NULL AS label FROM l UNION ALL SELECT 'Uniqueness', u, 0.2, NULL FROM l UNION ALL SELECT 'Validity', v, 0.25, NULL FROM l UNION ALL SELECT 'Consistency', k, 0.15, NULL FROM l UNION ALL SELECT 'Source coverage', s, 0.1, NULL FROM l UNION ALL SELECT 'TOTAL', total, 1.0, CASE WHEN total >= 90 THEN 'Excellent' WHEN total >= 80 THEN 'Good' WHEN total >= 70 THEN 'Acceptable' WHEN total >= 60 THEN 'Needs Improvement' ELSE 'Poor' END FROM l)",
)
def quality_score(s, d):
    """Customers, some without a name or balance and some twice, by five dimensions."""
    c = table(s, d, "customer")
    part = c.withColumns({"c_name": F.when(F.col("c_custkey") % 7 > 0, F.col("c_name")), "c_acctbal": F.when(F.col("c_custkey") % 5 > 0, F.col("c_acctbal"))})
    t = part.unionByName(c.filter("c_custkey % 10 = 1"))
    valid = [F.col("c_acctbal").isNull() | (F.col("c_acctbal") >= 0), F.col("c_nationkey").between(0, 24)]
    out = checks.quality_score(t, [F.col("c_custkey"), F.col("c_name")], valid, [F.length("c_mktsegment") <= 9, F.col("c_name").startswith("Customer")], [F.col("c_name").isNotNull() & F.col("c_acctbal").isNotNull()])
    return out.select("dimension", r6(F.col("score")).alias("score"), "weight", r6(F.col("weighted")).alias("weighted"), "label")


#: Twice the area under the normal, or Student's, curve from 0 to z by Simpson's rule.
_NORMAL = "(SELECT 1 - 2 * sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-power(z * i / 2000, 2) / 2)) * any_value(z) / 6000 / sqrt(2 * pi()) FROM z, range(0, 2001) t(i))"
_STUDENT = "(SELECT 1 - 2 * exp(any_value(lgamma((v + 1) / 2) - lgamma(v / 2))) / sqrt(any_value(v) * pi()) * sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * power(1 + power(z * i / 2000, 2) / v, -(v + 1) / 2)) * any_value(z) / 6000 FROM z, range(0, 2001) t(i))"


@query("st01_pearson_p", E + ", c AS (SELECT corr(rating, price) AS r, count(price)::DOUBLE AS n FROM ent), z AS (SELECT abs(r) * sqrt((n - 2) / (1 - r * r)) AS z, n - 2 AS v FROM c) SELECT round(r, 6) AS r, n::BIGINT AS n, round(" + _STUDENT + ", 6) AS p FROM c")
def pearson(s, d):
    return stats.pearson_test(entities(s, d), "rating", "price").select(r6(F.col("r")).alias("r"), "n", r6(F.col("p")).alias("p"))


RANKED = E + ", r AS (SELECT rank() OVER (ORDER BY reviews) + (count(*) OVER (PARTITION BY reviews) - 1) / 2.0 AS x, rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0 AS y FROM ent WHERE price IS NOT NULL), "


@query("st01_spearman_p", RANKED + "c AS (SELECT corr(x, y) AS r, count(*)::DOUBLE AS n FROM r), z AS (SELECT abs(r) * sqrt((n - 2) / (1 - r * r)) AS z, n - 2 AS v FROM c) SELECT round(r, 6) AS rho, n::BIGINT AS n, round(" + _STUDENT + ", 6) AS p FROM c")
def spearman(s, d):
    return stats.spearman(entities(s, d), "reviews", "price").select(r6(F.col("rho")).alias("rho"), "n", r6(F.col("p")).alias("p"))


@query("st03_kruskal", E + ", r AS (SELECT segment, rating, rank() OVER (ORDER BY rating) + (count(*) OVER (PARTITION BY rating) - 1) / 2.0 AS k FROM ent), t AS (SELECT sum(c * c * c - c) AS t FROM (SELECT count(*)::DOUBLE AS c FROM r GROUP BY rating)), g AS (SELECT sum(s * s / m) AS q, sum(m)::DOUBLE AS n, count(*) AS groups FROM (SELECT sum(k) AS s, count(*) AS m FROM r GROUP BY segment)), h AS (SELECT groups, n, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n * n * n - n)) AS h FROM g, t) SELECT groups, n, round(h, 4) AS h, round(exp(-h / 2) * (1 + h / 2), 6) AS p, round(h / ((n * n - 1) / (n + 1)), 6) AS epsilon2 FROM h")
def kruskal(s, d):
    """Five segments, for which the tail of chi-squared has a closed form."""
    return stats.kruskal(entities(s, d), "segment", "rating").select("groups", F.col("n").cast("double").alias("n"), F.round("h", 4).alias("h"), r6(F.col("p")).alias("p"), r6(F.col("epsilon2")).alias("epsilon2"))


@query("st04_mann_whitney", E + ", r AS (SELECT segment, rating, rank() OVER (ORDER BY rating) + (count(*) OVER (PARTITION BY rating) - 1) / 2.0 AS k FROM ent WHERE segment IN ('BUILDING', 'MACHINERY')), t AS (SELECT sum(c * c * c - c) AS t FROM (SELECT count(*)::DOUBLE AS c FROM r GROUP BY rating)), u AS (SELECT (count(*) FILTER (segment = 'BUILDING'))::DOUBLE AS a, (count(*) FILTER (segment <> 'BUILDING'))::DOUBLE AS b, sum(k) FILTER (segment = 'BUILDING') AS s FROM r), z AS (SELECT a, b, s - a * (a + 1) / 2 AS u, greatest(abs(s - a * (a + 1) / 2 - a * b / 2) - 0.5, 0) / sqrt(a * b / 12 * ((a + b + 1) - t / ((a + b) * (a + b - 1)))) AS z FROM u, t) SELECT a::BIGINT AS n_a, b::BIGINT AS n_b, u, round(" + _NORMAL + ", 6) AS p FROM z")
def mann_whitney(s, d):
    return stats.mann_whitney(entities(s, d), "segment", "rating", "BUILDING", "MACHINERY").withColumn("p", r6(F.col("p")))


GENERIC = ("hotel", "supplier", "spa")
_PAGES = "m AS (SELECT s_suppkey AS id, s_name || ' Bay' AS name, CASE s_suppkey % 3 WHEN 0 THEN 'https://h/' || lower(replace(s_name, '#', '-')) || '-bay/' WHEN 1 THEN 'https://h/chain-' || (s_suppkey // 6) ELSE 'https://h/other' || s_suppkey || 'zzzzzzzzzzzzzzzzzzzz' END AS url FROM supplier)"


def _pages(s: SparkSession, d: str) -> DataFrame:
    k, name = F.col("s_suppkey"), F.col("s_name")
    own = F.concat(F.lit("https://h/"), F.lower(F.replace(name, F.lit("#"), F.lit("-"))), F.lit("-bay/"))
    other = F.concat(F.lit("https://h/other"), k.cast("string"), F.lit("zzzzzzzzzzzzzzzzzzzz"))
    return table(s, d, "supplier").select(k.alias("id"), F.concat(name, F.lit(" Bay")).alias("name"), _pick(k, [own, F.concat(F.lit("https://h/chain-"), F.floor(k / 6).cast("string")), other]).alias("url"))


@query("er10_validation_terms", f"WITH {_PAGES} SELECT a.id, a.name || '|' || replace(lower(replace(a.name, '#', ' ')), 'supplier ', '') AS wanted, coalesce(string_agg(b.name, '|' ORDER BY b.id) FILTER (b.id <> a.id), '') AS excluded, split_part(replace(lower(replace(a.name, '#', ' ')), 'supplier ', ''), ' ', 1) AS doubtful, a.id % 3 > 0 AS requires_validation FROM m a JOIN m b ON b.url = a.url GROUP BY a.id, a.name")
def validation_terms(s, d):
    """Every third entity has a page named like it, every third shares one, and the others' pages are named otherwise."""
    t = resolve.validation_terms(_pages(s, d), GENERIC)
    return t.select("id", *(F.array_join(c, "|").alias(c) for c in ("wanted", "excluded", "doubtful")), "requires_validation")


@query("tx34_tx35_entity_match", f"WITH {_PAGES}, e AS (SELECT url, min(id) AS first_id, max(id) AS last_id FROM m GROUP BY 1), x AS (SELECT l_orderkey, l_linenumber, id, m.name, m.url, last_id, first_id, l_linenumber % 4 AS k FROM lineitem JOIN m ON id = l_suppkey JOIN e ON e.url = m.url), h AS (SELECT *, CASE k WHEN 0 THEN name WHEN 1 THEN 'Supplier#' || lpad(last_id::VARCHAR, 9, '0') || ' Bay' WHEN 2 THEN lpad(id::VARCHAR, 9, '0') ELSE NULL END AS term FROM x) SELECT l_orderkey, l_linenumber, CASE WHEN id % 3 = 0 THEN 'MATCHED' WHEN k = 1 AND last_id <> id THEN 'EXCLUDED' WHEN k IN (0, 1) THEN 'MATCHED' ELSE 'REVIEW_REQUIRED' END AS status, CASE WHEN id % 3 > 0 THEN term END AS term FROM h")
def entity_match(s, d):
    """Line items as documents on their supplier's page that name it, or the last entity of the page, or its first brand word alone, or nobody."""
    t = resolve.validation_terms(_pages(s, d), GENERIC)
    last = F.max_by("name", "id").over(Window.partitionBy("url"))
    t = t.withColumns({"last": last, "l_suppkey": F.col("id")})
    said = _pick(F.col("l_linenumber"), [F.concat(F.lit("We stayed at "), F.upper("name"), F.lit(".")), F.concat(F.lit("unlike "), F.col("last"), F.lit("!")), F.concat(F.lit("the "), F.element_at("doubtful", 1), F.lit(" one")), "nothing said"])
    j = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(t, "l_suppkey")
    m = j.select("l_orderkey", "l_linenumber", resolve.entity_match(said, F.col("requires_validation"), F.col("wanted"), F.col("excluded"), F.col("doubtful")).alias("m"))
    return m.select("l_orderkey", "l_linenumber", "m.*")


def _projects(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Parts and suppliers as (id, name, phone, area)."""
    key = F.col("s_suppkey")
    words = _pick(key, ["Small", "Old", "Hot", "Cold", "Blue", "Green", "Large", "New"]), _pick(F.floor(key / 8), ["Widget", "Gear", "Bolt", "Plate", "Ring", "Anvil", "Valve"])
    nation = F.broadcast(table(s, d, "nation").select("n_nationkey", "n_name"))
    official = table(s, d, "supplier").join(nation, F.col("n_nationkey") == F.col("s_nationkey"))
    phone = lambda c, n: F.lpad((c % n).cast("string"), 7, "0").alias("phone")
    right = official.select(key.alias("id"), F.concat_ws(" ", *words, "n_name").alias("name"), phone(key, 1013), F.concat(F.lit("Brand#"), (key % 25).cast("string")).alias("area"))
    left = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", F.initcap("p_type"), "p_name").alias("name"), phone(F.col("p_partkey"), 10_007), F.col("p_brand").alias("area"))
    return left, right


@query("jn16_er01_er03_matches")
def matches(s, d):
    """Every part as a project (type and name) against every supplier as an official row, whose names are written in the parts' words; every pair of similarity 0.55 or more counts and the best is taken for each (pairs are scored by names and areas, and by phones), and those without any are kept. String similarity has no SQL; a test holds it against all pairs."""
    left, right = _projects(s, d)
    phone, area = F.col("phone_l") == F.col("phone_r"), F.col("area_l") == F.col("area_r")

    def scored(c: DataFrame) -> DataFrame:
        c = c.withColumn("score", resolve.match_score(F.col("name_similarity"), phone, area, F.lit(None).cast("double")))
        return c.withColumn("status", resolve.match_class(F.col("score"), F.col("name_similarity"), phone, area))

    return resolve.assigned_once(resolve.best_of_candidates(left, right, scored), "id_r", "score", "id_l")


CROSSWALK = [("MOVE", ["motion", "place"], ["motion"]), ("WORDS", ["article", "joiner"], ["joiner", "short"]), ("PLACE", ["place"], []), ("SHORT", [], ["short"]), ("JOIN", ["joiner"], ["article"])]
_CROSS = "(VALUES " + ", ".join(f"('{c}', {a or '[]::VARCHAR[]'}, {b or '[]::VARCHAR[]'})" for c, a, b in CROSSWALK) + ") x(canonical, ga, sa)"


@query(
    "er13_jn19_alignment",
    AL + ", m AS (SELECT source, aspect, doc_id % 2 = 0 AS review, 100.0 * avg(matched::INT) AS mention, count(*) FILTER (matched) AS support, 100.0 * count(*) FILTER (matched AND rating_group = 'LOW') / nullif(count(*) FILTER (matched), 0) AS low, 100.0 * count(*) FILTER (matched AND rating_group = 'HIGH') / nullif(count(*) FILTER (matched), 0) AS high, count(*) AS n FROM lng GROUP BY 1, 2, 3), "
    f"s AS (SELECT DISTINCT source FROM documents), k AS (SELECT s.source, canonical, ga, sa, max(m.mention) FILTER (review AND list_contains(ga, m.aspect)) AS g, max(m.support) FILTER (review AND list_contains(ga, m.aspect)) AS gn, max(m.low) FILTER (review AND list_contains(ga, m.aspect)) AS low, max(m.high) FILTER (review AND list_contains(ga, m.aspect)) AS high, max(m.mention) FILTER (NOT review AND list_contains(sa, m.aspect)) AS c, any_value(m.n) FILTER (NOT review) AS n FROM s CROSS JOIN {_CROSS} LEFT JOIN m ON m.source IS NOT DISTINCT FROM s.source GROUP BY 1, 2, 3, 4), "
    "f AS (SELECT *, coalesce(g >= 15 AND gn >= 5, FALSE) AS said, coalesce(c >= 25 AND n >= 30, FALSE) AS theme FROM k) "
    "SELECT source, canonical, CASE WHEN len(sa) = 0 THEN CASE WHEN said THEN 'REVIEWS_ONLY' ELSE 'NO_SIGNAL' END WHEN len(ga) = 0 THEN CASE WHEN theme THEN 'COMPLAINTS_ONLY' ELSE 'NO_SIGNAL' END WHEN (g IS NOT NULL AND gn < 5) OR (c IS NOT NULL AND n < 30) THEN 'LOW_SUPPORT' WHEN said AND low >= 50 AND theme THEN 'BOTH_CONCERN' WHEN said AND high >= 70 AND theme THEN 'STRENGTH_VS_COMPLAINT' WHEN theme AND NOT said THEN 'COMPLAINTS_ONLY' WHEN said AND NOT theme THEN 'REVIEWS_ONLY' ELSE 'NO_SIGNAL' END AS label FROM f",
)
def alignment(s, d):
    """Documents of even id stand for reviews and the others for complaints; each canonical aspect takes the strongest of those that it stands for."""
    m = F.col("matched")
    rows = terms.aspect_rows(aspect_docs(s, d), list(ASPECTS), ["doc_id", "source", "rating_group"])
    of = lambda g: 100 * F.try_divide(F.count_if(m & (F.col("rating_group") == g)), F.count_if(m))
    cells = rows.groupBy("source", "aspect", (F.col("doc_id") % 2 == 0).alias("review")).agg((100 * F.avg(m.cast("int"))).alias("mention"), F.count_if(m).alias("support"), of("LOW").alias("low"), of("HIGH").alias("high"), F.count(F.lit(1)).alias("n"))
    cross = F.broadcast(s.createDataFrame(CROSSWALK, "canonical string, ga array<string>, sa array<string>"))
    j = cells.crossJoin(cross)
    g, c = F.col("review") & F.array_contains("ga", F.col("aspect")), ~F.col("review") & F.array_contains("sa", F.col("aspect"))
    top = lambda flag, x: F.max(F.when(flag, F.col(x)))
    k = j.groupBy("source", "canonical", "ga", "sa").agg(top(g, "mention").alias("g"), top(g, "support").alias("gn"), top(g, "low").alias("low"), top(g, "high").alias("high"), top(c, "mention").alias("c"), top(~F.col("review"), "n").alias("n"))
    label = resolve.alignment_label({"mention": F.col("g"), "support": F.col("gn"), "low": F.col("low"), "high": F.col("high")}, {"mention": F.col("c"), "small": F.col("n") < 30}, F.size("ga") > 0, F.size("sa") > 0)
    return k.select("source", "canonical", label.alias("label"))


@query("tk08_stratified_sample", E + ", r AS (SELECT entity_id, segment, sha256(entity_id::VARCHAR) AS h, row_number() OVER (PARTITION BY segment ORDER BY sha256(entity_id::VARCHAR), entity_id) AS rn FROM ent) SELECT entity_id, segment, rn <= 7 AS from_stratum FROM r ORDER BY rn > 7, h, entity_id LIMIT 100")
def stratified_sample(s, d):
    """Seven of each segment in the order of a digest, filled up to a hundred from the rest."""
    h = F.sha2(F.col("entity_id").cast("string"), 256)
    r = entities(s, d).select("entity_id", "segment", h.alias("h")).withColumn("rn", F.row_number().over(Window.partitionBy("segment").orderBy("h", "entity_id")))
    return r.orderBy(F.col("rn") > 7, "h", "entity_id").limit(100).select("entity_id", "segment", (F.col("rn") <= 7).alias("from_stratum"))


@query("tk09_validation_sample", AL + ", n AS (SELECT doc_id, sum(matched::INT) AS k FROM lng GROUP BY 1), st AS (SELECT doc_id, 1 AS stage FROM (SELECT aspect, min(doc_id) AS doc_id FROM lng WHERE matched GROUP BY 1) UNION ALL SELECT doc_id, 2 FROM n WHERE k = 0 UNION ALL SELECT doc_id, 3 FROM n WHERE k >= 4) SELECT doc_id, min(stage) AS stage FROM st GROUP BY 1 ORDER BY stage, doc_id LIMIT 40")
def validation_sample(s, d):
    """A reviewer's sample of 40: the first of each aspect, then documents without any, then those with many. Each document is read once and gives a row for each aspect and one for the rest."""
    k = sum((F.col(a).cast("int") for a in ASPECTS), F.lit(0))
    stage = F.when(k == 0, 2).when(k >= 4, 3)
    mine = F.array(*(F.when(F.col(a), F.struct(F.lit(a).alias("aspect"), F.lit(None).cast("long").alias("own"), F.lit(1).alias("stage"))) for a in ASPECTS), F.when(stage.isNotNull(), F.struct(F.lit("").alias("aspect"), F.col("doc_id").cast("long").alias("own"), stage.alias("stage"))))
    rows = aspect_docs(s, d).select("doc_id", F.inline(F.array_compact(mine)))
    picked = rows.groupBy("aspect", "own").agg(F.min("doc_id").alias("doc_id"), F.min("stage").alias("stage"))
    return picked.groupBy("doc_id").agg(F.min("stage").alias("stage")).orderBy("stage", "doc_id").limit(40)


@query("tx31_author_type", "SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'UNKNOWN' WHEN 'user' THEN 'USER' ELSE 'UNKNOWN' END AS author, " + _case("turn", ["'COMPANY'", "'USER'", "'COMPANY'", "'UNKNOWN'"]) + " AS written FROM conversations")
def author_type(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", X.author_type(F.col("role")).alias("author"), X.author_type(_pick(F.col("turn"), [" Firma", "kullanıcı", "Marka", None])).alias("written"))
