"""Text and date expressions. Arrow functions only where Spark has no built-in: Unicode forms, HTML entities, sequence similarity."""

from __future__ import annotations

import difflib
import html
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Letters with marks and their plain forms; the dotted and dotless i are told apart before lower-casing.
MARKED, PLAIN = "çğıöşüÇĞİÖŞÜâîûäéèêëàáíóúñôß", "cgiosuCGIOSUaiuaeeeeaaiounos"
ZERO_WIDTH = "[\\u200B\\u200C\\u200D\\u2060\\uFEFF]"
EMAIL, PHONE = r"[\w.+-]+@[\w-]+\.[\w.]+", r"(?<!\d)(\+?\d[\d ()-]{8,}\d)(?!\d)"
MOJIBAKE = "Ã.|Â.|â€|\\uFFFD"


def folded(c: Column) -> Column:
    """Plain lower-case words between single blanks; NULL if none is left."""
    x = F.regexp_replace(F.lower(F.translate(c, MARKED, PLAIN)), "[^a-z0-9_]+", " ")
    return F.nullif(F.trim(x), F.lit(""))


def core_name(c: Column, drop: Sequence[str]) -> Column:
    """folded(c) without the words of drop, or all of it if nothing else is left."""
    words = F.filter(F.split(folded(c), " "), lambda w: ~w.isin(*drop))
    return F.coalesce(F.nullif(F.array_join(words, " "), F.lit("")), folded(c))


def phone_key(c: Column) -> Column:
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.length(digits) >= 7, F.right(digits, F.lit(10)))


def token_containment(a: Column, b: Column) -> Column:
    """The share of a's words that b contains."""
    words = F.filter(F.split(a, " "), lambda w: w != "")
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: F.contains(b, w))) / F.size(words))


def turkish_lower(c: Column) -> Column:
    return F.lower(F.translate(c, "İI", "iı"))


def nlp_text(c: Column) -> Column:
    """Letters and blanks only, lower-cased, links, mails and phones masked; NULL is empty."""
    x = F.regexp_replace(F.coalesce(c, F.lit("")), ZERO_WIDTH, "")
    for pattern, mask in (("https?://\\S+", " urlmask "), (EMAIL, " emailmask "), (PHONE, " phonemask ")):
        x = F.regexp_replace(x, pattern, mask)
    return F.trim(F.regexp_replace(F.regexp_replace(turkish_lower(x), "[^\\p{L}\\s]", " "), "\\s+", " "))


def masked(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, EMAIL, "[EMAIL]"), PHONE, "[PHONE]")


def minimal_clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), ZERO_WIDTH, ""), "\\s+", " "))


def duplicate_key(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]+", " ")), F.lit(""))


def tokens(c: Column, least: int = 2, stop: Sequence[str] = ()) -> Column:
    out = F.filter(F.split(c, " "), lambda w: F.length(w) >= least)
    return F.filter(out, lambda w: ~w.isin(*stop)) if stop else out


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words; an empty array for fewer."""
    count = F.size(words) - n + 1
    return F.when(count >= 1, F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def truth(c: Column) -> Column:
    x = F.lower(F.trim(c))
    return F.when(x.isin("true", "1", "yes", "y", "evet", "var"), True).when(x.isin("false", "0", "no", "n", "hayır", "yok"), False)


def count_value(c: Column) -> Column:
    """'1.234', '1,2 B', '1.2K', '1.234,5 B', '3M' as whole numbers, halves to even; NULL for what cannot be read or is negative."""
    x = F.upper(F.regexp_replace(F.trim(c), "[ \\u00A0]", ""))
    factor = F.when(x.rlike("[BK]$"), 1000.0).when(x.rlike("M$"), 1_000_000.0).otherwise(1.0)
    body = F.regexp_replace(x, "[BKM]$", "")
    scaled = F.when(F.contains(body, F.lit(",")), F.translate(body, ",.", ".")).otherwise(body)
    plain = F.when(body.rlike("^[+-]?\\d{1,3}(\\.\\d{3})+$"), F.replace(body, F.lit("."), F.lit(""))).when(body.rlike("^[+-]?\\d{1,3}(,\\d{3})+$"), F.replace(body, F.lit(","), F.lit(""))).otherwise(F.replace(body, F.lit(","), F.lit(".")))
    value = F.bround(F.when(factor != 1.0, scaled).otherwise(plain).try_cast("double") * factor, 0)
    return F.when((value >= 0) & (value < 9e18), value.cast("long"))


def stable_id(prefix: str, *parts: Column, size: int = 24) -> Column:
    """The prefix and a cut SHA-256 of the parts, NULL as empty, with blanks squeezed."""
    clean = [F.trim(F.regexp_replace(F.coalesce(p.cast("string"), F.lit("")), "\\s+", " ")) for p in parts]
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.array_join(F.array(*clean), "\u0001"), 256), 1, size))


def canonical_url(c: Column, host: str) -> Column:
    """The path alone on a fixed host, without query, fragment or trailing slash."""
    path = F.regexp_replace(F.regexp_replace(F.trim(c), "^https?://[^/]+", ""), "[?#].*$", "")
    return F.concat(F.lit(host), F.regexp_replace(path, "/+$", ""))


def slug(c: Column) -> Column:
    return F.regexp_replace(folded(c), "[ _]+", "-")


def date_pattern(c: Column) -> Column:
    """Which form a written date has."""
    x = F.lower(F.trim(c))
    rules = [("^\\d{4}-\\d{2}-\\d{2}$", "ISO"), ("^\\d{1,2} \\p{L}+ \\d{4}( \\d{2}:\\d{2})?$", "DAY_MONTH_YEAR"), ("^\\d{1,2} \\p{L}+( \\d{2}:\\d{2})?$", "DAY_MONTH"), ("^\\S+ (gün|hafta|ay|yıl|day|week|month|year)s? (önce|ago).*$", "RELATIVE"), ("^(bugün|today).*$", "TODAY"), ("^(dün|yesterday).*$", "YESTERDAY")]
    out = F.lit("UNRECOGNIZED")
    for pattern, label in reversed(rules):
        out = F.when(x.rlike(pattern), label).otherwise(out)
    return F.when(c.isNotNull(), out)


#: Month names by number.
MONTHS = {"ocak": 1, "şubat": 2, "mart": 3, "nisan": 4, "mayıs": 5, "haziran": 6, "temmuz": 7, "ağustos": 8, "eylül": 9, "ekim": 10, "kasım": 11, "aralık": 12}


def written_date(c: Column, now: Column) -> Column:
    """Day, month name, year and time, each of the last two optional, as struct (at, approximate). A year left out is that of now, or the one before if that lies over a day ahead; impossible dates are NULL."""
    x = turkish_lower(F.trim(c))
    part = lambda i: F.nullif(F.regexp_extract(x, "^(\\d{1,2}) (\\p{L}+)(?: (\\d{4}))?(?: (\\d{2}):(\\d{2}))?$", i), F.lit("")).try_cast("int") if i != 2 else F.regexp_extract(x, "^(\\d{1,2}) (\\p{L}+)(?: (\\d{4}))?(?: (\\d{2}):(\\d{2}))?$", 2)
    month = F.element_at(F.create_map(*(F.lit(v) for k, n in MONTHS.items() for v in (k, n))), part(2))
    make = lambda year: F.try_make_timestamp(year, month, part(1), F.coalesce(part(4), F.lit(0)), F.coalesce(part(5), F.lit(0)), F.lit(0))
    guess = make(F.year(now))
    at = F.when(part(3).isNotNull(), make(part(3))).when(guess > now + F.expr("interval 1 day"), make(F.year(now) - 1)).otherwise(guess)
    return F.struct(at.alias("at"), part(3).isNull().alias("approximate"))


def relative_date(c: Column, now: Column) -> Column:
    """'2 hafta önce', 'bir ay önce' and the like: midnight so many days of 1, 7, 30 or 365 ago."""
    x = turkish_lower(F.trim(c))
    amount = F.when(F.regexp_extract(x, "^(\\S+) ", 1) == "bir", 1).otherwise(F.nullif(F.regexp_extract(x, "^(\\d+) ", 1), F.lit("")).try_cast("int"))
    unit = F.element_at(F.create_map(*(F.lit(v) for k, n in (("gün", 1), ("hafta", 7), ("ay", 30), ("yıl", 365)) for v in (k, n))), F.regexp_extract(x, "^\\S+ (gün|hafta|ay|yıl) önce", 1))
    return F.date_sub(now.cast("date"), amount * unit).cast("timestamp")


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The Ratcliff/Obershelp ratio of two strings; 0 where one is missing."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(StringType())
def unescaped(c: pd.Series) -> pd.Series:
    """HTML entities resolved and characters in compatibility form (NFKC). ASCII without entities is that already."""
    return c.map(lambda x: x if x is None or (x.isascii() and "&" not in x) else unicodedata.normalize("NFKC", html.unescape(x)))


def raw_clean(c: Column) -> Column:
    """unescaped, tags as blanks, without zero-width and control characters, blanks squeezed; NULL if nothing is left."""
    x = F.regexp_replace(F.regexp_replace(unescaped(c), ZERO_WIDTH, ""), "<[^>]+>", " ")
    x = F.regexp_replace(x, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", "")
    return F.nullif(F.trim(F.regexp_replace(x, "[\\s\\u00A0]+", " ")), F.lit(""))


def star_rating(c: Column) -> Column:
    """'N/5' with ',' or '.' decimals as whole stars, halves to even; NULL outside 1 to 5."""
    value = F.bround(F.replace(F.nullif(F.regexp_extract(F.trim(c), "^(\\d+(?:[.,]\\d+)?)\\s*/\\s*5$", 1), F.lit("")), F.lit(","), F.lit(".")).try_cast("double"), 0)
    return F.when(value.between(1, 5), value.cast("int"))


#: Written months between a day and an optional year and time.
_DISPLAY = "^(\\d{1,2})\\s+(" + "|".join(MONTHS) + ")(?:\\s+(\\d{4}))?(?:\\s+(\\d{1,2}):(\\d{2}))?$"


def display_date(c: Column, reference: Column) -> Column:
    """A written or relative date as struct (at, approximate, pattern).

    Patterns: MISSING, DAY_MONTH_YEAR_TIME, DAY_MONTH_TIME_NO_YEAR, RELATIVE_TODAY, RELATIVE_YESTERDAY,
    RELATIVE_DAYS_AGO, INVALID_CALENDAR_DATE, UNRECOGNIZED. A year left out is the reference's, or the one before if that
    would lie more than a day ahead; relative dates count back from the reference's midnight.
    """
    x = turkish_lower(F.trim(c))
    part = lambda i: F.nullif(F.regexp_extract(x, _DISPLAY, i), F.lit(""))
    number = lambda i: part(i).try_cast("int")
    written, yearless = x.rlike(_DISPLAY), part(3).isNull()
    month = F.element_at(F.create_map(*(F.lit(v) for k, n in MONTHS.items() for v in (k, n))), part(2))
    make = lambda year: F.try_make_timestamp(year, month, number(1), F.coalesce(number(4), F.lit(0)), F.coalesce(number(5), F.lit(0)), F.lit(0))
    now = make(F.year(reference))
    at = F.when(~yearless, make(number(3))).when(now > reference + F.expr("interval 1 day"), make(F.year(reference) - 1)).otherwise(now)
    time = "(?:\\s+(\\d{1,2}):(\\d{2}))?$"
    midnight = F.date_trunc("day", reference)
    clock = lambda word: F.make_dt_interval(F.lit(0), *(F.coalesce(F.nullif(F.regexp_extract(x, f"^{word}{time}", i), F.lit("")).try_cast("int"), F.lit(0)) for i in (1, 2)))
    ago = F.regexp_extract(x, "^(\\d+)\\s+gün\\s+önce$", 1).try_cast("int")
    pattern = (
        F.when(F.coalesce(x, F.lit("")) == "", "MISSING")
        .when(written & at.isNull(), "INVALID_CALENDAR_DATE")
        .when(written & yearless, "DAY_MONTH_TIME_NO_YEAR")
        .when(written, "DAY_MONTH_YEAR_TIME")
        .when(x.rlike(f"^bugün{time}"), "RELATIVE_TODAY")
        .when(x.rlike(f"^dün{time}"), "RELATIVE_YESTERDAY")
        .when(ago.isNotNull(), "RELATIVE_DAYS_AGO")
        .otherwise("UNRECOGNIZED")
    )
    when = F.when(written, at).when(pattern == "RELATIVE_TODAY", midnight + clock("bugün")).when(pattern == "RELATIVE_YESTERDAY", midnight - F.expr("interval 1 day") + clock("dün"))
    when = when.when(pattern == "RELATIVE_DAYS_AGO", F.date_sub(midnight.cast("date"), ago).cast("timestamp"))
    return F.struct(when.alias("at"), F.coalesce((written & yearless) | pattern.startswith("RELATIVE"), F.lit(False)).alias("approximate"), pattern.alias("pattern"))


def display_key(c: Column, year: Column) -> Column:
    """The first day, month and time in a text as struct (year, month, day, hour, minute), which sorts; year stands for one left out. NULL without a time or a known month."""
    found = "(\\d{1,2})\\s+([\\p{L}\\p{N}_]+)(?:\\s+(\\d{4}))?\\s+(\\d{1,2}):(\\d{2})"
    part = lambda i: F.nullif(F.regexp_extract(c, found, i), F.lit(""))
    number = lambda i: part(i).try_cast("int")
    month = F.element_at(F.create_map(*(F.lit(v) for k, n in MONTHS.items() for v in (k, n))), turkish_lower(part(2)))
    key = F.struct(F.coalesce(number(3), year).alias("year"), month.alias("month"), number(1).alias("day"), number(4).alias("hour"), number(5).alias("minute"))
    return F.when(month.isNotNull(), key)


#: Days of the units of relative dates; minutes and hours are below a day.
UNITS = {"gün": 1, "hafta": 7, "ay": 30, "yıl": 365}
_RELATIVE = "(?iu)^(?:(?:Google|Tripadvisor|Trip\\.com)\\s+üzerinde\\s+)?(bir|\\d+)\\s+(dakika|saat|gün|hafta|ay|yıl)\\s+önce(\\s+düzenlendi)?\\s*$"


def review_date(c: Column, collected: Column) -> Column:
    """'3 ay önce' and the like, on a platform or edited, as struct (at, approximate, edited, status): midnight of so long before collected."""
    x = F.trim(c)
    part = lambda i: F.nullif(F.regexp_extract(x, _RELATIVE, i), F.lit(""))
    amount = F.when(F.lower(part(1)) == "bir", 1).otherwise(part(1).try_cast("int"))
    unit = F.lower(part(2))
    minutes = F.when(unit == "dakika", amount).when(unit == "saat", amount * 60).otherwise(0)
    days = F.coalesce(F.element_at(F.create_map(*(F.lit(v) for k, n in UNITS.items() for v in (k, n))), unit), F.lit(0))
    status = F.when(F.coalesce(x, F.lit("")) == "", "MISSING").when(collected.isNull(), "MISSING_REFERENCE").when(x.rlike(_RELATIVE), "RELATIVE_PARSED").otherwise("UNRECOGNIZED")
    parsed = status == "RELATIVE_PARSED"
    at = F.date_sub((collected - F.make_dt_interval(F.lit(0), F.lit(0), minutes)).cast("date"), amount * days).cast("timestamp")
    return F.struct(F.when(parsed, at).alias("at"), parsed.alias("approximate"), (parsed & part(3).isNotNull()).alias("edited"), status.alias("status"))


def author_type(c: Column) -> Column:
    """COMPANY, USER or UNKNOWN."""
    x = F.lower(F.trim(c))
    return F.when(x.isin("company", "firma", "marka", "brand"), "COMPANY").when(x.isin("user", "kullanıcı", "customer", "müşteri"), "USER").otherwise("UNKNOWN")


def _plain_letters() -> tuple[str, str]:
    """All characters whose compatibility form, without marks, is one ASCII character, and these."""
    found = [(chr(k), unicodedata.normalize("NFKD", chr(k)).encode("ascii", "ignore").decode()) for k in range(128, 0xFFFF) if not 0xD800 <= k < 0xE000]
    pairs = [(x, y) for x, y in found if len(y) == 1]
    return "".join(x for x, _ in pairs), "".join(y for _, y in pairs)


_LETTERS, _ASCII = _plain_letters()


def match_key(c: Column) -> Column:
    """Lower-case ASCII: letters without their marks, the dotless i as i, characters that have no plain form left out; '' for NULL."""
    x = F.translate(F.lower(F.coalesce(c, F.lit(""))), "ı" + _LETTERS, "i" + _ASCII)
    return F.regexp_replace(x, "[^\\x00-\\x7F]", "")


def link_slug(c: Column) -> Column:
    """match_key in words of letters and digits between hyphens; '&' is the word and."""
    x = F.regexp_replace(F.replace(match_key(c), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", "-")
    return F.regexp_replace(x, "^-+|-+$", "")


def slug_candidates(name: Column, area: Column, place: str, drop: Sequence[str], most: int = 5) -> Column:
    """Slugs a page of that name may have, the likeliest first: the whole name, without the words of drop, with the place, without '&', with the area."""
    full, near = link_slug(name), link_slug(area)
    words = F.split(full, "-")
    short = F.filter(words, lambda w: ~w.isin(*drop))
    options = [full, F.when(F.size(short) > 0, F.array_join(short, "-")), F.when(~F.array_contains(words, place), F.concat(full, F.lit(f"-{place}"))), link_slug(F.replace(name, F.lit("&"), F.lit("")))]
    options.append(F.when((near != "") & ~F.array_contains(words, near), F.concat_ws("-", full, near)))
    return F.slice(F.array_distinct(F.filter(F.array(*options), lambda x: F.coalesce(x, F.lit("")) != "")), 1, most)


def search_queries(name: Column, area: Column, place: str, site: str, most: int = 4) -> Column:
    """The name alone, with its area and with the place where it lacks them, and with the site's name."""
    lacks = lambda part: ~F.contains(F.lower(name), F.lower(part))
    options = [name, F.when((area != "") & lacks(area), F.concat_ws(" ", name, area)), F.when(lacks(F.lit(place)), F.concat_ws(" ", name, F.lit(place))), F.concat_ws(" ", name, F.lit(site))]
    return F.slice(F.array_distinct(F.array_compact(F.array(*options))), 1, most)
