"""Terms, keyword aspects and drivers over documents."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def term_table(docs: DataFrame, words: Column, n: int = 1, min_docs: int = 1) -> DataFrame:
    """term, tokens, docs, and the share of all documents in per cent. A row's terms and its distinct terms leave it in one pass; tasks add them up before one shuffle."""
    total = docs.agg(F.count(F.lit(1)).alias("__n"))
    grams = docs.select((words if n == 1 else T.ngrams(words, n)).alias("g")).select(F.posexplode(F.array("g", F.array_distinct("g"))).alias("once", "g"))
    one = grams.select("once", F.explode("g").alias("term"))
    out = one.groupBy("term").agg(F.count_if(F.col("once") == 0).alias("n_tokens"), F.count_if(F.col("once") == 1).alias("n_docs")).filter(F.col("n_docs") >= min_docs)
    return out.crossJoin(F.broadcast(total)).withColumn("doc_share_pct", 100 * F.col("n_docs") / F.col("__n")).drop("__n")


def tf_idf(docs: DataFrame, words: Column, id_col: str = "doc_id", min_df: int = 3, max_df: float = 0.9) -> DataFrame:
    """(doc, term, weight): (1 + ln tf) * (ln((1 + N) / (1 + df)) + 1), each document's weights of length one. A document is a row; ids should be unique."""
    total = docs.agg(F.count(F.lit(1)).alias("n"))
    tf = docs.select(id_col, F.explode(words).alias("term")).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(total)).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))
    raw = tf.join(df, "term").withColumn("w", (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    return raw.withColumn("weight", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))).select(id_col, "term", "weight")


#: Short words with their own endings, and words that take none.
ENDINGS = {"oda": ("da", "dan", "ya", "yı", "nın", "sı", "mız", "lar", "ları", "m", "n"), "ses": ("i", "in", "ler", "leri", "siz", "inden")}
UNINFLECTED = ("checkin", "checkout")


def keyword_form(keyword: str, letters: str = "\\p{L}", suffix: int = 10) -> str:
    """A pattern of a keyword's forms: phrases and shorter words exactly, words with own endings by these, others of four letters or more with up to suffix further letters."""
    plain = re.escape(keyword).replace("\\ ", " ")
    if keyword in ENDINGS:
        return f"{plain}({'|'.join(ENDINGS[keyword])})?"
    if " " in keyword or len(keyword) < 4 or keyword in UNINFLECTED:
        return plain
    return f"{plain}{letters}{{0,{suffix}}}"


def keyword_pattern(keywords: Sequence[str], suffix: int = 10) -> str:
    """Any of the keywords' forms between other characters than letters."""
    return "(^|[^\\p{L}])(" + "|".join(keyword_form(k, suffix=suffix) for k in keywords) + ")([^\\p{L}]|$)"


#: A run of letters, which is what keywords are compared with.
RUN = "\\p{L}+"


def keyword_table(aspects: Mapping[str, Sequence[str]], unless: Mapping[str, Mapping[str, Sequence[str]]] | None = None, suffix: int = 10) -> list[tuple[str, int, str, str, bool]]:
    """(key, most, aspect, keyword, veto): the texts that stand for keywords. A run of letters that begins with key and goes on for up to most letters is a form of it; a key of several runs is what lies between the first and the last of them. veto: the keyword does not count in a text where this one occurs."""

    def forms(k: str) -> list[tuple[str, int]]:
        if k in ENDINGS:
            return [(k + e, 0) for e in ("", *ENDINGS[k])]
        return [(k, 0 if " " in k or len(k) < 4 or k in UNINFLECTED or not k.isalpha() else suffix)]

    rows = [(key, most, a, k, False) for a, keywords in aspects.items() for k in dict.fromkeys(keywords) for key, most in forms(k)]
    return rows + [(key, most, a, k, True) for a, of in (unless or {}).items() for k, others in of.items() for o in others for key, most in forms(o)]


def keyword_rows(df: DataFrame, id_col: str, text: Column, aspects: Mapping[str, Sequence[str]], unless: Mapping[str, Mapping[str, Sequence[str]]] | None = None, suffix: int = 10) -> DataFrame:
    """(id, aspect, keyword) for each keyword of each aspect that occurs in a lower-cased text, with keyword_form's rules, in one pass whose cost does not depend on the number of keywords.

    A text is cut in runs of letters. Its distinct runs, and what lies between the first run of a phrase and its last, are looked
    up in a table of forms, under each length that a keyword with endings has. The table is broadcast if Spark finds it small, else
    joined by shuffle. Keywords begin and end with a letter. unless: as in aspect_flags. A document is a row, and ids should be
    unique; NULL texts have no keyword.
    """
    table = keyword_table(aspects, unless, suffix)
    odd = [k for k, *_ in table if not (k[:1].isalpha() and k[-1:].isalpha())]
    if odd:
        raise ValueError(f"keywords that do not begin and end with a letter: {odd}")
    letters = lambda k: re.findall(r"[^\W\d_]+", k)
    spans = sorted({len(letters(k)) for k, *_ in table} - {1})
    first = sorted({letters(k)[0] for k, *_ in table if not k.isalpha()})
    most = {n: max(m for k, m, *_ in table if len(k) == n) for n in {len(k) for k, m, *_ in table if m}}
    # A phrase is told from a run by a character before it that is no letter.
    forms = df.sparkSession.createDataFrame([(k if k.isalpha() else "\0" + k, *rest) for k, *rest in table], "key string, most int, aspect string, keyword string, veto boolean")
    runs = F.regexp_extract_all(text, F.lit(RUN), F.lit(0))
    words = F.array_distinct("runs")
    cut = df.select(F.col(id_col).alias("id"), text.alias("text"), runs.alias("runs"))
    if spans:
        begins = F.arrays_overlap("runs", F.array(*map(F.lit, first)))
        cut = cut.withColumn("gaps", F.when(begins, F.split("text", RUN, -1)))

        def phrases(n: int) -> Column:
            """What lies between a phrase's first run and the n-th from it, wherever a phrase may begin."""
            text_at = lambda i: F.concat(F.lit("\0"), *(x for k in range(n) for x in ([F.get("gaps", i + k)] if k else []) + [F.get("runs", i + k)]))
            return F.transform(F.filter(F.sequence(F.lit(0), F.size("runs") - n), lambda i: F.get("runs", i).isin(*first)), text_at)

        none = F.array().cast("array<string>")
        words = F.concat(words, *(F.when(F.col("gaps").isNotNull() & (F.size("runs") >= n), F.array_distinct(phrases(n))).otherwise(none) for n in spans))
    seen = cut.select("id", F.explode(words).alias("run")).withColumn("n", F.length("run"))
    # Each run as it is, and cut to the lengths of keywords that take endings.
    sizes = F.explode(F.array(F.struct(F.lit(None).cast("int").alias("k"), F.lit(0).alias("most")), *(F.struct(F.lit(k).alias("k"), F.lit(most[k]).alias("most")) for k in sorted(most))))
    looked = seen.select("id", "run", "n", sizes.alias("s")).filter("s.k is null or (n > s.k and n <= s.k + s.most)")
    looked = looked.select("id", F.when(F.col("s.k").isNull(), F.col("run")).otherwise(F.substring("run", F.lit(1), F.col("s.k"))).alias("key"), F.when(F.col("s.k").isNull(), 0).otherwise(F.col("n") - F.col("s.k")).alias("extra"))
    met = looked.join(forms, "key").filter("extra <= most")
    found = met.groupBy("id", "aspect", "keyword").agg(F.bool_or("veto").alias("veto"), F.bool_or(~F.col("veto")).alias("hit"))
    return found.filter("hit and not veto").select(F.col("id").alias(id_col), "aspect", "keyword")


def keyword_counts(df: DataFrame, id_col: str, text: Column, aspects: Mapping[str, Sequence[str]]) -> DataFrame:
    """(aspect, keyword, n_docs) of every keyword of a dictionary, by keyword_rows."""
    every = df.sparkSession.createDataFrame([(a, k) for a, keywords in aspects.items() for k in dict.fromkeys(keywords)], "aspect string, keyword string")
    counts = keyword_rows(df, id_col, text, aspects).groupBy("aspect", "keyword").agg(F.count(F.lit(1)).alias("n_docs"))
    return every.join(counts, ["aspect", "keyword"], "left").na.fill(0, ["n_docs"])


def by_phrase(keywords: Sequence[str]) -> list[str]:
    """Phrases of more words first, then longer ones, then as given."""
    return sorted(dict.fromkeys(keywords), key=lambda k: (-len(k.split()), -len(k)))


def keywords_found(text: Column, keywords: Sequence[str], unless: Mapping[str, Sequence[str]] | None = None) -> Column:
    """The keywords that occur, phrases first. unless: a keyword does not count in a text with one of these phrases, where it means something else."""
    found = lambda k: text.rlike(keyword_pattern([k])) & (~text.rlike(keyword_pattern(unless[k])) if unless and k in unless else F.lit(True))
    return F.array_compact(F.array(*(F.when(found(k), F.lit(k)) for k in by_phrase(keywords))))


def aspect_flags(text: Column, aspects: Mapping[str, Sequence[str]], unless: Mapping[str, Mapping[str, Sequence[str]]] | None = None) -> dict[str, Column]:
    """Whether any keyword of each aspect occurs; unless: by aspect, as in keywords_found."""

    def flag(aspect: str, keywords: Sequence[str]) -> Column:
        other = (unless or {}).get(aspect, {})
        plain = [k for k in keywords if k not in other]
        out = text.rlike(keyword_pattern(plain)) if plain else F.lit(False)
        for k in (k for k in keywords if k in other):
            out = out | (text.rlike(keyword_pattern([k])) & ~text.rlike(keyword_pattern(other[k])))
        return F.coalesce(out, F.lit(False))

    return {a: flag(a, k) for a, k in aspects.items()}


def aspect_rows(df: DataFrame, aspects: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """A row for each document and aspect, matched or not; a document's flags are computed once."""
    return df.select(*ids, F.inline(F.array(*(F.struct(F.lit(a).alias("aspect"), F.col(a).alias("matched")) for a in aspects))))


def cooccurrence(df: DataFrame, aspects: Sequence[str], least: int = 1) -> DataFrame:
    """Unordered pairs of aspects: documents with both, share of all, Jaccard. All pairs are counted in one pass over the flags."""
    pairs = [(a, b) for i, a in enumerate(sorted(aspects)) for b in sorted(aspects)[i + 1 :]]
    agg = df.agg(F.count(F.lit(1)).alias("n"), F.array(*(F.struct(F.lit(a).alias("aspect_a"), F.lit(b).alias("aspect_b"), F.count_if(F.col(a) & F.col(b)).alias("n_both"), F.count_if(F.col(a) | F.col(b)).alias("n_any")) for a, b in pairs)).alias("p"))
    out = agg.select("n", F.inline("p"))
    return out.filter(F.col("n_both") >= least).select("aspect_a", "aspect_b", "n_both", (100 * F.col("n_both") / F.col("n")).alias("both_pct"), (F.col("n_both") / F.col("n_any")).alias("jaccard"))


def severity(text: Column, high: Sequence[str], medium: Sequence[str]) -> Column:
    return F.when(text.rlike(keyword_pattern(high)), "HIGH").when(text.rlike(keyword_pattern(medium)), "MEDIUM").otherwise("BASELINE")


def driver_class(gap: Column, support: Column, low: Column, high: Column) -> Column:
    """gap in percentage points (high minus low share), documents in support, both shares in per cent."""
    return F.when(support < 5, "INSUFFICIENT_SUPPORT").when((low >= 30) & (high >= 30), "EXPERIENCE_DEFINING").when(gap >= 10, "POSITIVE_DRIVER").when(gap <= -10, "NEGATIVE_DRIVER").otherwise(F.when((low < 10) & (high < 10), "MINOR").otherwise("MIXED"))
