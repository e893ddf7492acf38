"""Source divergence audit: how far the word frequencies of sources lie apart, over deduplicated count columns.

Terms of a language that have the same counts in all its sources behave alike in every comparison. So terms are grouped
by their sparse vector of (source, count), and each pair of sources is evaluated once for each distinct vector and
multiplied by the number of its terms; only then are the original terms ranked. Where both sources of a pair have a
term, the pair comes from the vector's own entries. Where one has it, the value depends on that count alone, so vectors
are grouped once more by it; where none has it, it is the same for all terms. All arithmetic is on whole numbers.

Words are counted within tasks, in tables of bounded size, before anything is shuffled; a vector has as many entries at
most as its language has sources.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .apply import quoted, trimmed
from .store import dropped, saved, shipped

LEAST_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
#: Every byte that is no part of a term becomes a blank, A-Z become a-z.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: Counted (group, term) pairs that a task holds before it passes them on, and bytes of a text that are split at once.
HELD, PIECE = 400_000, 1 << 20


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of about PIECE bytes, so that a very long text needs little more memory than itself."""
    body = (text or "").encode("utf-8", "surrogatepass").translate(FOLD)
    at = 0
    while at < len(body):
        end = body.find(b" ", at + PIECE) if at + PIECE < len(body) else -1
        end = len(body) if end < 0 else end
        yield body[at:end].split()
        at = end


def _counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of docs (lang, source, text): occurrences and documents, several rows a term."""
    fields = "lang string, source string, term string, n long, docs long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = defaultdict(lambda: (Counter(), Counter()))

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                words = list(n)
                if words:
                    texts = pa.array(words, pa.binary()).cast(pa.string())
                    same = lambda x, k=len(words): pa.array([x], pa.string()).take(pa.array([0] * k))
                    yield pa.RecordBatch.from_arrays([same(lang), same(source), texts, pa.array(n.values(), pa.int64()), pa.array([docs[w] for w in words], pa.int64())], ["lang", "source", "term", "n", "docs"])
            held.clear()

        size = 0
        for batch in batches:
            for at in range(batch.num_rows):
                lang, source, text = (batch.column(i)[at].as_py() for i in range(3))
                n, docs = held[lang, source]
                before, seen = len(n), set()
                for words in terms(text):
                    n.update(words)
                    seen.update(words)
                docs.update(seen)
                size += len(n) - before
                if size >= HELD:
                    yield from flushed()
                    size = 0
            trimmed()
        yield from flushed()

    shipped(docs.sparkSession)
    return docs.mapInArrow(run, fields)


def _share(n: str, total: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * v)), exact beyond 64 bits."""
    return F.expr(f"1 + (cast({n} + 2 as decimal(19, 0)) * {SCALE} div cast({total} + 2 * v as decimal(20, 0)))")


def _apart(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); both are below 2^31, so the square fits."""
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how far each (lang, source) group lies from the other sources of its language (part pair), and its terms that stand out most from the language (part term).

    Null text, lang and source read as empty texts. Terms are runs of letters and characters beyond ASCII, with A-Z
    lower-cased; a language keeps those in least_docs of its documents or more, and repeated rows are documents each. A
    group without kept terms has all counts 0; a language without kept terms has value 0 in all its pairs; a group that
    is alone in its language has no pairs. Ties are ranked by item, in order of code points. Texts of any length are
    read whole; an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    blank = lambda c: F.coalesce(quoted(c).cast("string"), F.lit(""))
    rows = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), quoted(text_col).alias("text"))
    # One exchange by (lang, term) serves both sums.
    counts = _counts(rows).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vec"))
    kept = saved(kept.filter(F.col("docs") >= least_docs).select("lang", "term", "vec"))
    vectors = saved(kept.groupBy("lang", "vec").agg(F.count(F.lit(1)).alias("m")).withColumn("vid", F.monotonically_increasing_id()))
    each = vectors.select("lang", "m", F.explode("vec").alias("x")).select("lang", "m", "x.source", "x.n")
    sums = each.groupBy("lang", "source").agg(F.sum(F.col("m") * F.col("n")).alias("total"))
    kinds = vectors.groupBy("lang").agg(F.sum("m").alias("v"), F.sum(F.col("m") * F.aggregate("vec", F.lit(0).cast("long"), lambda a, x: a + x["n"])).alias("all"))
    groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(kinds, "lang", "left").na.fill(0, ["total", "v", "all"])
    # zero: the share of a term that the group does not have.
    groups = saved(groups.withColumn("zero", F.when(F.col("v") > 0, _share("cast(0 as bigint)", "total"))))

    entries = vectors.select("lang", "vid", "m", F.aggregate("vec", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("of_all"), F.explode("vec").alias("x"))
    entries = entries.select("lang", "vid", "m", "of_all", "x.source", "x.n").join(groups, ["lang", "source"])
    entries = saved(entries.select("lang", "source", "vid", "m", _share("n", "total").alias("p"), "zero", _share("of_all", "all").alias("q")))
    pairs = _pairs(entries, groups)
    out = pairs.unionByName(_terms(entries, vectors, kept, top))
    out = saved(out)
    dropped(kept, vectors, groups, entries)
    return out


def _pairs(entries: DataFrame, groups: DataFrame) -> DataFrame:
    one = groups.select("lang", F.col("source").alias("a"), F.col("zero").alias("za"), "v")
    two = groups.select("lang", F.col("source").alias("b"), F.col("zero").alias("zb"))
    both = one.join(two, "lang").filter("a < b")
    # No source has any term; then what those differ by that one of them has; then those that both have.
    none = both.select("lang", "a", "b", F.when(F.col("v") > 0, F.col("v") * _apart("za", "zb")).otherwise(F.lit(0)).alias("value"))
    alike = entries.groupBy("lang", "source", "p", "zero").agg(F.sum("m").alias("m"))
    single = alike.join(two, "lang").filter("source <> b")
    single = single.groupBy("lang", F.least("source", "b").alias("a"), F.greatest("source", "b").alias("b")).agg(F.sum(F.col("m") * (_apart("p", "zb") - _apart("zero", "zb"))).alias("value"))
    vectors = entries.groupBy("lang", "vid", "m").agg(F.collect_list(F.struct("source", "p", "zero")).alias("xs")).filter(F.size("xs") > 1)
    met = vectors.select("lang", "m", "xs", F.explode("xs").alias("x")).select("lang", "m", "x", F.explode("xs").alias("y")).filter("x.source < y.source")
    met = met.select("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"), (F.col("m") * (_apart("x.p", "y.p") - _apart("x.p", "y.zero") - _apart("x.zero", "y.p") + _apart("x.zero", "y.zero"))).alias("value"))
    total = none.unionByName(single).unionByName(met).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return total.select("lang", "value", sides).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", F.row_number().over(order))


def _terms(entries: DataFrame, vectors: DataFrame, kept: DataFrame, top: int) -> DataFrame:
    over = entries.filter("p > q").select("lang", "source", "vid", _apart("p", "q").alias("value"))
    # A vector has a term at least, so those of the first terms are among the first vectors, ties included.
    first = over.withColumn("at", F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))).filter(F.col("at") <= top)
    names = kept.join(vectors, ["lang", "vec"]).select("vid", F.col("term").alias("item"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = first.join(names, "vid").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
