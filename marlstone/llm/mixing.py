"""Mixing of sources to target weights by capped water-filling.

Targets start at the sources' weighted shares of the mix; a target above its cap, a maximum number of epochs over the
source, is clamped, and the excess goes to the others by weight until none is above. Each source then takes whole
repetitions of all its documents and a fractional one of those whose seeded hash is up to a cut, which is found
from sums by hash range, so that the words taken come within half a document of the target. Rows that are equal in id
and text share a hash; where the cut falls among them, so many of them enter as come nearest to the target.

Sources are rows of written tables from their ranks to their cuts, so there may be any number of them; the driver sees
sums over all of them. Documents are never sorted or grouped as a whole: sums by source and hash range are taken before
anything is joined, and rows meet their source's cut by a broadcast of checked size, or by a join salted by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .apply import quoted, whole_row
from .store import dropped, saved

WEIGHTS, SHARE, EPOCHS, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, 20240601
#: Up to so many sources a table of one row each is broadcast; beyond, it is joined by shuffle, its rows repeated for SALTS salts.
BROADCAST_SOURCES, SALTS = 100_000, 16
BITS = 62
SOURCE = ["none", "name"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def place(seed: int, *key: Column) -> Column:
    """A seeded place in the order in which a source's documents enter its fractional repetition."""
    return F.xxhash64(F.lit(seed), *key).bitwiseAND(F.lit((1 << BITS) - 1))


def _keys(source: Column) -> list[Column]:
    return [source.isNull().alias("none"), F.coalesce(source, F.lit("")).alias("name")]


def ranked(sources: DataFrame) -> DataFrame:
    """sources (none, name and others) with rank: 0 for the first name by code point, null last. Ranges of names are sorted and counted apart."""
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = saved(sources.repartitionByRange(parts, *SOURCE).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*SOURCE)) - 1
    out = saved(dealt.join(F.broadcast(counts.select("part", before.alias("before"))), "part").withColumn("rank", rank).drop("part", "before"))
    dropped(dealt)
    return out


def water_level(sources: DataFrame, total: float, epochs: float = EPOCHS) -> float:
    """The target for each unit of weight among the sources (source_size, weight) that are not clamped: total's share, raised by what sources above their caps (epochs times their sizes) leave over, until no further one is above."""
    cap = (F.col("source_size") * F.lit(epochs)).cast("decimal(38,9)")
    level, clamped = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("weight") * F.lit(level) > F.col("source_size") * F.lit(epochs)
        now, caps, mass = sources.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight").cast("decimal(38,9)"))), F.lit(0))).first()
        if now == clamped:
            return level
        level, clamped = (total - float(caps)) / float(mass) if mass else float("inf"), now


def _with(rows: DataFrame, table: DataFrame, sources: int) -> DataFrame:
    """rows (with place) joined with the rows of table that have their source."""
    if sources <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(table), SOURCE)
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", (F.col("place") % SALTS).cast("int")).join(salted, [*SOURCE, "salt"]).drop("salt")


def mixing_plan(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> tuple[DataFrame, int]:
    """One row a source for rows of (none, name, size, place), and the number of sources.

    Sources rank by code point, null last; weights repeat over the ranks; the mix has share times all words. A row is
    taken whole times, and once more if its place is below cut; of the ties rows whose place is the cut, some are.
    """
    order = F.array(*(F.lit(float(w)) for w in weights))
    sums = ranked(sized.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"))).withColumn("weight", F.element_at(order, (F.col("rank") % len(weights)).cast("int") + 1))
    n, words = sums.agg(F.count(F.lit(1)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    level = water_level(sums, share * words, epochs) if n else 0.0
    target = F.when(F.col("weight") == 0, F.lit(0.0)).otherwise(F.least(F.col("weight") * F.lit(level), F.col("source_size") * F.lit(float(epochs))))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0).cast("int")
    targets = saved(sums.withColumn("target", target).withColumn("whole", whole).select(*SOURCE, "source_size", "target", "whole", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")).alias("quota")))
    rows, quota, spent = sized.select(*SOURCE, "size", "place"), targets.select(*SOURCE, "quota"), []

    def crossing(sums: DataFrame, by: str) -> DataFrame:
        """Of each source's sums (by, size, n), in order of by, the first with which they exceed the quota, and the sum before it."""
        upto = F.sum("size").over(Window.partitionBy(*SOURCE).orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
        over = sums.withColumn("upto", upto).join(quota, SOURCE).filter("upto > quota")
        first = over.groupBy(*SOURCE).agg(F.min_by(F.struct(by, "size", "n", (F.col("upto") - F.col("size")).alias("before"), "quota"), by).alias("x"))
        return first.select(*SOURCE, "x.*")

    for shift in (51, 40, 29):
        binned = rows.withColumn("bin", F.shiftright("place", shift))
        found = saved(crossing(binned.groupBy(*SOURCE, "bin").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "bin"))
        within = found.select(*SOURCE, "bin")
        rows = saved(binned.join(F.broadcast(within) if n <= BROADCAST_SOURCES else within, [*SOURCE, "bin"]).select(*SOURCE, "size", "place"))
        quota = found.select(*SOURCE, (F.col("quota") - F.col("before")).alias("quota"))
        spent += [found, rows]
    cut = crossing(rows.groupBy(*SOURCE, "place").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "place")
    some = F.least(F.col("n"), F.floor((F.col("quota") - F.col("before")) * F.col("n") / F.col("size") + 0.5).cast("long"))
    plan = saved(targets.join(cut.select(*SOURCE, F.col("place").alias("cut"), some.alias("some"), F.col("n").alias("ties")), SOURCE, "left").drop("quota"))
    dropped(targets, *spent)
    return plan, n


def _taken(rows: DataFrame, plan: DataFrame, sources: int) -> DataFrame:
    """rows (none, name, place and others) with their source's plan and copies, the number of times that each is taken."""
    rows = _with(rows, plan, sources)
    at = F.coalesce(F.col("place") == F.col("cut"), F.lit(False))
    enters = F.coalesce(F.col("place") < F.col("cut"), F.lit(False)) | (at & (F.col("some") > 0))
    copies = F.col("whole") + F.when(enters, 1).otherwise(0)
    if plan.filter("some > 0 and some < ties").isEmpty():
        return rows.withColumn("copies", copies)
    # Equal rows of which some enter: they are numbered by partition, and within it.
    split = at & (F.col("some") > 0) & (F.col("some") < F.col("ties"))
    tied = saved(rows.filter(split).withColumn("rid", F.monotonically_increasing_id())).withColumn("part", F.shiftright("rid", 33))
    counts = tied.groupBy(*SOURCE, "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*SOURCE).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = F.col("before") + F.row_number().over(Window.partitionBy(*SOURCE, "part").orderBy("rid"))
    tied = tied.join(counts.select(*SOURCE, "part", before.alias("before")), [*SOURCE, "part"]).withColumn("copies", F.col("whole") + F.when(number <= F.col("some"), 1).otherwise(0))
    return rows.filter(~split).withColumn("copies", copies).unionByName(tied.drop("rid", "part", "before"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    id_, text, source = quoted(id_col), quoted(text_col), quoted(source_col)
    return docs.select(id_.alias("doc_id"), *_keys(source), word_count(text).alias("size"), place(seed, id_, text).alias("place"))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, copies, taken.

    The size is the number of words of the whole text (null: 0); a null source is a source of its own. Rows equal in id
    and text share their place; where only some of them are wanted, some enter. Documents without words take no part
    in sums and are copied as their place tells. A source without words has the target 0. An empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    sized = saved(_sized(docs, id_col, text_col, source_col, seed))
    plan, sources = mixing_plan(sized, weights, share, epochs)
    return _taken(sized, plan, sources).select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """docs with each row as often as the mix takes it; the columns stay, whatever their names. How many of several rows equal in id, text and source enter is fixed; which, where they differ in other columns, is not."""
    sized = saved(_sized(docs, id_col, text_col, source_col, seed))
    plan, sources = mixing_plan(sized, weights, share, epochs)
    dropped(sized)
    rows = docs.select(whole_row(docs), *_keys(quoted(source_col)), place(seed, quoted(id_col), quoted(text_col)).alias("place"))
    return _taken(rows, plan, sources).select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")
