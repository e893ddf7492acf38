"""Exact duplicates by deterministic block naming, in DataFrame operations only.

Texts are cut into blocks of a fixed number of bytes. The distinct blocks are sorted and named by integers; then
adjacent pairs of names are sorted and named again, level by level, until one name is left of each text. Two texts
of one level share a name if and only if all their blocks are equal, so classes are free of collisions. Between
tasks a block travels as two 64-bit hashes; these are proven distinct for the distinct blocks at hand, or drawn
again with another seed. A hot text costs each task one row before the shuffle; joins against a hot name are split
by AQE, since both sides are plain tables.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import dropped, saved

BLOCK = 4096


def ascii_lower(text: Column) -> Column:
    """text with A-Z alone lower-cased; null is empty. Texts of ASCII only take the built-in's fast path."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _blocks(docs: DataFrame, text: str, size: int) -> DataFrame:
    cut = F.expr(f"transform(sequence(0, greatest(1, cast(ceil(length(raw) / {size}) as int)) - 1), i -> substring(raw, i * {size} + 1, {size}))")
    return docs.withColumn("raw", ascii_lower(F.col(text)).cast("binary")).withColumn("parts", cut)


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the
    largest id stays (null ids come last; of repeated rows with that id one stays). Texts of any length are named block
    by block. Names are unique integers whose order may differ between runs; the result does not depend on it. An empty
    table gives an empty result. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    for seed in range(1, 100):
        keys = [F.xxhash64(F.lit(seed), "block").alias("h1"), F.xxhash64(F.lit(-seed), F.lit(seed), "block").alias("h2")]
        names = saved(_named(_blocks(rows, "t", block).select(F.explode("parts").alias("block")), "block").select(*keys, "name"))
        if names.groupBy("h1", "h2").count().filter("count > 1").isEmpty():
            break
        dropped(names)
    else:
        raise RuntimeError("no seed keeps the blocks' hashes apart")
    cut = _blocks(rows, "t", block).withColumn("rid", F.monotonically_increasing_id()).select("rid", "doc_id", F.sha2("raw", 256).alias("sha"), F.size("parts").alias("n"), "parts")
    cut = cut.select("rid", "doc_id", "sha", "n", F.posexplode("parts").alias("pos", "block"))
    seen = saved(cut.select("rid", "doc_id", F.when(F.col("pos") == 0, F.col("sha")).alias("sha"), "n", "pos", *keys))
    level, live = 0, seen.drop("sha").join(names, ["h1", "h2"]).select("rid", "doc_id", "n", "pos", "name")
    live = saved(live)
    most = live.agg(F.max("n")).first()[0] or 1
    done, used = [live.filter("n = 1").select("rid", "doc_id", F.lit(0).alias("level"), "name")], [names]
    while most > 1:
        level, most = level + 1, -(-most // 2)
        pairs = live.filter("n > 1").groupBy("rid", "doc_id", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b")
        )
        pairs = saved(pairs)
        names = saved(_named(pairs.select("a", "b"), "a", "b"))
        live = saved(pairs.join(names, ["a", "b"]).select("rid", "doc_id", "n", "pos", "name"))
        dropped(pairs, *used)
        used = [names]
        done.append(live.filter("n = 1").select("rid", "doc_id", F.lit(level).alias("level"), "name"))
    whole = done[0]
    for x in done[1:]:
        whole = whole.unionByName(x)
    groups = saved(whole.groupBy("level", "name").agg(F.max(F.struct("doc_id", "rid")).alias("best"), F.count(F.lit(1)).alias("group_size")))
    texts = seen.filter("pos = 0").select("rid", F.col("sha").alias("text_sha256"))
    out = whole.join(groups, ["level", "name"]).join(texts, "rid")
    return out.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"), "text_sha256")


def _named(df: DataFrame, *cols: str) -> DataFrame:
    """The distinct rows of df, sorted within the partitions they hash to, with an integer that rises in that order and is unique among all."""
    return df.select(*cols).distinct().sortWithinPartitions(*cols).withColumn("name", F.monotonically_increasing_id())
