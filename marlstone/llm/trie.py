"""The prefix trie of conversations, by smallest-member ownership.

A node is a sequence of first turns, and its members are the conversations that begin with it. Members only become fewer
along a path, so a conversation that is the smallest member of a node is that of all later nodes on its path: each
conversation owns a suffix of its path, and each node has one owner. So what a node's subtree holds need not be
gathered along edges: one group-by over prefixes adds up, for each member, the tokens of its occurrences from there on
minus those of the nodes that it owns, and whether it owns a leaf.

Windows that run along a conversation give prefix keys and token sums. The smallest member is an aggregate and not a
window by node, since every conversation is a member of the root. Long conversations are no exception: turns are numbered by ranges of (conversation, turn), and
windows run over pieces of PIECE turns whose sums are carried on, so no task holds a conversation. Texts stay where they lie: a turn travels as its SHA-256.

A prefix key is the exclusive or of two 64-bit hashes of each turn with its place. Keys are proven, or drawn again with
another seed: all members of a node must agree in their last turn and in their parent's key, hence in all turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .apply import quoted
from .store import dropped, saved, shipped

#: A conversation takes up to SHARED - 1 first turns from the one whose id is the last multiple of FAMILY.
SHARED, FAMILY = 6, 100
PIECE = 1024
#: Ids that are joined in one row on their way to a digest.
IDS = 50_000


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv, i, body, tokens) of turns (conv, turn, body, tokens), numbered from 1 by turn (null first); turns that tie, by body."""
    dealt = turns.withColumn("nth", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("turn"), "body", "nth"]
    # Ranges split a long conversation, and equal rows too.
    dealt = saved(dealt.repartitionByRange("conv", *order).withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # Only one conversation goes on into a range, so there are no more rows than ranges.
    carried = sizes.select("conv", "part", upto.alias("before")).filter("before > 0")
    rows = dealt.withColumn("at", F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order)))
    return rows.join(F.broadcast(carried), ["conv", "part"], "left").select("conv", (F.coalesce("before", F.lit(0)) + F.col("at")).alias("i"), "body", "tokens")


def rebuilt_turns(turns: DataFrame, shared: int = SHARED, family: int = FAMILY) -> tuple[DataFrame, DataFrame]:
    """(conv, d, body, tokens) and (conv, len) of numbered turns (conv, i, body, tokens): every conversation c begins with the first h turns of conversation c - c % family, h = crc32(c) % shared, and goes on with its own after its first h."""
    h, base = F.crc32(F.col("conv").cast("string").cast("binary")) % shared, F.col("conv") - F.col("conv") % family
    heads = turns.filter((F.col("conv") % family == 0) & (F.col("i") < shared)).groupBy(F.col("conv").alias("base")).agg(F.collect_list(F.struct("i", "body", "tokens")).alias("head"))
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).select("conv", "n", h.alias("h"), base.alias("base")).join(heads, "base", "left")
    taken = F.coalesce(F.filter("head", lambda x: x["i"] <= F.col("h")), F.expr("cast(array() as array<struct<i:bigint,body:binary,tokens:bigint>>)"))
    convs = saved(convs.select("conv", "h", taken.alias("head"), (F.size(taken) + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")))
    first = convs.select("conv", F.explode("head").alias("x")).select("conv", F.col("x.i").alias("d"), "x.body", "x.tokens")
    own = turns.withColumn("h", h).filter("i > h").join(convs.select("conv", F.size("head").alias("k")), "conv").select("conv", (F.col("k") + F.col("i") - F.col("h")).alias("d"), "body", "tokens")
    return first.unionByName(own), convs.select("conv", "len")


def _along(turns: DataFrame, seed: int) -> DataFrame:
    """turns with the keys of the prefix that ends there (k1, k2) and of the one before (p1, p2), and its tokens (upto)."""
    marks = {f"x{j}": F.xxhash64(F.lit(seed * 2 + j), "d", "body") for j in (1, 2)}
    rows = turns.withColumns(marks).withColumn("piece", F.floor((F.col("d") - 1) / PIECE))
    here = Window.partitionBy("conv", "piece").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({"k1": F.bit_xor("x1").over(here), "k2": F.bit_xor("x2").over(here), "upto": F.sum("tokens").over(here)})
    past = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("conv", "piece").agg(F.bit_xor("x1").alias("c1"), F.bit_xor("x2").alias("c2"), F.sum("tokens").alias("c3"))
    carried = carried.select("conv", "piece", F.bit_xor("c1").over(past).alias("c1"), F.bit_xor("c2").over(past).alias("c2"), F.sum("c3").over(past).alias("c3")).filter("piece > 0")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    key = lambda j: F.col(f"k{j}").bitwiseXOR(zero(F.col(f"c{j}")))
    out = local.join(carried, ["conv", "piece"], "left")
    return out.select("conv", "d", "body", "tokens", key(1).alias("k1"), key(2).alias("k2"), key(1).bitwiseXOR(F.col("x1")).alias("p1"), key(2).bitwiseXOR(F.col("x2")).alias("p2"), (F.col("upto") + zero(F.col("c3"))).alias("upto"))


def _digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, d, digest) of ends (k1, k2, d, conv): SHA-256 of the ids, ascending, joined by commas. Ids are sorted and joined in ranges; only the text of what is joined passes one task, as a stream."""
    key = ["k1", "k2", "d"]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids = None, []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"k1": [now[0]], "k2": [now[1]], "d": [now[2]], "first": [ids[0]], "ids": [",".join(map(str, ids))]}, schema)

        schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("d", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
        for batch in batches:
            out: dict = {n: [] for n in schema.names}
            for *k, conv in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if ids and (k != now or len(ids) >= IDS):
                    for n, v in zip(schema.names, (*now, ids[0], ",".join(map(str, ids))), strict=True):
                        out[n].append(v)
                    ids = []
                now = k
                ids.append(conv)
            yield pa.RecordBatch.from_pydict(out, schema)
        if ids:
            yield row()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("d", pa.int64()), ("digest", pa.string())])
        for batch in batches:
            out: dict = {n: [] for n in schema.names}
            for *k, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if k == now:
                    digest.update(b"," + ids.encode())
                else:
                    if now:
                        for n, v in zip(schema.names, (*now, digest.hexdigest()), strict=True):
                            out[n].append(v)
                    now, digest = k, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pydict(out, schema)
        if now:
            yield pa.RecordBatch.from_pydict({"k1": [now[0]], "k2": [now[1]], "d": [now[2]], "digest": [digest.hexdigest()]}, schema)

    shipped(ends.sparkSession)
    chunks = ends.select(*key, "conv").repartitionByRange(*key, "conv").sortWithinPartitions(*key, "conv").mapInArrow(joined, "k1 long, k2 long, d long, first long, ids string")
    return chunks.repartition(*key).sortWithinPartitions(*key, "first").select(*key, "ids").mapInArrow(hashed, "k1 long, k2 long, d long, digest string")


def prefix_trie(talks: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", shared: int = SHARED, family: int = FAMILY) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, null first; turns of one conversation that tie, by the SHA-256 of role and text, so that repeated rows are
    turns one after another. Null roles and texts read as empty ones. Rows without a conversation id belong to none and are left out. A conversation that is left without
    turns is a member of the root alone. Texts of any length are read where they lie, conversations may have any number of turns. An empty table has no
    nodes; other columns are ignored, whatever their names. shared=1 leaves conversations as they are.
    """
    blank = lambda c: F.coalesce(quoted(c), F.lit(""))
    body = F.unhex(F.sha2(F.concat(F.length(blank(role_col)).cast("string"), F.lit(":"), blank(role_col), blank(text_col)), 256))
    turns = talks.select(quoted(conv_col).cast("long").alias("conv"), quoted(turn_col).alias("turn"), body.alias("body"), F.length(blank(text_col)).cast("long").alias("tokens")).filter("conv is not null")
    rebuilt, convs = rebuilt_turns(saved(numbered_turns(turns)), shared, family)
    root = convs.select("conv", F.lit(0).cast("long").alias("d"), F.lit(b"").alias("body"), *(F.lit(0).cast("long").alias(c) for c in ("tokens", "k1", "k2", "p1", "p2", "upto")))
    key = ["k1", "k2", "d"]
    for seed in range(1, 100):
        rows = saved(root.unionByName(_along(rebuilt, seed)).join(convs, "conv"))
        told = F.struct("body", "p1", "p2", "tokens")
        nodes = rows.groupBy(*key).agg(F.min("conv").alias("owner"), F.max("len").alias("longest"), F.min("upto").alias("upto"), F.min(told).alias("told"), F.max(told).alias("other"))
        nodes = saved(nodes)
        if nodes.filter("told <> other").isEmpty():
            break
        dropped(rows, nodes)
    else:
        raise RuntimeError("no seed keeps the prefixes' keys apart")
    # Where a conversation's own suffix starts, the tokens before it, and whether it ends in a leaf of its own.
    owned = nodes.groupBy(F.col("owner").alias("conv")).agg(F.min("d").alias("start"), F.min(F.col("upto") - F.col("told.tokens")).alias("free"), F.max((F.col("longest") == F.col("d")).cast("int")).alias("leaf"))
    marked = rows.join(owned, "conv", "left")
    # Of tokens before the own suffix, those from this node on; all, where nothing is owned.
    total = rows.filter("d = len").select("conv", F.col("upto").alias("total"))
    marked = marked.join(total, "conv")
    after = F.greatest(F.coalesce("free", "total") - (F.col("upto") - F.col("tokens")), F.lit(0))
    child = F.count_if((F.col("start") <= F.col("d") + 1) & (F.col("len") > F.col("d")))
    sums = marked.groupBy(*key).agg(F.min("conv").alias("conv_id"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.count(F.lit(1)).alias("n_convs"), child.alias("n_children"), F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"), F.sum(after).alias("saved_tokens"))
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("d") + 1).alias("d"), F.col("owner").alias("parent_conv_id"))
    ends = saved(_digests(rows.filter("d = len")))
    out = sums.join(parents, ["p1", "p2", "d"], "left").join(ends, key, "left")
    digest: Column = F.coalesce("digest", F.lit(hashlib.sha256(b"").hexdigest()))
    return out.select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", digest.alias("ends_sha256"))
