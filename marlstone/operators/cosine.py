"""All pairs of vectors at a cosine. A vector travels packed in one row, pairs are found and scored in tiles of two blocks of vectors, and only pairs that pass a bound are written."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..session import shipped
from ..sources.stage import dropped, saved

#: Bytes of text of a block; entries of a block's vectors, or of their beginnings, in a tile.
BLOCK_BYTES, SIDE = 16 << 20, 3_000_000
#: Meetings of entries that a tile holds at once, entries of one side that it looks at together, and bytes of text whose words are read at once.
MEETINGS, SLICE, PIECE = 500_000, 300_000, 1 << 20
#: A vector's beginning leaves no more than this of its squared length: less leaves fewer pairs to score, and lets more meet.
REST = 0.6
#: What half precision can take from a sum of products: of the sum, and besides.
HALF, SLACK = 1.1e-3, 1e-5

LETTER = np.array([97 <= b <= 122 for b in range(256)])
_wild = np.random.Generator(np.random.PCG64(18))
SYMBOL = _wild.integers(1, 2**63, 256, dtype=np.uint64)
BASE = np.uint64(0xD1342543DE82EF95)


def _trimmed() -> None:
    """Gives freed memory back to the system, since workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def letter_words(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts and 64-bit hashes of all runs of three or more letters a-z, piece by piece."""
    at = 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and LETTER[data[end]]:
            gap = np.flatnonzero(~LETTER[data[end : end + 4096]])
            end += int(gap[0]) if len(gap) else min(4096, len(data) - end)
        letter = LETTER[data[at:end]]
        edges = np.flatnonzero(np.diff(letter.astype(np.int8), prepend=0, append=0))
        starts, sizes = edges[::2], edges[1::2] - edges[::2]
        long = sizes >= 3
        starts, sizes = starts[long], sizes[long]
        if len(starts):
            ends = np.cumsum(sizes)
            place = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
            with np.errstate(over="ignore"):
                powers = np.cumprod(np.full(int(sizes.max()), BASE), dtype=np.uint64)
                h = np.add.reduceat(SYMBOL[data[at:end][np.repeat(starts, sizes) + place]] * powers[place], ends - sizes)
                h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            yield starts + at, (h ^ (h >> np.uint64(31))).view(np.int64)
        at = end


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _counted(texts: pa.Table, reps: pa.Table) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """The ids of a block's documents, and by (document, word): documents, words, counts. Of equal texts the one that reps names stays; texts of one id are one document."""
    wanted = dict(zip(reps.column("sha").to_pylist(), reps.column("id").to_pylist(), strict=True))
    ids, docs, rows = {}, [], []
    for k, (i, sha) in enumerate(zip(texts.column("id").to_pylist(), texts.column("sha").to_pylist(), strict=True)):
        if sha in wanted and wanted[sha] == i:
            del wanted[sha]
            docs.append(ids.setdefault(i, len(ids)))
            rows.append(k)
    parts = texts.column("low").take(pa.array(rows, pa.int64())).cast(pa.large_binary()).to_pylist()
    offsets = np.cumsum([0, *(len(x) + 1 for x in parts)])
    found = list(letter_words(np.frombuffer(b"\n".join(parts), np.uint8)))
    starts, t = (np.concatenate([x[c] for x in found] or [np.zeros(0, np.int64)]) for c in (0, 1))
    doc = np.array(docs, np.int64)[np.searchsorted(offsets, starts, "right") - 1] if len(t) else t
    by = np.lexsort((t, doc))
    doc, t = doc[by], t[by]
    at = _runs(doc, t)
    return list(ids), doc[at], t[at], np.diff(np.append(at, len(t)))


VECTOR = "t binary, d binary, c binary, q binary, r binary, p binary"


def _packed(ids: list, doc: np.ndarray, t: np.ndarray, d: np.ndarray, c: np.ndarray, w: np.ndarray) -> list[list]:
    """Columns of vectors: id, and from the rarest term on: terms t, their numbers of documents d, what weights are derived from c, and of the beginning half of each term q, its rarity class r and weight p in half precision."""
    by = np.lexsort((t, d, doc))
    doc, t, d, c, w = doc[by], t[by], d[by].astype(np.uint32), c[by], w[by]
    r = np.minimum(8 * np.log2(d), 255).astype(np.uint8)
    at = _runs(doc)
    out = [[] for _ in range(7)]
    for a, b in zip(at, np.append(at[1:], len(doc)), strict=True):
        left = 1 - np.cumsum(w[a:b] ** 2)
        # All terms of the last one's class belong to the beginning.
        p = int(np.searchsorted(r[a:b], r[a:b][min(int(np.searchsorted(-left, -REST)), b - a - 1)], "right"))
        own = c[a:b] if c.dtype == np.float64 else c[a:b].astype(np.min_scalar_type(int(c[a:b].max())))
        for x, y in zip(out, (ids[doc[a]], t[a:b].tobytes(), d[a:b].tobytes(), own.tobytes(), t[a : a + p].astype(np.uint32).tobytes(), r[a : a + p].tobytes(), w[a : a + p].astype(np.float16).tobytes()), strict=True):
            x.append(y)
    return out


def _weights(c: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    return (1 + np.log(c)) * (np.log((1 + n) / (1 + d)) + 1)


def text_vectors(docs: DataFrame, id_col: str, text: str, max_df: float = 0.9) -> tuple[DataFrame, int]:
    """Vectors (id, and VECTOR) of the words [a-z]{3,} of lower-cased texts, weighted as terms.tf_idf does, and the number of different texts. Equal texts count once, by their least id. NULL texts are left out.

    Texts are read twice, block by block: once for the words that a block has, once when it is known in how many
    documents of all blocks these are. So no table has a row for each word of each document.
    """
    spark = docs.sparkSession
    shipped(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).filter("text IS NOT NULL")
    kind = rows.schema["id"].dataType
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    block = F.pmod(F.xxhash64("id"), F.lit(max(8, -(-int(size) // BLOCK_BYTES)))).cast("int").alias("block")
    sha = F.unhex(F.sha2("text", 256)).alias("sha")
    texts = rows.select(block, "id", sha, F.lower("text").alias("low"))
    reps = saved(rows.select("id", sha).groupBy("sha").agg(F.min("id").alias("id")).select(block, "id", "sha"))
    n = reps.count()

    def words(texts: pa.Table, reps: pa.Table) -> pa.Table:
        _, doc, t, _ = _counted(texts, reps)
        found, times = np.unique(t, return_counts=True)
        _trimmed()
        of = texts if texts.num_rows else reps
        return pa.table([pa.array(np.full(len(found), of.column("block")[0].as_py() if of.num_rows else 0, np.int32)), pa.array(found), pa.array(times)], ["block", "t", "c"])

    of_blocks = texts.groupBy("block").cogroup(reps.groupBy("block")).applyInArrow(words, "block int, t long, c long")
    df = F.sum("c").over(Window.partitionBy("t"))
    known = saved(of_blocks.select("block", "t", df.alias("df")).filter(F.col("df") <= max_df * n))

    def vectors(texts: pa.Table, told: pa.Table) -> pa.Table:
        is_rep = told.column("t").is_null()
        ids, doc, t, c = _counted(texts, told.filter(is_rep))
        told = told.filter(told.column("t").is_valid())
        terms, df = told.column("t").to_numpy(), told.column("df").to_numpy()
        by = np.argsort(terms)
        at = by[np.minimum(np.searchsorted(terms, t, sorter=by), len(terms) - 1)] if len(terms) else np.zeros(0, np.int64)
        ok = terms[at] == t if len(terms) else np.zeros(len(t), bool)
        doc, t, c, d = doc[ok], t[ok], c[ok], df[at[ok]] if len(terms) else t[ok]
        v = _weights(c, d, n)
        w = v / np.sqrt(np.bincount(doc, v * v, len(ids)))[doc]
        out = _table(_packed(ids, doc, t, d, c, w), arrow)
        _trimmed()
        return out

    schema = T.StructType().add("id", kind)
    for f in T.StructType.fromDDL(VECTOR):
        schema = schema.add(f)
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
    told = reps.select("block", "id", "sha", F.lit(None).cast("long").alias("t"), F.lit(None).cast("long").alias("df"))
    told = told.unionByName(known, allowMissingColumns=True)
    out = saved(texts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(vectors, schema))
    dropped(reps, known)
    return out, n


def _table(columns: list[list], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def row_vectors(weights: DataFrame, id_col: str) -> DataFrame:
    """Vectors (id, and VECTOR) of rows (id, term, weight) whose vectors have length one. Terms travel as hashes of 64 bits."""
    shipped(weights.sparkSession)
    rows = weights.select(F.col(id_col).alias("id"), F.xxhash64("term").alias("t"), F.col("weight").cast("double").alias("w"))
    rows = rows.join(rows.groupBy("t").agg(F.count(F.lit(1)).alias("d")), "t")
    lists = rows.groupBy("id").agg(F.collect_list(F.struct("t", "d", "w")).alias("of")).select("id", "of.t", "of.d", "of.w")
    schema = T.StructType([lists.schema["id"], *T.StructType.fromDDL(VECTOR)])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def pack(batches):
        for batch in batches:
            doc = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(1).offsets.to_numpy()))
            t, d, w = (batch.column(k).flatten().to_numpy() for k in (1, 2, 3))
            if len(doc):
                yield from _table(_packed(batch.column(0).to_pylist(), doc, t, d, w, w), arrow).to_batches()

    return saved(lists.mapInArrow(pack, schema))


def _grid(rows: DataFrame, id_: Column, blocks: int) -> DataFrame:
    """rows, each once for every tile (i, j), i <= j, that its block g is in."""
    g = F.pmod(F.xxhash64(id_), F.lit(blocks)).cast("int")
    dealt = rows.withColumn("g", g).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return dealt.withColumns({"i": F.least("g", "k"), "j": F.greatest("g", "k")}).drop("k")


class _Side:
    """The beginnings of a block's vectors laid end to end."""

    def __init__(self, table: pa.Table):
        parts = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
        self.ids = table.column("id").combine_chunks()
        self.t, r, self.w = parts("q", np.uint32), parts("r", np.uint8), parts("p", np.float16).astype(np.float32)
        size = np.array([len(x) for x in table.column("r").to_pylist()], np.int64)
        self.ends = np.cumsum(size)
        self.begins = self.ends - size
        self.doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
        self.mass = np.concatenate([[0], np.cumsum(self.w**2, dtype=np.float64)])
        self.key = (self.doc << 8) | r
        self.last = r[self.ends - 1].astype(np.int32)
        self.rest = self.beyond(np.arange(len(size)), self.ends)

    def beyond(self, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(1 - (1 - HALF) * (self.mass[at] - self.mass[self.begins[doc]]), 0) + SLACK)

    def left(self, doc: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The length of what a vector has beyond terms of classes up to most, none of which come after its beginning."""
        return self.beyond(doc, np.searchsorted(self.key, (doc.astype(np.int32) << 8) | most, "right"))


def _met(threshold: float, schema: pa.Schema):
    """Pairs (a, b) of a tile that may reach threshold by what their beginnings share and the lengths of what lies beyond the one that ends first."""

    def work(table: pa.Table) -> pa.Table:
        i, j, g = table.column("i")[0].as_py(), table.column("j")[0].as_py(), table.column("g").to_numpy()
        sides = [table.filter(pa.array(g == k)).drop_columns(["i", "j", "g"]).combine_chunks() for k in (i, j)]
        del table
        if not min(x.num_rows for x in sides):
            return schema.empty_table()
        two = _Side(sides[1])
        by = np.argsort(two.t)
        t, doc, w = two.t[by], two.doc[by], two.w[by]
        del by, two.t, two.doc, two.w
        out, size = [], np.cumsum([len(x) for x in sides[0].column("r").to_pylist()])
        cuts = np.unique(np.append(np.searchsorted(size, np.arange(0, size[-1], SLICE)), len(size)))
        for base, end in zip([0, *cuts[:-1]], cuts, strict=True):
            if base == end:
                continue
            one = _Side(sides[0].slice(base, end - base))
            lo = np.searchsorted(t, one.t)
            many = np.searchsorted(t, one.t, "right") - lo
            total = np.concatenate([[0], np.cumsum(many)])
            k = 0
            while k < len(one.ends):
                a = one.begins[k]
                k = max(k + 1, int(np.searchsorted(total[one.ends], total[a] + MEETINGS, "right")))
                b = one.ends[k - 1]
                x = np.repeat(np.arange(a, b), many[a:b])
                y = np.arange(len(x)) + np.repeat(lo[a:b] - total[a:b] + total[a], many[a:b])
                if i == j:  # each meets those after it
                    after = doc[y] > one.doc[x] + base
                    x, y = x[after], y[after]
                p, q = _passing(one, two, one.doc[x].astype(np.int64) * len(two.ends) + doc[y], one.w[x] * w[y], threshold)
                out.append(pa.Table.from_arrays([one.ids.take(pa.array(p)), two.ids.take(pa.array(q))], schema=schema))
        _trimmed()
        return pa.concat_tables(out)

    return work


def _passing(one: _Side, two: _Side, pair: np.ndarray, product: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(pair)
    pair = pair[by]
    at = _runs(pair)
    shared = np.add.reduceat(product[by], at) * (1 + HALF) + SLACK if len(at) else product
    a, b = np.divmod(pair[at], len(two.ends))
    x, y = one.last[a], two.last[b]
    ok = shared + np.where(x <= y, one.rest[a], two.rest[b]) >= threshold
    a, b, shared, most = a[ok], b[ok], shared[ok], np.minimum(x, y)[ok]
    ok = shared + one.left(a, most) * two.left(b, most) >= threshold
    return a[ok], b[ok]


def _scored(threshold: float, n: int | None, schema: pa.Schema):
    """(a, b, cosine) of the pairs of a tile that reach threshold. n: of how many documents counts make weights; none if weights are given."""

    def work(pairs: pa.Table, table: pa.Table) -> pa.Table:
        if not pairs.num_rows:
            return schema.empty_table()
        ids = table.column("id").combine_chunks()
        a, b = (pc.index_in(pairs.column(c).combine_chunks(), ids).to_numpy() for c in ("a", "b"))
        size = np.array([len(x) // 8 for x in table.column("t").to_pylist()], np.int64)
        doc = np.repeat(np.arange(len(size)), size)
        t = np.frombuffer(b"".join(table.column("t").to_pylist()), np.int64)
        parts = [np.frombuffer(x, np.float64 if n is None else f"u{len(x) // m}") for x, m in zip(table.column("c").to_pylist(), size.tolist(), strict=True)]
        w = np.concatenate(parts).astype(np.float64)
        if n is not None:
            w = _weights(w, np.frombuffer(b"".join(table.column("d").to_pylist()), np.uint32), n)
            w /= np.sqrt(np.bincount(doc, w * w))[doc]
        terms, t = np.unique(t, return_inverse=True)
        key = doc * len(terms) + t
        by = np.argsort(key)
        key, t, w = key[by], t[by], w[by]
        first = np.cumsum(size) - size
        x, y = np.where(size[a] <= size[b], a, b), np.where(size[a] <= size[b], b, a)
        total, cosine, k = np.concatenate([[0], np.cumsum(size[x])]), np.zeros(len(a)), 0
        while k < len(a):
            e = max(k + 1, int(np.searchsorted(total, total[k] + MEETINGS, "right")) - 1)
            pair = np.repeat(np.arange(e - k), size[x[k:e]])
            own = np.arange(len(pair)) + (first[x[k:e]] - total[k:e] + total[k])[pair]
            seek = y[k:e][pair] * len(terms) + t[own]
            at = np.minimum(np.searchsorted(key, seek), len(key) - 1)
            hit = key[at] == seek
            cosine[k:e] = np.bincount(pair[hit], w[own[hit]] * w[at[hit]], e - k)
            k = e
        ok = cosine >= threshold
        _trimmed()
        return pa.Table.from_arrays([*(pairs.column(c).filter(pa.array(ok)) for c in ("a", "b")), pa.array(cosine[ok])], schema=schema)

    return work


def vector_pairs(vectors: DataFrame, n: int | None, threshold: float, side: int = SIDE) -> DataFrame:
    """(a, b, cosine) with a < b for vectors of text_vectors or row_vectors (then n is None), which are deleted.

    Beginnings of vectors are held against each other in tiles, one for every two blocks of some side entries: a pair's
    meetings all lie in one tile, which adds them up and returns the pairs that may reach threshold. Then only vectors
    with such a partner are dealt, in tiles again, and scored. No pair at the threshold is lost.
    """
    kind = vectors.schema["id"].dataType
    arrow = pa.schema([("a", to_arrow_type(kind)), ("b", to_arrow_type(kind))])
    schema = T.StructType().add("a", kind).add("b", kind)
    entries = lambda df, c, width, most: max(3, -(-int(df.agg(F.sum(F.length(c))).first()[0] or 0) // (width * most)))
    begin = vectors.filter("id IS NOT NULL").select("id", "q", "r", "p")
    tiles = _grid(begin, F.col("id"), entries(vectors, "r", 1, side)).groupBy("i", "j")
    found = tiles.applyInArrow(_met(threshold, arrow), schema)
    pairs = saved(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    paired = saved(vectors.select("id", "t", "d", "c").join(ids, "id", "left_semi"))
    dropped(vectors)
    blocks = entries(paired, "t", 8, max(1, side // 2))
    g = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    pairs = pairs.withColumns({"i": F.least(g("a"), g("b")), "j": F.greatest(g("a"), g("b"))})
    score = _scored(threshold, n, arrow.append(pa.field("cosine", pa.float64())))
    return pairs.groupBy("i", "j").cogroup(_grid(paired, F.col("id"), blocks).drop("g").groupBy("i", "j")).applyInArrow(score, schema.add("cosine", "double"))
