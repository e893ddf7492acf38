"""N-gram Jaccard join: every link between texts whose sets of word shingles are alike, by T-occurrence search.

A set that is to be found must share T of a query's shingles. In a tile of sets each shingle has an inverted list; a query
merges its short lists, which yields the few sets with enough occurrences, and probes its long lists for these alone
(DivideSkip). Shingles with the same inverted list are one list with a weight, so that what many copies share is merged
or probed once.

Which sets can meet at all is found by the pigeonhole principle. If two sets differ in at most D shingles, and the
universe is dealt into more than D segments, both have the same shingles in some segment. Sizes fall in bands, and D
follows from a band's largest size; a set joins the next band too if a partner may lie there. Sets that share a
segment lie in one component, whose sets are searched together: small components many to a task, large ones in tiles of
bounded size, each pair of blocks of compatible sizes once. Components only limit what is compared: they hold every link and more.
Each tile passes on one row a set (its least partner in the tile and how many links it has), never its pairs.

Equal sets are one from the start, as their fingerprint names them; a fingerprint has 128 bits, a shingle within a pair 64.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .apply import annotated, gathered, quoted, trimmed
from .sets import shingles
from .store import dropped, saved, shipped
from .words import combine, mix

SHINGLE, PERCENT = 4, 85
#: Shingles in a block of a large component; a task holds two blocks at most.
BLOCK = 1_000_000
#: A set's lists count as long up to T / (PROBE * log2(longest list) + 1) occurrences.
PROBE = 0.0085
#: Short lists with at most so many entries are merged through a heap of their heads; more, by merging sorted runs.
HEAP = 256
#: Lists that hold at least one in DENSE sets of a tile are probed by position instead of by bisection.
DENSE = 16
#: Bits of the filter that is broadcast to pick the sets that may have partners. It lets all through that have, and more of the others the more sets there are.
FILTER_BITS, FILTER_HASHES = 1 << 25, 4


def bands(percent: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest sizes of the bands up to size most (a set's partners are at most one band away), and how many shingles two sets of a band, or of it and the band below, may differ in."""
    tops = [1]
    while tops[-1] < most:
        tops.append(max(tops[-1] * 100 // percent, tops[-1] + 1, tops[-1] * 5 // 4))
    top = np.array(tops, np.int64)
    # Linked sets of a and b shingles share percent / (100 + percent) * (a + b) or more.
    return top, 2 * top * (100 - percent) // (100 + percent)


def sets(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each distinct shingle: its text's number and its hash, ascending; then each text's set size and the 128-bit fingerprint (n, 2) of its set."""
    row, gram, _, size, _ = shingles(text, SHINGLE)
    n = np.bincount(row, minlength=len(size))
    marks = np.zeros((len(size), 2), np.uint64)
    with np.errstate(over="ignore"):
        for k, seed in enumerate((0xA0761D6478BD642F, 0xE7037ED1A0B428DB)):
            np.add.at(marks[:, k], row, mix(gram ^ np.uint64(seed)))
            marks[:, k] = mix(marks[:, k] + n.astype(np.uint64))
    return row, gram, n, marks


def segment_keys(row: np.ndarray, gram: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, key) for each segment in which a text may agree with a partner. Any two texts that link, and differ, share a key."""
    top, differ = bands(percent, 2 * int(n.max(initial=1)) + 2)
    band = np.searchsorted(top, n)
    out_row, out_key = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for up in (0, 1):
        at = band + up
        live = (n > 0) & (differ[at] > 0) & ((up == 0) | (n * 100 // percent > top[band]))
        segments = np.where(live, differ[at] + 2 + differ[at] // 12, 0)
        first = np.concatenate([[0], np.cumsum(segments)])
        take = live[row]
        r, g = row[take], gram[take]
        place = first[r] + (mix(g ^ mix(at[r].astype(np.uint64))) % np.maximum(segments[r], 1).astype(np.uint64)).astype(np.int64)
        sums = np.zeros(first[-1], np.uint64)
        with np.errstate(over="ignore"):
            np.add.at(sums, place, mix(g + np.uint64(0x2545F4914F6CDD1D)))
        count = np.bincount(place, minlength=first[-1])
        owner = np.repeat(np.arange(len(n)), segments)
        number = np.arange(first[-1]) - first[owner]
        # Empty segments agree without saying anything. They are needed only where all others may differ.
        full = np.bincount(owner, weights=count > 0, minlength=len(n)).astype(np.int64)
        use = (count > 0) | (full <= differ[at])[owner]
        owner, number, sums, count = owner[use], number[use], sums[use], count[use]
        out_row.append(owner)
        out_key.append(combine(at[owner].astype(np.uint64), number.astype(np.uint64), sums, count.astype(np.uint64)))
    return np.concatenate(out_row), np.concatenate(out_key)


def merged(lists: list[np.ndarray], weights: list[int], upto: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets that lie in sorted lists, ascending, and the weight of the lists that hold them; all are below upto."""
    if sum(map(len, lists)) <= HEAP:
        heads = heapq.merge(*(zip(x.tolist(), [w] * len(x), strict=True) for x, w in zip(lists, weights, strict=True)))
        found = [(k, sum(w for _, w in g)) for k, g in groupby(heads, key=lambda x: x[0])]
        return np.array([k for k, _ in found], np.int64), np.array([w for _, w in found], np.int64)
    sums = np.bincount(np.concatenate(lists), np.repeat(weights, [len(x) for x in lists]), upto)
    at = np.flatnonzero(sums)
    return at, sums[at].astype(np.int64)


class Tile:
    """The inverted lists of sets; equal lists are one list with a weight."""

    def __init__(self, grams: list[np.ndarray]):
        self.n = np.array([len(g) for g in grams], np.int64)
        every, doc = np.concatenate(grams), np.repeat(np.arange(len(grams)), self.n)
        order = np.argsort(every, kind="stable")
        every, doc = every[order], doc[order]
        starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        size = np.diff(np.append(starts, len(every)))
        with np.errstate(over="ignore"):
            names = [np.add.reduceat(mix(doc.astype(np.uint64) + np.uint64(s)), starts) for s in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
        shared = np.flatnonzero(size > 1)
        _, one, self.weight = np.unique(np.stack([names[0][shared], names[1][shared]], 1), axis=0, return_index=True, return_counts=True)
        self.lists = [doc[starts[k] : starts[k] + size[k]] for k in shared[one]]
        sizes = np.array([len(x) for x in self.lists], np.int64)
        # The lists that each set is in.
        inside = np.concatenate([*self.lists, np.zeros(0, np.int64)])
        at = np.argsort(inside, kind="stable")
        self.of = np.split(np.repeat(np.arange(len(sizes)), sizes)[at], np.cumsum(np.bincount(inside, minlength=len(grams)))[:-1])
        self.flags = {}
        for c in np.flatnonzero(sizes * DENSE >= len(grams)):
            self.flags[int(c)] = np.zeros(len(grams), bool)
            self.flags[int(c)][self.lists[c]] = True

    def partners(self, q: int, low: int, high: int, percent: int) -> np.ndarray:
        """The sets from low to high (exclusive) that link with set q."""
        need = -(-percent * int(self.n[q]) // 100)
        mine = self.of[q]
        if self.weight[mine].sum() < need:
            return np.zeros(0, np.int64)
        cut = [(x := self.lists[c])[np.searchsorted(x, low) : np.searchsorted(x, high)] for c in mine]
        size, weight = np.array([len(x) for x in cut]), self.weight[mine]
        order = np.argsort(size, kind="stable")
        longest = max(2, int(size[order[-1]]))
        limit = min(need - 1, need / (PROBE * np.log2(longest) + 1))
        # From the longest list down, as long as the others must still hold one occurrence of what is looked for.
        tail = np.cumsum(weight[order][::-1])
        long = order[::-1][: int(np.searchsorted(tail, limit, "right"))]
        short = order[: len(order) - len(long)]
        rest = int(weight[long].sum())
        found, have = merged([cut[k] for k in short], weight[short].tolist(), high)
        ok = have >= need - rest
        found, have = found[ok], have[ok]
        for k in long:
            if not len(found):
                break
            flags = self.flags.get(int(mine[k]))
            if flags is not None:
                hit = flags[found]
            else:
                at = np.searchsorted(cut[k], found)
                hit = cut[k][np.minimum(at, len(cut[k]) - 1)] == found if len(cut[k]) else np.zeros(len(found), bool)
            rest -= int(weight[k])
            have = have + weight[k] * hit
            ok = have >= need - rest
            if not ok.all():
                found, have = found[ok], have[ok]
        return found[100 * have >= percent * (self.n[q] + self.n[found] - have)]


def tile_links(grams: list[np.ndarray], times: np.ndarray, split: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each set: the first set that links join it with in this tile, and how many rows it links with. times: rows of each set.

    The first split sets are one block and the others another, both ascending by size; sets of one block are compared with those of the
    other. Without a split (0) all are one block, and each is compared with those before it.
    """
    tile = Tile(grams)
    root, links = np.arange(len(grams)), np.zeros(len(grams), np.int64)

    def tops(at: np.ndarray) -> np.ndarray:
        while True:
            up = root[at]
            if (up == root[up]).all():
                return np.unique(up)
            root[at] = root[up]

    for q in range(split or 1, len(grams)):
        n = int(tile.n[q])
        sizes = tile.n[: split or q]
        low, high = np.searchsorted(sizes, -(-percent * n // 100)), np.searchsorted(sizes, n * 100 // percent, "right")
        found = tile.partners(q, int(low), int(high), percent)
        if len(found):
            links[q] += times[found].sum()
            links[found] += times[q]
            up = tops(np.append(found, q))
            root[up] = up[0]
    while (root != root[root]).any():
        root = root[root]
    return root, links


#: Columns of rows that say which sets share a segment: a key and a set's node, or two nodes that share one.
MET = "key long, node long, other long"


def met_in(node: np.ndarray, row: np.ndarray, gram: np.ndarray, n: np.ndarray, percent: int) -> dict[str, pa.Array]:
    """Rows of MET for sets (row, gram, n) and the node of each."""
    owner, key = segment_keys(row, gram, n, percent)
    node = node[owner]
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    # Of a key's nodes in this slice one goes on; the others are joined to it here.
    new = np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]])
    first = node[np.flatnonzero(new)][np.cumsum(new) - 1] if len(key) else node
    pairs = np.unique(np.stack([node, first], 1)[~new & (node != first)], axis=0)
    keys = np.concatenate([key[new].view(np.int64), pairs[:, 0]])
    nodes = np.concatenate([node[new], pairs[:, 0]])
    return {"key": pa.array(keys), "node": pa.array(nodes), "other": pa.concat_arrays([pa.nulls(int(new.sum()), pa.int64()), pa.array(pairs[:, 1])])}


def _keys(percent: int):
    def work(text):
        row, gram, n, marks = sets(text)
        return met_in(marks[:, 0].view(np.int64), row, gram, n, percent)

    return work


def met_components(met: DataFrame) -> DataFrame:
    """(node, label): the components of nodes that share a segment, from rows of MET. Nodes that share none with others are left out."""
    before = F.lag("node").over(Window.partitionBy("key").orderBy("node"))
    edges = met.select("node", F.coalesce("other", F.when(F.col("other").isNull(), before)).alias("other")).filter("node <> other")
    edges = saved(edges.select(F.col("node").alias("a"), F.col("other").alias("b")).distinct())
    label = components(edges)
    dropped(edges)
    return label


def searched(near: DataFrame, bodies: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """(mark, root, links), for each tile that a set lies in: the first set that links join it with there, and with how many rows it links. near: (label, mark, n, times) of each set; bodies: (mark, body), its shingles as sorted bytes of 64 bits, once or more often."""
    tiles = _tiles(near, percent, block).hint("merge").join(bodies, "mark").select("tile", "n", "mark", "times", "side", "body")
    return saved(_searched(tiles.repartition("tile").sortWithinPartitions("tile", "side", "n", "mark"), percent))


def _sized():
    def work(text):
        _, _, n, marks = sets(text)
        return [pa.array(n), [m.tobytes() for m in marks], pa.array(marks[:, 0].view(np.int64))]

    return work


def filter_bits(nodes: np.ndarray) -> np.ndarray:
    """(nodes, FILTER_HASHES): the bits of the filter that stand for each node."""
    seeds = np.arange(1, FILTER_HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        return (mix(nodes[:, None] + seeds) % np.uint64(FILTER_BITS)).astype(np.int64)


def _filter(nodes: DataFrame) -> np.ndarray:
    """The filter's bits, of nodes (node); tasks set bits in words of 64, of which there are a fixed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            flags[filter_bits(batch.column(0).to_numpy().view(np.uint64)).ravel()] = True
        words = np.packbits(flags, bitorder="little").view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], ["at", "word"])

    shipped(nodes.sparkSession)
    words = nodes.mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words.column("at").to_numpy()] = words.column("word").to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of edges (a, b), by contraction: each node moves to its least neighbour, and edges between what is left go on; these become fewer from round to round."""
    live, label = edges, None
    while True:
        both = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up"))
        top = low.select(F.col("node").alias("at"), F.col("up").alias("top"))
        # One step further along, since a least neighbour often has a lesser one.
        moved = saved(low.join(top, F.col("up") == F.col("at"), "left").select("node", F.least("up", "top").alias("up")))
        new = moved.select("node", F.col("up").alias("label"))
        if label is not None:
            step = moved.select(F.col("node").alias("at"), "up")
            new = label.join(step, F.col("label") == F.col("at"), "left").select("node", F.coalesce("up", "label").alias("label"))
        new = saved(new)
        of = lambda c: moved.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up"))  # noqa: B023, E731
        rest = live.join(of("a"), "a").join(of("b"), "b").filter("a_up <> b_up")
        rest = saved(rest.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct())
        done = rest.isEmpty()
        dropped(moved, *([label, live] if label is not None else []))
        live, label = rest, new
        if done:
            dropped(rest)
            return label


def _bodies(wanted):
    def work(text):
        row, gram, n, marks = sets(text)
        first = np.concatenate([[0], np.cumsum(n)])
        _, one = np.unique(marks, axis=0, return_index=True)
        one = one[wanted.value[filter_bits(marks[one, 0])].all(1)]
        return {"mark": [marks[i].tobytes() for i in one], "body": [gram[first[i] : first[i + 1]].tobytes() for i in one]}

    return work


def _searched(rows: DataFrame, percent: int) -> DataFrame:
    """(mark, root, links) of rows (tile, n, mark, times, side, body), which lie together by tile, and in it by side, n and mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def done() -> pa.RecordBatch:
            marks = [h[1] for h in held]
            root, links = tile_links([np.frombuffer(h[4], np.uint64) for h in held], np.array([h[2] for h in held]), sum(h[3] == 0 for h in held), percent)
            return pa.RecordBatch.from_arrays([pa.array(marks, pa.binary()), pa.array([marks[r] for r in root], pa.binary()), pa.array(links, pa.int64())], ["mark", "root", "links"])

        tile = None
        for batch in batches:
            for at in range(batch.num_rows):
                row = tuple(batch.column(i)[at].as_py() for i in range(6))
                if row[0] != tile:
                    if held:
                        yield done()
                    held, tile = [], row[0]
                if not held or held[-1][1] != row[2]:  # a set may come from several tasks
                    held.append(row[1:])
        if held:
            yield done()
        trimmed()

    shipped(rows.sparkSession)
    return rows.mapInArrow(run, "mark binary, root binary, links long")


def _tiles(sizes: DataFrame, percent: int, block: int) -> DataFrame:
    """(mark, n, times, tile, side) of sizes (label, mark, n, times): the tiles in which each set is searched; side is 0 or 1 in a tile of two blocks, 2 in a tile of one.

    A component's sizes are dealt in blocks of about block shingles in order of size; a size with more than that is dealt by its
    sets' fingerprints.
    """
    counts = sizes.groupBy("label", "n").agg((F.count(F.lit(1)) * F.col("n")).alias("weight"))
    upto = F.sum("weight").over(Window.partitionBy("label").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("at", F.floor(F.coalesce(upto, F.lit(0)) / block)).withColumn("parts", F.ceil(F.col("weight") / block))
    placed = sizes.join(counts.select("label", "n", "at", "parts"), ["label", "n"])
    placed = saved(placed.select("label", "mark", "n", "times", (F.col("at") + F.pmod(F.xxhash64("mark"), "parts")).alias("block")))
    blocks = saved(placed.groupBy("label", "block").agg(F.min("n").alias("least"), F.max("n").alias("most")))
    one = blocks.select("label", F.col("block").alias("i"), F.col("most").alias("most_i"), F.col("least").alias("least_i"))
    two = blocks.select("label", F.col("block").alias("j"), F.col("most").alias("most_j"), F.col("least").alias("least_j"))
    fits = (F.col("most_i") * 100 >= F.col("least_j") * percent) & (F.col("most_j") * 100 >= F.col("least_i") * percent)
    # Only a component of several blocks has tiles of two.
    pairs = one.join(two, "label").filter((F.col("i") < F.col("j")) & fits)
    name = lambda i, j: F.xxhash64("label", i, j)
    sides = [blocks.select("label", "block", name("block", "block").alias("tile"), F.lit(2).alias("side"))]
    sides += [pairs.select("label", F.col(c).alias("block"), name("i", "j").alias("tile"), F.lit(k).alias("side")) for k, c in enumerate("ij")]
    dealt = sides[0].unionByName(sides[1]).unionByName(sides[2])
    return placed.join(dealt, ["label", "block"]).select("mark", "n", "times", "tile", "side")


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the least id that links reach), n_links (how many other rows it links with).

    Words are lower-cased in A-Z. Sets are the distinct shingles of SHINGLE words, or the whole sequence if it is shorter; null texts
    and texts without words have none and are alone. Two rows link if percent or more of the shingles of either are
    shared by both. Rows with equal texts, repeated rows too, link with each other and with the same others. A component without ids has a null component_id.
    Texts of any length are read whole. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    sized = saved(annotated(rows, "text", ["doc_id"], "n long, mark binary, node long", _sized))
    label = met_components(gathered(rows, "text", [], MET, lambda: _keys(percent)))
    whole = saved(sized.filter("n > 0").groupBy("mark", "node", "n").agg(F.count(F.lit(1)).alias("times"), F.min("doc_id").alias("least")))
    near = saved(whole.join(label, "node").select("label", "node", "mark", "n", "times"))
    # Sets are made again from the texts where these lie; only those that may have partners leave.
    wanted = docs.sparkSession.sparkContext.broadcast(_filter(near.select("node")))
    bodies = gathered(rows, "text", [], "mark binary, body binary", lambda: _bodies(wanted))
    found = searched(near, bodies, percent, block)
    stars = saved(found.filter("mark <> root").select(F.col("mark").alias("a"), F.col("root").alias("b")).distinct())
    top = components(stars)
    links = found.groupBy("mark").agg(F.sum("links").alias("links"))
    # All rows of a set: what they link with, and the least id that links reach.
    named = whole.join(top.select(F.col("node").alias("mark"), F.col("label").alias("root")), "mark", "left")
    named = saved(named.join(links, "mark", "left").select("mark", "least", F.coalesce("root", "mark").alias("root"), (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = saved(named.join(least, "root").select("mark", "component_id", "n_links"))
    dropped(near, found, stars)
    return sized.join(named, "mark", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
