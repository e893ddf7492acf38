"""Near duplicates by BagMinHash over multisets of word shingles.

A text is the multiset of its five-word shingles. For each distinct shingle, Poisson processes over the dyadic weight
intervals (0,1], (1,2], (2,4] ... up to its multiplicity yield points in order of time, each with a signature place and,
by halving its interval again and again, a weight; points above the multiplicity do not count. A place keeps its
earliest point, so two texts agree in a place with exactly the chance of their weighted Jaccard similarity. A shingle's
process stops where it is later than all places of its text. Bands of places are the buckets in which candidates meet.

Copies are folded into one node first, without regard to id. In each bucket the members are compared with one centre,
not with each other; the members of buckets that still hold several components are then searched for shared occurrences,
which loses no pair at the threshold. So every candidate pair at or above it ends in one component.
Similarities are exact multiset overlaps. Components come from label propagation with pointer jumping over written
tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .apply import annotated, gathered, whole_row
from .sets import shingles
from .store import dropped, saved, shipped
from .words import combine, mix

THRESHOLD = 0.8
BANDS, ROWS = 32, 7
#: Up to so many (id, text hash) keys are broadcast to pick texts; beyond, they are joined by shuffle.
BROADCAST_KEYS = 1_000_000


def signatures(row: np.ndarray, gram: np.ndarray, count: np.ndarray, texts: int, places: int = BANDS * ROWS) -> np.ndarray:
    """(texts, places): the earliest point of each place, as a hash; 0 for texts without shingles."""
    low = np.zeros(len(row))
    parts = []
    while True:  # one process for each dyadic interval that the multiplicity reaches into
        live = count > low
        if not live.any():
            break
        parts.append((row[live], gram[live], count[live].astype(float), low[live], np.maximum(low[live], 1)))
        low = np.where(live, np.maximum(low * 2, 1), np.inf)
    if not parts:
        return np.zeros((texts, places), np.uint64)
    row, gram, count, low, width = (np.concatenate(x) for x in zip(*parts, strict=True))
    key = mix(gram ^ mix(low.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)))
    best = np.full(texts * places, np.inf)
    time, unit = np.zeros(len(row)), 1 / (width * places)
    latest = np.full(texts, np.inf)
    turn = np.uint64(0)
    with np.errstate(over="ignore"):
        while len(row):
            turn += np.uint64(1)
            bits = mix(key + turn * np.uint64(0x9E3779B97F4A7C15))
            time = time - np.log(((bits >> np.uint64(11)).astype(float) + 1) / 2.0**53) * unit
            early = time < latest[row]
            if not early.all():
                row, key, count, low, width, time, unit, bits = (x[early] for x in (row, key, count, low, width, time, unit, bits))
            more = mix(bits ^ np.uint64(0xD6E8FEB86659FD93))
            place = (more >> np.uint64(40)).astype(np.int64) % places
            # The weight at which a point falls: its bits say which half of which half of the interval.
            weight = low + width * ((more & np.uint64((1 << 40) - 1)).astype(float) + 1) / 2.0**40
            inside = weight <= count
            np.minimum.at(best, row[inside] * places + place[inside], time[inside])
            touched = np.unique(row[inside])
            latest[touched] = best.reshape(texts, places)[touched].max(1)
    out = mix(best.view(np.uint64)).reshape(texts, places)
    out[np.isinf(best).reshape(texts, places)] = 0
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(texts, bands): one hash of the places of each band and its number."""
    texts, places = signature.shape
    parts = signature.reshape(texts, bands, places // bands)
    number = np.broadcast_to(np.arange(bands, dtype=np.uint64), (texts, bands)).ravel()
    return combine(number, *(parts[:, :, k].ravel() for k in range(places // bands))).reshape(texts, bands)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).view(np.int64)))


def _sign():
    def work(text):
        row, gram, count, size, marks = shingles(text)
        keys = band_keys(signatures(row, gram, count, len(size)))
        full = size > 0
        return [[m.tobytes() for m in marks], _lists(keys[full].ravel(), np.where(full, BANDS, 0))]

    return work


def _multiset():
    def work(text, node):
        row, gram, count, size, _ = shingles(text)
        many = np.repeat(np.arange(len(row)), count)
        nth = (np.arange(len(many)) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint64)
        with np.errstate(over="ignore"):
            each = np.where(nth == 0, gram[many], mix(gram[many] + nth * np.uint64(0x9E3779B97F4A7C15)))
        return {"node": node, "items": _lists(each, np.bincount(row[many], minlength=len(size)))}

    return work


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each node's component, over edges (a, b)."""
    both = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m"))
        low = saved(label.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label")))
        up = low.select(F.col("node").alias("at"), F.col("label").alias("up"))
        new = saved(low.join(up, F.col("label") == F.col("at"), "left").select("node", "old", F.least("label", "up").alias("label")))
        done = new.filter("label <> old").isEmpty()
        dropped(label, low)
        label = new.select("node", "label")
        label._saved_path = new._saved_path
        if done:
            dropped(both)
            return label


def joined(label: DataFrame, edges: DataFrame) -> DataFrame:
    """label with the components that edges (a, b) join made one. Only edges between components count, and each pair of components once."""
    of = lambda c: label.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    links = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    links = saved(links.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    top = components(links).withColumnRenamed("node", "at").withColumnRenamed("label", "up")
    nodes = label.select("node", "label").unionByName(top.select(F.col("at").alias("node"), F.col("at").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))
    out = saved(nodes.join(top, F.col("label") == F.col("at"), "left").select("node", F.coalesce("up", "label").alias("label")))
    dropped(links)
    return out


def across(rest: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose links make the components of all links between sets of rest (node, items), which are alike by threshold.

    The items of a multiset are a set once each has its number among equal ones. Sets that may be alike share a segment and are
    searched by occurrences, as in jaccard: what a template's texts have in common is one list, so that texts of one template
    that are not alike cost no more than themselves, and no item's texts are held against each other.
    """
    percent = round(100 * threshold)
    kept = rest.select("node", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                n, gram = _flat(part.column(1))
                out = jaccard.met_in(part.column(0).to_numpy(), np.repeat(np.arange(len(n)), n), gram, n, percent)
                yield pa.RecordBatch.from_pydict(out)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gram = _flat(batch.column(1))
            ends = np.cumsum(n)
            yield pa.RecordBatch.from_pydict({"mark": [str(k).encode() for k in batch.column(0).to_pylist()], "body": [gram[e - m : e].tobytes() for e, m in zip(ends, n, strict=True)]})

    shipped(rest.sparkSession)
    label = jaccard.met_components(kept.mapInArrow(run, jaccard.MET))
    mark = F.col("node").cast("string").cast("binary").alias("mark")
    near = saved(rest.join(label.select("node", F.col("label").alias("near")), "node").select(F.col("near").alias("label"), mark, F.size("items").alias("n"), F.lit(1).cast("long").alias("times")))
    found = jaccard.searched(near, kept.mapInArrow(pack, "mark binary, body binary"), percent)
    long = lambda c: F.col(c).cast("string").cast("long")
    out = saved(found.filter("mark <> root").select(long("mark").alias("a"), long("root").alias("b")).distinct())
    dropped(near, found)
    return out


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of lists of longs and their values as unsigned ones."""
    return np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy().view(np.uint64)


def _picked(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of docs (doc_id, loc, text) with a key of keys (id, loc, node), with node."""
    small = keys.count() <= BROADCAST_KEYS
    keys = keys.withColumnRenamed("loc", "at")
    return docs.join(F.broadcast(keys) if small else keys, (F.col("doc_id").eqNullSafe(F.col("id"))) & (F.col("loc") == F.col("at"))).select("node", "text")


def _assigned(docs: DataFrame, threshold: float) -> DataFrame:
    """(rid, doc_id, loc, class_id, class_size, kept) of each row of docs (doc_id, text)."""
    rows = docs.withColumn("loc", F.xxhash64("text"))
    signed = saved(annotated(rows, "text", ["doc_id", "loc"], "mark binary, bands array<long>", _sign).withColumn("rid", F.monotonically_increasing_id()))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    full = F.size("bands") > 0
    nodes = saved(signed.filter(full).groupBy("mark").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "loc", "bands")).alias("x")).select("mark", F.monotonically_increasing_id().alias("node"), F.col("x.doc_id").alias("id"), "x.loc", "x.bands"))
    members = nodes.select("node", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min_by("node", F.xxhash64("node")).alias("centre")).filter("n > 1").select("key", "centre")
    bucket = saved(members.join(shared, "key"))
    stars = saved(bucket.filter("node <> centre").groupBy(F.col("node").alias("a"), F.col("centre").alias("b")).agg(F.count(F.lit(1)).alias("n")))
    asked = stars.select(F.col("a").alias("node")).unionByName(stars.select(F.col("b").alias("node"))).distinct()
    keys = saved(nodes.select("node", "id", "loc").join(asked, "node"))
    items = saved(gathered(_picked(rows, keys), "text", ["node"], "node long, items array<long>", _multiset).groupBy("node").agg(F.min("items").alias("items")))
    dropped(keys)

    def compared(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) with their exact weighted Jaccard distance."""
        left = pairs.select("a", "b").join(items.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
        both = left.join(items.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        return saved(both.select("a", "b", (1 - common / (F.size("x") + F.size("y") - common)).alias("d")))

    def apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
        """The pairs whose ends no component joins."""
        pairs = pairs.join(label.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").join(label.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
        return pairs.filter(~F.coalesce(F.col("la") == F.col("lb"), F.lit(False)))

    most = 1 - threshold + 1e-9
    first = compared(stars.groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b")))
    label = components(first.filter(F.col("d") <= most))
    second = compared(saved(apart(stars.join(first.select("a", "b"), ["a", "b"], "left_anti"), label).select("a", "b")))
    label = joined(label, second.filter(F.col("d") <= most).select("a", "b"))
    # What is left: members of buckets that hold several components.
    spread = bucket.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = spread.groupBy("key").agg((F.min("label") != F.max("label")).alias("several"), F.count(F.lit(1)).alias("n")).filter("several and n > 2").select("key")
    rest = saved(spread.join(several, "key").select("node").distinct().join(items, "node"))
    third = across(rest, threshold)
    if not third.isEmpty():
        label = joined(label, third)
    of = saved(nodes.select("mark", "node").join(label, "node", "left").select("mark", F.coalesce("label", "node").alias("class")))
    dropped(bucket, stars, items, first, second, rest, third)
    placed = signed.select("rid", "doc_id", "loc", "mark", full.alias("full"))
    placed = saved(placed.join(of, "mark", "left").select("rid", "doc_id", "loc", F.coalesce(F.when(F.col("full"), F.col("class")), -1 - F.col("rid")).alias("class")))
    dropped(signed, nodes, of)
    classes = saved(placed.groupBy("class").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("class_size")))
    return placed.join(classes, "class").select("rid", "doc_id", "loc", F.col("best.doc_id").alias("class_id"), "class_size", (F.col("rid") == F.col("best.rid")).alias("kept"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id (the least id of its class), class_size, kept (true for one row a class).

    Classes are the connected components of pairs at or above threshold. Null texts and texts without words are alone.
    A class without ids has a null class_id; of repeated rows, and of rows that tie for the least id, one is kept. Texts
    of any length are read whole. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    return _assigned(docs.select("doc_id", "text"), threshold).select("doc_id", "class_id", "class_size", "kept")


def without_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class, in its own columns, whatever their names."""
    found = _assigned(docs.select("doc_id", "text"), threshold)
    found = saved(found.select(F.col("doc_id").alias("id"), F.col("loc").alias("of"), "kept"))
    keys = saved(found.groupBy("id", "of").agg(F.bool_or("kept").alias("some"), (~F.bool_and("kept")).alias("less")).filter("less").select("id", "of", "some"))
    dropped(found)
    small = keys.count() <= BROADCAST_KEYS
    rows = docs.select(whole_row(docs), "doc_id", F.xxhash64("text").alias("loc"))
    join = lambda k: F.broadcast(k) if small else k
    match = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("loc") == F.col("of"))
    clean = rows.join(join(keys), match, "left_anti")
    # Repeated rows of which one stays.
    twins = rows.join(join(keys.filter("some")), match, "left_semi").dropDuplicates(["doc_id", "loc"])
    return clean.unionByName(twins).select("row.*")
