"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words and word beginnings that mark labelled toxic texts, by smoothed log-odds less two
standard errors. Features are the lexicon's densities and extremes, its nearness to the second person, and rates of
capitals, punctuation, obfuscated and drawn-out words. The labelled rows fall in three parts by hash: the lexicon is
counted on the first, trees are grown on the second, and the calibration is fitted on the third. All three are
bounded: of each class at most SAMPLE rows are drawn, weighted back to the counts of all labels. Every text is
scored whole, where it lies.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import gbdt
from .apply import annotated, gathered, quoted, whole_row
from .store import dropped, saved
from .words import MARKS, buffers, word_hash, words

#: Labelled rows drawn of each class.
SAMPLE = 4000
#: Beginnings of words, in bytes, that enter the lexicon.
HEADS = (4, 5, 6)
NEAR = 5
#: Second-person words of the languages at hand.
SECOND = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "sie", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "tus", "usted", "ti", "eres")
FEATURES = 16
FOLDS = 5


def fold(id_: Column, folds: int = FOLDS) -> Column:
    """crc32 of the id as text, modulo folds; -1 for a null id."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % folds, F.lit(-1)).cast("int")


@dataclass
class Model:
    """lexicon: for words and each length of beginnings, sorted hashes and their weights."""

    lexicon: list[tuple[np.ndarray, np.ndarray]]
    trees: gbdt.Trees | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None
    prior: float = 0.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.prior)
        raw = self.trees.raw(x)
        return np.clip(0.99 * np.interp(raw, *self.knots) + 0.01 / (1 + np.exp(-raw)), 0.0, 1.0)


def _weights(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> np.ndarray:
    keys, weight = table
    if not len(keys):
        return np.zeros(len(hashes))
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, weight[at], 0.0)


def features(text: pa.Array, lexicon: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """One row of FEATURES values for each text."""
    data, offsets = buffers(text)
    n = len(offsets) - 1
    second = np.sort(np.array([word_hash(w) for w in SECOND]))
    total, hit, head, best, besth, near, you, shout = (np.zeros(n) for _ in range(8))
    # Numbers of marked words and of the second person's, with their rows, over all pieces: pairs may lie across a cut.
    marked, person, done = [], [], 0
    for starts, sizes, rows, hashes, *heads in words(data, offsets, HEADS, MARKS):
        count = lambda mask: np.bincount(rows[mask], minlength=n)  # noqa: B023, E731
        w = _weights(lexicon[0], hashes)
        h = np.max([_weights(t, x) for t, x in zip(lexicon[1:], heads, strict=True)], axis=0)
        is_you = second[np.minimum(np.searchsorted(second, hashes), len(second) - 1)] == hashes
        total += np.bincount(rows, minlength=n)
        hit += count(w > 0)
        head += count(h > 0)
        you += count(is_you)
        np.maximum.at(best, rows[w > 0], w[w > 0])
        np.maximum.at(besth, rows[h > 0], h[h > 0])
        for found, mask in ((marked, (w > 0) | (h > 0)), (person, is_you)):
            at = np.flatnonzero(mask)
            found.append(np.stack([at + done, rows[at]]))
        done += len(rows)
        upper = np.concatenate([[0], np.cumsum((data[starts[0] : starts[-1] + sizes[-1]] >= 65) & (data[starts[0] : starts[-1] + sizes[-1]] <= 90))])
        caps = upper[starts - starts[0] + sizes] - upper[starts - starts[0]]
        shout += count((caps == sizes) & (sizes > 1))
    (at, row), (yous, of) = (np.concatenate([np.zeros((2, 0), np.int64), *found], 1) for found in (marked, person))
    if len(at) and len(yous):
        k = np.searchsorted(yous, at)
        left, right = np.maximum(k - 1, 0), np.minimum(k, len(yous) - 1)
        close = ((np.abs(at - yous[left]) <= NEAR) & (of[left] == row)) | ((np.abs(yous[right] - at) <= NEAR) & (of[right] == row))
        near += np.bincount(row[close], minlength=n)
    low = data | 32
    letter = ((low >= 97) & (low <= 122)) | (data >= 128)
    per = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets]).astype(float)
    begins = np.zeros(len(data) + 2, bool)
    begins[offsets] = True
    inner = np.zeros(len(data), bool)
    inner[1:-1] = letter[:-2] & letter[2:] & ~letter[1:-1] & ~np.isin(data[1:-1], np.frombuffer(b" \t\n\r\x0b\x0c'-.,/:", np.uint8))
    inner &= ~begins[: len(data)] & ~begins[1 : len(data) + 1]
    drawn = np.zeros(len(data), bool)
    drawn[2:] = letter[2:] & (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & ~begins[1 : len(data) - 1] & ~begins[2 : len(data)]
    size, letters = np.maximum(per(np.ones(len(data), bool)), 1), np.maximum(per(letter), 1)
    t = np.maximum(total, 1)
    columns = [np.log1p(total), hit / t, np.log1p(hit), best, head / t, np.log1p(head), besth, near / np.maximum(hit + head, 1), near, you / t]
    columns += [per((data >= 65) & (data <= 90)) / letters, shout / t, per((data == 33) | (data == 63)) / size, per(MARKS[data] & (data > 32)) / size, per(inner) / t, per(drawn) / t]
    return np.stack(columns, 1)


def sample(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, size: int = SAMPLE) -> tuple[DataFrame | None, dict[int, int], dict[int, float]]:
    """At most size labelled texts of each class, drawn by hash among ids of the training folds; how many labels each class has; and what each row of a class stands for. None instead of texts without both classes.

    A label counts once however often it is repeated, and only where a document with a text has its id; an id that is
    labelled both ways has one label of each.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    usable = labels.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("toxic").cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    usable = usable.filter(fold(F.col("doc_id"), folds) != 0).distinct().join(docs.filter("text is not null").select("doc_id"), "doc_id", "left_semi")
    span = 1 << 40
    usable = saved(usable.withColumn("u", F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(span))))
    counts = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    if set(counts) != {0, 1}:
        dropped(usable)
        return None, counts, {}
    upto = F.when(F.col("y") == 1, F.lit(int(span * min(1, 1.3 * size / counts[1])))).otherwise(F.lit(int(span * min(1, 1.3 * size / counts[0]))))
    drawn = sorted(usable.filter(F.col("u") < upto).collect(), key=lambda r: (r["u"], r["doc_id"], r["y"]))
    dropped(usable)
    kept = [r for y in (0, 1) for r in [x for x in drawn if x["y"] == y][:size]]
    table = spark.createDataFrame([(r["doc_id"], r["y"], r["u"]) for r in kept], T.StructType([T.StructField("doc_id", kind), T.StructField("y", T.IntegerType()), T.StructField("u", T.LongType())]))
    texts = docs.filter("text is not null").join(F.broadcast(table), "doc_id").groupBy("doc_id", "y", "u").agg(F.min("text").alias("text"))
    share = {y: counts[y] / max(1, sum(r["y"] == y for r in kept)) for y in (0, 1)}
    return saved(texts.withColumn("part", F.when(F.col("u") % 20 < 8, 0).when(F.col("u") % 20 < 16, 1).otherwise(2))), counts, share


def learn_lexicon(part: DataFrame, least: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """Units in least toxic texts or more whose log-odds, less two standard errors, are above log 2. They are counted once a text and summed on the executors; only those kept reach the driver."""
    size = {r["y"]: r["count"] for r in part.groupBy("y").count().collect()}
    pos, neg = size.get(1, 0), size.get(0, 0)

    def make():
        def work(text, y):
            data, offsets = buffers(text)
            y, found = np.asarray(y), []
            for _, _, rows, hashes, *heads in words(data, offsets, HEADS, MARKS):
                for kind, h in enumerate((hashes, *heads)):
                    found.append(np.stack([np.full(len(h), kind, np.uint64), rows.astype(np.uint64), h], 1)[h != 0])
            if not found:
                return {"kind": [], "unit": [], "a": [], "b": []}
            once = np.unique(np.concatenate(found), axis=0)
            toxic = y[once[:, 1].astype(np.int64)] == 1
            units, inverse = np.unique(once[:, [0, 2]], axis=0, return_inverse=True)
            inverse = inverse.ravel()
            a, b = np.bincount(inverse[toxic], minlength=len(units)), np.bincount(inverse[~toxic], minlength=len(units))
            return {"kind": units[:, 0].astype(np.int32), "unit": units[:, 1].view(np.int64) if units[:, 1].flags.c_contiguous else np.ascontiguousarray(units[:, 1]).view(np.int64), "a": a, "b": b}

        return work

    counts = gathered(part, "text", ["y"], "kind int, unit long, a long, b long", make).groupBy("kind", "unit").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    odds = F.log((F.col("a") + 0.5) / (pos + 1)) - F.log((F.col("b") + 0.5) / (neg + 1))
    sure = odds - 2 * F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    kept = counts.filter((F.col("a") >= least) & (sure > float(np.log(2)))).select("kind", "unit", odds.alias("w")).collect()
    out = []
    for kind in range(1 + len(HEADS)):
        mine = sorted((int(r["unit"]) & (2**64 - 1), r["w"]) for r in kept if r["kind"] == kind)
        out.append((np.array([u for u, _ in mine], np.uint64), np.array([w for _, w in mine])))
    return out


def train(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, size: int = SAMPLE) -> Model:
    """The model of docs (doc_id, text) and labels (doc_id, toxic). Where the trees or their calibration would see one class only, it gives every text the mean of the labels."""
    texts, counts, share = sample(docs, labels, folds, size)
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    if texts is None:
        return Model([], prior=prior)
    lexicon = learn_lexicon(texts.filter("part = 0"))

    def make():
        return lambda text, y, part: {"y": y.to_pylist(), "part": part.to_pylist(), "x": features(text, lexicon).tolist()}

    rows = gathered(texts.filter("part > 0").coalesce(64), "text", ["y", "part"], "y int, part int, x array<double>", make).collect()
    dropped(texts)
    rows = sorted(((r["part"], r["y"], r["x"]) for r in rows), key=str)
    cols = [(np.array([r[2] for r in rows if r[0] == p]), np.array([float(r[1]) for r in rows if r[0] == p])) for p in (1, 2)]
    if any(len(set(y)) < 2 for _, y in cols):
        return Model([], prior=prior)
    weight = [np.where(y == 1, share[1], share[0]) for _, y in cols]
    trees = gbdt.fit(*cols[0], weight[0] / weight[0].mean())
    return Model(lexicon, trees, gbdt.isotonic(trees.raw(cols[1][0]), cols[1][1], weight[1]))


def scored(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The columns keep of docs and the calibrated score of each whole text; a kept column of the score's name gives way to it."""
    if model.trees is None:
        return docs.select(*(quoted(c) for c in keep if c.lower() != score_col.lower()), F.lit(model.prior).alias(score_col))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = sent.value
        return lambda text: [m.scores(features(text, m.lexicon))]

    return annotated(docs, text_col, keep, f"`{score_col}` double", make)


def untoxic(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of docs whose score is below limit, in their own columns, whatever their names."""
    rows = docs.select(whole_row(docs), quoted(text_col).alias("text"))
    return scored(rows, model, ["row"]).filter(F.col("score") < limit).select("row.*")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts are scored like any other; very long ones are read whole, in pieces; rows without an id are
    scored and not held out; repeated rows are scored each and learned from once, and of rows with one id the least
    text is. Ids may be of any type that orders. Labels other than 0 and 1, and those of absent documents, are
    ignored; a repeated label row counts once. Ties at a draw's end go by hash, then id. With too few labels for both
    classes to reach the trees and their calibration the score is the labels' mean (0 for none). An empty table gives
    an empty result. Other columns are ignored, whatever their names.
    """
    rows = docs.select("doc_id", "text")
    out = scored(rows, train(rows, labels), ["doc_id"])
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
