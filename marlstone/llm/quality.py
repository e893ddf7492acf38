"""Quality from weak labels: expectation-maximisation over heuristic labellers, then a hashed linear scorer.

Overlapping heuristics vote good, bad or nothing on every text. All texts' vote patterns are counted (a table of at most
3^11 rows), and expectation-maximisation on the counts estimates how often each heuristic votes what on good
and on bad texts. The posterior labels of a bounded sample of texts, drawn by hash, train a logistic scorer over
hashed words and word shapes, which scores every text whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .apply import annotated, gathered
from .words import BLANK, buffers, mix, words

#: Texts that train the scorer; buckets of hashed words and, after them, of shapes.
SAMPLE, BUCKETS, SHAPES = 4000, 1 << 14, 1 << 10
LINES = np.zeros(256, bool)
LINES[10] = True
#: Rows of a slice, in the low bits of a key whose high bits are a hash; a slice has fewer rows.
ROW_MASK, NONE = np.uint64((1 << 20) - 1), np.zeros(0, np.uint64)
#: By byte: marks that are no letter, digit or byte of a longer character; those outside plain prose; ends of sentences; and the kinds that shapes tell apart.
MARK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
ODD = MARK & ~BLANK & ~np.isin(np.arange(256), list(b".,;:'\"!?()-"))
STOP = np.isin(np.arange(256), list(b".!?"))
UPPER = np.array([65 <= b <= 90 for b in range(256)])
LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
KIND = np.array([4 if b >= 128 else 1 if 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else b for b in range(256)], np.uint64)
LABELLERS = ("length", "word_size", "short_words", "capitals", "symbols", "tails", "ends", "lines", "variety", "lone_marks", "runs")


def _keyed(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashes and their rows in one integer each, which sort at once."""
    return (hashes & ~ROW_MASK) | rows.astype(np.uint64)


def _again(rows: np.ndarray, hashes: np.ndarray, last: tuple | None) -> np.ndarray:
    """Whether each word is the one before it in its text once more; last: row and hash of the word before the first."""
    out = np.zeros(len(rows), bool)
    out[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    out[0] = last is not None and last == (rows[0], hashes[0])
    return out


def votes(text: pa.Array) -> np.ndarray:
    """One row a text: 1 (good), -1 (bad) or 0 for each of LABELLERS."""
    data, offsets = buffers(text)
    n = len(offsets) - 1
    total, short, tail, stop, lone, runs = (np.zeros(n) for _ in range(6))
    mark = MARK[data]
    seen, last = [NONE], None
    for starts, sizes, rows, hashes in words(data, offsets):
        total += np.bincount(rows, minlength=n)
        short += np.bincount(rows[sizes <= 3], minlength=n)
        ends = starts + sizes - 1
        tail += np.bincount(rows[(sizes > 1) & mark[ends] & mark[ends - 1]], minlength=n)
        stop += np.bincount(rows[STOP[data[ends]]], minlength=n)
        lone += np.bincount(rows[(sizes == 1) & mark[starts]], minlength=n)
        again = _again(rows, hashes, last)
        last = (rows[-1], hashes[-1])
        runs += np.bincount(rows[again], minlength=n)
        seen.append(_keyed(rows, hashes))
    kinds = np.bincount((np.unique(np.concatenate(seen)) & ROW_MASK).astype(np.int64), minlength=n).astype(float)
    keys = [NONE, *(_keyed(rows, hashes)[sizes >= 12] for _, sizes, rows, hashes in words(data, offsets, gaps=LINES))]
    each, count = np.unique(np.concatenate(keys), return_counts=True)
    owner = (each & ROW_MASK).astype(np.int64)
    line, again = np.bincount(owner, count, n), np.bincount(owner, count - 1, n)
    per = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets]).astype(float)
    solid = np.maximum(per(~BLANK[data]), 1)
    letters = np.maximum(per(LETTER[data]), 1)
    t = np.maximum(total, 1)
    caps, symbols = per(UPPER[data]) / letters, per(ODD[data]) / solid
    split = lambda good, bad: np.where(bad, -1, np.where(good, 1, 0))
    size = solid / t
    out = [
        split(total >= 50, total < 8),
        split((size >= 3) & (size <= 9), (size < 2) | (size > 14)),
        split((short / t >= 0.1) & (short / t <= 0.7), (short / t < 0.02) | (short / t > 0.9)),
        split(caps <= 0.15, caps > 0.5),
        split(symbols <= 0.02, symbols > 0.1),
        split(tail / t <= 0.03, tail / t > 0.3),
        split((stop / t >= 0.01) & (stop / t <= 0.4), (stop / t > 0.7) | ((stop == 0) & (total >= 60))),
        split((again <= 0.05 * line) & (line > 0), again > 0.4 * line),
        split(kinds / t >= 0.25, (kinds / t < 0.1) & (total >= 60)),
        split(lone / t <= 0.05, lone / t > 0.25),
        split(runs / t <= 0.02, runs / t > 0.2),
    ]
    return np.stack(out, 1) * (total > 0)[:, None]


def fit_labellers(patterns: np.ndarray, count: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation over distinct vote patterns (rows of -1, 0, 1) and their counts: the share of good texts, each labeller's chances of its votes on bad and on good texts (2, labellers, 3), and each pattern's posterior of good. It starts from texts that no labeller finds bad, since a text has one defect more often than several."""
    post = np.where((patterns < 0).any(1), 0.1, np.where((patterns > 0).any(1), 0.9, 0.5))
    chance, share = np.zeros((2, patterns.shape[1], 3)), 0.5
    for _ in range(rounds):
        for y, w in enumerate((count * (1 - post), count * post)):
            for v in (-1, 0, 1):
                chance[y, :, v + 1] = ((patterns == v) * w[:, None]).sum(0) + 0.5
            chance[y] /= chance[y].sum(1, keepdims=True)
        share = float((count * post).sum() + 1) / float(count.sum() + 2)
        logs = [np.log(chance[y])[np.arange(patterns.shape[1])[None, :], patterns + 1].sum(1) for y in (0, 1)]
        new = 1 / (1 + np.exp(np.clip(logs[0] + np.log(1 - share) - logs[1] - np.log(share), -500, 500)))
        if np.abs(new - post).max() < 1e-6:
            post = new
            break
        post = new
    return np.array([share]), chance, post


def hashed(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word, twice: its row and its bucket, once by its hash and once by its shape; then the words of each row."""
    data, offsets = buffers(text)
    rows_, buckets, total, before = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(offsets) - 1), None
    for starts, sizes, rows, hashes in words(data, offsets):
        total += np.bincount(rows, minlength=len(total))
        first, end, prior = data[starts], data[starts + sizes - 1], data[np.maximum(starts + sizes - 2, 0)]
        shape = mix(KIND[first] * np.uint64(1 << 20) + KIND[end] * np.uint64(1 << 10) + KIND[prior] + (np.minimum(sizes, 20) << 32).astype(np.uint64))
        shape[_again(rows, hashes, before)] = 0  # a shape of its own: the word before once more
        before = (rows[-1], hashes[-1])
        rows_ += [rows, rows]
        buckets += [(hashes % np.uint64(BUCKETS)).astype(np.int64), BUCKETS + (shape % np.uint64(SHAPES)).astype(np.int64)]
    return np.concatenate(rows_), np.concatenate(buckets), total


def fit_scorer(rows: np.ndarray, buckets: np.ndarray, values: np.ndarray, target: np.ndarray, steps: int = 250, rate: float = 0.5, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by Adam over the whole sample."""
    n, size = len(target), BUCKETS + SHAPES
    w, bias = np.zeros(size), 0.0
    m, s = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(steps):
        q = 1 / (1 + np.exp(-(np.bincount(rows, w[buckets] * values, n) + bias)))
        g = np.append(np.bincount(buckets, (q - target)[rows] * values, size) / n + decay * w, (q - target).mean())
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        move = rate * (1 - step / steps) * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(s / (1 - 0.99 ** (step + 1))) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def quality(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, n_votes, posterior, score, predicted.

    n_votes counts the labellers that voted, posterior is the label model's chance of good, score the scorer's, and
    predicted is 1 from 0.5 on. Null and empty texts get no vote, and score 0; texts of any length are read whole, in
    pieces whose cuts change nothing. Repeated rows are counted and scored each; of rows that tie at the end of the
    sample any may train. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    rows = docs.select("doc_id", "text")
    code = 3 ** np.arange(len(LABELLERS))

    def make_votes():
        def work(text):
            return [(votes(text) + 1) @ code]

        return work

    counts = annotated(rows, "text", [], "pattern int", make_votes).groupBy("pattern").count().collect()
    if not counts:
        return rows.select("doc_id", F.lit(0).alias("n_votes"), F.lit(0.0).alias("posterior"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    counts.sort(key=lambda r: r["pattern"])
    keys = np.array([r["pattern"] for r in counts])
    patterns = keys[:, None] // code[None, :] % 3 - 1
    number = np.array([float(r["count"]) for r in counts])
    _, _, post = fit_labellers(patterns, number)
    send = docs.sparkSession.sparkContext.broadcast
    table = send((keys, post))

    def posterior(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        v = votes(text)
        k, p = table.value
        return np.abs(v).sum(1), p[np.minimum(np.searchsorted(k, (v + 1) @ code), len(k) - 1)]

    def make_sample():
        def work(text, u):
            out: dict = {"u": u.to_pylist(), "post": posterior(text)[1], "buckets": [], "values": []}
            r, b, total = hashed(text)
            each, count = np.unique(r * (BUCKETS + SHAPES) + b, return_counts=True)
            at = np.searchsorted(each // (BUCKETS + SHAPES), np.arange(len(text) + 1))
            for i in range(len(text)):
                part = slice(at[i], at[i + 1])
                out["buckets"].append(each[part] % (BUCKETS + SHAPES))
                out["values"].append(count[part] / max(total[i], 1))
            return out

        return work

    span = min(1.0, 1.2 * sample / number.sum())
    drawn = rows.withColumn("u", F.pmod(F.xxhash64(F.lit("quality"), "doc_id", "text"), F.lit(1 << 40))).filter((F.col("u") < int(span * (1 << 40))) & (F.length("text") > 0))
    got = sorted(gathered(drawn, "text", ["u"], "u long, post double, buckets array<int>, values array<float>", make_sample).collect(), key=lambda r: (r["u"], len(r["buckets"])))[:sample]
    size = [len(r["buckets"]) for r in got]
    w, bias = fit_scorer(np.repeat(np.arange(len(got)), size), np.concatenate([np.array(r["buckets"], np.int64) for r in got] or [np.zeros(0, np.int64)]), np.concatenate([np.array(r["values"]) for r in got] or [np.zeros(0)]), np.array([r["post"] for r in got] or [0.5]))
    scorer = send((w, bias))

    def make_scores():
        weights, b = scorer.value

        def work(text):
            n_votes, p = posterior(text)
            r, k, total = hashed(text)
            score = 1 / (1 + np.exp(-(np.bincount(r, weights[k], len(text)) / np.maximum(total, 1) + b)))
            score[total == 0] = 0.0
            p = np.where(total == 0, 0.0, p)
            return [n_votes, p, score, (score >= 0.5).astype(np.int32)]

        return work

    return annotated(rows, "text", ["doc_id"], "n_votes int, posterior double, score double, predicted int", make_scores)
