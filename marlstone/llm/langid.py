"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

A text's bytes are cut into windows; in each window one network reads forwards and one backwards, and a linear layer on
both states gives every position a distribution over the languages. A document's distribution is the mean over all
its positions, so texts of any length are read whole in bounded memory. The network is trained by backpropagation
through time on a bounded sample of labelled rows: WINDOWS windows from each of at most SAMPLE documents of each
language, both drawn by hash. That bounds what is learned from, not what is predicted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .apply import annotated, gathered
from .toxicity import fold
from .words import LOWER, buffers

WINDOW, HIDDEN, EMBED = 64, 8, 12
#: Documents of each language, windows of each, and passes in training.
SAMPLE, WINDOWS, EPOCHS, LANES = 500, 4, 6, 256
FOLDS, HELD = 4, 2
NONE = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Network:
    """emb: a vector for each byte; for each direction w (input), u (state) and b of the update, reset and candidate gates; v and c: output."""

    langs: list[str]
    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, langs: list[str], seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        make = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        p = {"emb": make(257, EMBED) * 4, "v": make(2 * HIDDEN, len(langs)), "c": np.zeros(len(langs), np.float32)}
        for d in "fb":
            p |= {f"w{d}": make(EMBED, 3 * HIDDEN), f"u{d}": make(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
        return cls(langs, p)

    def states(self, x: np.ndarray, d: str, trace: list | None = None) -> np.ndarray:
        """The states after each byte of windows x (time, lanes); 256 stands for no byte."""
        table = self.p["emb"] @ self.p[f"w{d}"] + self.p[f"b{d}"]
        u, n = self.p[f"u{d}"], HIDDEN
        out = np.empty((*x.shape, n), np.float32)
        h = np.zeros((x.shape[1], n), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            g = table[x[t]]
            s = h @ u
            g[:, : 2 * n] += s[:, : 2 * n]
            g[:, : 2 * n] *= 0.5
            zr = np.tanh(g[:, : 2 * n])
            zr += 1
            zr *= 0.5
            c = np.tanh(g[:, 2 * n :] + zr[:, n:] * s[:, 2 * n :])
            new = c + zr[:, :n] * (h - c)
            if trace is not None:
                trace.append((t, h, zr, c, s[:, 2 * n :]))
            out[t] = h = new
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(time, lanes, languages)"""
        y = np.concatenate([self.states(x, "f"), self.states(x, "b")], 2) @ self.p["v"] + self.p["c"]
        y -= y.max(2, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(2, keepdims=True)
        return y

    def gradients(self, x: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean cross-entropy over all positions that hold a byte, and its gradients by backpropagation through time."""
        p, n, g = self.p, HIDDEN, {}
        traces: dict[str, list] = {"f": [], "b": []}
        h = np.concatenate([self.states(x, d, traces[d]) for d in "fb"], 2)
        y = h @ p["v"] + p["c"]
        y -= y.max(2, keepdims=True)
        y = np.exp(y)
        y /= y.sum(2, keepdims=True)
        mask = (x < 256).astype(np.float32)
        total = max(1.0, float(mask.sum()))
        lanes = np.arange(x.shape[1])
        loss = float(-(np.log(y[:, lanes, label] + 1e-9) * mask).sum() / total)
        y[:, lanes, label] -= 1
        y *= (mask / total)[:, :, None]
        flat = y.reshape(-1, y.shape[2])
        g["v"], g["c"] = h.reshape(-1, 2 * n).T @ flat, flat.sum(0)
        dh_out = y @ p["v"].T
        g["emb"] = np.zeros_like(p["emb"])
        for k, d in enumerate("fb"):
            du, dtable = np.zeros_like(p[f"u{d}"]), np.zeros((257, 3 * n), np.float32)
            dh = np.zeros((x.shape[1], n), np.float32)
            for t, before, zr, c, s in reversed(traces[d]):
                dh = dh + dh_out[t, :, k * n : (k + 1) * n]
                z, r = zr[:, :n], zr[:, n:]
                dc = dh * (1 - z) * (1 - c * c)
                gate = np.concatenate([dh * (before - c) * z * (1 - z), dc * s * r * (1 - r), dc], 1)
                into = gate.copy()
                into[:, 2 * n :] *= r
                du += before.T @ into
                for j in range(3 * n):
                    dtable[:, j] += np.bincount(x[t], gate[:, j], 257)
                dh = dh * z + into @ p[f"u{d}"].T
            g[f"u{d}"], g[f"b{d}"] = du, dtable.sum(0)
            g[f"w{d}"] = p["emb"].T @ dtable
            g["emb"] += dtable @ p[f"w{d}"].T
        return loss, g


def train_network(x: np.ndarray, label: np.ndarray, langs: list[str], epochs: int = EPOCHS, rate: float = 0.01, seed: int = 7) -> Network:
    """Windows x (rows, WINDOW) with their languages' indices; Adam with a falling rate."""
    net, r = Network.fresh(langs, seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    per = max(1, -(-len(x) // LANES))
    epochs = max(epochs, -(-150 // per))
    for step in range(epochs * per):
        if step % per == 0:
            order = r.permutation(len(x))
        rows = order[(step % per) * LANES : (step % per + 1) * LANES]
        _, g = net.gradients(x[rows].T, label[rows])
        norm = float(np.sqrt(sum((v.astype(np.float64) ** 2).sum() for v in g.values())))
        now = rate * (1 - step / (epochs * per)) + 1e-4
        for k, v in g.items():
            v = v * min(1.0, 1.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * v
            s[k] = 0.99 * s[k] + 0.01 * v * v
            net.p[k] = (net.p[k] - now * (m[k] / (1 - 0.9 ** (step + 1))) / (np.sqrt(s[k] / (1 - 0.99 ** (step + 1))) + 1e-7)).astype(np.float32)
    return net


def windows_of(data: np.ndarray) -> np.ndarray:
    """data in rows of WINDOW bytes; 256 fills the last."""
    out = np.full(-(-len(data) // WINDOW) * WINDOW, 256, np.int16)
    out[: len(data)] = LOWER[data]
    return out.reshape(-1, WINDOW)


def predict(net: Network, text: pa.Array, lanes: int = 2048) -> tuple[list[str], list[float], np.ndarray]:
    """Each text's language and its pooled probability, and the pooled probabilities of all languages."""
    data, offsets = buffers(text)
    sizes = np.diff(offsets)
    rows = -(-sizes // WINDOW)
    first = np.concatenate([[0], np.cumsum(rows)])
    pooled = np.zeros((len(sizes), len(net.langs)))
    # The byte at which each window starts; windows never cross texts.
    begin = np.repeat(offsets[:-1] - first[:-1] * WINDOW, rows) + np.arange(first[-1]) * WINDOW
    owner = np.repeat(np.arange(len(sizes)), rows)
    for at in range(0, int(first[-1]), lanes):
        b, o = begin[at : at + lanes], owner[at : at + lanes]
        place = b[None, :] + np.arange(WINDOW)[:, None]
        inside = place < offsets[o + 1][None, :]
        x = np.where(inside, LOWER[data[np.minimum(place, len(data) - 1)]].astype(np.int16), np.int16(256))
        y = net.probabilities(x)
        if not inside[-1].all():
            y *= inside[:, :, None]
        sums = y.sum(0)
        for k in range(len(net.langs)):
            pooled[:, k] += np.bincount(o, sums[:, k], len(sizes))
    pooled /= np.maximum(sizes, 1)[:, None]
    ascii_letter = np.concatenate([[0], np.cumsum((LOWER[data] >= 97) & (LOWER[data] <= 122))])[offsets]
    has = np.diff(ascii_letter) > 0
    for i in np.flatnonzero(~has):
        raw = data[offsets[i] : offsets[i + 1]]
        has[i] = bool(len(raw)) and bool((raw >= 128).any()) and any(c.isalpha() for c in raw.tobytes().decode("utf-8", "replace"))
    best = pooled.argmax(1)
    return [net.langs[k] if h else NONE for k, h in zip(best, has, strict=True)], [float(min(1.0, pooled[i, k])) if h else 0.0 for i, (k, h) in enumerate(zip(best, has, strict=True))], pooled


def train(docs: DataFrame, folds: int = FOLDS, held: int = HELD, size: int = SAMPLE) -> Network | None:
    """The network of docs (doc_id, text, lang), of rows outside the held-out fold; None without such rows. The driver sees a count of each language and the sampled windows."""
    usable = docs.select("doc_id", "text", "lang").filter((fold(F.col("doc_id"), folds) != held) & F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return None
    span = 1 << 40
    rates = F.create_map(*(F.lit(v) for k, n in sorted(counts.items()) for v in (k, int(span * min(1.0, 1.3 * size / n)))))
    drawn = usable.withColumn("u", F.pmod(F.xxhash64(F.lit("lang"), "doc_id", "text"), F.lit(span))).filter(F.col("u") < F.element_at(rates, F.col("lang")))

    def make():
        def work(text, lang, u):
            data, offsets = buffers(text)
            out: dict = {"lang": [], "u": [], "bytes": []}
            for i, key in enumerate(u.to_pylist()):
                w = windows_of(data[offsets[i] : offsets[i + 1]])
                for k in range(min(WINDOWS, len(w))):
                    row = w[(key + k * max(1, len(w) // WINDOWS)) % len(w)]
                    out["lang"].append(lang[i].as_py())
                    out["u"].append(key)
                    out["bytes"].append(row.tobytes())
            return out

        return work

    found = sorted({(r["lang"], r["u"], bytes(r["bytes"])) for r in gathered(drawn, "text", ["lang", "u"], "lang string, u long, bytes binary", make).collect()})
    langs, x, label = sorted(counts), [], []
    for k, lang in enumerate(langs):
        mine = [r for r in found if r[0] == lang]
        last = sorted({r[1] for r in mine})[:size][-1:]
        mine = [r for r in mine if last and r[1] <= last[0]]
        x += [np.frombuffer(r[2], np.int16) for r in mine]
        label += [k] * len(mine)
    return train_network(np.stack(x).astype(np.int64), np.array(label), langs)


def languages(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Null and empty texts and those without a letter are `und` with score 0, and so are all texts if no row can be
    learned from. Of a long text every byte is labelled, window by window. Languages that tie for a text give the first
    by name. Repeated rows are scored each, and learned from once; rows without an id are not held out. An empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    net = train(docs)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD, F.lit(False)).alias("held_out")
    if net is None:
        return docs.select("doc_id", held, F.lit(NONE).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast((net.langs, net.p))

    def make():
        mine = Network(*sent.value)
        return lambda text: list(predict(mine, text)[:2])

    return annotated(docs, "text", ["doc_id"], "lang_pred string, score double", make).select("doc_id", held, "lang_pred", "score")
