"""The corpus operators against plain versions of their own methods, written without the library's arrays."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from marlstone.llm import gbdt, langid, mixing, quality, secrets, sharding, toxicity
from marlstone.llm import words as W

R = random.Random(21)
WORDS = [f"w{i}" for i in range(300)]


def prose(n, r=R):
    return " ".join(r.choice(WORDS) for _ in range(n))


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def slot(doc_id, text, slots):
    """The slot of a row, by the hash that is chained over its columns; null leaves it as it was."""
    h = 42
    if doc_id is not None:
        h = xxhash.xxh64(doc_id.to_bytes(8, "little", signed=True), seed=h).intdigest()
    if text is not None:
        h = xxhash.xxh64(text.encode(), seed=h).intdigest()
    return (h - (1 << 64) if h >= 1 << 63 else h) % slots


def claimed(names, slots):
    """Shards in turn take the first slot of their preference list that is free; the lists are written out."""
    import hashlib

    lists = []
    for name in names:
        digest = hashlib.sha256(name.encode()).digest()
        offset, skip = int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:16], "big") % (slots - 1) + 1
        lists.append([(offset + j * skip) % slots for j in range(slots)])
    owner = {}
    while len(owner) < slots:
        for i, preference in enumerate(lists):
            if len(owner) < slots:
                owner[next(x for x in preference if x not in owner)] = i
    return [owner[i] for i in range(slots)]


def test_shards(spark):
    names, slots = tuple(f"part {i}" for i in range(7)), 503
    want = claimed(names, slots)
    assert sharding.lookup_table(names, slots) == want
    rows = [(i, prose(R.randint(0, 30))) for i in range(300)] + [(None, "a"), (5, None), (None, None), (-9, "日本"), (5, "")]
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string"), names, slots=slots).collect()
    for r in got:
        k = slot(r["doc_id"], r["text"], slots)
        assert (r["slot"], r["shard"]) == (k, names[want[k]])
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)


def levelled(sizes, weights, total, epochs):
    """The level at which capped shares sum to total, by halving."""
    if total >= sum(epochs * s for s, w in zip(sizes, weights, strict=True) if w):
        return [epochs * s if w else 0.0 for s, w in zip(sizes, weights, strict=True)]
    a, b = 0.0, total + 1
    for _ in range(300):
        m = (a + b) / 2
        a, b = (m, b) if sum(min(m * w, epochs * s) for s, w in zip(sizes, weights, strict=True)) < total else (a, m)
    return [min(a * w, epochs * s) for s, w in zip(sizes, weights, strict=True)]


@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_mixture(spark, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    r = random.Random(3)
    rows = [(i, prose(r.randint(0, 60), r), r.choice(["b", "a", None, "ü", "Z", "c"]) if i % 3 else "hot") for i in range(4000)]
    rows += [(10_000 + i, "one two three", "small") for i in range(3)] + [(20_000, "", "none"), (20_001, None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixture(docs).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted(s for s in size if s is not None) + [None]
    target = dict(zip(names, levelled([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(size.values()), 2), strict=True))
    source, taken = {r_[0]: r_[2] for r_ in rows}, Counter()
    for x in got:
        s = source[x["doc_id"]]
        taken[s] += x["taken"]
        assert (x["source_size"], x["target"]) == (size[s], pytest.approx(target[s]))
        assert x["taken"] == x["size"] * x["copies"] <= 2 * x["size"] and x["copies"] - int(target[s] / size[s] + 1e-9 if size[s] else 0) in (0, 1)
    assert all(abs(taken[s] - target[s]) <= 60 for s in names) and taken["small"] == 18
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mixture(docs.repartition(7)).collect()), key=str)


@pytest.mark.parametrize("ids", [False, True])
def test_repeated_rows_are_split(spark, ids):
    # All rows are equal in id and text, so they share a place; the mix takes 150 % of the words, capped at twice.
    rows = [(7 if ids else None, "one two three", "a")] * 900 + [(i, prose(20), "b") for i in range(100, 140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mixture(docs).collect()
    for name, n in (("a", 3), ("b", 20)):
        mine = [x for x in got if x["size"] == n]
        assert abs(sum(x["taken"] for x in mine) - mine[0]["target"]) <= n, name
    again = mixing.mixture(docs.repartition(2)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    assert Counter(x["text"] for x in mixing.mixed(docs).collect())["one two three"] * 3 == sum(x["taken"] for x in got if x["size"] == 3)


def test_labels_at_the_cap_and_no_words(spark):
    docs = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(x["target"], x["taken"]) for x in mixing.mixture(docs).collect()] == [(0.0, 0), (0.0, 0)]
    one = spark.createDataFrame([(1, "a b c d", "a")], "doc_id long, text string, source string")
    assert mixing.mixture(one).first()["taken"] in (4, 8)


def gru(net, data, backwards):
    """One direction over one window, a byte and a gate at a time."""
    d, n = "b" if backwards else "f", langid.HIDDEN
    p = {k: v.astype(float) for k, v in net.p.items()}
    sig = lambda v: 1 / (1 + np.exp(-v))
    h, out = np.zeros(n), [None] * len(data)
    for t in reversed(range(len(data))) if backwards else range(len(data)):
        x = p["emb"][data[t]] @ p[f"w{d}"] + p[f"b{d}"]
        s = h @ p[f"u{d}"]
        z, r = sig(x[:n] + s[:n]), sig(x[n : 2 * n] + s[n : 2 * n])
        c = np.tanh(x[2 * n :] + r * s[2 * n :])
        h = z * h + (1 - z) * c
        out[t] = h
    return out


def test_every_byte_is_labelled_and_pooled():
    net = langid.Network.fresh(["aa", "bb", "cc"], 5)
    texts = ["Grüße, Welt!", "x" * 64, prose(60), "", "été " * 16 + "z"]
    lang, score, pooled = langid.predict(net, pa.array(texts), lanes=3)
    for i, t in enumerate(texts):
        data, total = [W.LOWER[b] for b in t.encode()], np.zeros(3)
        for at in range(0, len(data), langid.WINDOW):
            part = data[at : at + langid.WINDOW]
            full = part + [256] * (langid.WINDOW - len(part))
            for f, b in list(zip(gru(net, full, False), gru(net, full, True), strict=True))[: len(part)]:
                y = np.exp(np.concatenate([f, b]) @ net.p["v"] + net.p["c"])
                total += y / y.sum()
        want = total / max(1, len(data))
        assert pooled[i] == pytest.approx(want, abs=2e-5)
        assert (lang[i], score[i]) == ((net.langs[int(want.argmax())], pytest.approx(want.max(), abs=2e-5)) if t else ("und", 0.0))


def lexicon_of(words, heads):
    """The hashed form of {word: weight} and {length: {beginning: weight}}."""
    out = [sorted((int(W.word_hash(w)), v) for w, v in words.items())]
    for n in toxicity.HEADS:
        one = []
        for head, v in heads.get(n, {}).items():
            data = np.frombuffer(head.encode(), np.uint8)
            one.append((int(next(W.words(data, np.array([0, len(data)]), (n,), W.MARKS))[4][0]), v))
        out.append(sorted(one))
    return [(np.array([k for k, _ in x], np.uint64), np.array([v for _, v in x])) for x in out]


def plain_features(text, words, heads):
    raw = text.encode()
    ws = [w for w in re.split(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", raw) if w]
    lows = [w.lower() for w in ws]
    mark = [words.get(w.decode(), 0) for w in lows]
    head = [max([heads.get(n, {}).get(w[:n].decode(errors="replace"), 0) if len(w) >= n else 0 for n in toxicity.HEADS]) for w in lows]
    you = [w.decode() in toxicity.SECOND for w in lows]
    near = sum(bool(a or b) and any(you[max(0, i - toxicity.NEAR) : i + toxicity.NEAR + 1]) for i, (a, b) in enumerate(zip(mark, head, strict=True)))
    hit, heads_, n, t = sum(m > 0 for m in mark), sum(h > 0 for h in head), len(ws), max(1, len(ws))
    is_letter = lambda b: chr(b).isalpha() if b < 128 else True
    letters, size = max(1, sum(map(is_letter, raw))), max(1, len(raw))
    lower = raw.lower()
    inner = sum(is_letter(raw[i - 1]) and is_letter(raw[i + 1]) and not is_letter(raw[i]) and raw[i] not in b" \t\n\r\x0b\x0c'-.,/:" for i in range(1, len(raw) - 1))
    drawn = sum(is_letter(raw[i]) and lower[i] == lower[i - 1] == lower[i - 2] for i in range(2, len(raw)) if raw[i] < 128)
    out = [math.log1p(n), hit / t, math.log1p(hit), max([0, *mark]), heads_ / t, math.log1p(heads_), max([0, *head]), near / max(1, hit + heads_), near, sum(you) / t]
    out += [sum(65 <= b <= 90 for b in raw) / letters, sum(len(w) > 1 and all(65 <= b <= 90 for b in w) for w in ws) / t, sum(b in b"!?" for b in raw) / size]
    return out + [sum(32 < b < 128 and not chr(b).isalnum() for b in raw) / size, inner / t, drawn / t]


def test_features(monkeypatch):
    r = random.Random(9)
    words, heads = {"vile": 2.0, "grimly": 1.5}, {4: {"nast": 1.25}, 5: {"grims": 0.75}, 6: {}}
    pool = [*WORDS[:20], "vile", "VILE!!", "nastier", "grimset", "you", "dich,", "Your", "st*pid", "sooo", "A-B", "YES", "GRIMLY"]
    texts = [" ".join(r.choice(pool) for _ in range(r.randint(0, 80))) for _ in range(60)] + ["a!", "b", "aa", "aab", "", "!a", "you vile"]
    want = np.array([plain_features(t, words, heads) for t in texts])
    assert toxicity.features(pa.array(texts), lexicon_of(words, heads)) == pytest.approx(want)
    # Cuts inside texts change nothing.
    monkeypatch.setattr(W, "pieces", lambda data, offsets, limit=0, gaps=W.BLANK, f=W.pieces: f(data, offsets, 40, gaps))
    assert toxicity.features(pa.array(texts), lexicon_of(words, heads)) == pytest.approx(want)


def plain_raw(trees, x):
    out = trees.start
    for f, c, leaf in zip(trees.feature, trees.cut, trees.leaf, strict=True):
        node = 0
        for _ in range(trees.depth):
            bin_ = sum(e < x[f[node]] for e in trees.edges[f[node]])
            node = 2 * node + (2 if bin_ > c[node] else 1)
        out += leaf[node - (2**trees.depth - 1)]
    return out


def pooled_adjacent(y, weight):
    """The non-decreasing means nearest to y: of all runs that begin up to i and end from i on, the largest least mean."""
    n = len(y)
    mean = lambda a, b: np.average(y[a:b], weights=weight[a:b])
    return [max(min(mean(a, b) for b in range(i + 1, n + 1)) for a in range(i + 1)) for i in range(n)]


def test_trees_and_calibration():
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 4))
    y = (x[:, 0] + x[:, 2] > 0.2).astype(float)
    trees = gbdt.fit(x, y, np.ones(300), trees=12)
    assert trees.raw(x[:40]) == pytest.approx([plain_raw(trees, v) for v in x[:40]])
    # The first split is the best of all by gain.
    p = y.mean()
    g, h = p - y, np.full(300, p * (1 - p))
    best = (-1.0, 0, 0)
    for j, edges in enumerate(trees.edges):
        for k, e in enumerate(edges):
            left = x[:, j] <= e
            if min(left.sum(), (~left).sum()) >= 10:
                gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - g.sum() ** 2 / (h.sum() + 1)
                best = max(best, (gain, j, k))
    assert (trees.feature[0][0], trees.cut[0][0]) == best[1:]
    s, t, w = np.arange(30.0), (r.random(30) < np.linspace(0.1, 0.9, 30)).astype(float), r.random(30) + 0.5
    want = pooled_adjacent(t, w)
    knots, values = gbdt.isotonic(s, t, w)
    mass = {v: w[np.isclose(want, v)].sum() for v in set(np.round(want, 12))}
    for i, v in enumerate(want):
        m = next(mass[k] for k in mass if math.isclose(k, v, abs_tol=1e-9))
        half = w.mean() / 2
        assert np.interp(s[i], knots, values) == pytest.approx((v * m + half) / (m + 2 * half), abs=1e-9)


def test_ties_are_calibrated_together():
    knots, values = gbdt.isotonic(np.zeros(10), np.array([0.0] * 8 + [1.0] * 2), np.ones(10))
    assert np.interp(0.0, knots, values) == pytest.approx(2.5 / 11)
    a = gbdt.isotonic(np.array([1.0, 2, 2, 3]), np.array([0.0, 0, 1, 1]), np.ones(4))
    b = gbdt.isotonic(np.array([3.0, 2, 2, 1]), np.array([1.0, 1, 0, 0]), np.ones(4))
    assert np.interp([1, 2, 3], *a) == pytest.approx(np.interp([1, 2, 3], *b))


def test_expectation_maximisation():
    r = np.random.default_rng(5)
    truth = r.random(200) < 0.7
    votes = np.where(r.random((200, 3)) < 0.8, np.where(truth[:, None], 1, -1), np.where(truth[:, None], -1, 1)) * (r.random((200, 3)) < 0.9)
    # Text by text, with plain sums.
    post = [0.1 if min(v) < 0 else 0.9 if max(v) > 0 else 0.5 for v in votes]
    for _ in range(200):
        chance = {(y, j, v): 0.5 for y in (0, 1) for j in range(3) for v in (-1, 0, 1)}
        for row, q in zip(votes, post, strict=True):
            for j, v in enumerate(row):
                chance[1, j, v] += q
                chance[0, j, v] += 1 - q
        total = {(y, j): sum(chance[y, j, v] for v in (-1, 0, 1)) for y in (0, 1) for j in range(3)}
        share = (sum(post) + 1) / (len(post) + 2)
        new = []
        for row in votes:
            a, b = share, 1 - share
            for j, v in enumerate(row):
                a *= chance[1, j, v] / total[1, j]
                b *= chance[0, j, v] / total[0, j]
            new.append(a / (a + b))
        done = max(abs(p - q) for p, q in zip(new, post, strict=True)) < 1e-6
        post = new
        if done:
            break
    patterns, count = np.unique(votes, axis=0, return_counts=True)
    got = quality.fit_labellers(patterns, count.astype(float))
    at = {tuple(p): i for i, p in enumerate(patterns)}
    assert got[0][0] == pytest.approx(share, abs=1e-6) and [got[2][at[tuple(v)]] for v in votes] == pytest.approx(post, abs=1e-5)


def battery(token):
    """The three tests, in plain sums."""
    core = token.rstrip("=")
    for name, pattern, symbols in secrets.ALPHABETS:
        if not pattern or re.match(pattern, core):
            core = core.lower() if name in ("hex", "base36") else core
            if not pattern:
                core = core.replace("-", "+").replace("_", "/")
            break
    n, k = len(core), len(symbols)
    v = [symbols.index(c) + 1 for c in core]
    chi = (sum(core.count(c) ** 2 for c in symbols) * k / n - n - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    up = [2 * x > k for x in v]
    high, lows = sum(up), n - sum(up)
    count = 1 + sum(a != b for a, b in zip(up, up[1:], strict=False))
    spread = 2 * high * lows * (2 * high * lows - n) / (n * n * (n - 1))
    runs = abs(count - 2 * high * lows / n - 1) / math.sqrt(spread) if spread > 0 else 9.0
    mean = sum(v) / n
    var = sum(x * x for x in v) / n - mean * mean
    lag = sum((a - mean) * (b - mean) for a, b in zip(v, v[1:], strict=False))
    serial = abs(lag / n / var + 1 / n) * math.sqrt(n) if var > 0 else 9.0
    return max(chi, runs, serial)


def test_randomness(spark):
    from pyspark.sql import functions as F

    r = random.Random(4)
    sets = ["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789", "abcXYZ0189", "ab+/Z9-_", "q"]
    tokens = ["".join(r.choice(s) for _ in range(r.randint(20, 90))) + r.choice(["", "=", "=="]) for s in sets for _ in range(12)]
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secrets.randomness(F.col("t")).alias("x")).collect()
    for x in got:
        assert x["x"] == pytest.approx(battery(x["t"]), abs=1e-9), x["t"]


def test_cut_scores():
    r = random.Random(8)
    bins = [(c, b, r.randint(0, 40), r.randint(0, 3), r.randint(0, 2)) for c in range(3) for b in range(20)] + [(4, 3, 7, 0, 0), (5, 2, 9, 0, 0)]
    got = secrets.cut_scores(bins)
    # The two longest classes and those without rows go with the third.
    for group in ([0], [1], [2, 3, 4, 5]):
        ok = []
        far = [sum(x[k] for x in bins if x[0] in group and x[1] >= 14) for k in (2, 3)]
        for b in range(14):
            upto = [x for x in bins if x[0] in group and x[1] <= b]
            mixed, words, loose = (sum(x[k] for x in upto) for k in (2, 3, 4))
            bare = sum(x[2] * (52 / 62) ** secrets.CLASSES[x[0]] / (1 - (52 / 62) ** secrets.CLASSES[x[0]]) for x in upto)
            if mixed and min(1, (far[0] + 1) / (far[1] + 1)) * (words + max(0, loose - bare - 2 * math.sqrt(bare)) + 1) <= 0.05 * mixed:
                ok.append(b)
        assert {got[c] for c in group} == {max(ok, default=-1)}
    assert secrets.cut_scores([]) == [-1] * 6 and secrets.cut_scores([(0, 0, 19, 0, 0)]) == [-1] * 6 and secrets.cut_scores([(0, 0, 19, 0, 0), (0, 20, 0, 9, 0)]) == [0] * 6


def test_secrets_take_time_in_proportion(spark):
    import time

    r = random.Random(5)
    one = lambda n: " ".join("".join(r.choice("0123456789abcdef") for _ in range(26)) for _ in range(n))
    took = {}
    for n in (2000, 16000, 64000):  # the first compiles
        docs = spark.createDataFrame([(1, one(n) + " token=abcdef1234 " + "Ab3dE5gH7jK9mN1pQ3sT5 " * (n // 10))], "doc_id long, text string")
        began = time.time()
        x = secrets.secrets(docs).first()
        took[n] = time.time() - began
        assert (x["n_hex"], x["n_assign"]) == (n, 1)
    assert took[64000] < 7 * max(took[16000], 1)


def test_cuts_inside_texts_change_no_vote(monkeypatch):
    r = random.Random(12)
    texts = [" ".join(r.choice(["go", "go", "Go", "stop.", "x" * 30, "!!", "a\nline of some length\n"]) for _ in range(r.randint(0, 90))) for _ in range(30)]
    plain = quality.votes(pa.array(texts)), quality.hashed(pa.array(texts))
    monkeypatch.setattr(W, "pieces", lambda data, offsets, limit=0, gaps=W.BLANK, f=W.pieces: f(data, offsets, 25, gaps))
    assert (quality.votes(pa.array(texts)) == plain[0]).all()
    key = lambda h: sorted(zip(h[0].tolist(), h[1].tolist(), strict=True))
    cut = quality.hashed(pa.array(texts))
    assert key(cut) == key(plain[1]) and (cut[2] == plain[1][2]).all()


def test_tables_on_the_way_are_swept(spark):
    import os

    from marlstone.llm import store

    def make():
        a = store.saved(spark.range(5))
        return a.filter("id > 2")

    kept = store.saved(spark.range(3))
    out = store.settled(spark, make)
    assert sorted(r["id"] for r in out.collect()) == [3, 4] and kept.count() == 3
    store.swept(spark, {out._saved_path})
    there = lambda df: os.path.exists(df._saved_path.removeprefix("file://"))
    assert there(out) and not there(kept)
