"""Source divergence, the n-gram Jaccard join and the prefix trie against brute force, on odd rows, and in forced small pieces."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import groupby

import numpy as np
import pytest

from marlstone.llm import divergence, jaccard, trie
from marlstone.llm.words import mix

SCHEMA = "doc_id long, text string, lang string, source string, Rank int, value string, mark string, `a.b` string"
LOWER = {i: i + 32 for i in range(65, 91)}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 7, "v", "m", "x") for i, t, lang, source in rows], SCHEMA)


def plain_divergence(rows, least, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))) for _, t, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(w for d in mine for w in set(d[2]))
        kept = {w for w, n in df.items() if n >= least}
        count = defaultdict(Counter)
        for _, source, words in mine:
            count[source].update(w for w in words if w in kept)
        share = lambda c: {w: 1 + 1000000000 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}
        p = {s: share(c) for s, c in count.items()}
        q = share(sum(count.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in count:
            pairs = sorted(((-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in count if o != s))
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(pairs, 1)]
            terms = sorted((-f(p[s][w], q[w]), w.encode(), w) for w in kept if count[s][w] and p[s][w] > q[w])[:top]
            out += [(lang, s, "term", w, -v, k) for k, (v, _, w) in enumerate(terms, 1)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "held", "piece"), [(1, 400_000, 1 << 20), (2, 5, 3)])
def test_divergence(spark, monkeypatch, seed, held, piece):
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "PIECE", piece)
    r = random.Random(seed)
    words = ["Ab", "ab", "naïve", "東京", "x", "Ç", "z9z", "ä-ö"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = [(r.choice([i, 1, None]), " ".join(r.choices(words, k=r.randrange(9))), r.choice(["en", "de", None, ""]), r.choice(["s1", "s2", "ß", None, "hot", "hot", "hot"])) for i in range(150)]
    rows += [(1, None, "en", "empty"), (2, "", "void", "a"), (3, None, "void", "b"), (4, "word " * 50_000, "en", "s1")] * 2
    df = frame(spark, rows)
    for least, top in ((10, 10), (2, 3)):
        got = sorted(map(tuple, divergence.divergence(df, least_docs=least, top=top).collect()))
        assert got == plain_divergence(rows, least, top)
    assert {x[4] for x in got if x[0] == "void"} == {0}


def test_divergence_of_nothing(spark):
    assert divergence.divergence(frame(spark, [])).collect() == []


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def plain_links(rows, percent=85):
    sets = [shingle_set(t) for _, t, *_ in rows]
    near = [[k for k, b in enumerate(sets) if k != i and a and b and 100 * len(a & b) >= percent * len(a | b)] for i, a in enumerate(sets)]
    out = []
    for i, (key, *_) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for k in near[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        out.append((key, len(sets[i]), min(ids) if ids else None, len(near[i])))
    return sorted(out, key=str)


def near_copies(r, n):
    """Texts of all sizes with copies at all distances around the threshold, shared passages and templates."""
    vocab = [f"v{k}" for k in range(400)]
    passage = r.choices(vocab, k=60)
    rows = []
    for i in range(n):
        base = r.choices(vocab, k=r.choice([1, 2, 3, 4, 5, 8, 9, 10, 12, 20, 40, 80, 200]))
        if r.random() < 0.3:
            base += passage
        rows.append((i, " ".join(base), "en", "s"))
        for c in range(r.randrange(4)):
            words = list(base)
            for _ in range(r.randrange(1 + len(words) // 25 + r.randrange(2))):
                at = r.randrange(len(words))
                words[at : at + r.choice([0, 1])] = [r.choice(vocab)]
            rows.append((1000 + 10 * i + c, " ".join(words).upper() if c else "\t".join(words), "en", "s"))
    template = r.choices(vocab, k=100)
    for k in range(30):
        words = list(template)
        words[50] = f"only{k}"
        words[90] = f"also{k % 3}"
        rows.append((5000 + k, " ".join(words), "en", "s"))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "block", "heap", "dense"), [(1, 1_000_000, 256, 16), (2, 400, 0, 1), (3, 2000, 10**9, 10**9)])
def test_jaccard_links(spark, monkeypatch, seed, block, heap, dense):
    monkeypatch.setattr(jaccard, "HEAP", heap)
    monkeypatch.setattr(jaccard, "DENSE", dense)
    rows = near_copies(random.Random(seed), 120)
    rows += [(None, None, "", ""), (7, "", "", ""), (8, " \n ", "", ""), (None, "one", None, None), (9, "ONE", "", ""), (9, "one", "", ""), (9, "one", "", ""), (10, "long " * 30_000, "", "")]
    got = sorted(map(tuple, jaccard.jaccard_links(frame(spark, rows), block=block).collect()), key=str)
    want = plain_links(rows)
    assert got == want
    assert sum(x[3] for x in want) > 500


def test_jaccard_links_of_nothing(spark):
    assert jaccard.jaccard_links(frame(spark, [])).collect() == []
    assert [tuple(x) for x in jaccard.jaccard_links(frame(spark, [(None, None, None, None), (3, "", None, None)])).collect()] in ([(None, 0, None, 0), (3, 0, 3, 0)], [(3, 0, 3, 0), (None, 0, None, 0)])


def test_linked_sets_share_a_segment():
    r = np.random.default_rng(3)
    for n in [*range(6, 60), 100, 250, 1000]:
        for _ in range(20):
            a = mix(r.integers(1, 1 << 60, n).astype(np.uint64))
            other = int(r.integers(0, n * 15 // 100 + 1))
            cut = int(r.integers(0, other + 1))
            b = np.concatenate([a[cut:], mix(r.integers(1, 1 << 60, other - cut).astype(np.uint64))])
            common = n - cut
            if 100 * common < 85 * (n + len(b) - common) or cut + other == 0:
                continue
            row = np.repeat([0, 1], [n, len(b)])
            owner, key = jaccard.segment_keys(row, np.concatenate([a, b]), np.array([n, len(b)]), 85)
            assert set(key[owner == 0].tolist()) & set(key[owner == 1].tolist()), (n, cut, other)


def plain_trie(rows, shared=6, family=100):
    body = lambda x: hashlib.sha256(f"{len(x[2] or '')}:{x[2] or ''}{x[3] or ''}".encode()).digest()
    talks = defaultdict(list)
    for x in rows:
        if x[0] is not None:
            talks[x[0]].append(x)
    turns = {c: [(x[2] or "", x[3] or "") for x in sorted(v, key=lambda x: (x[1] is not None, x[1] or 0, body(x)))] for c, v in talks.items()}
    full = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % shared
        full[c] = turns.get(c - int(np.fmod(c, family)), [])[:h] + mine[h:]
    nodes = defaultdict(list)
    for c, path in full.items():
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append(c)
    childless = {p for p in nodes} - {p[:-1] for p in nodes if p}
    out = []
    for p, members in nodes.items():
        below = [x for x in nodes if x[: len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in members if len(full[c]) == len(p))))
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1]) for x in below if x)
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), sum(len(x) == len(p) + 1 for x in below), sum(x in childless for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("seed", "piece", "ids"), [(1, 1024, 50_000), (2, 3, 2)])
def test_trie(spark, monkeypatch, seed, piece, ids):
    monkeypatch.setattr(trie, "PIECE", piece)
    monkeypatch.setattr(trie, "IDS", ids)
    r = random.Random(seed)
    rows = []
    for c in [*range(40), *range(95, 130), 200, 305, 317, 1000, 1003, -1, -5, -100, -150]:
        # Many begin alike, some are alike throughout, one is long.
        for t in range(60 if c == 100 else r.choice([1, 2, 3, 5, 7])):
            rows.append((c, r.choice([t, None]) if r.random() < 0.1 else t, r.choice(["user", "user", None, ""]), r.choice(["hi", "hi", "hi", "é東", None, ""]) if t < 4 else f"x{t % 2}", "extra", "extra"))
    rows += [(None, 1, "user", "lost", "", ""), (3, 2, "user", "hi", "", ""), (3, 2, "user", "hi", "", ""), (7, 9, "u", "long " * 30_000, "", "")]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth string, Conv string")
    assert sorted(map(tuple, trie.prefix_trie(df).collect()), key=lambda x: (x[0], x[1])) == plain_trie(rows)
    assert sorted(map(tuple, trie.prefix_trie(df, shared=1).collect()), key=lambda x: (x[0], x[1])) == plain_trie(rows, 1)


def test_trie_of_one_long_talk(spark):
    """A conversation with nearly all rows, equal ones among them, is numbered over several ranges."""
    rows = [(100, None if k % 7 else k // 50, "u", f"t{k % 5}") for k in range(4000)] + [(101, 0, "u", "t1")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = df.selectExpr("conv_id as conv", "turn", "unhex(sha2(text, 256)) as body", "cast(1 as long) as tokens")
    one = trie.numbered_turns(turns.repartition(4)).filter("conv = 100").orderBy("i").collect()
    assert [x["i"] for x in one] == list(range(1, 4001))
    assert [k for k, _ in groupby(bytes(x["body"]) for x in one[:3428])] == sorted({bytes(x["body"]) for x in one})
    got = {(x["conv_id"], x["depth"]): x for x in trie.prefix_trie(df).collect()}
    assert sorted(got) == [(100, d) for d in range(4001)]
    assert sum(x["n_convs"] for x in got.values()) == 4001 + 1 + min(zlib.crc32(b"101") % 6, 4000)


def test_trie_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(df).collect() == []
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], df.schema)).collect() == []
