"""Operators of the subpackage llm against brute force, and on nulls, empties, long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from marlstone.llm import decontaminate, exact_dedup, gbdt, langid, lmscore, mixing, neardup, quality, secrets, sharding, toxicity, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, label string"
R = random.Random(5)
WORDS = [f"w{i}" for i in range(400)]


def prose(n, r=R):
    return " ".join(r.choice(WORDS) for _ in range(n))


LONG = prose(30_000)
ODD = [
    (1, None, "en", "a", 0, "x", None),
    (2, "", None, None, None, None, "y"),
    (3, " \n\t ", "en", "a", 3, "x", "y"),
    (4, LONG, "en", "a", 9, "x", "y"),
    (5, LONG.upper(), "de", None, 9, "x", "y"),
    (6, "Éa ÉA éA", "fr", "b", 9, "x", "y"),
    (6, "Éa ÉA éA", "fr", "b", 9, "x", "y"),
    (None, "Éa Éa éa", "fr", "b", 9, "x", "y"),
    (None, None, None, None, None, None, None),
    (7, "日本 語" * 3, "ja", "c", 9, "x", "y"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n if i is not None else -1


@pytest.mark.parametrize("block", [8, 4096])
def test_exact_classes(odd, block):
    got = sorted(map(tuple, exact_dedup.exact_classes(odd, block=block).collect()), key=str)
    groups = {}
    for r in ODD:
        groups.setdefault(low(r[1]), []).append(r[0])
    want = []
    for text, ids in groups.items():
        best = max(ids, key=lambda x: (x is not None, x or 0))
        seen = False
        for i in ids:
            kept = i == best and not seen
            seen |= kept
            want.append((i, best, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_exact_classes_of_nothing(none):
    assert exact_dedup.exact_classes(none).collect() == []


def brute_hits(text, items):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    hit, named = set(), set()
    for key, item in items:
        iw = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(item))
        n = min(len(iw), 10)
        for k in range(len(iw) - n + 1 if n else 0):
            for i in range(len(ws) - n + 1):
                if ws[i : i + n] == iw[k : k + n]:
                    hit |= set(range(i, i + n))
                    named.add(str(key))
    return len(ws), len(hit), sorted(named)


def test_contamination(spark, odd, none):
    items = [(10, " ".join(WORDS[:14])), (9, "Short ITEM"), (11, None), (12, "!!"), (13, " ".join(WORDS[5:25]))]
    rows = [(1, "a " + "; ".join(WORDS[:25]) + " b", "", "", 0, "", ""), (2, "short   item, short item x", "", "", 0, "", ""), (3, prose(300), "", "", 0, "", ""), (4, " ".join(WORDS[2:11]), "", "", 0, "", "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for blocks in (1, 1 << 20):
        docs = spark.createDataFrame([*rows, rows[0]], SCHEMA)
        found = decontaminate.contamination(docs, bench, block_bytes=blocks).collect()
        got = {r["doc_id"]: r for r in found}
        assert len(found) == len(rows) + 1
        for i, text, *_ in rows:
            n, hit, named = brute_hits(text, items)
            r = got[i]
            assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, hit, len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), hit > 0)
            assert r["items"] == named
        clean = Counter(i for i, text, *_ in rows if not brute_hits(text, items)[1])
        assert Counter(r["doc_id"] for r in decontaminate.uncontaminated(docs, bench, block_bytes=blocks).collect()) == clean
        assert decontaminate.uncontaminated(none, bench, block_bytes=blocks).collect() == []
        assert decontaminate.contamination(odd, bench, block_bytes=blocks).count() == len(ODD)
    (a, b), *_ = got[1]["spans"]
    assert rows[0][1][a:b] == "; ".join(WORDS[:25])
    assert decontaminate.contamination(odd, bench).count() == len(ODD) and decontaminate.contamination(none, bench).collect() == []
    assert not any(r["contaminated"] for r in decontaminate.contamination(odd, bench.filter("false")).collect())


def test_lookup_table_is_even_and_stable():
    names = tuple(f"s{i}" for i in range(20))
    a, b = sharding.lookup_table(names, 5003), sharding.lookup_table(names[:-1], 5003)
    sizes = Counter(a)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 20
    assert sum(x != y for x, y in zip(a, b, strict=True)) < 0.25 * 5003
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 5000)


def test_sharded(spark, odd, none):
    rows = sharding.sharded(odd).collect()
    assert len(rows) == len(ODD) and all(r["shard"] for r in rows)
    assert len({(r["slot"], r["shard"]) for r in rows if r["doc_id"] == 6}) == 1
    assert sharding.sharded(sharding.sharded(odd)).count() == len(ODD) and sharding.sharded(none).collect() == []


def test_mixture(spark, odd, none):
    rows = [(i, prose(R.randint(0, 60)), "", R.choice(["b", "a", None, "ü"]), 0, "", "") for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mixture(docs).collect()}
    assert Counter(r["doc_id"] for r in mixing.mixed(docs).collect()) == Counter({k: v for k, v in copies.items() if v})
    assert mixing.mixture(odd).count() == len(ODD) and mixing.mixture(none).collect() == [] and mixing.mixed(none).collect() == []


def brute_secrets(text):
    out = []
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for k, (name, pattern, group, least) in enumerate((("assign", assign, 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24))):
        out += [(m.start(), k, m.end(), name) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return [f"{n}:{a}:{b}" for a, _, b, n in sorted(out)]


def test_secrets(spark, odd, none):
    r = random.Random(3)
    key = lambda n, s: "".join(r.choice(s) for _ in range(n))
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    texts = [
        f"é Password = '{key(9, b64)}' and token:token:abcdefgh secret=x; API_KEY=\"{key(30, b64)}\"",
        f"日本 AKIA{key(16, 'ABC123')} AKIAshort {key(40, '0123456789abcdef')} {key(23, '0123456789abcdef')}",
        "password:token:abcdefgh",
        f"AKIA{key(20, '0123456789ABCDEF')}token=AKIA{key(16, 'A1')}",
        "deadbeef" * 3 + "password=" + "deadbeef" * 4,
        f"x {key(44, b64)} y {'thesethentionerwhichoverandunder'} {'averylongplainword' * 2}",
        None,
        "",
    ]
    texts += [f"word {key(36, b64)} end" for _ in range(40)] + ["interconnectednessandmore" + "ing" * (i % 5) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x["doc_id"]: x for x in secrets.secrets(docs).collect()}
    for i, t in enumerate(texts):
        base = brute_secrets(t)
        kinds = Counter(x.split(":")[0] for x in base)
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == (kinds["assign"], kinds["access"], kinds["hex"]), t
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [x for x in got[i]["spans"].split(",") if x and not x.startswith("random")] == base
    found = sum(got[i]["n_random"] for i in range(8, 48))
    assert found >= 15 and sum(got[i]["n_random"] for i in range(48, 88)) == 0
    assert secrets.secrets(odd).count() == len(ODD) and secrets.secrets(none).collect() == []


@pytest.mark.parametrize("bare", [0, 1, 2, 3])
def test_letters_alone_hide_no_secrets(spark, bare):
    r = random.Random(10 + bare)
    b62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def key(s, digits):
        while True:
            x = "".join(r.choice(s) for _ in range(22))
            if digits == any(c.isdigit() for c in x):
                return x

    texts = [f"word {key(b62, True)} end" for _ in range(39)] + [f"word {key(b62, False)} end" for _ in range(bare)] + [f"see {w}" for w in ("internationalisationofthings", "chapter/section/paragraph/notes", "theaveragelengthofaword")] * 8
    got = {x["doc_id"]: x["n_random"] for x in secrets.secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(got[i] for i in range(39)) >= 35 and sum(got[i] for i in range(39, len(texts))) == 0


def test_digit_runs_hide_no_secrets(spark):
    r = random.Random(4)
    key = lambda n, s: "".join(r.choice(s) for _ in range(n))
    b62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    texts = [f"word {key(22, b62)} end" for _ in range(200)] + [f"order {key(22, '0123456789')} sent" for _ in range(2000)] + ["interconnectednessandmore"[:22]] * 5
    got = {x["doc_id"]: x["n_random"] for x in secrets.secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(got[i] for i in range(200)) >= 180 and sum(got[i] for i in range(200, len(texts))) == 0


def test_distinct_and_order_by_packed_numbers():
    """Places are sorted within numbers: values that differ in the lowest bits only are still told apart, and equal ones stay in order of place."""
    r = np.random.default_rng(1)
    far = r.integers(0, 2**64, 5000, dtype=np.uint64)[r.integers(0, 5000, 20_000)]
    for values in (far, far ^ r.integers(0, 2, 20_000, dtype=np.uint64), np.arange(300, dtype=np.uint64)[::-1], np.full(9, 2**64 - 1, np.uint64), far[:0], far[:1]):
        kinds, first, which = words.distinct(values)
        assert kinds.tolist() == sorted(set(values.tolist())) and (kinds[which] == values).all() and (values[first] == kinds).all()
        order, upper = words.coarse_order(values)
        assert order.tolist() == sorted(range(len(values)), key=lambda k: (int(values[k] & upper), k))


def test_lm_scores(spark, monkeypatch, odd, none):
    r = random.Random(11)
    rows = [(2000 + i, " ".join(r.choice(WORDS[:12]) if r.random() < 0.7 else r.choice(WORDS) for _ in range(r.randint(0, 40))), "", "", 0, "", "") for i in range(400)]
    rows += [(1000 + i, "w1 w2 w3 w1 w2 w3 W1 x", "", "", 0, "", "") for i in range(5)] + list(ODD)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = lmscore.lm_scores(docs, least=(1e-3, 1e-4)).collect()
    monkeypatch.setattr(lmscore, "BLOCK_BYTES", 5000)
    blocks = lmscore.lm_scores(docs, least=(1e-3, 1e-4)).collect()
    key = lambda x: (str(x["doc_id"]), x["n_tokens"], round(x["score"], 6))
    assert [key(x) for x in sorted(got, key=key)] == [key(x) for x in sorted(blocks, key=key)]
    toks = lambda t: re.findall(r"[^\x20\x09-\x0D]+", low(t)) + ["</s>"]
    count = Counter(w for row in rows if crc(row[0], 5) != 1 for w in toks(row[1]))
    n, v = sum(count.values()), len(count)
    by = {x["doc_id"]: x for x in got}
    for row in rows[:405]:
        t, x = toks(row[1]), by[row[0]]
        assert (x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"]) == (crc(row[0], 5) == 1, len(t), sum(w in count for w in t), n)
        assert x["base_score"] == pytest.approx(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
    held = [x for x in got if x["held_out"]]
    assert sum(x["score"] for x in held) > sum(x["base_score"] for x in held)
    assert lmscore.lm_scores(none).collect() == [] and lmscore.lm_scores(spark.createDataFrame([(2, "a b")], "doc_id long, text string")).first()["score"] <= 0


def brute_scores(rows):
    toks = lambda t: re.findall(r"[^\x20\x09-\x0D]+", low(t)) + ["</s>"]
    count = Counter()
    for i, t in rows:
        w = ["<s>", *toks(t)]
        count.update(tuple(w[a:b]) for b in range(2, len(w) + 1) for a in range(max(0, b - 3), b) if crc(i, 5) != 1)
    words = {g: c for g, c in count.items() if len(g) == 1}
    count["<s>",] = words["</s>",]
    spent, n, v = Counter(), sum(words.values()), len(words)
    for g, c in count.items():
        if len(g) > 1 and c >= 2:
            spent[g[:-1]] += c - 0.75
    for _, t in rows:
        w, out = ["<s>", *toks(t)], 0
        for b in range(2, len(w) + 1):
            p = (count[w[b - 1],] + 0.5) / (n + 0.5 * (v + 1))
            for a in range(b - 2, max(0, b - 3) - 1, -1):
                ctx, c = tuple(w[a : b - 1]), count[tuple(w[a:b])]
                often = max(count[ctx], 1)
                p = (c - 0.75 if c >= 2 else 0) / often + min(1, max(1e-12, 1 - spent[ctx] / often)) * p
            out += math.log10(p)
        yield out


@pytest.mark.parametrize("hot", [2e-3, 2.0])
@pytest.mark.parametrize("block", [60_000, 8 << 20])
def test_every_repeated_ngram_counts(spark, monkeypatch, block, hot):
    # "rare1 rare2 rare3" is two of 60,000 tokens and more, below what the thresholds by share took.
    r = random.Random(8)
    texts = [" ".join(r.choice(WORDS) for _ in range(150)) for _ in range(600)] + ["rare1 rare2 rare3"] * 8 + ["", None, "w1 w1 w1"]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(lmscore, "BLOCK_BYTES", block)
    monkeypatch.setattr(lmscore, "HOT", hot)
    got = {x["doc_id"]: x for x in lmscore.lm_scores(docs).collect()}
    for (i, _), want in zip(rows, brute_scores(rows), strict=True):
        assert got[i]["score"] == pytest.approx(want, abs=1e-6), i


def told(hashes, offsets, order, least=2):
    """The answers of all orders for texts that are the whole corpus, by counting; and tokens and distinct tokens."""
    starts = [i for a, b in zip(offsets[:-1], offsets[1:], strict=True) for i in [int(a)] * int(b - a)]
    gram = lambda i, k: tuple(hashes[j] if j >= starts[i] else 0 for j in range(i - k + 1, i + 1)) if i - k + 2 >= starts[i] else None
    count = [Counter(g for i in range(len(hashes)) if (g := gram(i, k))) for k in range(order + 1)]
    spent = Counter()
    for k in range(2, order + 1):
        for g, c in count[k].items():
            spent[g[:-1]] += (c - lmscore.DISCOUNT) * (c >= least)
    out = []
    for k in range(1, order + 1):
        # Contexts of order 3 and more are kept n-grams.
        at = [i for i in range(len(hashes)) if (g := gram(i, k)) and (k < 3 or (g[0] != 0 or g[1] != 0) and count[k - 1][g[:-1]] >= least)]
        keys, place = np.unique([str(gram(i, k)) for i in at], return_inverse=True)
        of = dict(zip(place.tolist(), at, strict=True))
        n = np.array([count[k][gram(of[j], k)] for j in range(len(keys))])
        out.append(lmscore.Answer(np.array(at), place, n if k == 1 else np.where(n >= least, n, 0), np.array([spent[gram(of[j], k)[:-1]] for j in range(len(keys))], float)))
    return out, len(hashes), len(count[1])


def test_automaton_sums_to_one_and_falls_where_it_must():
    r = random.Random(2)
    texts = [" ".join(r.choice(WORDS[:6]) for _ in range(30)) for _ in range(60)]
    h, o = lmscore.tokens_of(pa.array(texts))
    answers, total, kinds = told(h.tolist(), o, 3)
    model, token, low = lmscore.block_automaton(o, answers, total, kinds)
    n = model.n
    assert model.order == 3 and len(model.fall) > n + 2
    root = np.log10((answers[0].count + 0.5) / (total + 0.5 * (kinds + 1)))
    rest = np.log10(0.5 / (total + 0.5 * (kinds + 1)))
    for s in range(len(model.fall)):
        gain, _ = model.step(np.full(n, s), np.arange(n), root)
        miss, _ = model.step(np.array([s]), np.array([-1]), np.array([rest]))
        assert (10**gain).sum() + 10 ** miss[0] == pytest.approx(1, abs=1e-9)
    model.falls = 0
    got = lmscore.traverse(model, token, o, low)
    # Failure arcs, one state and token after the other, over the same tables.
    arcs = {int(k): (w, int(f)) for k, w, f in zip(model.keys, model.weight, model.follow, strict=True)}
    falls, want = 0, []
    for a, b in zip(o[:-1], o[1:], strict=True):
        state, sum_ = n + 1, 0.0
        for i in range(a, b):
            after = int(token[i]) + 1
            while state and (key := state * (n + 1) + int(token[i])) not in arcs:
                sum_, state, falls = sum_ + model.loss[state], int(model.fall[state]), falls + 1
            if state:
                sum_, after = sum_ + arcs[key][0], arcs[key][1]
            else:
                sum_ += low[i]
            state = after
        want.append(sum_)
    assert got == pytest.approx(want) and model.falls == falls > 20


def test_long_texts_are_traversed_like_short_ones(monkeypatch):
    texts = [" ".join(random.Random(i).choice(WORDS[:6]) for _ in range(700)) for i in range(4)]
    h, o = lmscore.tokens_of(pa.array(texts))
    model, token, low = lmscore.block_automaton(o, *told(h.tolist(), o, 3))
    a = lmscore.traverse(model, token, o, low)
    monkeypatch.setattr(lmscore, "LANE", 10_000)
    assert a == pytest.approx(lmscore.traverse(model, token, o, low))


def test_languages(spark, odd, none):
    r = random.Random(1)
    sample = {"en": ["the", "and", "with", "that", "sh", "tion"], "de": ["und", "der", "sch", "ung", "ß", "ä"], "fr": ["é", "eau", "que", "le", "ç"]}
    rows = [(i, " ".join("".join(r.choice(sample[k]) for _ in range(r.randint(1, 3))) for _ in range(60)), k, "s", 0, "", "") for i, k in enumerate(["en", "de", "fr"] * 80)]
    got = {x["doc_id"]: x for x in langid.languages(spark.createDataFrame(rows, SCHEMA)).collect()}
    held = [x for x in rows if crc(x[0], 4) == 2]
    assert all(got[x[0]]["held_out"] for x in held)
    assert np.mean([got[x[0]]["lang_pred"] == x[2] for x in held]) >= 0.9 and all(0 <= x["score"] <= 1 for x in got.values())
    none_of = [x["lang_pred"] for x in langid.languages(odd).collect() if x["doc_id"] in (1, 2, 3)]
    assert none_of == ["und"] * 3 and langid.languages(none).collect() == []


def test_network_gradients():
    net = langid.Network.fresh(["a", "b"], 3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    x, label = r.integers(0, 257, (9, 4)), np.array([0, 1, 1, 0])
    _, g = net.gradients(x, label)
    for k in ("emb", "uf", "wb", "bf", "v"):
        i = tuple(r.integers(0, s) for s in net.p[k].shape) if k != "emb" else (x[2, 1], 3)
        old = net.p[k][i]
        net.p[k][i] = old + 1e-3
        up = net.gradients(x, label)[0]
        net.p[k][i] = old - 1e-3
        down = net.gradients(x, label)[0]
        net.p[k][i] = old
        assert g[k][i] == pytest.approx((up - down) / 2e-3, rel=0.08, abs=2e-5)


def weighted_jaccard(a, b):
    def grams(t):
        w = low(t).split()
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])

    x, y = grams(a), grams(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_signatures_estimate_weighted_jaccard():
    a = "a b c d e f " * 6 + prose(80)
    b = "a b c d e f " * 3 + a[36:]
    row, gram, count, size, _ = neardup.shingles(pa.array([a, b]))
    s = neardup.signatures(row, gram, count, 2, 4000)
    assert count.max() > 3 and np.mean(s[0] == s[1]) == pytest.approx(weighted_jaccard(a, b), abs=0.04)


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(8)
    texts = []
    for _ in range(25):
        base = [r.choice(WORDS) for _ in range(r.randint(60, 160))]
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 5)):
            copy = list(base)
            for _ in range(r.randint(0, 6)):
                copy[r.randrange(len(copy))] = "edit%d" % r.randrange(10**6)
            texts.append(" ".join(copy))
    texts += [texts[0].upper(), None, "", " ", "one two", "one two", "one two three", "x " * 40, "x " * 44]
    docs = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "").split() and weighted_jaccard(texts[i], texts[j]) >= 0.8:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    got = {x["doc_id"]: x for x in neardup.near_duplicates(docs).collect()}
    sizes = Counter(label)
    for i, k in enumerate(label):
        assert (got[100 + i]["class_id"], got[100 + i]["class_size"], got[100 + i]["kept"]) == (100 + k, sizes[k], k == i), texts[i]


def test_near_duplicates_of_odd_rows(spark, odd, none):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and neardup.near_duplicates(none).collect() == []
    left = neardup.without_near_duplicates(odd).collect()
    assert neardup.without_near_duplicates(none).collect() == []
    assert Counter(x["doc_id"] for x in left) == Counter([1, 2, 3, 4, 6, 7, None]) and set(left[0].asDict()) == set(odd.columns)


def test_boosting_and_calibration():
    r = np.random.default_rng(0)
    x = r.normal(size=(1500, 5))
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0.5)).astype(float)
    trees = gbdt.fit(x[:1000], y[:1000], np.ones(1000))
    raw = trees.raw(x[1000:])
    assert np.mean((raw > 0) == (y[1000:] > 0)) > 0.95
    knots, values = gbdt.isotonic(raw, y[1000:], np.ones(500))
    assert (np.diff(values) >= 0).all() and (np.diff(knots) >= 0).all() and 0 < values[0] < values[-1] < 1


def test_toxicity(spark, odd, none):
    r = random.Random(4)
    bad = ["vilewrd", "nastyone", "grimthing"]
    rows, labels = [], []
    for i in range(600):
        t = prose(r.randint(20, 60), r).split()
        y = int(r.random() < 0.3)
        if y:
            for _ in range(3):
                t.insert(r.randrange(len(t)), r.choice(bad) + r.choice(["", "s", "ish", "."]))
        rows.append((i, " ".join(t), "", "", 0, "", ""))
        labels.append((i, y))
    lab = spark.createDataFrame([*labels, (None, 1), (3, None), (5, 7)], "doc_id long, toxic int")
    got = {x["doc_id"]: x for x in toxicity.toxicity(spark.createDataFrame([*rows, *ODD[8:9]], SCHEMA), lab).collect()}
    held = [(got[i], y) for i, y in labels if crc(i, 5) == 0]
    assert all(x["held_out"] for x, _ in held) and np.mean([x["predicted"] == y for x, y in held]) >= 0.95
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in got.values())
    assert toxicity.toxicity(odd, lab.filter("false")).count() == len(ODD) and toxicity.toxicity(none, lab).collect() == []


def test_quality(spark, odd, none):
    r = random.Random(6)
    rows = []
    for i in range(400):
        t = [w + ("." if k % 9 == 8 else "") for k, w in enumerate(prose(80, r).split())]
        if i % 5 == 0:
            t = [w.upper() + "!!" for w in t]
        if i % 5 == 1:
            t = [t[0]] * 80
        rows.append((i, " ".join(t), "", "", 0, "", ""))
    got = {x["doc_id"]: x for x in quality.quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert np.mean([got[i]["predicted"] == int(i % 5 > 1) for i in range(400)]) >= 0.97
    assert quality.quality(odd).count() == len(ODD) and quality.quality(none).collect() == []


def test_labellers_are_recovered():
    r = np.random.default_rng(1)
    y = r.random(20000) < 0.8
    acc = np.array([0.9, 0.8, 0.7, 0.85])
    v = np.where(r.random((20000, 4)) < acc, np.where(y[:, None], 1, -1), np.where(y[:, None], -1, 1))
    p, c = np.unique(v, axis=0, return_counts=True)
    share, chance, _ = quality.fit_labellers(p, c.astype(float))
    assert share[0] == pytest.approx(0.8, abs=0.06) and chance[1][:, 2] == pytest.approx(acc, abs=0.06)
