"""Columns with clashing names, few labels, ids that are texts, rows that repeat, and every stage of the pipeline against a plain version."""

import math
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_brute import claimed, levelled, low, plain_features, plain_raw, slot

from marlstone.llm import decontaminate, exact_dedup, langid, lmscore, mixing, neardup, quality, secrets, sharding, toxicity
from marlstone.llm.store import saved

SF = "/root/testdata/sf0.001"
#: Names that the operators use themselves, or once did.
TAKEN = ["contaminated", "n_words", "n_hit", "spans", "items", "Slot", "SHARD", "__copy", "__none", "row", "k0", "v0", "place", "cut", "copies", "score", "loc", "same", "kept", "hit", "col", "rid", "part", "a.b", "tick`ed", "name", "block"]


def clashing(spark, n=60):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(n)
    rows = [(*r, *(f"{c} of {i}" for c in TAKEN)) for i, r in enumerate(docs.collect())]
    kind = docs.schema
    for c in TAKEN:
        kind = kind.add(c, "string")
    return spark.createDataFrame(rows, kind)


def test_stages_carry_columns_of_any_name(spark):
    docs = saved(clashing(spark))
    for name, stage in corpus_pipeline.STAGES:
        mine = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        new = [c for c in out.columns if c not in docs.columns]
        assert (new == [] and out.columns == docs.columns) or name == "sharding", name
        kept = [c for c in docs.columns if c.lower() not in ("slot", "shard")]
        if name == "sharding":
            assert out.columns == [*kept, "slot", "shard"]
        rows = out.collect()
        assert rows
        for r in rows:
            assert [r[c] for c in kept] == [mine[r["doc_id"]][c] for c in kept], name
        docs = saved(out)


def test_operators_ignore_columns_of_any_name(spark):
    docs = saved(clashing(spark))
    plain = docs.select("doc_id", "text", "lang", "source")
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    same = lambda f: sorted(map(str, f(docs).collect())) == sorted(map(str, f(plain).collect()))
    for f in (lmscore.lm_scores, langid.languages, neardup.near_duplicates, mixing.mixture, quality.quality, exact_dedup.exact_classes, secrets.secrets):
        assert same(f), f.__name__
    assert same(lambda x: toxicity.toxicity(x, labels)) and same(lambda x: decontaminate.contamination(x, bench))
    assert same(lambda x: sharding.sharded(x).select("doc_id", "slot", "shard"))
    one = decontaminate.contamination(docs, bench, ("doc_id", "n_words", "Slot")).columns
    assert one[:2] == ["doc_id", "Slot"] and one.count("n_words") == 1


def test_few_labels_give_their_mean(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(60).select("doc_id", "text")
    ids = [r["doc_id"] for r in docs.collect()]
    labels = spark.createDataFrame([(i, int(k % 10 == 0)) for k, i in enumerate(ids)] + [(10**9 + k, 1) for k in range(500)] + [(ids[1], 0)] * 50, "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    held = {r["doc_id"] for r in got if r["held_out"]}
    used = [int(k % 10 == 0) for k, i in enumerate(ids) if i not in held]
    # The share of the labels, or of those that calibrate where both classes reach them.
    assert len({r["score"] for r in got}) == 1 and 0.02 <= got[0]["score"] <= 0.4 and not any(r["predicted"] for r in got)
    # One toxic text can't be grown and calibrated on.
    mine = [i for i in ids if i not in held][:12]
    few = spark.createDataFrame([(i, int(k == 3)) for k, i in enumerate(mine)], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.toxicity(docs, few).collect()] == pytest.approx([1 / 12] * 60)
    assert toxicity.untoxic(docs, toxicity.train(docs, labels)).count() == 60


def test_ids_may_be_texts(spark):
    r = random.Random(2)
    rows = [(f"id {i}", " ".join(r.choice(["vilewrd", "w1", "w2", "w3", "w4", "w5"][int(i % 3 > 0) :]) for _ in range(30))) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    labels = spark.createDataFrame([(i, int("vilewrd" in t)) for i, t in rows], "doc_id string, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert np.mean([x["predicted"] == int("vilewrd" in dict(rows)[x["doc_id"]]) for x in got]) > 0.95
    texts, bench = docs.limit(20), spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")
    for out in (lmscore.lm_scores(texts), neardup.near_duplicates(texts), exact_dedup.exact_classes(texts), secrets.secrets(texts), quality.quality(texts), decontaminate.contamination(texts, bench)):
        assert out.count() == 20


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def classes(docs, threshold):
    """The least position of each document's class, from all pairs that share a shingle; and those pairs' similarities."""
    bags, having = [grams(t) for _, t in docs], defaultdict(list)
    label, alike = list(range(len(docs))), {}
    for i, bag in enumerate(bags):
        for j in {j for g in bag for j in having[g]}:
            inter = sum((bag & bags[j]).values())
            alike[j, i] = inter / (sum(bag.values()) + sum(bags[j].values()) - inter)
        for g in bag:
            having[g].append(i)

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for (i, j), s in alike.items():
        if s >= threshold:
            a, b = sorted((top(i), top(j)))
            label[b] = a
    return [top(i) for i in range(len(docs))], alike


def test_pairs_across_components_lose_nothing(spark):
    # Sets of items with labels of their own, on both sides of the threshold; one label has many members.
    r = random.Random(14)
    base = [r.sample(range(1000), 60) for _ in range(8)]
    sets = []
    for i in range(150):
        mine = set(base[i % 8])
        for _ in range(r.randint(0, 9)):
            mine.discard(r.choice(sorted(mine)))
            mine.add(r.randint(0, 3000))
        sets.append((i, 1 if i % 8 == 0 and i % 3 else i, sorted(mine)))
    rest = spark.createDataFrame([(i, s) for i, _, s in sets], "node long, items array<long>")
    got = {(x["a"], x["b"]) for x in neardup.across(rest, 0.8).collect()}
    alike = [(i, j) for i, _, s in sets for j, _, t in sets if i < j and len(set(s) & set(t)) >= 0.8 * len(set(s) | set(t))]
    joined = lambda pairs: _components(len(sets), pairs)
    # The same components: no link is lost, and none is made up.
    assert joined(got) == joined(alike) and len(alike) > 50 and len(got) < len(sets)


def _components(n, pairs):
    label = list(range(n))
    for a, b in pairs:
        x, y = label[a], label[b]
        label = [min(x, y) if k in (x, y) else k for k in label]
    return label


def test_a_template_costs_no_more_than_its_texts(spark):
    """Texts of one template, just below the threshold: twice as many take about twice the time."""
    import time

    r = random.Random(6)
    template = [f"t{r.randrange(5000)}" for _ in range(120)]

    def text(k):
        words = list(template)
        for at in (20, 40, 60, 80, 100):
            words[at] = f"u{k}x{at}"
        return " ".join(words)

    took = {}
    for n in (200, 2000, 4000):
        docs = saved(spark.createDataFrame([(k, text(k)) for k in range(n)], "doc_id long, text string").repartition(8))
        began = time.time()
        assert {x["class_size"] for x in neardup.near_duplicates(docs).select("class_size").distinct().collect()} == {1}
        took[n] = time.time() - began
    assert took[4000] < 2.2 * max(took[2000], 2), took


def test_recall_of_near_copies_on_a_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    want, alike = classes(docs, 0.8)
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    pairs = [(i, j) for (i, j), s in alike.items() if s >= 0.8]
    found = sum(got[docs[i][0]] == got[docs[j][0]] for i, j in pairs)
    assert len(pairs) > 100 and found >= 0.99 * len(pairs)
    apart = [(i, j) for (i, j), s in alike.items() if s < 0.8 and want[i] != want[j]]
    assert not any(got[docs[i][0]] == got[docs[j][0]] for i, j in apart)


def test_pipeline_against_plain_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    for name, stage in corpus_pipeline.STAGES:
        rows = sorted(map(tuple, docs.select("doc_id", "text", "source").collect()), key=str)
        out = stage(spark, docs, SF)
        got = Counter((r["doc_id"], r["text"], r["source"]) for r in out.collect())
        if name == "toxicity":
            model = toxicity.train(docs.select("doc_id", "text"), labels)
            want = Counter()
            for r in rows:
                if model.trees is None:
                    score = model.prior
                else:
                    x = toxicity.features(pa.array([r[1]], pa.string()), model.lexicon)[0]
                    assert x[[0, 9, 10, 11, 12, 13]] == pytest.approx(np.array(plain_features(r[1] or "", {}, {}))[[0, 9, 10, 11, 12, 13]])
                    raw = plain_raw(model.trees, x)
                    score = 0.99 * np.interp(raw, *model.knots) + 0.01 / (1 + math.exp(-raw))
                want[r] += score < 0.5
            assert got == +want
        elif name == "near_duplicates":
            kept, _ = classes([(r[0], r[1]) for r in rows_by_id(rows)], 0.8)
            assert got == Counter(r for i, r in enumerate(rows_by_id(rows)) if kept[i] == i)
        elif name == "decontamination":
            want = Counter()
            for r in rows:
                w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(r[1]))
                want[r] += not any(hits(w, re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))) for _, t in items)
            assert got == +want
        elif name == "mixing":
            words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
            size, taken = Counter(), Counter()
            for r in rows:
                size[r[2]] += words(r[1])
            for r, n in got.items():
                taken[r[2]] += n * words(r[1])
            names = sorted(x for x in size if x is not None) + ([None] if None in size else [])
            target = levelled([size[x] for x in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(size.values()), 2)
            longest = max(words(r[1]) for r in rows)
            assert all(abs(taken[x] - t) <= longest for x, t in zip(names, target, strict=True)) and set(got) <= set(rows) and max(got.values()) <= 2
        else:
            table = claimed(sharding.SHARDS[:3], 101)
            assert sharding.lookup_table(sharding.SHARDS[:3], 101) == table and got == Counter(rows)
            assert all(r["slot"] == slot(r["doc_id"], r["text"], sharding.SLOTS) and r["shard"] in sharding.SHARDS for r in out.collect())
        docs = saved(out)


def rows_by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))


def hits(words, item):
    n = min(10, len(item))
    mine = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if n else set()
    return any(tuple(words[i : i + n]) in mine for i in range(len(words) - n + 1)) if n else False
