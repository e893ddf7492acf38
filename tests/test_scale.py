"""Operators for whole tables against plain versions: exact quantiles, keyword lookups, name tiles, heavy terms, buckets, streams, reports, page identities."""

import difflib
import itertools
import random
import re
import time
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.operators import composites, cosine, pages, quantiles, reports, resolve, similar, stats, terms
from marlstone.sources import buckets, stage
from marlstone.streaming import incremental


@pytest.mark.parametrize("few", [5, 300, 100_000])
def test_quantiles_are_exact(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "ACCURACY", 50)
    r = random.Random(few)
    values = [r.choice([None, 1.5, -2.0, r.gauss(0, 1e9), r.random() / 1e9, float(r.randrange(5))]) for _ in range(4000)]
    df = spark.createDataFrame([(v, 7.0 if i % 2 else None, None) for i, v in enumerate(values)], "v double, same double, none double").repartition(5)
    fractions = [0, 0.001, 0.05, 0.25, 1 / 3, 0.5, 0.95, 1]
    got = quantiles.exact_quantiles(df, {**{f"q{i}": ("v", q) for i, q in enumerate(fractions)}, "same": ("same", 0.5), "none": ("none", 0.5)}, few=few).first()
    want = np.quantile([v for v in values if v is not None], fractions)
    assert [got[f"q{i}"] for i in range(len(fractions))] == pytest.approx(want, rel=1e-12, abs=1e-300) and got["same"] == 7 and got["none"] is None
    assert quantiles.exact_quantiles(df.filter("false"), {"q": ("v", 0.5)}).collect() == [(None,)]


def test_quantiles_of_many_distinct_values(spark):
    """The rows that one task sees after the scan are those of the bracket, not of the table."""
    df = spark.range(1_000_000).select((F.col("id") * 7919 % 1_000_003).cast("double").alias("v"))
    have = np.sort(np.arange(1_000_000) * 7919 % 1_000_003)
    out = quantiles.exact_quantiles(df, {"m": ("v", 0.5), "q": ("v", 0.9)}, few=2000)
    assert tuple(out.first()) == pytest.approx(tuple(np.quantile(have, [0.5, 0.9])))
    assert "percentile(" not in out._jdf.queryExecution().executedPlan().toString()
    brackets = quantiles._brackets(df.select(F.col("v").alias("v0"), F.col("v").alias("v1")), [0.5, 0.9], 2000)
    assert all(((have >= low) & (have <= high)).sum() <= 2000 for _, low, high in brackets)


def test_outside_fences(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([*range(20), 90, -80])] + [(99, None)], "i long, v double")
    assert sorted(map(tuple, stats.outside_fences(df, "v").collect())) == [(20, 90.0), (21, -80.0)]


def test_keyword_rows_follow_the_patterns(spark):
    r = random.Random(5)
    aspects = {"A": ["servis", "muhatap yok", "oda", "oda temizliği"], "B": ["ses", "kirli", "checkin", "a.b", "koy", "servis"], "C": ["çay ocağı iyi", "yemek"]}
    unless = {"A": {"servis": ["servis aracı", "araç servisi"]}}
    pieces = ["servis", "servisler", "servisx" + "y" * 9, "aracı", "araç", "servisi", "oda", "odalar", "odada", "odacı", "temizliği", "muhatap", "yok", "ses", "sesli", "sesin", "kirliydi", "checkin", "checkinler", "a.b", "a", "b", "koy", "koyu", "çay", "ocağı", "iyi", "yemekhane", "z"]
    rows = [(i, "".join(x + r.choice([" ", " ", "  ", "-", "1", "."]) for x in r.choices(pieces, k=r.randrange(14)))) for i in range(500)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "i long, t string").repartition(4)
    got = {tuple(x) for x in terms.keyword_rows(df, "i", F.col("t"), aspects, unless).collect()}
    # The patterns in Python, where letters are word characters but digits and the underscore.
    has = lambda k, t: re.search("(^|[^a-zçğıöşü])(" + terms.keyword_form(k, "[a-zçğıöşü]") + ")([^a-zçğıöşü]|$)", t)
    want = {(i, a, k) for i, t in rows for a, ks in aspects.items() for k in ks if t and has(k, t) and not any(has(o, t) for o in unless.get(a, {}).get(k, []))}
    assert got == want and len(want) > 500
    counts = {(x["aspect"], x["keyword"]): x["n_docs"] for x in terms.keyword_counts(df, "i", F.col("t"), aspects).collect()}
    assert counts == {(a, k): sum(1 for _, t in rows if t and has(k, t)) for a, ks in aspects.items() for k in ks}
    with pytest.raises(ValueError):
        terms.keyword_rows(df, "i", F.col("t"), {"A": ["#1"]})


def test_keyword_rows_do_not_depend_on_the_number_of_keywords(spark):
    df = spark.createDataFrame([(1, "alpha beta")], "i long, t string")
    size = lambda n: len(terms.keyword_rows(df, "i", F.col("t"), {"A": [f"word{k:04d}x" for k in range(n)]})._jdf.queryExecution().analyzed().toString().split("\n"))
    assert size(2000) == size(20)


@pytest.mark.parametrize("block", [3, 2000])
def test_name_tiles_lose_no_pair(spark, block):
    r = random.Random(9)
    words = ["blue", "bay", "grand", "hotel", "sunset", "xanadu", "kaya", "palace", "q", "東京"]
    name = lambda: " ".join(r.sample(words, r.randint(1, 4))) + r.choice(["", "s", " 7"])
    left, right = [name() for _ in range(60)] + ["", None], [name() for _ in range(80)] + [None, "a"]
    schema = "name string"
    got = {(x["left"], x["right"]): x["ratio"] for x in resolve.alike_names(spark.createDataFrame([(x,) for x in left], schema), spark.createDataFrame([(x,) for x in right], schema), 0.55, block).collect()}
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    assert got == {(a, b): ratio(a, b) for a in set(left) for b in set(right) if a and b and ratio(a, b) >= 0.55} and len(got) > 200


def test_matches_on_a_table_are_those_of_all_pairs(spark):
    """Every part against every supplier, by the ratio itself."""
    from marlstone.plans import registry
    from marlstone.plans.cleaning_queries import _projects

    sf = "/root/testdata/sf0.01"
    left, right = ([r.asDict() for r in x.collect()] for x in _projects(spark, sf))
    assert len(left) == 2000 and len(right) == 100
    fold = lambda n: re.sub("[^a-z0-9_]+", " ", n.lower()).strip()
    ratios = {(a, b): difflib.SequenceMatcher(None, a, b).ratio() for a in {fold(x["name"]) for x in left} for b in {fold(y["name"]) for y in right}}
    want = {}
    for x in left:
        best, n = None, 0
        for y in right:
            s, phone, area = ratios[fold(x["name"]), fold(y["name"])], x["phone"] == y["phone"], x["area"] == y["area"]
            if s < 0.55 and not phone:
                continue
            n += 1
            score = min(1.0, max(0.6 * s + 0.2 * phone + 0.15 * area, 0.95 * phone))
            best = max(best or (), (phone, round(score, 4), s, -y["id"]))
        want[x["id"]] = (n, best and -best[3])
    got = {r["id_l"]: (r["n_candidates"], r["id_r"]) for r in registry.queries()["jn16_er01_er03_matches"](spark, sf).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    # Halves to even of a fourth digit may tie two rows: nearly all agree on the row too.
    assert sum(got[k] == want[k] for k in want) >= 0.99 * len(want) and sum(v[1] is not None for v in want.values()) > 100


def test_a_heavy_term_is_dealt_over_all_tasks(spark):
    rows = [(i, "heavy" if i % 5 == 0 else f"t{i % 400}") for i in range(4000)]
    df = spark.createDataFrame(rows, "i long, t string")
    pairs = similar.tiled_pairs(df, "t", "i", [], tile=100)
    got = sorted(tuple(sorted((r["a"], r["b"]))) for r in pairs.collect())
    by = {}
    for i, t in rows:
        by.setdefault(t, []).append(i)
    assert got == sorted(p for g in by.values() for p in itertools.combinations(g, 2))
    for key, value in (("spark.sql.adaptive.coalescePartitions.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(key, value)
    where = [r["n"] for r in pairs.filter("t = 'heavy'").groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    for key in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold"):
        spark.conf.unset(key)
    assert sum(where) == 800 * 799 // 2 and len(where) >= 6 and max(where) <= 0.5 * sum(where)


def test_cosine_pairs_in_small_tiles(spark):
    r = random.Random(11)
    rows = []
    for i in range(60):
        w = {t: r.random() for t in r.sample(["common", *"abcdefgh"], 4)} | {"common": 0.4}
        norm = sum(x * x for x in w.values()) ** 0.5
        rows += [(i, t, x / norm) for t, x in w.items()]
    df = spark.createDataFrame(rows, "doc_id long, term string, weight double")
    one, two = ({(x["a"], x["b"]): x["cosine"] for x in similar.cosine_pairs(df, tile=t).collect()} for t in (4, 2000))
    assert one == pytest.approx(two) and len(one) > 20


def test_cosine_texts_write_less_than_their_pairs_have_words(spark, monkeypatch):
    """Before, every pair that met was joined with all its words: 90 long texts that share rare words wrote one row for each word of each pair."""
    r = random.Random(18)
    word = lambda k: "".join(chr(97 + k // 26**j % 26) for j in range(4))
    docs = [(i, " ".join(word(r.randrange(6000)) for _ in range(400))) for i in range(90)]
    docs += [(100 + i, docs[i][1].replace(word(7), "zzz", 1) + " end") for i in range(30)]
    docs += [(200, docs[0][1]), (201, None), (202, ""), (203, "a b"), (204, "\u0130stanbul K\u00e9 \u212aelvin ab1cde"), (205, "\u0130stanbul k\u00e9 kelvin ab1cde fg"), (None, docs[3][1] + " tail"), (5, docs[6][1] + " more")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    t = df.filter("text IS NOT NULL").groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    w = terms.tf_idf(t.select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)).alias("ws")), F.col("ws"), min_df=1).collect()
    vec = {}
    for x in w:
        vec.setdefault(x["doc_id"], {})[x["term"]] = x["weight"]
    all_pairs = {(a, b): sum(x * vec[b].get(k, 0) for k, x in vec[a].items()) for a in vec for b in vec if a is not None and b is not None and a < b}
    want = {k: c for k, c in all_pairs.items() if c >= 0.8}
    written = []
    monkeypatch.setattr(cosine, "saved", lambda df: written.append(stage.saved(df)) or written[-1])
    monkeypatch.setattr(cosine, "dropped", lambda *_: None)
    for size in (16 << 20, 20_000):
        monkeypatch.setattr(cosine, "BLOCK_BYTES", size)
        got = {(x["a"], x["b"]): x["cosine"] for x in similar.cosine_texts(df, "doc_id", "text").collect()}
        assert got == pytest.approx(want) and len(want) >= 30 and (204, 205) in want
    # Nearly all that is written as a pair is one.
    pairs = [x.count() for x in written if x.columns == ["a", "b"]]
    assert len(pairs) == 2 and max(pairs) <= 2 * len(want) < len(all_pairs) / 20


def test_cosine_tiles_in_slices(monkeypatch):
    """Words and meetings are the same however they are sliced."""
    text = ("ab abc zabcd9efg \u00e9xyz\n" * 30 + "q" * 300 + " end").encode()
    data = np.frombuffer(text, np.uint8)
    monkeypatch.setattr(cosine, "PIECE", 37)
    starts, hashes = (np.concatenate(x) for x in zip(*cosine.letter_words(data), strict=True))
    want = [(m.start(), m.group()) for m in re.finditer(rb"[a-z]{3,}", text)]
    assert starts.tolist() == [x for x, _ in want]
    assert len(set(zip(hashes.tolist(), (w for _, w in want), strict=True))) == len(set(hashes.tolist())) == len({w for _, w in want})
    r = np.random.default_rng(3)
    x = r.random((80, 40)) * (r.random((80, 40)) < 0.2)
    x[40:] = x[:40] * (r.random((40, 40)) < 0.95)
    x[:, 0] += 0.5
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    doc, t = np.nonzero(x)
    columns = cosine._packed(list(range(80)), doc, t, (x > 0).sum(axis=0)[t], x[doc, t], x[doc, t])
    table = pa.table(columns, names=["id", "t", "d", "c", "q", "r", "p"])
    begin = table.append_column("g", [[i % 2 for i in range(80)]])
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    want = {(a, b) for a, b in itertools.combinations(range(80), 2) if x[a] @ x[b] >= 0.8}
    for most in (7, 1000, 2_000_000):
        monkeypatch.setattr(cosine, "MEETINGS", most)
        monkeypatch.setattr(cosine, "SLICE", most // 3 + 1)
        found = set()
        for i, j in ((0, 0), (0, 1), (1, 1)):
            tile = begin.filter(pa.array([g in (i, j) for g in begin.column("g").to_pylist()])).append_column("i", [[i] * 40 * (1 + j - i)]).append_column("j", [[j] * 40 * (1 + j - i)])
            pairs = cosine._met(0.8, schema)(tile)
            found |= {(min(p), max(p)) for p in zip(*(c.to_pylist() for c in pairs.columns), strict=True)}
        assert want <= found and len(want) > 20
        every = pa.table([[a for a in range(80) for b in range(a)], [b for a in range(80) for b in range(a)]], schema=schema)
        got = cosine._scored(0.8, None, schema.append(pa.field("cosine", pa.float64())))(every, table).to_pylist()
        assert {(v["b"], v["a"]) for v in got} == want and all(v["cosine"] == pytest.approx(x[v["a"]] @ x[v["b"]]) for v in got)


def test_buckets_rewrite_only_what_they_touch(spark, tmp_path):
    at, schema = str(tmp_path / "t"), "k long, v string, bucket string"
    make = lambda rows: spark.createDataFrame([(k, v, "own") for k, v in rows], schema)
    files = lambda: {p for p in Path(at).rglob("*.parquet")}
    assert buckets.read(spark, at, schema).collect() == []
    buckets.write(make([(k, "a") for k in range(200)] + [(None, "n")]), at, "k", buckets.replace("k"), buckets=16)
    before = files()
    buckets.write(make([(3, "b"), (500, "c")]), at, "k", buckets.replace("k"))
    touched = {p.parent.name for p in files() - before}
    assert 1 <= len(touched) <= 2 and {p for p in before if p.parent.name not in touched} <= files()
    want = {**dict.fromkeys(range(200), "a"), None: "n", 3: "b", 500: "c"}
    assert {r["k"]: r["v"] for r in buckets.read(spark, at, schema).collect()} == want
    assert {r["bucket"] for r in buckets.read(spark, at, schema).collect()} == {"own"}
    # The version before is still there, and a version that is done is not written again.
    assert {r["k"]: r["v"] for r in buckets.read(spark, at, schema, 0).collect()}[3] == "a"
    buckets.write(make([(3, "again")]), at, "k", buckets.replace("k"), version=1)
    assert {r["k"]: r["v"] for r in buckets.read(spark, at, schema).collect()} == want

    def lost(old, new):
        return buckets.replace("k")(old, new).withColumn("v", F.when(F.col("k") == 7, F.raise_error("lost")).otherwise(F.col("v")))

    with pytest.raises(Exception, match="lost"):
        buckets.write(make([(7, "never")]), at, "k", lost)
    assert {r["k"]: r["v"] for r in buckets.read(spark, at, schema).collect()} == want
    buckets.write(make([(7, "z")]), at, "k", buckets.replace("k"))
    assert {r["k"]: r["v"] for r in buckets.read(spark, at, schema).collect()} == want | {7: "z"}


def test_bucket_rules(spark, tmp_path):
    one = lambda rule, *batches: {r["k"]: r["v"] for r in _kept(spark, tmp_path, rule, batches).collect()}
    a, b = [(1, 5), (2, 6)], [(2, 7), (3, 8)]
    assert one(buckets.replace("k"), a, b) == {1: 5, 2: 7, 3: 8}
    assert one(buckets.add_counters("k", ["v"]), a, b) == {1: 5, 2: 13, 3: 8}
    assert one(buckets.keep_first("k", "v"), a, [*b, (3, 1)]) == {1: 5, 2: 6, 3: 1}


def _kept(spark, folder, rule, batches):
    at = f"{folder}/{random.random()}"
    for rows in batches:
        buckets.write(spark.createDataFrame(rows, "k long, v long"), at, "k", rule, buckets=4)
    return buckets.read(spark, at, "k long, v long")


def test_streams_drop_what_comes_again(spark, tmp_path):
    """Late, repeated and replayed rows: the stream ends with the batch's rows."""
    schema = "id string, at timestamp, v long"
    rows = [(f"r{k}", f"2024-01-{1 + k % 5:02d} 00:00:00", k) for k in range(40)]
    parts = [rows[:20], rows[10:30], rows[:5] + rows[25:]]
    landing = f"{tmp_path}/in"
    make = lambda part: spark.createDataFrame(part, "id string, at string, v long").withColumn("at", F.col("at").cast("timestamp")).coalesce(1)
    for part in parts:
        make(part).write.mode("append").parquet(landing)
    stream = incremental.first_reviews(incremental.landing(spark, landing, schema), "id", "at", "30 days")
    q = stream.writeStream.format("memory").queryName("firsts").outputMode("append").trigger(availableNow=True).start()
    assert incremental.awaited(q, 120)
    batch = incremental.first_reviews(spark.read.schema(schema).parquet(landing), "id", "at")
    assert sorted(map(tuple, spark.table("firsts").collect())) == sorted(map(tuple, batch.collect())) == sorted(map(tuple, make(rows).collect()))


def test_streams_stop_safely_and_skip_what_is_done(spark, tmp_path):
    schema, landing, at, state, stop = "id long, v long", f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", tmp_path / "stop"
    run = lambda checkpoint: incremental.awaited(incremental.collect_stream(incremental.landing(spark, landing, schema), at, "id", "v", checkpoint, str(stop), 8), 120)
    rows = lambda: {r["id"]: r["v"] for r in incremental.latest(spark, at, schema).collect()}
    put = lambda part: spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(landing)
    put([(1, 1), (2, 2)])
    assert run(state) and rows() == {1: 1, 2: 2}
    put([(2, 9), (3, 3)])
    stop.write_text("")
    assert not run(state) and rows() == {1: 1, 2: 2}
    stop.unlink()
    assert run(state) and rows() == {1: 1, 2: 2, 3: 3}
    # A new checkpoint replays all files: nothing changes.
    assert run(f"{tmp_path}/fresh") and rows() == {1: 1, 2: 2, 3: 3}
    done = spark.createDataFrame([(1,), (2,)], "id long")
    assert incremental.not_done(incremental.latest(spark, at, schema), done, "id").collect() == [(3, 3)]


def test_rules_hold_for_their_source_alone(spark):
    docs = spark.createDataFrame([(1, "a", "x colours y"), (2, "a", "x collection colours"), (3, "a", "plain"), (4, "b", "x colours"), (5, None, "x colours"), (6, "a", None)], "i long, src string, t string")
    rules = spark.createDataFrame([("a", 1, "collection", "C"), ("a", 2, "colou?rs", "K"), ("a", 2, "colours", "K2"), ("z", 1, ".", "Z")], "source string, priority int, pattern string, entity string")
    got = {r["i"]: (r["entity"], r["status"]) for r in resolve.resolved_by_source(docs, rules, "i", "src", F.col("t")).collect()}
    assert got == {1: ("K", "RESOLVED"), 2: ("C", "RESOLVED"), 3: (None, "NO_RULE_HOLDS"), 4: (None, "NO_RULES"), 5: (None, "NO_RULES"), 6: (None, "NO_RULE_HOLDS")}


def test_page_identities(spark):
    page = lambda title, *links: f"<title>{title}</title>" + "".join(f"<a href='{x}'>t</a>" for x in links)
    rows = [
        (1, "https://s/green-bay-resort", page("Green Bay Resort Şikayet ve Yorumları - S", "/green-bay-resort/a", "/green-bay-resort/a?x", "/other/b")),
        (2, "https://s/la-blanche?page=1", page("La Blanche &amp; Co Şikayetleri - S", "/la-blanche-spa/a", "https://s/etstur/b", "/la-blanche-spa/c", "/about")),
        (3, "https://s/hakkimizda", page("Hakkımızda")),
        (4, "https://s/arama?q=x", page("X Şikayetleri")),
        (5, "https://s/empty", page("Empty sikayet")),
        (6, None, None),
    ]
    got = {r["page_id"]: r for r in pages.identities(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k]["exists"] for k in range(1, 7)] == [True, True, False, False, True, False]
    assert (got[1]["company_name"], got[1]["own_cards"], got[1]["related_slugs"]) == ("Green Bay Resort", 1, [])
    assert (got[2]["slug"], got[2]["own_cards"], got[2]["related_slugs"]) == ("la-blanche", 0, ["la-blanche-spa", "etstur"])
    assert (got[5]["company_name"], got[5]["own_cards"], got[5]["related_slugs"]) == ("Empty", 0, []) and got[3]["company_name"] is None and got[4]["own_cards"] is None


def test_reports_are_read_back_as_written(spark, tmp_path):
    names = spark.createDataFrame([("b",), ("a/x y",)], "report string")
    body = spark.createDataFrame([("b", 2, "- two"), ("b", 1, "- one")], "report string, order int, line string")
    reports.write_reports(reports.report_lines(names, [("ONE", body), ("NOTE", "n1\nn2")]), f"{tmp_path}/r")
    got = {}
    for r in reports.read_reports(spark, f"{tmp_path}/r").orderBy("number").collect():
        got.setdefault(r["report"], []).append(r["line"])
        assert r["number"] == len(got[r["report"]])
    assert got["b"] == ["b", "=", "", "ONE", "- one", "- two", "", "NOTE", "n1", "n2"]
    assert got["a/x y"] == ["a/x y", "=====", "", "ONE", "- no data", "", "NOTE", "n1", "n2"]
    assert len(list(Path(f"{tmp_path}/r").rglob("*.txt"))) == 2


def test_complaints_are_cleaned_once(spark):
    df = spark.createDataFrame([(i, "word " * (1 + i % 3), "5 Ocak 2025") for i in range(9)], "i long, complaint_text string, complaint_date_raw string")
    out = composites.prepared_complaints(df)
    assert "ArrowEvalPython" not in out._jdf.queryExecution().executedPlan().toString()
    row = out.filter("i = 0").first()
    assert row["very_short_threshold"] == 1 and row["very_short_text_flag"] and not row["missing_text_flag"] and row["missing_title_flag"] and not row["date_parse_failed_flag"] and row["date_is_approximate_flag"] is False


def test_replies_leave_as_rows(spark):
    message = "<div id='message-{0}'><i data-ga-element='Complaint_Answer_Brand'></i><p>said {0}</p></div>"
    many = "<div id='messages'>" + "".join(message.format(k) if k % 2 else message.format(k).replace("Complaint_Answer_Brand", "x") for k in range(100_000)) + "</div>"
    df = spark.createDataFrame([(1, many), (2, None), (3, "<p>none</p>"), (4, "<div id='messages'><div id='message-1'><a href='/firm'>f</a><p>we</p></div></div>")], "page_id long, html string")
    out = pages.reply_rows(df, brand_links=["/firm"])
    got = out.groupBy("page_id", "reply_author_type").agg(F.count(F.lit(1)).alias("n"), F.max("reply_order").alias("last")).collect()
    assert {(r["page_id"], r["reply_author_type"]): (r["n"], r["last"]) for r in got} == {(1, "COMPANY"): (50_000, 100_000), (1, "USER"): (50_000, 99_999), (4, "COMPANY"): (1, 1)}
    few = df.filter("page_id > 1")
    assert sorted(pages.reply_rows(few, brand_links=["/firm"]).collect()) == sorted(pages.replies(pages.detail(few, brand_links=["/firm"])).collect())


def test_rank_statistics_of_values_that_are_computed_anew(spark):
    """Each pass over the table gives other last bits, as means of doubles do when their rows come in another order: no row may be lost."""

    @F.pandas_udf("double")
    def shaken(v: pd.Series) -> pd.Series:
        return v * (1 + np.random.default_rng().random(len(v)) / 1e12)

    df = spark.range(400).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g"), (F.col("id") % 7).alias("x"), (F.col("id") * 37 % 400 + 1).cast("double").alias("v"))
    df = df.withColumn("y", shaken.asNondeterministic()("v"))
    plain, moved = stats.spearman(df, "x", "v").first(), stats.spearman(df, "x", "y").first()
    assert moved["n"] == 400 and moved["rho"] == pytest.approx(plain["rho"], abs=1e-12)
    assert stats.kruskal(df, "g", "y").first()["n"] == 400 and tuple(stats.mann_whitney(df, "g", "y", "a", "b").first())[:2] == (200, 200)


def test_copies_are_held_against_others_once(spark):
    """Of 200 copies of a text and one near text of 150 copies: a row for each copy and one for the link, where all pairs are 61,075."""
    texts = ["the grand hotel of the northern coast", "the grand hotels of the northern coast", "something else"]
    rows = [(i, "g", texts[0] if i % 7 < 4 else texts[1]) for i in range(350)] + [(900, "h", texts[0]), (901, "g", texts[2]), (902, None, texts[0]), (903, "g", None)]
    df = spark.createDataFrame(rows, "i long, g string, t string")
    out = similar.alike_classes(df, "i", "g", "t")
    got = [tuple(r)[1:3] for r in out.collect()]
    assert sorted(got) == sorted([(0, 4), *((0 if i % 7 < 4 else 4, i) for i in range(350) if i not in (0, 4))])
    # Expanded, they are all pairs.
    assert similar.alike_within(df, "i", "g", "t").count() == 350 * 349 // 2


def test_best_of_candidates_is_that_of_all_pairs(spark):
    r = random.Random(8)
    words, areas, phones = ["bay", "grand", "hotel", "royal", "sea", "palm", "çay"], ["a", "b", None], [None, "02521234567", "02527654321", "12"]
    table = lambda n: spark.createDataFrame([(i, r.choice([None, "", " ".join(r.choices(words, k=r.randint(1, 3)))]) if i % 9 == 0 else " ".join(r.choices(words, k=r.randint(1, 3))), r.choice(phones) if i % 4 == 0 else None, r.choice(areas)) for i in range(n)], "id long, name string, phone string, area string")
    left, right = table(150), table(120)
    phone, area = F.col("phone_l") == F.col("phone_r"), F.col("area_l") == F.col("area_r")

    def scored(c):
        c = c.withColumn("score", resolve.match_score(F.col("name_similarity"), phone, area, F.lit(None).cast("double")))
        return c.withColumn("status", resolve.match_class(F.col("score"), F.col("name_similarity"), phone, area))

    for drop in ([], ["hotel"]):
        want = resolve.best_matches(left, scored(resolve.candidates(left, right, drop=drop)))
        got = resolve.best_of_candidates(left, right, scored, drop=drop)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # 400 million pairs of rows, of one pair of names.
    many = spark.range(20_000).select("id", F.lit("grand hotel").alias("name"), F.lit(None).cast("string").alias("phone"), F.lit("a").alias("area"))
    got = resolve.best_of_candidates(many, many, scored).groupBy("id_r", "status", "n_candidates").count().collect()
    assert [tuple(x) for x in got] == [(0, "HIGH_CONFIDENCE", 20_000, 20_000)]


def test_saved_tables_leave_no_shuffle_files(spark):
    def held() -> int:
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))

    before, kept = held(), []
    for k in range(3):
        df = spark.range(20_000).groupBy((F.col("id") % 1000 + k).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        kept.append(stage.saved(df))
        assert kept[-1].agg(F.sum("n")).first()[0] == 20_000
    settings = spark.conf.get(stage.CLEANUP, None)
    for _ in range(50):
        if held() <= before + 3 * 2:
            break
        time.sleep(0.1)
    assert settings in (None, "false") and held() <= before + 3 * 2
