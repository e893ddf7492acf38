"""Operators on their own small cases, and every registered query against its SQL on the smallest tables."""

import datetime as dt
import difflib
import math
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__
from marlstone.functions import text as X
from marlstone.functions.arrays import counted
from marlstone.operators import checks, clean, pages, ranks, resolve, similar, stats, terms, within
from marlstone.plans import registry
from marlstone.sources import io
from marlstone.streaming import incremental

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(expr.alias("x")).first()["x"]


def text(spark, f, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(f(F.col("v"))).collect()]


def test_coercions(spark):
    assert text(spark, clean.to_number, "1.5", "x", None, "NaN") == [1.5, None, None, None]
    assert text(spark, clean.to_integer, "2", "2.0", "2.5", "a") == [2, 2, None, None]
    assert text(spark, clean.blank_to_null, " a ", "  ", None) == ["a", None, None]
    assert text(spark, clean.to_iso_date, "2024-02-29", "2023-02-29", "x") == ["2024-02-29", None, None]
    assert one(spark, clean.safe_ratio(F.lit(10), F.lit(2), 1000.0)) == 5000 and one(spark, clean.safe_ratio(F.lit(1), F.lit(0))) is None and one(spark, clean.safe_ratio(F.lit(1), F.lit(None).cast("int"))) is None


def test_counts_and_flags(spark):
    assert text(spark, X.count_value, "1.234", "1,2 B", "1.2K", "1200", None, "-5", "z", "1.234,5 B", "12,5") == [1234, 1200, 1200, 1200, None, None, None, 1234500, 12]
    assert text(spark, X.truth, "Evet", "0", "maybe", None) == [True, False, None, None]
    assert one(spark, clean.swapped_number(F.lit(1234.5))) == "1.234,50" and one(spark, clean.swapped_number(F.lit(None).cast("double"))) == "—"
    assert one(spark, clean.strength(F.lit(-0.65))) == "strong negative" and one(spark, clean.flags_text([(F.lit(False), "A")])) == "OK"


def test_text(spark):
    assert text(spark, X.folded, "Şişli  Oteli!", "İI", "--", None) == ["sisli oteli", "ii", None, None]
    assert text(spark, X.phone_key, "+90 (252) 123 45 67", "12", None) == ["2521234567", None, None]
    assert text(spark, X.turkish_lower, "İSTANBUL ILIK") == ["istanbul ılık"]
    assert text(spark, lambda c: X.core_name(c, ["hotel"]), "Hotel Deniz", "Hotel") == ["deniz", "hotel"]
    assert text(spark, X.raw_clean, "a​b <b>x</b> &amp;\n ok 😀 değil", " ", None) == ["ab x & ok 😀 değil", None, None]
    assert text(spark, X.masked, "mail a.b@c.com now") == ["mail [EMAIL] now"]
    assert text(spark, lambda c: X.ngrams(X.tokens(c), 2), "aa bb cc", "aa") == [["aa bb", "bb cc"], []]
    assert text(spark, lambda c: X.canonical_url(c, "https://h"), "http://x.y/a/b/?q=1#f") == ["https://h/a/b"]
    df = spark.createDataFrame([("abcd", "abxd"), (None, "a")], "a string, b string")
    assert [r[0] for r in df.select(X.sequence_ratio("a", "b")).collect()] == [0.75, 0.0]
    ids = spark.createDataFrame([("a  b", None), ("a b", None), ("a", "b")], "x string, y string").select(X.stable_id("p_", F.col("x"), F.col("y"), size=16)).collect()
    assert ids[0] == ids[1] != ids[2] and len(ids[0][0]) == 18


def test_dates(spark):
    now = F.lit("2025-01-10 00:00:00").cast("timestamp")
    got = text(spark, lambda c: X.written_date(c, now), "5 Ağustos 2025 09:58", "5 Ağustos", "31 Şubat 2024", "hm")
    assert got[0]["at"] == dt.datetime(2025, 8, 5, 9, 58) and not got[0]["approximate"]
    assert got[1]["at"] == dt.datetime(2024, 8, 5) and got[1]["approximate"] and got[2]["at"] is None and got[3]["at"] is None
    assert text(spark, lambda c: X.relative_date(c, now), "bir ay önce", "2 hafta önce düzenlendi", "x") == [dt.datetime(2024, 12, 11), dt.datetime(2024, 12, 27), None]
    shown = text(spark, lambda c: X.display_date(c, now), "5 Ağustos", "bugün 10:30", "Dün", "3 gün önce", "31 Şubat 2024", " ", "x", None)
    assert [r["pattern"] for r in shown] == ["DAY_MONTH_TIME_NO_YEAR", "RELATIVE_TODAY", "RELATIVE_YESTERDAY", "RELATIVE_DAYS_AGO", "INVALID_CALENDAR_DATE", "MISSING", "UNRECOGNIZED", "MISSING"]
    assert [r["at"] for r in shown[:4]] == [dt.datetime(2024, 8, 5), dt.datetime(2025, 1, 10, 10, 30), dt.datetime(2025, 1, 9), dt.datetime(2025, 1, 7)]
    assert [tuple(r) if r else r for r in text(spark, lambda c: X.display_key(c, F.lit(2025)), "a 22 Ağustos 13:45", "21 Aralık 2023 9:05", "5 Foo 10:00", None)] == [(2025, 8, 22, 13, 45), (2023, 12, 21, 9, 5), None, None]
    assert [tuple(r) for r in text(spark, lambda c: X.review_date(c, now), "Google üzerinde 2 ay önce düzenlendi", "bir saat önce", "?")] == [(dt.datetime(2024, 11, 11), True, True, "RELATIVE_PARSED"), (dt.datetime(2025, 1, 9), True, False, "RELATIVE_PARSED"), (None, False, False, "UNRECOGNIZED")]
    assert text(spark, X.date_pattern, "2024-01-01", "3 gün önce", "bugün", "??") == ["ISO", "RELATIVE", "TODAY", "UNRECOGNIZED"]


def test_within(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 3.0), ("a", None), ("b", 2.0)], "g string, v double")
    got = sorted(((r[0], r[1], r[2]) for r in df.select("g", "v", within.tie_percent_rank("v", "g")).collect()), key=str)
    assert got == sorted([("a", 1.0, 0.5), ("a", 1.0, 0.5), ("a", 3.0, 1.0), ("a", None, None), ("b", 2.0, 1.0)], key=str)
    assert {r[0] for r in df.filter("g = 'b'").select(within.min_max("v")).collect()} == {50.0}
    assert one(spark, within.available_mean([(F.lit(10.0), 3.0), (F.lit(None).cast("double"), 1.0)])) == 10.0
    assert one(spark, within.available_mean([(F.lit(10.0), 3.0), (F.lit(None).cast("double"), 1.0)], 2)) is None


def test_statistics(spark):
    df = spark.createDataFrame([(float(i), float(i * i), 1.0) for i in range(10)], "x double, y double, c double")
    assert df.agg(stats.pearson(F.col("x"), F.col("c"))).first()[0] is None and stats.spearman(df, "x", "y").first()["rho"] == pytest.approx(1)
    assert stats.correlation_p(0.5, 20) == pytest.approx(0.0247, abs=1e-4) and stats.correlation_p(0.0, 10) == pytest.approx(1)
    assert stats.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and stats.chi2_tail(18.307, 10) == pytest.approx(0.05, abs=1e-5)
    assert stats.correlation_p(1.0, 5) == 0.0 and math.isnan(stats.correlation_p(0.3, 2))


def test_checks(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0), (2, 2.5), (4, 1.0)], "k int, v double")
    assert {r["k"]: r["status"] for r in checks.compared(a, b, ["k"], "v").collect()} == {1: "MATCH", 2: "DIFFERENT", 3: "ONLY_EXPECTED", 4: "ONLY_ACTUAL"}
    with pytest.raises(ValueError):
        checks.require_columns(a, ["k", "z"])
    with pytest.raises(Exception, match="repeated key"):
        checks.joined_once(a, b.union(b).withColumnRenamed("v", "w"), ["k"]).collect()
    assert checks.joined_once(a, b.withColumnRenamed("v", "w"), ["k"]).count() == 3
    assert checks.fingerprint(a).first() == checks.fingerprint(a.orderBy(F.desc("k"))).first() != checks.fingerprint(b).first()
    twice = [spark.createDataFrame([(k,), (k,)], "k int") for k in (1, 7)]
    assert checks.fingerprint(twice[0]).first() != checks.fingerprint(twice[1]).first() and checks.fingerprint(a.filter("false")).first()["n_rows"] == 0


def test_resolution(spark):
    s = lambda n, p, a: one(spark, resolve.match_score(F.lit(n), F.lit(p), F.lit(a), F.lit(0.0)))
    assert s(0.2, True, False) == 0.95 and s(1.0, False, True) == 0.75 and s(1.0, False, None) == 0.675
    cls = lambda n, p, a: one(spark, resolve.match_class(F.lit(0.6), F.lit(n), F.lit(p), F.lit(a)))
    assert cls(0.96, False, True) == "HIGH_CONFIDENCE" and cls(0.96, False, False) == "REVIEW_REQUIRED" and cls(0.96, False, None) == "REVIEW_REQUIRED"
    m = spark.createDataFrame([(1, 9, 0.99), (2, 9, 0.97), (3, 8, 0.96)], "id int, owner int, score double").withColumn("status", F.lit("HIGH_CONFIDENCE"))
    assert {r["id"]: r["status"] for r in resolve.assigned_once(m, "owner", "score", "id").collect()} == {1: "HIGH_CONFIDENCE", 2: "REVIEW_REQUIRED", 3: "HIGH_CONFIDENCE"}


def test_aspects(spark):
    flags = terms.aspect_flags(F.col("t"), {"room": ["oda", "temiz"], "staff": ["güler yüz", "servis"], "noise": ["ses"]}, {"staff": {"servis": ["servis aracı"]}})
    said = {"temizlik iyi": "room", "odalar": "room", "odamız": "room", "odacı": "", "güler yüz": "staff", "oda!": "room", "sesleri": "noise", "sessiz": "noise", "sessizlik": "", "servis yavaş": "staff", "servis aracı": "", "servisler": "staff", None: ""}
    got = spark.createDataFrame([(t,) for t in said], "t string").select("t", F.concat_ws("|", *(F.when(c, k) for k, c in flags.items())).alias("x")).collect()
    assert {r["t"]: r["x"] for r in got} == said
    assert one(spark, terms.severity(F.lit("very bad rash"), ["rash"], ["bad"])) == "HIGH"
    assert text(spark, lambda c: terms.keywords_found(c, ["oda", "a.b", "checkin", "oda kokusu"]), "odalar ve oda kokusu", "axb checkinler", "a.b checkin") == [["oda kokusu", "oda"], [], ["checkin", "a.b"]]
    empty = spark.createDataFrame([], "a boolean, b boolean")
    assert terms.cooccurrence(empty, ["a", "b"]).collect() == []


def test_terms_are_counted_within_rows(spark):
    import collections
    import random

    rnd = random.Random(2)
    rows = [(i, [rnd.choice("abcdef") for _ in range(rnd.randint(0, 30))]) for i in range(50)] + [(90, None), (91, [])]
    got = spark.createDataFrame(rows, "i int, ws array<string>").select("i", counted(F.col("ws")).alias("c")).collect()
    for r, (_, ws) in zip(sorted(got), rows, strict=True):
        assert (r["c"] and dict(map(tuple, r["c"]))) == (ws and dict(collections.Counter(ws))) or not ws
    table = terms.term_table(spark.createDataFrame(rows, "i int, ws array<string>"), F.col("ws"), 2)
    want = collections.Counter(f"{a} {b}" for _, ws in rows for a, b in zip(ws or [], (ws or [])[1:], strict=False))
    assert {r["term"]: r["n_tokens"] for r in table.collect()} == want


def test_pages(spark):
    html = "<title>T &amp;x</title><a class='c' href='/co/one?z=1'>One <b>x</b></a><p> p1 <p></p><p>p2<script>no</script>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    assert [tuple(r) for r in pages.links(df, prefix="/co").collect()] == [(1, 0, "/co/one", "One x")]
    got = {r["page_id"]: r for r in pages.detail(df).collect()}
    assert (got[1]["title"], got[1]["body"], got[1]["n_paragraphs"]) == ("T &x", "p1\np2", 2)
    assert all(got[k][f] is None for k in (2, 3) for f in ("title", "body", "view_count", "support_count")) and got[2]["user_reply_count"] == 0
    brand = "<article><div data-ga-element='Engagement_Card_Upvote'>Destekle 12</div></article><div id='messages'><div id='message-1'><a href='/firm'>f</a><p>we</p></div><div id='message-2'><p>I</p></div></div>"
    x = pages.detail(spark.createDataFrame([(1, brand)], "page_id long, html string"), brand_links=["/firm"]).first()
    assert (x["support_count"], x["company_response_text"], x["first_user_reply_text"], x["user_reply_count"]) == ("12", "we", "I", 1)


def test_ranks_have_no_global_window(spark):
    import random

    rnd = random.Random(4)
    rows = [(i, rnd.choice([None, *range(40)]), rnd.choice("abc") * rnd.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, v int, t string").repartition(6)
    for order in (["v", "i"], ["t", "i"]):
        k = 1 if order[0] == "v" else 2
        want = {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[k] is not None, r[k] if r[k] is not None else 0, r[0])), 1)}
        assert {r["i"]: r["n"] for r in ranks.numbered(df, order, "n").collect()} == want
    down = {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0])), 1)}
    assert {r["i"]: r["n"] for r in ranks.numbered(df, ["v", "i"], "n", descending=True).collect()} == down
    have = sorted(r[1] for r in rows if r[1] is not None)
    got = {r["v"]: (r["ties"], r["rank"]) for r in ranks.mean_ranks(df, "v").collect()}
    assert got == {v: (have.count(v), have.index(v) + (have.count(v) + 1) / 2) for v in set(have)}
    assert ranks.numbered(df.filter("false"), ["v"], "n").collect() == [] and ranks.mean_ranks(df.filter("false"), "v").collect() == []
    # Texts with a common beginning, ties and NULLs are split.
    same = spark.createDataFrame([(i, "Customer#0000" + str(i % 50), None) for i in range(2000)], "i int, t string, part string")
    for order in (["t", "i"], ["part", "i"]):
        out = ranks.numbered(same, order, "n", ranges=8)
        assert out.columns == ["i", "t", "part", "n"] and {r["i"]: r["n"] for r in out.collect()} == {r[0]: n for n, r in enumerate(sorted(((i, "" if order[0] == "part" else "Customer#0000" + str(i % 50)) for i in range(2000)), key=lambda r: (r[1], r[0])), 1)}
        assert len({r[0] for r in out.select(F.spark_partition_id()).distinct().collect()}) > 1
    sums = ranks.along(df, ["v", "i"], {"upto": "v"}).collect()
    assert max(r["upto"] for r in sums) == sum(have)


def test_tests(spark):
    # Against sums over all pairs, and tables of the distributions.
    a, b = [1, 2, 2, 5, 7, 9, 9, 12], [2, 3, 8, 9, 10, 10, 14]
    df = spark.createDataFrame([("a", float(x)) for x in a] + [("b", float(x)) for x in b] + [("a", None)], "g string, v double")
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    r = stats.mann_whitney(df, "g", "v", "a", "b").first()
    assert (r["n_a"], r["n_b"], r["u"]) == (8, 7, u) and 0 < r["p"] < 1
    h = stats.kruskal(df, "g", "v").first()
    assert h["groups"] == 2 and h["p"] == pytest.approx(math.erfc(math.sqrt(h["h"] / 2)), abs=1e-9)
    assert stats.kruskal(df.filter("g = 'a'"), "g", "v").first()["h"] is None
    rho = stats.spearman(spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 4.0), (4.0, 3.0), (5.0, 5.0)], "x double, y double"), "x", "y").first()
    assert rho["rho"] == pytest.approx(0.8) and rho["p"] == pytest.approx(0.104088, abs=1e-5)
    t = stats.pearson_test(spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 4.0), (4.0, 3.0), (5.0, 5.0), (6.0, None)], "x double, y double"), "x", "y").first()
    assert (t["n"], t["r"]) == (5, pytest.approx(0.8))


def test_candidates_are_all_pairs(spark):
    import difflib
    import random

    rnd = random.Random(6)
    words = ["blue", "bay", "grand", "hotel", "sunset", "xanadu", "kaya", "bodrumm", "palace", "q"]
    make = lambda n, at: [(at + i, " ".join(rnd.sample(words, rnd.randint(1, 3))) + rnd.choice(["", "x", " 7"]), rnd.choice(["0252 123 45 6" + str(rnd.randint(0, 9)), None]), "a") for i in range(n)]
    left, right = make(40, 0), [*make(60, 100), (900, None, None, "a"), (901, "??", "12", "a")]
    schema = "id long, name string, phone string, area string"
    fold = lambda n: "".join(c if c.isalnum() else " " for c in n or "").strip()
    core = lambda n: " ".join(w for w in fold(n).split() if w != "hotel") or fold(n)
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0
    want = {}
    for x in left:
        for y in right:
            s = max(ratio(fold(x[1]), fold(y[1])), ratio(core(x[1]), core(y[1])))
            if s >= 0.55 or (x[2] and x[2] == y[2]) or (core(x[1]) and core(x[1]) == core(y[1])):
                want[x[0], y[0]] = s
    scored = resolve.candidates(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), drop=["hotel"])
    got = {(r["id_l"], r["id_r"]): r["name_similarity"] for r in scored.collect()}
    assert got == pytest.approx(want) and 100 < len(want) < 40 * 60
    alone = [*left, (50, "zzz", None, "a")]
    best = resolve.best_matches(spark.createDataFrame(alone, schema), scored.withColumns({"score": F.col("name_similarity"), "status": F.lit("REVIEW_REQUIRED")})).collect()
    assert len(best) == 41 and {r["id_l"]: r["status"] for r in best}[50] == "UNMATCHED"


def test_alignment(spark):
    def label(g, n, low, high, c, small, has=(True, True)):
        v = lambda x, t="double": F.lit(x).cast(t)
        return one(spark, resolve.alignment_label({"mention": v(g), "support": v(n, "int"), "low": v(low), "high": v(high)}, {"mention": v(c), "small": v(small, "boolean")}, F.lit(has[0]), F.lit(has[1])))

    assert label(20, 9, 60, 10, 30, False) == "BOTH_CONCERN" and label(20, 9, 10, 80, 30, False) == "STRENGTH_VS_COMPLAINT"
    assert label(20, 4, 60, 10, 30, False) == "LOW_SUPPORT" and label(20, 9, 60, 10, 30, True) == "LOW_SUPPORT"
    assert label(10, 9, 60, 10, 30, False) == "COMPLAINTS_ONLY" and label(20, 9, 60, 10, 3, False) == "REVIEWS_ONLY" and label(1, 9, 0, 0, 3, False) == "NO_SIGNAL"
    assert label(None, None, None, None, 30, False) == "COMPLAINTS_ONLY" and label(20, 9, 0, 0, None, None, (True, False)) == "REVIEWS_ONLY"


def test_files(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("t", T.StringType())])
    (tmp_path / "a.csv").write_text('﻿id,t\n1,"x\ny"\n2,\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("id,t\n3,z\n")
    (tmp_path / "d.csv").write_text('t,more,id\n"a ""b""",9,7\n')
    (tmp_path / "empty.csv").write_text("")
    assert sorted(map(tuple, io.read_csv(spark, f"{tmp_path}/*.csv", ["id", "t"]).collect()), key=str) == [("1", "x\ny"), ("2", None), ("3", "z"), ("7", 'a "b"')]
    typed = io.read_csv(spark, f"{tmp_path}/d.csv", T.StructType([T.StructField("id", T.LongType()), T.StructField("none", T.DateType()), T.StructField("t", T.IntegerType())]))
    assert typed.collect() == [(7, None, None)]
    io.append_csv(spark.createDataFrame([(1, "a")], "k int, v string"), f"{tmp_path}/out", ["k", "w"])
    io.append_csv(spark.createDataFrame([("b", 2)], "w string, k int"), f"{tmp_path}/out", ["k", "w"])
    assert sorted(map(tuple, io.read_csv(spark, f"{tmp_path}/out", ["w", "k"]).collect()), key=str) == [("b", "2"), (None, "1")]
    assert io.read_csv(spark, f"{tmp_path}/a.csv", schema).filter("id = '1'").first()["t"] == "x\ny"
    assert io.read_or_empty(spark, f"{tmp_path}/none.csv", schema).collect() == [] and io.read_first(spark, [f"{tmp_path}/none.csv", f"{tmp_path}/b.csv"], schema).count() == 1
    (tmp_path / "c.json").write_text('{"a": {"k": ["x"]}}')
    assert io.read_settings(spark, f"{tmp_path}/c.json", "a struct<k: array<string>>").first()["a"]["k"] == ["x"]
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, io.merged(old, new, "k", "v").collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted(map(tuple, io.upserted(old, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert io.reindexed(old, ["v", "w"]).first()["w"] is None
    assert io.as_json(spark.sql("SELECT 1 AS a, double('NaN') AS b")).first()[0] == '{"a":1,"b":null}'


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    q = incremental.windowed_counts(incremental.landing(spark, f"{tmp_path}/in", events.schema)).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, incremental.windowed_counts(events).collect()))


def test_upserts_keep_the_newest(spark, tmp_path):
    schema = "k string, at int, v string"
    batches = [[("a", 1, "old"), ("a", 3, "new"), ("b", 1, "x"), (None, 1, "n1")], [("a", 2, "late"), ("b", 5, "y"), (None, 2, "n2"), ("c", 1, "z")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = incremental.upsert_stream(incremental.landing(spark, f"{tmp_path}/in", schema), f"{tmp_path}/out", "k", "at", f"{tmp_path}/state")
        q.awaitTermination(120)
        assert q.exception() is None
    got = {r["k"]: (r["at"], r["v"]) for r in incremental.latest(spark, f"{tmp_path}/out", schema).collect()}
    assert got == {"a": (3, "new"), "b": (5, "y"), "c": (1, "z"), None: (2, "n2")}


def test_alike_within_loses_no_pair(spark):
    import difflib
    import random

    rnd, rows = random.Random(3), []
    for i in range(160):
        base = list(f"{'abcdefgh'[i % 5] * 3} grand hotel of the {i % 7} northern coast and bay {'xyz'[i % 3]}")
        for _ in range(rnd.randint(0, 4)):
            at = rnd.randrange(len(base))
            base[at : at + rnd.randint(0, 1)] = rnd.choice(["q", "", "zz"])
        rows.append((i, "g" + str(i % 2), "".join(base)))
    rows += [(900, "g0", None), (901, "g0", ""), (902, "g1", rows[1][2]), (903, "g1", "a"), (904, "g1", "a")]
    got = {(r["a"], r["b"]) for r in similar.alike_within(spark.createDataFrame(rows, "i long, g string, t string"), "i", "g", "t").collect()}
    want = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[1] == y[1] and x[2] and y[2] and difflib.SequenceMatcher(None, x[2], y[2]).ratio() >= 0.94}
    assert got == want and len(want) > 20


def test_cosine_pairs_are_all_pairs(spark):
    import random

    rnd = random.Random(5)
    docs = [(i, rnd.sample("abcdefghijklmnop", 5)) for i in range(120)]
    w = terms.tf_idf(spark.createDataFrame(docs, "doc_id long, ws array<string>"), F.col("ws"), min_df=1, max_df=1.0)
    vec = {}
    for r in w.collect():
        vec.setdefault(r["doc_id"], {})[r["term"]] = r["weight"]
    want = {(a, b) for a in vec for b in vec if a < b and sum(x * vec[b].get(k, 0) for k, x in vec[a].items()) >= 0.8}
    got = {(r["a"], r["b"]) for r in similar.cosine_pairs(w).collect()}
    assert got == want and len(want) > 5
    assert similar.cosine_pairs(w.filter("false")).count() == 0


def test_candidates_fail_closed(spark):
    rows = [("k1", 1, 0.95, True, False), ("k1", 2, 0.93, False, False), ("k2", 1, 0.95, True, False), ("k3", 1, 0.99, True, True), ("k4", 1, 0.8, False, False), ("k5", 1, 0.5, False, False), ("k6", 1, 0.1, False, False)]
    df = spark.createDataFrame(rows, "k string, c int, score double, exact boolean, conflict boolean")
    got = {r["k"]: r["status"] for r in resolve.classified_candidates(df, "k", "score", "c", F.col("exact"), F.col("conflict")).collect()}
    assert got == {"k1": "AMBIGUOUS", "k2": "EXACT", "k3": "REVIEW_CONFLICT", "k4": "ACCEPTED", "k5": "REVIEW", "k6": "NONE"}
    assert text(spark, X.star_rating, "4,5/5", "5/5", "0/5", "6/5", "x", None) == [4, 5, None, None, None, None]


def test_filters_reach_the_scan(spark):
    plan = registry.queries()["jn11_semi"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(o_orderstatus,P)" in plan and "o_totalprice" not in plan


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def canonical(df):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
            return "null"
        if str(v) in ("True", "False"):
            return str(v)
        try:
            return f"{float(v):.6g}"
        except (TypeError, ValueError):
            return str(v)

    return sorted(tuple(cell(v) for v in row) for row in df[sorted(df.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = registry.queries()[name](spark, SF).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and canonical(ours) == canonical(theirs)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 25
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    for name, query in registry.queries().items():
        if name not in registry.oracle_sql():
            assert query(spark, SF).schema.names


def test_alike_within_on_a_table(spark):
    """All pairs by the ratio itself, in all groups: none on the smallest table, some on the next."""
    for sf, some in ((SF, False), ("/root/testdata/sf0.01", True)):
        got = {(r["a"], r["b"]) for r in registry.queries()["jn17_alike_within"](spark, sf).collect()}
        groups = defaultdict(list)
        for r in spark.read.parquet(f"{sf}/part.parquet").collect():
            groups[r["p_brand"]].append((r["p_partkey"], r))
        assert bool(got) == some
        text = lambda r: " ".join(str(r[c]) for c in ("p_name", "p_type", "p_size") if r[c] is not None)
        want = {(a, b) for g in groups.values() for a, x in g for b, y in g if a < b and difflib.SequenceMatcher(None, text(x), text(y)).ratio() >= 0.94}
        assert got == want
