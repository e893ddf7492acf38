"""The stages of the pipeline on a small table, and the registered SQL's names."""

from collections import Counter

import corpus_pipeline
import pytest

from marlstone.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "sharding":
            assert out.columns == before
        rows = out.collect()
        old = Counter(r["doc_id"] for r in docs.collect())
        new = Counter(r["doc_id"] for r in rows)
        if name in ("toxicity", "near_duplicates", "decontamination"):
            assert not new - old and len(new) >= 0.5 * len(old)
        docs = spark.createDataFrame(rows, out.schema)
    assert {"slot", "shard"} <= set(docs.columns)


def test_run_is_its_stages(spark):
    """The whole pipeline on a table, on an empty one, and on one of odd rows with empty labels and benchmark."""
    out = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert out.columns == [*docs.columns, "slot", "shard"] and 0 < out.count()
    kept = {r["doc_id"] for r in out.select("doc_id").collect()}
    assert kept <= {r["doc_id"] for r in docs.collect()} and len(kept) >= 0.4 * docs.count()


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "word " * 30_000, "en", "s", 1), (3, "some plain words here", None, None, 2)]])
def test_run_on_odd_tables(spark, tmp_path, rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spark.createDataFrame(rows, docs.schema).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").filter("false").write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} <= {r[0] for r in rows} and bool(out) == bool(rows)


def test_sql_belongs_to_queries():
    assert set(queries.oracle_sql()) <= set(queries.queries()) and len(queries.queries()) >= 11
