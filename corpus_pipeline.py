"""A training corpus from raw documents: toxic documents, near copies and contaminated documents go, sources are mixed, and what is left is dealt to shards.

Each stage is (name, function) and takes (spark, docs, sf_dir); run() writes what it returns as Parquet in the
shared folder and reads it again as the next one's docs; run() deletes each such table, and what a stage wrote on the way, when
the next one is written.

Null and empty texts are kept by the first three stages, and so is any one row of each of the texts that they keep; the
mix takes documents without words as their place tells. Texts of any length are read whole. Rows without an id are
documents like any other; of repeated rows the second stage keeps one. Empty documents give an empty table with the
same columns; without labels of both classes no text is rejected unless most labels are toxic, and an empty benchmark
leaves all documents. Further columns are carried along whatever their names; only the last stage replaces columns
that are named slot or shard, in any case of letters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import decontaminate, mixing, neardup, sharding, toxicity
from marlstone.llm.store import dropped, settled


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated score is below 1/2, learned from the labelled ones among docs."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.untoxic(docs, toxicity.train(docs.select("doc_id", "text"), labels))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of near copies."""
    return neardup.without_near_duplicates(docs)


def free_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontaminate.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def dealt_to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their slot and shard."""
    return sharding.sharded(docs)


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("near_duplicates", one_of_near_copies),
    ("decontamination", free_of_benchmark),
    ("mixing", mixed_to_weights),
    ("sharding", dealt_to_shards),
]

#: The trained classifier and the sketches have no SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if before:
            dropped(before)
        before = docs
    return docs
