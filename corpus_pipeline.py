"""The training-data pipeline over ``documents``: filter, deduplicate, mix, pack.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before it wrote, and returns a
DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from structlens.llm import _work, mixing, packing, simhash, substring, toxicity
from structlens.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    ship(spark)
    return toxicity.non_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each SimHash component."""
    ship(spark)
    return simhash.representatives(docs)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that already start in one with a smaller id."""
    ship(spark)
    return substring.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, some left out and some repeated, in training order."""
    return mixing.mixed_documents(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin of every piece of every document."""
    ship(spark)
    return packing.best_fit(docs).select("shard", "bin", "doc_id", "start_word", "n_words")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", one_of_each_group),
    ("substring", drop_passages),
    ("mixing", mix_sources),
    ("packing", pack_bins),
]

#: The classifier, the fingerprints and the packing are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written to the shared folder and read back as the next one's input, and what
    the stage needed on the way is deleted."""
    before = _work.made()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = _work.keep(stage(spark, docs, sf_dir), f"stage-{name}")
        _work.clear(spark, before=before, but=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
