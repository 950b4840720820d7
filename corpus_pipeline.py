"""A corpus pipeline: each stage is one of the operators of lettercrate.llm, written as Parquet before the next.

All stages: a null text counts as empty; repeated rows are alike and treated alike; columns beyond those of documents
are passed on, whatever their names (the last stage returns its own columns); an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettercrate.llm import mixing, packing, quality_rules, secret_scans, simhash
from lettercrate.llm.common import discard, documents, shared_dir, written
from lettercrate.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, those without words among them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.keep(docs, quality_rules.trusted_ids(labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the least doc_id, of equal ids the least hash of its text. A
    document without an id goes if one with an id is in its group."""
    return simhash.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay."""
    return secret_scans.redact(docs, secret_scans.update_ledger(docs, shared_dir(spark)))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture reads them: once at least, those of the rarest source twice at most. Documents
    without a source are one source."""
    rows = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("row"))
    return mixing.mix(written(mixing.prepare(rows).drop("text"))).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("mixing", mixture),
    ("best-fit packing", packed),
]

#: Hashed n-grams, XXH64 and byte-pair encoding have no counterpart in DuckDB's SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir))
        if number:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
