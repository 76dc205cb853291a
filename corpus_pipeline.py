"""From raw documents to packed training windows, each stage one operator over all rows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents, and further columns of any names stay too.  Between stages rows are written as Parquet
and read again.  Every stage has a defined result for null and empty texts (they are texts without
words, and copies of each other), null ids (the largest of all, never labelled), repeated rows (each
for itself, until deduplication leaves one) and an empty table (an empty result); very long texts are
read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventlake.llm import exact_dedup, mixing, packing, simhash, toxicity
from eventlake.plans import scratch

#: What the mix should be made of: nearly all documents of good quality, few of low quality.
MIX = {"high": 0.97, "low": 0.03}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.  Null and empty texts have the score of the bias; without labels all stay."""
    return toxicity.keep_clean(docs, _labels(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays: of ties the one with the smallest id; null and empty texts are equal."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, a similarity of 0.8 or more."""
    return simhash.keep_similar(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low quality are thinned towards the target weights; all others stay.  Without labels all stay."""
    return mixing.thin(docs, mixing.label_domains(_labels(spark, sf_dir)), MIX, protected="high")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training windows.  Null and empty texts are the end id alone."""
    return packing.pack(docs, cached_words=500_000)  # beside a JVM that four stages have filled


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mixing to target weights", mix),
    ("packing", pack),
]

# Learned scores, fingerprints and tokens cannot be expressed in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
