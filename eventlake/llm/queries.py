"""Queries of the training-data operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventlake.llm import exact_dedup, html_extract, mixing, packing, rules, sharding, simhash, token_scan, toxicity, warc
from eventlake.plans import scratch

SHARDS = [f"shard-{i:03d}" for i in range(128)]
TARGETS = {"high": 0.85, "low": 0.1, "toxic": 0.05}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_shard_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents")).drop("points")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch.place(spark, "warc")
    manifest = warc.write(_table(spark, sf_dir, "pages"), folder)
    return warc.read(manifest, folder).drop("url", "payload")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = mixing.label_domains(_table(spark, sf_dir, "labels"))
    return mixing.weigh(_table(spark, sf_dir, "documents"), labelled, TARGETS)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_scan.count_tokens(_table(spark, sf_dir, "documents")).drop("file", "ordinal")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_shard_placement, op2_main_text, op3_toxicity, op4_exact_dedup, op5_warc, op6_simhash, op7_packing,
        op8_quality_rules, op9_mixing, op10_token_counts, pipeline,
    )
}

# op1 fills its table by turns; op2 parses; op3, op8 and op9 learn; op6 hashes with XXH64; op7 and op10 tokenise: no SQL.
ORACLES: dict[str, str] = {
    "op4_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents
        ), r AS (
            SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
                   row_number() OVER w AS rank_
            FROM t WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)
        )
        SELECT doc_id, keep_id, group_size, rank_ = 1 AS kept, sha256(norm) AS text_sha256 FROM r
    """,
    "op5_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
        SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   ((('0x' || substr(s, (5 * i) // 4 + 1, 2))::INT >> (3 - (5 * i) % 4)::INT) & 31) + 1, 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM p
    """,
}
