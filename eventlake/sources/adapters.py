"""The driver's tables as event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_as_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as stored events: a user is an aggregate, its events in order of event_id its versions."""
    # Versions are counted by the id that later folds group by, so that they share one shuffle.
    named = table(spark, sf_dir, "events").withColumn("originator_id", F.col("user_id").cast("string"))
    version = F.row_number().over(Window.partitionBy("originator_id").orderBy("event_id")).cast("long")
    return named.select(
        "originator_id",
        version.alias("originator_version"),
        F.col("event_type").alias("topic"),
        F.col("ts").alias("timestamp"),
        F.col("value").cast("decimal(12,2)").alias("amount"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        (F.col("event_id") + 1).alias("notification_id"),
    )


def events_as_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the log that need no version: no shuffle."""
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("notification_id"),
        F.col("user_id").cast("string").alias("originator_id"),
        F.col("event_type").alias("topic"),
        F.col("ts").alias("timestamp"),
        F.col("value").cast("decimal(12,2)").alias("amount"),
    )


def orders_as_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") + 1).alias("notification_id"),
        F.col("o_custkey").cast("string").alias("originator_id"),
        F.col("o_orderstatus").alias("topic"),
        F.col("o_orderdate").alias("timestamp"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("amount"),
    )
