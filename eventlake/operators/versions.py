"""Giving out versions and notification ids, and finding conflicts and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlake.schema import KEY


def assign_versions(rows: DataFrame, key: str, order: str, last: DataFrame | None = None, initial: int = 1, width: int = 1 << 20) -> DataFrame:
    """``rows`` with originator_version, counting on from ``last`` (key, last_version) or from ``initial``.

    Safe for a key with very many rows: rows are numbered within ranges of ``order`` (a whole
    number) and ranges of a key are shifted by a prefix sum, so no task sorts a whole sequence.
    """
    cut = rows.withColumn("range_", F.expr(f"`{order}` div {width}"))
    counts = cut.groupBy(key, "range_").agg(F.count(F.lit(1)).alias("n_"))
    before = Window.partitionBy(key).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(key, "range_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("shift_"))
    if last is None:
        shifts = shifts.withColumn("shift_", F.col("shift_") + (initial - 1))
    else:
        shifts = shifts.join(last.select(key, F.col("last_version").alias("v_")), key, "left")
        shifts = shifts.withColumn("shift_", F.col("shift_") + F.coalesce("v_", F.lit(initial - 1))).drop("v_")
    inside = F.row_number().over(Window.partitionBy(key, "range_").orderBy(order))
    numbered = cut.withColumn("inside_", inside).join(shifts, [key, "range_"])
    return numbered.withColumn("originator_version", (F.col("inside_") + F.col("shift_")).cast("long")).drop("range_", "inside_", "shift_")


def assign_notification_ids(batch: DataFrame, order: str, base: int) -> DataFrame:
    """Ids base + 1, base + 2, ... in order of ``order`` (a whole number), without sorting in one task."""
    from eventlake.operators.reads import ranked

    numbered = ranked(batch.withColumn("notification_id", F.col(order)))
    return numbered.withColumn("notification_id", F.col("rank_") + (base + 1)).drop("rank_")


def conflicts_in_batch(batch: DataFrame) -> DataFrame:
    """Keys that a batch has more than once."""
    return batch.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*KEY, "n")


def conflicts_with_table(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of a batch whose key is stored already."""
    return batch.join(stored.select(*KEY), KEY, "left_semi")


def gaps(events: DataFrame, initial: int = 1) -> DataFrame:
    """Events whose version is not one more than the one before (the first: not ``initial``)."""
    before = F.lag("originator_version").over(Window.partitionBy("originator_id").orderBy("originator_version"))
    expected = F.coalesce(before + 1, F.lit(initial).cast("long"))
    return events.select("originator_id", "originator_version", expected.alias("expected_version")).where("originator_version <> expected_version")
