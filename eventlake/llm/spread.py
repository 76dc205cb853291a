"""Dealing few small rows, each of which stands for much work, over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame

MOST_A_TASK = 64


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` (a written table) in as many partitions as keep the cluster busy, at most ``MOST_A_TASK`` rows in each.

    The partitions are asked for by number: those asked for by a column would be merged again, as
    the rows are small.
    """
    there = rows.count()
    least = -(-there // MOST_A_TASK)
    return rows.repartition(max(1, least, min(there, 4 * rows.sparkSession.sparkContext.defaultParallelism)))
