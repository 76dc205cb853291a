"""Bounded samples, for fitting only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded(rows: DataFrame, id_col: str, most: int, *ties: str) -> DataFrame:
    """At most ``most`` rows, those whose ids have the smallest hashes; the same rows on any cluster.

    A threshold on the hash lets through hardly more than that, so that what tasks send to be
    ordered does not grow with their number.
    """
    hashed = F.xxhash64(id_col)
    there = rows.count()
    if there > most:
        share = (most + 6 * most**0.5 + 20) / there
        rows = rows.where(F.pmod(hashed, F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30)))
    return rows.orderBy(F.pmod(hashed, F.lit(1 << 30)), id_col, *ties).limit(most)
