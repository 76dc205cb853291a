"""State in the past: at a version, or at a point in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlake.operators.folds import AggregateSpec, project


def state_at_version(events: DataFrame, spec: AggregateSpec, version: int) -> DataFrame:
    """Every aggregate as it was at ``version``; those without an event by then have no row."""
    return project(events.where(F.col("originator_version") <= version), spec)


def version_asof(asked: DataFrame, events: DataFrame, initial: int = 1) -> DataFrame:
    """``asked`` (originator_id, as_of) with version, the highest at or before that time; initial - 1 if there is none.

    Both sides are laid into one line and the maximum runs along it, so no pairs are made.  Lines are
    cut into days, and the maxima of earlier days are carried over, so that a busy aggregate does not
    lie in one task.
    """
    kind = events.schema["timestamp"].dataType
    known = events.where(F.col("timestamp").isNotNull() & F.col("originator_id").isNotNull())
    stamps = known.select("originator_id", F.col("timestamp").alias("t_"), F.lit(0).alias("ask_"), F.col("originator_version").alias("v_"))
    asks = asked.select("originator_id", F.col("as_of").cast(kind).alias("t_"), F.lit(1).alias("ask_"), F.lit(None).cast("long").alias("v_"), "as_of")
    line = stamps.withColumn("as_of", F.lit(None).cast(asked.schema["as_of"].dataType)).unionByName(asks).withColumn("day_", F.to_date("t_"))
    # An event comes before what is asked at its time.
    along = Window.partitionBy("originator_id", "day_").orderBy("t_", "ask_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = line.withColumn("within_", F.max("v_").over(along)).where("ask_ = 1").select("originator_id", "as_of", "day_", "within_")
    days = line.groupBy("originator_id", "day_").agg(F.max("v_").alias("m_"))
    earlier = Window.partitionBy("originator_id").orderBy("day_").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select(F.col("originator_id").alias("id_"), F.col("day_").alias("d_"), F.max("m_").over(earlier).alias("carried_"))
    joined = within.join(carried, F.col("originator_id").eqNullSafe(F.col("id_")) & F.col("day_").eqNullSafe(F.col("d_")))
    version = F.coalesce(F.greatest("within_", "carried_"), F.lit(initial - 1).cast("long"))
    return joined.select("originator_id", "as_of", version.alias("version"))


def version_at(events: DataFrame, as_of, initial: int = 1) -> DataFrame:
    """Each aggregate's version at one time: one conditional maximum, no join."""
    version = F.max(F.when(F.col("timestamp") <= as_of, F.col("originator_version")))
    return events.groupBy("originator_id").agg(F.coalesce(version, F.lit(initial - 1).cast("long")).alias("version"))


def state_at(events: DataFrame, spec: AggregateSpec, as_of) -> DataFrame:
    """Every aggregate as it was at a time: its events up to the version it had then.

    That version is a maximum over the sequence, taken where the sequence lies for the fold anyway.
    """
    whole = Window.partitionBy("originator_id")
    had = F.max(F.when(F.col("timestamp") <= as_of, F.col("originator_version"))).over(whole)
    bounded = events.withColumn("asof_version_", had).where("originator_version <= asof_version_").drop("asof_version_")
    return project(bounded, spec)
