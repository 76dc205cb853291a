"""Snapshots, replay from snapshots, and states kept up to date from new events only.

Here states are those of algebraic folds that can be continued: sums, counts, flags, last values
and lists.  A ``Continued`` says how a field of a later state follows from that of an earlier one
and from the events in between.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlake.operators.folds import project, span, unbroken
from eventlake.schema import ProgrammingError


#: Times in snapshots keep their microseconds; those written without are read too.
WRITTEN = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
READ = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]"}


@dataclass(frozen=True)
class Continued:
    """A field's aggregate over new events, and how it joins the earlier value."""

    over: Column
    kind: str  # sum, first, last, any, append

    def join(self, before: Column, since: Column) -> Column:
        if self.kind == "sum":
            return F.coalesce(before + since, before, since)
        if self.kind == "first":
            return F.coalesce(before, since)
        if self.kind == "last":
            return F.coalesce(since, before)
        if self.kind == "any":
            return F.coalesce(before, F.lit(False)) | F.coalesce(since, F.lit(False))
        if self.kind == "append":
            return F.concat(F.coalesce(before, F.array().cast("array<string>")), F.coalesce(since, F.array().cast("array<string>")))
        raise ProgrammingError(f"no way to continue a field of kind {self.kind}")


def take(states: DataFrame, topic: str, class_version: int = 1) -> DataFrame:
    """Snapshots of states: id, version, the time and class they belong to, and the fields as JSON."""
    fields = [c for c in states.columns if c not in ("originator_id", "version")]
    state = F.to_json(F.struct(*fields, *([F.lit(class_version).alias("class_version")] if class_version > 1 else [])), WRITTEN)
    return states.select("originator_id", F.col("version").alias("originator_version"), F.lit(topic).alias("topic"), state.alias("state"))


def every(events: DataFrame, fields: Mapping[str, Column], interval: int) -> DataFrame:
    """The state at each version that ``interval`` divides: a running fold, then a filter."""
    window = Window.partitionBy("originator_id").orderBy("originator_version").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = events.select("originator_id", "originator_version", "timestamp", *[c.over(window).alias(n) for n, c in fields.items()])
    return running.where(F.col("originator_version") % interval == 0)


def latest(snapshots: DataFrame, lte: int | None = None) -> DataFrame:
    """Each aggregate's last snapshot (at or before a version)."""
    if lte is not None:
        snapshots = snapshots.where(F.col("originator_version") <= lte)
    rest = [c for c in snapshots.columns if c not in ("originator_id", "originator_version")]
    best = F.max_by(F.struct(*rest), F.col("originator_version")).alias("s_")
    found = snapshots.groupBy("originator_id").agg(F.max("originator_version").alias("originator_version"), best)
    return found.select("originator_id", "originator_version", "s_.*")


def replay(
    events: DataFrame, snapshots: DataFrame, fields: Mapping[str, Continued], version: int | None = None, initial: int = 1,
    decode: Callable[[DataFrame], DataFrame] | None = None, discarded: tuple[str, ...] = (), checked: bool = True,
) -> DataFrame:
    """State from the last snapshot (at or before ``version``) and the events after it only.

    An aggregate whose last event is the snapshotted one has no later events; it keeps its row, as
    does one that has no snapshot.  ``decode`` is only given events that are later than the
    snapshots.  An event of a ``discarded`` topic ends what was before it, the snapshot too.  Events
    that do not go on from the snapshot, without a gap or a repeat, raise unless ``checked`` is off.
    """
    if version is not None:
        events = events.where(F.col("originator_version") <= version)
    seeds = latest(snapshots, version).withColumnRenamed("originator_version", "seed_version_")
    tail = events.join(seeds.select("originator_id", "seed_version_"), "originator_id", "left").where(
        "seed_version_ is null or originator_version > seed_version_"
    )
    tail = decode(tail) if decode else tail
    seeds = seeds.select("originator_id", "seed_version_", *[F.col(n).alias(f"{n}_before_") for n in fields])
    ended = F.lit(None).cast("long")
    if discarded:
        ends = tail.where(F.col("topic").isin(*discarded)).groupBy("originator_id").agg(F.max("originator_version").alias("end_"))
        tail = tail.join(ends, "originator_id", "left").where("end_ is null or originator_version > end_")
        seeds, ended = seeds.join(ends, "originator_id", "left_anti"), F.max("end_")
    since = tail.groupBy("originator_id").agg(*span(), ended.alias("end_"), *[c.over.alias(f"{n}_since_") for n, c in fields.items()])
    both = seeds.join(since, "originator_id", "full")
    first = F.coalesce(F.col("end_") + 1, F.col("seed_version_") + 1, F.lit(initial).cast("long"))
    last = F.when(F.col("n_").isNotNull(), unbroken(first) if checked else F.col("hi_"))
    return both.select(
        "originator_id", F.coalesce(last, "seed_version_").alias("version"),
        *[c.join(F.col(f"{n}_before_"), F.col(f"{n}_since_")).alias(n) for n, c in fields.items()],
    )


def fast_forward(states: DataFrame, new_events: DataFrame, fields: Mapping[str, Continued]) -> DataFrame:
    """States (originator_id, version, fields) brought up to date; only events newer than a state count.

    This is a replay seeded by the states themselves, so ``new_events`` may overlap what they hold.
    """
    return replay(new_events, states.withColumnRenamed("version", "originator_version"), fields)


def touched(states: DataFrame, new_events: DataFrame) -> DataFrame:
    """Ids whose states are out of date."""
    return new_events.join(states, "originator_id", "left").where("version is null or originator_version > version").select("originator_id").distinct()


def project_snapshot(events: DataFrame, spec, ids: DataFrame | None = None, version: int | None = None) -> DataFrame:
    """Snapshots of chosen aggregates (of all if no ids are given) at a version (or the last)."""
    if ids is not None:
        events = events.join(ids.select("originator_id").distinct(), "originator_id", "left_semi")
    if version is not None:
        events = events.where(F.col("originator_version") <= version)
    return take(project(events, spec), spec.name, spec.class_version)
