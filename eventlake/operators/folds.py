"""Folds of event sequences into state, in three tiers with one meaning.

* ``algebraic``: every field is an aggregate (sum, last value, flag, count, ordered list).  Rows are
  merged before the shuffle and nothing needs the sequence in order; the default.
* ``hof``: an ordered fold with a struct as state, by F.aggregate, for state machines that are not
  algebraic.  A sequence is one row's array.
* ``pandas``: any Python function over the ordered events of a group, through Arrow, streamed in
  sorted order so that a long sequence is not held in memory.

Sequences are always folded by version, whatever the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlake.schema import OriginatorIDError, OriginatorVersionError, ProgrammingError


def total(value: Column) -> Column:
    """Sum of a value over the sequence; null adds nothing."""
    return F.sum(F.coalesce(value, F.lit(0)))


def last_value(value: Column, when: Column | None = None) -> Column:
    """The value of the last event (of those meeting ``when``)."""
    version = F.col("originator_version")
    return F.max_by(value, version if when is None else F.when(when, version))


def flag(when: Column) -> Column:
    """True once an event meets ``when``."""
    return F.bool_or(F.coalesce(when, F.lit(False)))


def counter(when: Column | None = None) -> Column:
    return F.count(F.lit(1) if when is None else F.when(when, 1))


def appended(value: Column, when: Column | None = None) -> Column:
    """The values in order of version, as an array."""
    pair = F.struct(F.col("originator_version").alias("v"), value.alias("x"))
    return F.transform(F.array_sort(F.collect_list(pair if when is None else F.when(when, pair))), lambda e: e["x"])


@dataclass(frozen=True)
class EventType:
    """A kind of event: its topic and the payload fields it carries."""

    topic: str
    payload: str = ""


@dataclass(frozen=True)
class AggregateSpec:
    """What an aggregate is: its events and, for each field of its state, the aggregate that folds it.

    ``created`` lists topics that may start a sequence (any if empty); ``discarded`` those that end
    it; ``initial_version`` is the version of a first event.  ``continued`` says how fields of a later
    state follow from an earlier one (see ``snapshots``), and ``types`` their types in snapshots; with
    both, a repository starts from snapshots.
    """

    name: str
    fields: Mapping[str, Column]
    events: tuple[EventType, ...] = ()
    created: tuple[str, ...] = ()
    discarded: tuple[str, ...] = ()
    initial_version: int = 1
    class_version: int = 1
    types: Mapping[str, str] = field(default_factory=dict)
    continued: Mapping[str, object] = field(default_factory=dict)

    def __post_init__(self):
        topics = [e.topic for e in self.events]
        if len(set(topics)) != len(topics):
            raise ProgrammingError(f"{self.name}: an event type is defined twice")
        unknown = set(self.created + self.discarded) - set(topics)
        if topics and unknown:
            raise ProgrammingError(f"{self.name}: no event type for {', '.join(sorted(unknown))}")
        clash = {"originator_id", "version", "created_on", "modified_on"} & set(self.fields)
        if clash:
            raise ProgrammingError(f"{self.name}: reserved field {', '.join(sorted(clash))}")


def after_discarding(events: DataFrame, topics: tuple[str, ...]) -> DataFrame:
    """The events after each aggregate's last discarding one; discarded aggregates have none."""
    if not topics:
        return events
    ends = events.where(F.col("topic").isin(*topics)).groupBy("originator_id").agg(F.max("originator_version").alias("end_"))
    return events.join(ends, "originator_id", "left").where("end_ is null or originator_version > end_").drop("end_")


def discarded(events: DataFrame, topics: tuple[str, ...]) -> DataFrame:
    """Ids of aggregates whose last event discards them."""
    last = events.groupBy("originator_id").agg(F.max_by("topic", "originator_version").alias("last_topic"))
    return last.where(F.col("last_topic").isin(*topics)).select("originator_id")


def span() -> list[Column]:
    """Aggregates of a sequence's versions, for ``unbroken``."""
    v = F.col("originator_version")
    wide = v.cast("decimal(18,0)")
    return [F.min(v).alias("lo_"), F.max(v).alias("hi_"), F.count(v).alias("n_"), F.sum(wide).alias("sum_"), F.sum((wide * wide).cast("decimal(36,0)")).alias("squares_")]


def unbroken(first: Column) -> Column:
    """The last version of a sequence of ``span`` from ``first``; a gap or a repeat raises.

    Count, sum and sum of squares are those of the whole numbers between the ends, which costs no
    sort; the ordered folds look at every step.
    """
    lo, hi = F.col("lo_").cast("decimal(12,0)"), F.col("hi_").cast("decimal(12,0)")
    below = lambda x: x * (x + 1) * (2 * x + 1)  # noqa: E731  six times the sum of squares up to x
    good = (F.col("lo_") == first) & (F.col("n_") == F.col("hi_") - F.col("lo_") + 1) & (2 * F.col("sum_") == (lo + hi) * F.col("n_"))
    good &= 6 * F.col("squares_") == below(hi) - below(lo - 1)
    said = F.concat(F.lit("OriginatorVersionError: the versions of "), F.col("originator_id"), F.lit(" are not whole from "), first.cast("string"))
    return F.when(good, F.col("hi_")).otherwise(F.raise_error(said).cast("long"))


def project(events: DataFrame, spec: AggregateSpec, checked: bool = True) -> DataFrame:
    """Current state: originator_id, version, created_on, modified_on and the spec's fields, a row per aggregate.

    A gap or a repeat in the versions, a sequence that does not begin with the initial version (or
    after a discarding event), and one that begins with another topic than those that create raise,
    unless ``checked`` is off.
    """
    version = F.col("originator_version")
    rows = events
    if spec.discarded:
        ends = events.where(F.col("topic").isin(*spec.discarded)).groupBy("originator_id").agg(F.max(version).alias("end_"))
        rows = events.join(ends, "originator_id", "left").where("end_ is null or originator_version > end_")
    names = [F.col(n) for n in spec.fields]
    folded = rows.groupBy("originator_id").agg(
        *span(), (F.max("end_") if spec.discarded else F.lit(None).cast("long")).alias("end_"),
        F.min_by("timestamp", version).alias("created_on"), F.max_by("timestamp", version).alias("modified_on"),
        F.min_by("topic", version).alias("began_") if spec.created else F.lit(None).alias("began_"),
        *[c.alias(name) for name, c in spec.fields.items()],
    )
    now = F.col("hi_")
    if checked:
        now = unbroken(F.coalesce(F.col("end_") + 1, F.lit(spec.initial_version).cast("long")))
        if spec.created:
            said = F.concat(F.lit("ProgrammingError: "), F.col("originator_id"), F.lit(" begins with "), F.col("began_"))
            now = F.when(F.col("began_").isin(*spec.created), now).otherwise(F.raise_error(said).cast("long"))
    return folded.select("originator_id", now.alias("version"), "created_on", "modified_on", *names)


def continues(events: DataFrame, originator_id: str, version: int) -> int:
    """The version that one aggregate has after ``events``; raises if they are not its next ones."""
    found = events.agg(*span(), F.max(F.when(~F.col("originator_id").eqNullSafe(originator_id), F.coalesce("originator_id", F.lit("null")))).alias("other_")).first()
    if found["other_"] is not None:
        raise OriginatorIDError(f"an event of {found['other_']} for {originator_id}")
    if not found["n_"]:
        return version
    whole = range(version + 1, found["hi_"] + 1)
    if found["lo_"] != version + 1 or found["n_"] != len(whole) or found["sum_"] != (found["lo_"] + found["hi_"]) * found["n_"] // 2:
        raise OriginatorVersionError(f"the versions of {originator_id} do not go on from {version}")
    return found["hi_"]


def history(events: DataFrame, fields: Mapping[str, Column]) -> DataFrame:
    """The events with running values of the fields (aggregates) up to and with each event."""
    window = Window.partitionBy("originator_id").orderBy("originator_version").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.select("*", *[c.over(window).alias(name) for name, c in fields.items()])


def fold(
    events: DataFrame, zero: Column, merge: Callable[[Column, Column], Column], columns: list[str], finish: Callable[[Column], Column] | None = None,
    seeds: DataFrame | None = None, initial_version: int = 1,
) -> DataFrame:
    """Ordered fold with a struct accumulator: originator_id, version, state.

    ``merge(state, event)`` sees the event's ``columns`` and its version as v.  With ``seeds``
    (originator_id, seed_version, seed of zero's type) a sequence starts from its seed.  A gap or a
    repeat in the versions raises.
    """
    entry = F.struct(F.col("originator_version").alias("v"), *columns)
    grouped = events.groupBy("originator_id").agg(F.array_sort(F.collect_list(entry)).alias("events_"))
    if seeds is not None:
        grouped = grouped.join(seeds, "originator_id", "left")
        start, at = F.coalesce(F.col("seed"), zero), F.coalesce(F.col("seed_version"), F.lit(initial_version - 1).cast("long"))
    else:
        start, at = zero, F.lit(initial_version - 1).cast("long")

    def step(acc: Column, event: Column) -> Column:
        wrong = F.raise_error(F.concat(F.lit("OriginatorVersionError: expected "), (acc["v"] + 1).cast("string"), F.lit(", got "), event["v"].cast("string")))
        return F.struct(F.when(event["v"] == acc["v"] + 1, event["v"]).otherwise(wrong.cast("long")).alias("v"), merge(acc["s"], event).alias("s"))

    whole = F.aggregate("events_", F.struct(at.alias("v"), start.alias("s")), step).alias("acc_")
    out = grouped.select("originator_id", whole)
    state = F.col("acc_.s")
    return out.select("originator_id", F.col("acc_.v").alias("version"), (finish(state) if finish else state).alias("state"))


def fold_python(
    events: DataFrame, initial: Callable[[], object], mutate: Callable[[object, dict], object], finish: Callable[[object], dict], schema: str, columns: list[str],
    initial_version: int = 1,
) -> DataFrame:
    """Fold with any Python function: ``mutate(state, event) -> state``; None means the aggregate is gone.

    A gap or a repeat in the versions raises OriginatorVersionError.

    Sequences are dealt by id and sorted, and the events stream through the worker, so a sequence
    longer than memory folds too.  ``schema`` describes what ``finish(state)`` returns.
    """
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, version, state, out = None, 0, None, []
        for batch in batches:
            for row in batch.to_dict("records"):
                if row["originator_id"] != now:
                    if now is not None and state is not None:
                        out.append({"originator_id": now, "version": version, **finish(state)})
                    now, state, version = row["originator_id"], initial(), initial_version - 1
                if row["originator_version"] != version + 1:
                    raise OriginatorVersionError(f"{now}: expected {version + 1}, got {row['originator_version']}")
                state = mutate(initial() if state is None else state, row)
                version = row["originator_version"]
            yield pd.DataFrame(out, columns=["originator_id", "version", *names])
            out = []
        if now is not None and state is not None:
            yield pd.DataFrame([{"originator_id": now, "version": version, **finish(state)}], columns=["originator_id", "version", *names])

    rows = events.select("originator_id", "originator_version", *columns)
    dealt = rows.repartition("originator_id").sortWithinPartitions("originator_id", "originator_version")
    return dealt.mapInPandas(run, f"originator_id string, version long, {schema}")


def dispatch(topic: Column, cases: Mapping[str, Column], otherwise: Column) -> Column:
    """The expression registered for a topic."""
    out = None
    for name, expression in cases.items():
        out = F.when(topic == name, expression) if out is None else out.when(topic == name, expression)
    return otherwise if out is None else out.otherwise(otherwise)


def violations(events: DataFrame, delta: Column, limit: Column) -> DataFrame:
    """Events that would take a running balance below -limit: originator_id, originator_version, balance."""
    window = Window.partitionBy("originator_id").orderBy("originator_version").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = events.withColumn("balance", F.sum(delta).over(window))
    return running.where(F.col("balance") < -limit).select("originator_id", "originator_version", "balance")


def uncovered(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, finish: str, width_seconds: int = 86_400) -> DataFrame:
    """Points that lie in no interval (start < at < finish) of their key.

    Intervals are listed under every period of ``width_seconds`` they touch, so the join is on key
    and period, not on the key alone.
    """
    period = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / (width_seconds * 1_000_000)).cast("long")
    listed = intervals.withColumn("p_", F.explode(F.sequence(period(F.col(start)), period(F.col(finish))))).select(key, "p_", start, finish)
    on = (F.col("a_.k_") == F.col("b_.k_")) & (F.col("a_.p_") == F.col("b_.p_"))
    left = points.withColumn("p_", period(F.col(at))).withColumnRenamed(key, "k_").alias("a_")
    right = listed.withColumnRenamed(key, "k_").alias("b_")
    inside = (F.col(f"b_.{start}") < F.col(f"a_.{at}")) & (F.col(f"a_.{at}") < F.col(f"b_.{finish}"))
    return left.join(right, on & inside, "left_anti").drop("p_").withColumnRenamed("k_", key)
