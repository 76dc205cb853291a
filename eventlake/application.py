"""Applications: a log, snapshots and the aggregates of a spec, with the usual entry points.

Every call works on any number of aggregates at once and returns DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.functions import codec
from eventlake.functions.config import Settings
from eventlake.operators import reads, snapshots
from eventlake.operators.folds import AggregateSpec, project
from eventlake.schema import AggregateNotFoundError, ProgrammingError
from eventlake.sources.log import EventLog


class Repository:
    """States of aggregates of one spec.  ``decode`` turns stored events into columns that its fields use."""

    def __init__(self, application: Application, spec: AggregateSpec, decode: Callable[[DataFrame], DataFrame]):
        self._application, self._spec, self._decode = application, spec, decode

    def _stored(self, ids: Sequence[str] | DataFrame | None = None, version: int | None = None) -> DataFrame:
        rows = self._application.log.notifications()
        if isinstance(ids, DataFrame):
            rows = rows.join(ids.select("originator_id").distinct(), "originator_id", "left_semi")
        elif ids is not None:
            rows = rows.where(F.col("originator_id").isin(*ids))
        return rows if version is None else rows.where(F.col("originator_version") <= version)

    def events(self, ids: Sequence[str] | DataFrame | None = None, version: int | None = None) -> DataFrame:
        return self._decode(self._stored(ids, version))

    def get(self, ids: Sequence[str] | DataFrame | None = None, version: int | None = None) -> DataFrame:
        """States, current or at a version; ids without events have no row.

        Where the application takes snapshots and the spec says how its fields go on from one, events
        at or before the last snapshot are dropped before they are decoded.
        """
        spec = self._spec
        if self._application.snapshots is None or not spec.continued:
            return project(self.events(ids, version), spec)
        at = F.col("originator_version")
        fields = {
            "created_on": snapshots.Continued(F.min_by("timestamp", at), "first"),
            "modified_on": snapshots.Continued(F.max_by("timestamp", at), "last"), **spec.continued,
        }
        taken = self._application.snapshots.notifications()
        if isinstance(ids, DataFrame):
            taken = taken.join(ids.select("originator_id").distinct(), "originator_id", "left_semi")
        elif ids is not None:
            taken = taken.where(F.col("originator_id").isin(*ids))
        time = self._decode(self._stored()).schema["timestamp"].dataType.simpleString()
        seeds = self._seeds(taken, {"created_on": time, "modified_on": time, **spec.types})
        return snapshots.replay(self._stored(ids, version), seeds, fields, version, spec.initial_version, self._decode, spec.discarded)

    def _seeds(self, taken: DataFrame, types: Mapping[str, str]) -> DataFrame:
        known = self._application.decode(taken.where(F.col("topic") == self._spec.name))
        state = F.from_json("state", ", ".join(f"`{n}` {t}" for n, t in types.items()), snapshots.READ)
        return known.select("originator_id", "originator_version", state.alias("s_")).select("originator_id", "originator_version", "s_.*")

    def replay(self, fields: Mapping[str, snapshots.Continued], types: Mapping[str, str], version: int | None = None) -> DataFrame:
        """States (originator_id, version, fields) from the last snapshots at or before a version and the events after them.

        ``types`` are those of the fields in the snapshots' JSON.
        """
        if self._application.snapshots is None:
            raise ProgrammingError("snapshotting is not enabled")
        seeds = self._seeds(self._application.snapshots.notifications(), types)
        return snapshots.replay(self._stored(), seeds, fields, version, self._spec.initial_version, self._decode)

    def get_one(self, originator_id: str, version: int | None = None):
        found = self.get([originator_id], version).collect()
        if not found:
            raise AggregateNotFoundError(originator_id)
        return found[0]

    def __contains__(self, originator_id: str) -> bool:
        return bool(self.get([originator_id]).limit(1).count())


class Application:
    """``path`` holds the logs of events and snapshots.

    Settings (prefix NAME_ or none): CIPHER_KEY, COMPRESSOR_TOPIC, IS_SNAPSHOTTING_ENABLED.
    """

    name = "Application"
    log_section_size = 10

    def __init__(self, spark: SparkSession, path: str, env: Mapping[str, str] | None = None, snapshotting_intervals: Mapping[str, int] | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.settings = Settings(self.name, env, spark=spark)
        self.log = EventLog(spark, f"{self.path}/events").create()
        self.snapshotting_intervals = dict(snapshotting_intervals or {})
        self.is_snapshotting_enabled = self.settings.flag("IS_SNAPSHOTTING_ENABLED", bool(self.snapshotting_intervals))
        self.snapshots = EventLog(spark, f"{self.path}/snapshots").create() if self.is_snapshotting_enabled else None
        self._cipher, self._compressor = self.settings.get("CIPHER_KEY"), self.settings.get("COMPRESSOR_TOPIC")

    def encode(self, events: DataFrame) -> DataFrame:
        """Envelope columns of events whose ``state`` is JSON text."""
        data = codec.encode_state(F.col("state"), self._cipher, self._compressor)
        return events.withColumn("state", data)

    def decode(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("state", codec.decode_state(F.col("state"), self._cipher, self._compressor))

    def save(self, events: DataFrame, tracking: tuple[str, int] | None = None, order: str | None = None) -> DataFrame:
        """Record events (originator_id, originator_version, topic, state as JSON); the rows with their ids."""
        return self.log.append(self.encode(events), tracking, order=order)

    def repository(self, spec: AggregateSpec, columns: Callable[[DataFrame], DataFrame]) -> Repository:
        return Repository(self, spec, lambda rows: columns(self.decode(rows)))

    def notification_log(self, section_id: str) -> dict:
        return self.log.section(section_id, self.log_section_size)

    def select(self, start: int, limit: int, stop: int | None = None, topics: Sequence[str] = ()) -> DataFrame:
        reads.check_limit(limit, self.log_section_size)
        return self.log.select_notifications(start, limit, stop, topics)

    def take_snapshots(self, repository: Repository, spec: AggregateSpec, ids: DataFrame | None = None, version: int | None = None) -> DataFrame:
        """Snapshot aggregates at a version (or the last)."""
        if self.snapshots is None:
            raise ProgrammingError("snapshotting is not enabled")
        made = snapshots.project_snapshot(repository.events(ids, version), spec)
        return self.snapshots.append(self.encode(made))

    def take_automatic_snapshots(self, repository: Repository, spec: AggregateSpec, new_events: DataFrame) -> DataFrame | None:
        """Snapshot the aggregates at those of their new versions that the spec's interval divides."""
        interval = self.snapshotting_intervals.get(spec.name)
        if not interval or self.snapshots is None:
            return None
        due = new_events.where(F.col("originator_version") % interval == 0).select("originator_id", "originator_version")
        at = F.col("originator_version")
        times = {"created_on": F.min_by("timestamp", at), "modified_on": F.max_by("timestamp", at)}
        running = snapshots.every(repository.events(due), {**times, **spec.fields}, interval)
        made = running.join(due, ["originator_id", "originator_version"], "left_semi").drop("timestamp")
        return self.snapshots.append(self.encode(snapshots.take(made.withColumnRenamed("originator_version", "version"), spec.name, spec.class_version)))


class EventSourcedLog:
    """One long sequence under a fixed id that is never folded, such as the list of all ids."""

    def __init__(self, log: EventLog, originator_id: str, topic: str, initial_version: int = 1):
        self.log, self.originator_id, self.topic, self.initial_version = log, originator_id, topic, initial_version

    def trigger_events(self, states: DataFrame, order: str) -> DataFrame:
        """Append entries (a state each) in an order, numbered on from the last."""
        rows = states.withColumn("originator_id", F.lit(self.originator_id)).withColumn("topic", F.lit(self.topic))
        numbered = self.log.next_versions(rows, order, self.initial_version)
        return self.log.append(numbered, order="originator_version")

    def get(self, gt: int | None = None, lte: int | None = None, desc: bool = False, limit: int | None = None) -> DataFrame:
        return self.log.select_events(self.originator_id, gt=gt, lte=lte, desc=desc, limit=limit)

    def get_first(self) -> DataFrame:
        return self.get(limit=1)

    def get_last(self) -> DataFrame:
        return self.get(desc=True, limit=1)
