"""The event log: Parquet data files and a numbered chain of commits.

An append stages its rows as Parquet and then publishes one commit entry by creating the next
numbered file exclusively; entries decide what exists.  A writer that loses the race looks again
for conflicts with what was committed meanwhile and tries the next number.  So

* a batch, its tracking record and its stream batch id become visible together or not at all;
* keys (originator_id, originator_version) are unique, in the table and in a batch;
* notification ids are gapless, and their order is that of commits.

Data files hold ids relative to their commit; the entry holds the base.  A loser therefore never
rewrites data.  Readers prune commits by id range before any file is opened, and an append looks for
conflicts only in commits that may hold one of its aggregates (see ``marks``).
"""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlake.functions.config import retry
from eventlake.operators import reads
from eventlake.operators.versions import conflicts_in_batch, conflicts_with_table
from eventlake.plans import scratch
from eventlake.schema import NOTIFICATION, TRACKING, IntegrityError
from eventlake.sources import commits, marks


class LostRace(Exception):
    """Another writer took the commit number."""


class EventLog:
    """A log below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._store, self._base = scratch.filesystem(self.path)
        self._known: list[dict] = []

    # -- commits ---------------------------------------------------------------------------------

    def create(self) -> EventLog:
        """Make the folders; does no harm where they exist."""
        for part in ("commits", "data"):
            self._store.create_dir(f"{self._base}/{part}", recursive=True)
        return self

    def entries(self) -> list[dict]:
        """Committed entries in order."""
        self._known = max(self._known, commits.read_on(self._store, self._base, self._known), key=len)
        return self._known

    def _publish(self, entry: dict) -> None:
        name = f"{self._base}/commits/{commits.name(entry['number'])}"
        data = json.dumps(entry).encode()
        if self._store.type_name == "local":
            # Written aside and linked: the name appears with its content, for one writer only.
            aside = f"{self._base}/commits/.{os.getpid()}-{os.urandom(6).hex()}"
            with open(aside, "wb") as sink:
                sink.write(data)
                sink.flush()
                os.fsync(sink.fileno())
            try:
                os.link(aside, name)
            except FileExistsError as taken:
                raise LostRace(name) from taken
            finally:
                os.unlink(aside)
            return
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits/{commits.name(entry['number'])}")
        store = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        # Written aside and renamed where the name is free, so that it appears with its content.
        aside = jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits/.{os.getpid()}-{os.urandom(6).hex()}")
        sink = store.create(aside, False)
        sink.write(bytearray(data))
        sink.close()
        if not store.rename(aside, where):
            store.delete(aside, False)
            if store.exists(where):
                raise LostRace(name)
            raise OSError(f"{name} cannot be written")

    # -- writes ----------------------------------------------------------------------------------

    def append(
        self, events: DataFrame | None, tracking: tuple[str, int] | None = None, batch: tuple[str, int] | None = None, order: str | None = None
    ) -> DataFrame | None:
        """Append events (originator_id, originator_version, topic, state) in their order, or by ``order``.

        Returns the rows just committed, with their ids; None if ``batch`` (query name, batch id)
        was committed before, so that a repeated micro-batch does nothing.  Raises IntegrityError,
        and writes nothing, if a key or the tracking record exists.
        """
        self.create()
        known = self.entries()
        if batch is not None and any(e.get("batch") == list(batch) for e in known):
            return None
        staged, count, data = None, 0, None
        if events is not None:
            data = f"data/commit-{os.urandom(8).hex()}"
            staged, count = self._stage(events, data, order)
        if staged is not None and count and conflicts_in_batch(staged).limit(1).count():
            raise IntegrityError("a key occurs twice in the batch")
        ids, checked = marks.of(staged) if staged is not None and count else None, 0

        def attempt() -> dict:
            nonlocal known, checked
            known = self.entries()
            if batch is not None and any(e.get("batch") == list(batch) for e in known):
                return {}
            if tracking is not None and any(tuple(e["tracking"]) == tuple(tracking) for e in known if e.get("tracking")):
                raise IntegrityError(f"{tracking} is tracked already")
            fresh = [e for e in known[checked:] if e["count"] and marks.intersects(e.get("ids"), ids)]
            if count and fresh and conflicts_with_table(staged, self._rows(fresh)).limit(1).count():
                raise IntegrityError("a key is stored already")
            checked = len(known)
            base = max((e["base"] + e["count"] for e in known), default=0)
            entry = {
                "number": len(known), "base": base, "count": count, "data": data if count else None,
                "tracking": list(tracking) if tracking else None, "batch": list(batch) if batch else None, "ids": ids,
            }
            self._publish(entry)
            return entry

        entry = retry(LostRace, attempts=1000, wait=0.01)(attempt)()
        if not entry:
            return None
        return self._rows([entry]) if count else self.spark.createDataFrame([], NOTIFICATION)

    def _stage(self, events: DataFrame, data: str, order: str | None) -> tuple[DataFrame, int]:
        """Write the batch with relative ids 1, 2, ...: counters within partitions, shifted by counts of partitions."""
        rows = events.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in NOTIFICATION.fields[1:]], *([F.col(order).alias("order_")] if order else []))
        if order:
            rows = rows.repartitionByRange("order_").sortWithinPartitions("order_")
        first = scratch.keep(rows.select(*[f.name for f in NOTIFICATION.fields[1:]], F.monotonically_increasing_id().alias("at_")), "log-stage")
        part = F.shiftright("at_", 33)
        counts = sorted((r["p_"], r["n_"]) for r in first.groupBy(part.alias("p_")).agg(F.count(F.lit(1)).alias("n_")).collect())  # a row per partition
        shifts, total = [], 0
        for p, n in counts:
            shifts.append((p, total))
            total += n
        table = self.spark.createDataFrame(shifts, "p_ long, shift_ long")
        numbered = first.withColumn("p_", part).join(F.broadcast(table), "p_")
        relative = (F.col("at_").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("shift_") + 1).alias("relative")
        numbered.select(relative, *[f.name for f in NOTIFICATION.fields[1:]]).write.parquet(f"{self.path}/{data}")
        return self.spark.read.schema(self._stored()).parquet(f"{self.path}/{data}"), total

    @staticmethod
    def _stored() -> T.StructType:
        return T.StructType([T.StructField("relative", T.LongType()), *NOTIFICATION.fields[1:]])

    # -- reads -----------------------------------------------------------------------------------

    def _rows(self, entries: Sequence[dict]) -> DataFrame:
        entries = [e for e in entries if e["count"]]
        if not entries:
            return self.spark.createDataFrame([], NOTIFICATION)
        stored = self.spark.read.schema(self._stored()).parquet(*[f"{self.path}/{e['data']}" for e in entries])
        name = F.regexp_extract(F.col("_metadata.file_path"), r"(commit-[0-9a-f]+)", 1)
        columns = [f.name for f in NOTIFICATION.fields[1:]]
        if len(entries) == 1:
            return stored.select((F.col("relative") + entries[0]["base"]).alias("notification_id"), *columns)
        bases = self.spark.createDataFrame([(e["data"].split("/")[-1], e["base"]) for e in entries], "c_ string, base_ long")
        joined = stored.withColumn("c_", name).join(F.broadcast(bases), "c_")  # a row per commit
        return joined.select((F.col("relative") + F.col("base_")).alias("notification_id"), *columns)

    def notifications(self, start: int = 1, stop: int | None = None) -> DataFrame:
        """All notifications of an id range, in no order; commits outside it are not opened."""
        want = [e for e in self.entries() if e["count"] and e["base"] + e["count"] >= start and (stop is None or e["base"] < stop)]
        rows = self._rows(want).where(F.col("notification_id") >= start)
        return rows if stop is None else rows.where(F.col("notification_id") <= stop)

    def select_events(self, originator_id: str | None = None, **options) -> DataFrame:
        return reads.select_events(self.notifications().drop("notification_id"), originator_id, **options)

    def select_notifications(self, start: int, limit: int | None = None, stop: int | None = None, topics: Sequence[str] = ()) -> DataFrame:
        return reads.select_notifications(self.notifications(start, stop), start, limit, stop, topics)

    def section(self, section_id: str, section_size: int = 10) -> dict:
        start, limit = reads.section_bounds(section_id, section_size)
        return reads.section(self.notifications(start, start + limit - 1 if limit else start), section_id, section_size)

    def max_notification_id(self) -> int:
        """From the commits alone."""
        return max((e["base"] + e["count"] for e in self.entries()), default=0)

    def tracking(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(e["tracking"]) for e in self.entries() if e.get("tracking")], TRACKING)

    def max_tracking_id(self, application_name: str) -> int:
        return max((e["tracking"][1] for e in self.entries() if e.get("tracking") and e["tracking"][0] == application_name), default=0)

    def has_tracking_id(self, application_name: str, notification_id: int) -> bool:
        return any(e["tracking"] == [application_name, notification_id] for e in self.entries() if e.get("tracking"))

    def next_versions(self, rows: DataFrame, order: str, initial: int = 1) -> DataFrame:
        """``rows`` with the versions that follow those stored."""
        from eventlake.operators.versions import assign_versions

        last = self.notifications().groupBy("originator_id").agg(F.max("originator_version").alias("last_version"))
        return assign_versions(rows, "originator_id", order, last, initial)
