"""State kept by streams: aggregates per id, and projections written once per micro-batch.

Watermarks and event-time windows order events by their time; logs are ordered by position, so
those are offered as an extension only (``windowed``).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Collection, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from eventlake.plans import scratch


class _Balance(StatefulProcessor):
    """One value state per aggregate: its version and running sum."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("aggregate", "version long, total decimal(38,2)")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        version, total = self.state.get() if self.state.exists() else (0, None)
        for batch in rows:
            batch = batch.sort_values("originator_version")
            for v, amount in zip(batch["originator_version"], batch["amount"], strict=True):
                if v > version:  # a repeated row changes nothing
                    version, total = int(v), amount if total is None else total + amount
        self.state.update((version, total))
        yield pd.DataFrame({"originator_id": [key[0]], "version": [version], "total": [total]})

    def close(self) -> None:
        return None


def running_totals(stream: DataFrame) -> DataFrame:
    """Per micro-batch the new version and total of each aggregate with new events (a custom stateful operator)."""
    return stream.groupBy("originator_id").transformWithStateInPandas(
        _Balance(), "originator_id string, version long, total decimal(38,2)", "Update", "None"
    )


class Projection:
    """A table of the latest row per key, kept by micro-batches.

    Rows lie in ``buckets`` by a hash of the key.  A batch writes anew only the buckets it has keys of,
    and then a version: which folder holds each bucket.  A version is named by its batch id and
    appears with its content, and the newest one counts, so a batch that runs twice makes the same
    version again.  Folders that neither the new version nor the one before it names are removed.
    """

    def __init__(self, path: str, schema: str, key: str, order: str, buckets: int = 64):
        self.path, self.schema, self.key, self.order, self.buckets = path.rstrip("/"), schema, key, order, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _versions(self) -> list[int]:
        store, base = scratch.filesystem(self.path)
        found = store.get_file_info(fs.FileSelector(f"{base}/versions", allow_not_found=True))
        return sorted(int(x.base_name) for x in found if x.base_name.isdigit())

    def _folders(self, before: int | None = None) -> dict[int, str]:
        """The folder of each bucket in the newest version (before a batch)."""
        versions = [v for v in self._versions() if before is None or v < before]
        if not versions:
            return {}
        store, base = scratch.filesystem(self.path)
        with store.open_input_stream(f"{base}/versions/{versions[-1]}") as source:
            return {int(k): v for k, v in json.loads(source.read()).items()}

    def _read(self, spark, folders: Collection[str]) -> DataFrame:
        paths = sorted({f"{self.path}/data/{x}" for x in folders})
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def table(self, spark, before: int | None = None) -> DataFrame:
        return self._read(spark, self._folders(before).values())

    def upsert(self, batch: DataFrame, batch_id: int, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> None:
        """Bring the table up to date; ``merge`` is given the rows of the buckets that the batch has keys of."""
        spark, folders, name = batch.sparkSession, self._folders(batch_id), f"{batch_id}-{uuid.uuid4().hex}"
        touched = sorted(r["b_"] for r in batch.select(self._bucket().alias("b_")).distinct().collect())  # at most ``buckets``
        old = self._read(spark, [folders[b] for b in touched if b in folders])
        rows = merge(old, batch) if merge else old.unionByName(batch)
        rest = [c for c in rows.columns if c != self.key]
        latest = rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), F.col(self.order)).alias("r_")).select(self.key, "r_.*")
        latest.select(*old.columns, self._bucket().alias("bucket_")).write.partitionBy("bucket_").parquet(f"{self.path}/data/{name}")
        store, base = scratch.filesystem(self.path)
        store.create_dir(f"{base}/data/{name}", recursive=True)
        written = [x.base_name for x in store.get_file_info(fs.FileSelector(f"{base}/data/{name}")) if x.base_name.startswith("bucket_=")]
        now = {b: f for b, f in folders.items() if b not in touched} | {int(x.split("=")[1]): f"{name}/{x}" for x in written}
        store.create_dir(f"{base}/versions", recursive=True)
        with store.open_output_stream(f"{base}/versions/.{name}") as sink:
            sink.write(json.dumps(now).encode())
        store.move(f"{base}/versions/.{name}", f"{base}/versions/{batch_id}")
        used = set(now.values()) | set(folders.values())
        for batch_folder in store.get_file_info(fs.FileSelector(f"{base}/data")):
            there = store.get_file_info(fs.FileSelector(batch_folder.path))
            gone = [x for x in there if x.base_name.startswith("bucket_=") and f"{batch_folder.base_name}/{x.base_name}" not in used]
            for x in gone:
                store.delete_dir(x.path)

    def follow(self, stream: DataFrame, checkpoint: str, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None):
        """Start a query that brings the projection up to date with what is available."""
        write = stream.writeStream.foreachBatch(lambda batch, n: self.upsert(batch, n, merge))
        return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(stream: DataFrame, time_col: str, late: str, length: str, *aggregates) -> DataFrame:
    """Extension: event-time windows with a watermark."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, length), "topic").agg(*aggregates)
