"""The event log as a data source: spark.read / spark.readStream.format("eventlake").

Options: path (of the log), topics (comma-separated), start and stop (ids, for batch reads) and
section_size (a cap on commits taken into one micro-batch, 0 for none).  The stream's offset is
{"n": number of commits read}, so what it takes next follows from the commit chain; each row is
delivered once per checkpoint.  Partitions are data files; they are read as Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from eventlake.plans import scratch
from eventlake.plans.session import ship
from eventlake.schema import NOTIFICATION
from eventlake.sources import commits


@dataclass
class _File(InputPartition):
    path: str
    base: int
    start: int
    stop: int | None
    topics: tuple[str, ...]

    def batches(self) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        store, path = scratch.filesystem(self.path)
        keep = ds.field("relative") >= self.start - self.base
        if self.stop is not None:
            keep &= ds.field("relative") <= self.stop - self.base
        if self.topics:
            keep &= ds.field("topic").isin(list(self.topics))
        names = [f.name for f in NOTIFICATION.fields]
        for batch in ds.dataset(path, filesystem=store, format="parquet").to_batches(filter=keep):
            ids = pc.add(batch.column("relative"), self.base)
            yield pa.RecordBatch.from_arrays([ids, *[batch.column(n) for n in names[1:]]], names=names)


def _entries(path: str, known: list[dict] | None = None) -> list[dict]:
    store, base = scratch.filesystem(path)
    return commits.read_on(store, base, known or [])


def _files(path: str, entries: list[dict], start: int, stop: int | None, topics: tuple[str, ...]) -> list[_File]:
    from pyarrow import fs

    store, base = scratch.filesystem(path)
    out = []
    for e in entries:
        if not e["count"] or e["base"] + e["count"] < start or stop is not None and e["base"] >= stop:
            continue
        for x in store.get_file_info(fs.FileSelector(f"{base}/{e['data']}")):
            if x.base_name.endswith(".parquet"):
                out.append(_File(f"{path}/{e['data']}/{x.base_name}", e["base"], start, stop, topics))
    return out


class _Options:
    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.topics = tuple(t for t in options.get("topics", "").split(",") if t)
        self.start = int(options.get("start", 1))
        self.stop = int(options["stop"]) if "stop" in options else None
        self.section_size = int(options.get("section_size", 0))


class _Reader(DataSourceReader):
    def __init__(self, options: _Options):
        self.options = options

    def partitions(self) -> list[_File]:
        o = self.options
        return _files(o.path, _entries(o.path), o.start, o.stop, o.topics) or [_File("", 0, 1, 0, ())]

    def read(self, partition: _File) -> Iterator:
        return partition.batches() if partition.path else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: _Options):
        self.options, self.at, self.known = options, 0, []

    def initialOffset(self) -> dict:
        return {"n": 0}

    def latestOffset(self) -> dict:
        self.known = _entries(self.options.path, self.known)
        there = len(self.known)
        self.at = min(there, self.at + self.options.section_size) if self.options.section_size else there
        return {"n": self.at}

    def partitions(self, start: dict, end: dict) -> list[_File]:
        o = self.options
        self.at = max(self.at, end["n"])
        self.known = _entries(o.path, self.known)
        return _files(o.path, self.known[start["n"] : end["n"]], 1, None, o.topics)

    def read(self, partition: _File) -> Iterator:
        return partition.batches()

    def commit(self, end: dict) -> None:
        return None


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "eventlake"

    def schema(self):
        return NOTIFICATION

    def reader(self, schema) -> DataSourceReader:
        return _Reader(_Options(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(_Options(self.options))


def register(spark: SparkSession) -> SparkSession:
    ship(spark).dataSource.register(LogSource)
    return spark
