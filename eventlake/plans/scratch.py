"""Intermediate tables in the folder that driver and executors share.

Cutting lineage and handing files from executors to later jobs both need storage that outlives an
executor.  The folder is the one the cluster names in ``spark.checkpoint.dir``; it is read from
the session.  Only where that is unset, and Spark runs in one process, is a temporary folder used.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_OWN: set[str] = set()


def _remove(own: str) -> None:
    """Remove a folder in whatever store it is, by pyarrow: the JVM may be gone."""
    try:
        store, path = filesystem(own)
        store.delete_dir(path)
    except (OSError, ValueError):  # it is gone, or this driver cannot reach the store any more
        return


def root(spark: SparkSession) -> str:
    """The shared folder of this session, as a URI without a trailing slash."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="eventlake-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        named = f"file://{_LOCAL[0]}"
    path = spark._jvm.org.apache.hadoop.fs.Path(named)  # a bare path is one of the default file system
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, in this application's part of it.

    That part is removed when the driver's Python ends.
    """
    own = f"{root(spark)}/eventlake-{spark.sparkContext.applicationId}"
    if own not in _OWN:
        _OWN.add(own)
        atexit.register(_remove, own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a reader of it.

    Unlike a cached frame this survives the loss of any executor, and the plan above it starts
    from files.  With ``batch_rows`` the rows go to Python in Arrow batches of at most so many while
    this is written (and of the session's bytes, as ever); the session is left as it was.
    """
    spark = df.sparkSession
    path = place(spark, name)
    with batches_of(spark, batch_rows):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Within this block queries send Python at most ``rows`` rows a batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if rows is None or 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a folder, for executors that write other than Parquet files.

    Works for any store that pyarrow can open (file, hdfs, s3, gs); a bare path is a local one.
    """
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:") if uri.startswith("file:") else "file://" + uri
    return fs.FileSystem.from_uri(uri)
