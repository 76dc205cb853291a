"""Token counts from flat, unindexed token files by a separator scan.

A token file is a run of fixed-width ids; documents end at ``end_id`` and nothing says where.
Files are cut into blocks of ``block_tokens`` ids, read independently of each other; in each block
one vectorised comparison finds all separators.  A document may begin any number of blocks before
its separator, so the blocks' last separators and counts are stitched by a prefix scan over the
blocks of a file: its carried end gives the first document's start, its running count the ordinals.

Defined results: two adjacent separators enclose a document of 0 ids.  Ids after the last
separator are a document with ``terminated`` false.  An empty file has no documents.  Of a table,
null and empty texts have 0 ids, a null id stays null, repeated rows are counted each for itself,
and an empty table gives an empty result.  Other columns than id and text are not read; an id
column that is named as one of the results is kept, and that result is called token_<name>.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventlake.llm.spread import spread
from eventlake.llm.tokens import default_path, tokenizer
from eventlake.plans import scratch


def write_token_files(
    docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text",
    tokenizer_path: str | None = None, end_id: int = 49_407, width: int = 2, file_tokens: int = 1 << 27,
) -> DataFrame:
    """Write whole texts as token files below ``folder``; (file_, ordinal_, id_) says what was written where.

    Null and empty texts are a separator alone.  Each attempt of a task writes names of its own,
    and only those of committed attempts are in the returned (written) table.  A text that yields
    ``end_id`` or an id over ``width`` bytes could not be told apart again and raises ValueError;
    the default tokenizer and width have neither.
    """
    path = tokenizer_path or default_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get()
        encode, kind = tokenizer(path, literal_specials=True).encode, np.dtype(f"<u{width}")
        store, base = scratch.filesystem(folder)
        end, sink, files, ordinal, written = np.array([end_id], kind).tobytes(), None, 0, 0, 0
        for batch in batches:
            out = []
            for id_, text in zip(batch["id_"], batch["text_"], strict=True):
                if sink is None:
                    name = f"tokens-{task.partitionId():06d}-{files:04d}-{task.taskAttemptId()}.bin"
                    sink, ordinal, written = store.open_output_stream(f"{base}/{name}"), 0, 0
                ids = np.frombuffer(encode(text), "<u4")
                if len(ids) and (int(ids.max()) > np.iinfo(kind).max or (ids == end_id).any()):
                    raise ValueError(f"ids of a text do not fit {width} bytes or contain the end id")
                sink.write(ids.astype(kind).tobytes() + end)
                out.append((name, ordinal, id_))
                ordinal, written = ordinal + 1, written + len(ids) + 1
                if written >= file_tokens:
                    sink.close()
                    sink, files = None, files + 1
            yield pd.DataFrame(out, columns=["file_", "ordinal_", "id_"])
        if sink is not None:
            sink.close()

    store, base = scratch.filesystem(folder)
    store.create_dir(base, recursive=True)
    # The id goes as text, as pandas has no long that may be null.
    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("id_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    found = rows.mapInPandas(run, "file_ string, ordinal_ long, id_ string").withColumn("id_", F.col("id_").cast("long"))
    return scratch.keep(found, "token-files", batch_rows=2000)


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes) of the files below ``folder``."""
    from pyarrow import fs

    store, base = scratch.filesystem(folder)
    found = [(x.base_name, x.size) for x in store.get_file_info(fs.FileSelector(base)) if x.is_file]
    return spark.createDataFrame(found, "file string, bytes long")


def sized(files: DataFrame, folder: str) -> DataFrame:
    """(file, bytes) of named files, asked for by the executors: the driver lists nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = scratch.filesystem(folder)
        for batch in batches:
            names = batch["file"].tolist()
            found = store.get_file_info([f"{base}/{name}" for name in names]) if names else []
            yield pd.DataFrame({"file": names, "bytes": [x.size for x in found]}, columns=["file", "bytes"])

    return spread(files.select("file")).mapInPandas(run, "file string, bytes long")


def scan(files: DataFrame, folder: str, end_id: int = 49_407, width: int = 2, block_tokens: int = 1 << 21) -> DataFrame:
    """One row per document of ``files`` (file, bytes): file, ordinal, start, n_tokens, terminated.

    start and n_tokens count ids; the separator is not counted.
    """
    size = block_tokens * width
    known = scratch.keep(files.where(F.col("bytes") > 0).select("file", "bytes"), "token-sizes")
    blocks = known.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(bytes - 1) div {size}"))).alias("block"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = scratch.filesystem(folder)
        for batch in batches:
            for file, total, block in zip(batch["file"], batch["bytes"], batch["block"], strict=True):
                if total % width:
                    raise ValueError(f"{file}: {total} bytes are not whole ids of {width} bytes")
                with store.open_input_file(f"{base}/{file}") as source:
                    ids = np.frombuffer(source.read_at(min(size, total - block * size), block * size), f"<u{width}")
                ends = np.flatnonzero(ids == end_id) + block * block_tokens
                yield pd.DataFrame({"file": [file], "tokens_": [total // width], "block": [block], "ends": [ends]})

    # The scan reads each block once; what is left of it is positions.
    found = scratch.keep(spread(blocks).mapInPandas(run, "file string, tokens_ long, block long, ends array<long>"), "token-ends")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    marks = found.select("file", "tokens_", "block", F.size("ends").alias("n_"), F.expr("if(size(ends) > 0, ends[size(ends) - 1], null)").alias("last_"))
    stitched = marks.select(
        "file", "block",
        F.coalesce(F.last("last_", ignorenulls=True).over(earlier), F.lit(-1)).alias("carried_"),
        F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("before_"),
    )
    closed = (
        found.where(F.size("ends") > 0)
        .join(stitched, ["file", "block"])
        .select(
            "file", "before_",
            F.posexplode(
                F.arrays_zip(
                    F.concat(F.array(F.col("carried_")), F.slice("ends", F.lit(1), F.size("ends") - 1)).alias("last"),
                    F.col("ends").alias("end"),
                )
            ).alias("k_", "pair_"),
        )
        .select("file", (F.col("before_") + F.col("k_")).alias("ordinal"), (F.col("pair_.last") + 1).alias("start"), F.col("pair_.end").alias("end_"))
        .select("file", "ordinal", "start", (F.col("end_") - F.col("start")).alias("n_tokens"), F.lit(True).alias("terminated"))
    )
    whole = marks.groupBy("file").agg(F.max("tokens_").alias("tokens_"), F.coalesce(F.max("last_"), F.lit(-1)).alias("last_"), F.sum("n_").alias("n_"))
    open_ = whole.where(F.col("last_") + 1 < F.col("tokens_")).select(
        "file", F.col("n_").alias("ordinal"), (F.col("last_") + 1).alias("start"),
        (F.col("tokens_") - F.col("last_") - 1).alias("n_tokens"), F.lit(False).alias("terminated"),
    )
    return closed.unionByName(open_)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = 49_407, width: int = 2) -> DataFrame:
    """Token counts of documents, by writing their token files and scanning those: id, file, ordinal, start, n_tokens."""
    spark = docs.sparkSession
    folder = scratch.place(spark, "tokens")
    written = write_token_files(docs, folder, id_col, text_col, tokenizer_path, end_id, width)
    files = scratch.keep(written.select(F.col("file_").alias("file")).distinct(), "token-names")
    found = scan(sized(files, folder), folder, end_id, width)
    on = (found["file"] == written["file_"]) & (found["ordinal"] == written["ordinal_"])
    return found.join(written, on).select(F.col("id_").alias(id_col), *[F.col(c).alias(f"token_{c}" if c == id_col else c) for c in ("file", "ordinal", "start", "n_tokens")])
