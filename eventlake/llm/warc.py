"""WARC archives: a deterministic sharded writer and its reader.

Writing.  Records are dealt to shards by ranges of page id and payload digest that hold about
``shard_bytes`` each, cut at exact prefix sums, so the same table gives the same shards on any
cluster.  There are at most ``MOST_SHARDS`` of them (and one); beyond, shards get larger, which bounds
the table of cuts.  Each shard is sorted and written by one task, a gzip member per record; a file is closed
when it has ``roll_bytes`` compressed bytes.  Headers, record ids, lengths and digests are made
anew from the content.  A file is written under a temporary name, moved to its final name, and
counts only once the manifest (a table committed after all files) names it, with its own digest.
Equal input gives equal files, byte by byte, so a task that runs again does no harm.

Revisits.  Of records with equal payloads of at least ``revisit_from`` bytes the one with the
smallest page id is a response, the others are revisits that refer to it.  Payloads are compared by
SHA-256 and length.  What decides travels as a small row beside the page into the sorted shard, so
pages are shuffled once.

Defined results: a null payload is empty.  A null page id comes last and refers to the smallest
id, if there is one.  Rows that repeat the smallest id are responses too, and rows that repeat id
and payload share a shard, whatever its size; it is streamed and its files are rolled all the same.
Line ends and other control characters in a URL are percent-encoded; a null URL becomes
urn:page:<id>.  An empty table makes an empty manifest.  Other columns than id, URL and HTML are
not read.  Ids may be any long.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.llm.spread import spread
from eventlake.plans import scratch

MOST_SHARDS = 1 << 17
_HEADERS = 512  # what a record has beside its payload, about
_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:eventlake:warc")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "file string, shard long, records long, bytes long, sha256 string"


def payload_digest(payload: bytes) -> str:
    """Base-32 SHA-1, upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}:{digest}')}>"


def _uri(url: str | None, page_id: int | None) -> str:
    if not url:
        return f"urn:page:{page_id}"
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url)


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    digest = payload_digest(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = block if revisit else block + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id, digest)), ("WARC-Date", date),
        ("WARC-Target-URI", _uri(url, page_id)), ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"),
        ("X-Page-ID", "" if page_id is None else str(page_id)), ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    return _record(headers, block)


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _cuts(light: DataFrame, shard_bytes: int) -> list[tuple[int, int, str]]:
    """The place (1 for a null id, id, digest in hexadecimal) of the first record of each shard but the first.

    Records are set in order, each begins where the sizes before it end, and those that begin in the
    same ``shard_bytes`` are a shard.  So a shard exceeds that by less than its last record, whatever
    the ids are.  The sizes are summed within tasks, then over the tasks.
    """
    sizes = light.groupBy("id_", "key_").agg(F.sum(F.col("bytes_") + _HEADERS).cast("long").alias("size_"))  # repeats are merged first
    sizes = scratch.keep(sizes.select(*_place(), "size_"), "warc-sizes")
    each = max(shard_bytes, -(-(sizes.agg(F.sum("size_")).first()[0] or 0) // MOST_SHARDS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            ends = batch["size_"].cumsum() + at
            at = int(ends.iloc[-1]) if len(ends) else at
            yield batch.assign(part_=part, start_=ends - batch["size_"], end_=ends).drop(columns="size_")

    ordered = sizes.repartitionByRange("n_", "i_", "k_").sortWithinPartitions("n_", "i_", "k_")
    begun = scratch.keep(ordered.mapInPandas(run, "n_ int, i_ long, k_ string, part_ int, start_ long, end_ long"), "warc-order")
    shifts, at = [], 0
    for part, end in sorted((r["part_"], r["e_"]) for r in begun.groupBy("part_").agg(F.max("end_").alias("e_")).collect()):  # a row per task
        shifts.append((part, at))
        at += end
    table = light.sparkSession.createDataFrame(shifts, "part_ int, shift_ long")
    numbered = begun.join(F.broadcast(table), "part_").withColumn("shard_", F.expr(f"(start_ + shift_) div {each}"))
    firsts = numbered.groupBy("shard_").agg(F.min(F.struct("n_", "i_", "k_")).alias("f_")).collect()  # at most MOST_SHARDS rows and one
    return sorted(tuple(r["f_"]) for r in firsts)[1:]


def _place() -> list[Column]:
    return [F.col("id_").isNull().cast("int").alias("n_"), F.coalesce("id_", F.lit(0).cast("long")).alias("i_"), F.hex("key_").alias("k_")]


def _shard(cuts: list[tuple[int, int, str]]) -> Column:
    """How many of the ``cuts`` are at or before the row's place, by binary search."""
    if not cuts:
        return F.lit(0)
    table = F.from_json(F.lit(json.dumps([{"n_": n, "i_": i, "k_": k} for n, i, k in cuts])), "array<struct<n_:int,i_:bigint,k_:string>>")
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))])
    most, here = F.lit(len(cuts)), F.struct(*_place())
    # The table is a constant, so the optimizer parses it once.
    after = lambda at, step: (at + step <= most) & (F.element_at(table, F.least(at + step, most)) <= here)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(after(at, step), at + step).otherwise(at))


def write(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    shard_bytes: int = 16 << 20, roll_bytes: int = 8 << 20, revisit_from: int = 0, date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Write one record per row below ``folder``; returns the manifest (file, shard, records, bytes, sha256)."""
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    base = pages.select(F.col(id_col).cast("long").alias("id_"), F.col(url_col).alias("url_"), payload.alias("payload_"))
    keyed = base.withColumn("key_", F.unhex(F.sha2("payload_", 256))).withColumn("bytes_", F.length("payload_").cast("long"))
    light = scratch.keep(keyed.select("id_", "key_", "bytes_"), "warc-rows")

    firsts = light.where(F.col("bytes_") >= revisit_from).groupBy("key_", "bytes_").agg(F.min("id_").alias("first_"), F.count(F.lit(1)).alias("n_"))
    copied = firsts.where((F.col("n_") > 1) & F.col("first_").isNotNull()).select("key_", "bytes_", "first_")
    revisits = light.join(copied, ["key_", "bytes_"]).where(~F.col("id_").eqNullSafe(F.col("first_"))).select("id_", "key_", "first_").distinct()

    cuts = _cuts(light, shard_bytes)
    told = revisits.select("id_", "key_", F.lit(0).alias("kind_"), F.lit(None).cast("string").alias("url_"), F.lit(None).cast("binary").alias("payload_"), "first_")
    full = keyed.select("id_", "key_", F.lit(1).alias("kind_"), "url_", "payload_", F.lit(None).cast("long").alias("first_"))
    rows = told.unionByName(full).withColumn("shard_", _shard(cuts))
    # A shard is a partition: by its number, not by a hash of it, so that no task gets several.
    dealt = rows.repartitionById(len(cuts) + 1, F.col("shard_")).sortWithinPartitions(
        "shard_", F.col("id_").asc_nulls_last(), "key_", "kind_", F.col("url_").asc_nulls_first()
    )
    dealt = dealt.withColumns({c: F.col(c).cast("string") for c in ("id_", "first_")})  # pandas has no long that may be null

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        store, base_path = scratch.filesystem(folder)
        sink = shard = told_of = None
        part, done, digest, size, records = 0, [], None, 0, 0

        def open_() -> None:
            nonlocal sink, digest, size, records
            name = f"shard-{shard:06d}-{part:04d}.warc.gz"
            sink, digest, size, records = store.open_output_stream(f"{base_path}/.tmp-{attempt}-{name}", compression=None), hashlib.sha256(), 0, 0
            info = f"software: eventlake\r\nformat: WARC File Format 1.1\r\nfile: {name}\r\n".encode()
            headers = [
                ("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMES, name)}>"), ("WARC-Date", date),
                ("WARC-Filename", name), ("Content-Type", "application/warc-fields"),
            ]
            put(_member(_record(headers, info)))

        def put(data: bytes) -> None:
            nonlocal size
            sink.write(data)
            digest.update(data)
            size += len(data)

        def close() -> None:
            nonlocal sink, part
            name = f"shard-{shard:06d}-{part:04d}.warc.gz"
            sink.close()
            store.move(f"{base_path}/.tmp-{attempt}-{name}", f"{base_path}/{name}")
            done.append((name, shard, records, size, digest.hexdigest()))
            sink, part = None, part + 1

        for batch in batches:
            for id_, key, kind, url, payload_, first, of in zip(
                batch["id_"], batch["key_"], batch["kind_"], batch["url_"], batch["payload_"], batch["first_"], batch["shard_"], strict=True
            ):
                id_ = None if id_ is None else int(id_)
                if of != shard:
                    if sink is not None:
                        close()
                    shard, part = of, 0
                if kind == 0:
                    told_of = (id_, bytes(key), int(first))
                    continue
                if sink is None:
                    open_()
                revisit = told_of is not None and told_of[:2] == (id_, bytes(key))
                put(_member(_page_record(id_, url, bytes(payload_), told_of[2] if revisit else None, revisit, date)))
                records += 1
                if size >= roll_bytes:
                    close()
            yield pd.DataFrame(done, columns=["file", "shard", "records", "bytes", "sha256"])
            done.clear()
        if sink is not None:
            close()
            yield pd.DataFrame(done, columns=["file", "shard", "records", "bytes", "sha256"])

    store, base_path = scratch.filesystem(folder)
    store.create_dir(base_path, recursive=True)
    with scratch.batches_of(spark, 2000):
        dealt.mapInPandas(run, _MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def _members(source) -> Iterator[bytes]:
    """The gzip members of a stream, each whole; a record is in memory at a time."""
    unpacker, out, rest = zlib.decompressobj(31), [], b""
    while chunk := rest or source.read(1 << 20):
        rest = b""
        out.append(unpacker.decompress(chunk))
        if unpacker.eof:
            yield b"".join(out)
            rest, out, unpacker = unpacker.unused_data, [], zlib.decompressobj(31)
    if out and any(out):
        raise ValueError("truncated archive")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per response or revisit: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload.

    The payload of a revisit is null; its length and digest are those its headers state.  Digests
    of responses are computed from the payload and must equal the headers.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base_path = scratch.filesystem(folder)
        for batch in batches:
            for file in batch["file"]:
                out, held = [], 0
                with store.open_input_stream(f"{base_path}/{file}", compression=None) as source:
                    for data in _members(source):
                        headers, block = parse_record(data)
                        kind = headers["WARC-Type"]
                        if kind not in ("response", "revisit"):
                            continue
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        size, payload = int(headers["X-Payload-Length"]), None
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if payload_digest(payload) != digest or len(payload) != size:
                                raise ValueError(f"{file}: a payload does not match its headers")
                        page, refers = headers["X-Page-ID"], headers.get("X-Refers-To-Page-ID")
                        out.append((page or None, size, digest, kind, refers, headers["WARC-Target-URI"], payload))
                        held += size
                        if held > 1 << 24:
                            yield frame(out)
                            out, held = [], 0
                yield frame(out)

    def frame(out: list[tuple]) -> pd.DataFrame:
        columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
        return pd.DataFrame(out, columns=columns)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    found = spread(manifest.select("file")).mapInPandas(run, schema.replace("page_id long", "page_id string").replace("refers_to long", "refers_to string"))
    return found.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})
