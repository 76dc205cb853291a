import base64
import gzip
import hashlib
import random

from eventlake.llm import warc

PAGES = "page_id long, url string, html string"


def _pages(n=60):
    rng = random.Random(4)
    base = ["", "<p>é</p>", "x" * 5000, "same", None] + [f"page {i}" * 50 for i in range(20)]
    rows = [(i * 7, f"http://a/{i}\r\nX: y", rng.choice(base)) for i in range(n)]
    return [*rows, (rows[3][0], "again", rows[3][2]), (None, None, "same"), (None, "u", "only here"), (9999, None, "y" * 300_000)]


def _want(rows):
    first = {}
    for id_, _, html in rows:
        if id_ is not None:
            first[html or ""] = min(id_, first.get(html or "", id_))
    out = []
    for id_, _, html in rows:
        data, head = (html or "").encode(), first.get(html or "")
        revisit = head is not None and id_ != head
        out.append((str(id_), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", str(head if revisit else None)))
    return sorted(out)


def _run(spark, rows, folder, parts, **options):
    manifest = warc.write(spark.createDataFrame(rows, PAGES).repartition(parts), folder, **options)
    got = warc.read(manifest, folder).collect()
    return manifest, sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got)


def test_round_trip_and_same_bytes_however_dealt(spark, tmp_path):
    rows, found = _pages(), []
    for parts in (1, 5):
        folder = f"file://{tmp_path}/w{parts}"
        manifest, got = _run(spark, rows if parts == 1 else rows[::-1], folder, parts, shard_bytes=20_000, roll_bytes=700)
        assert got == _want(rows)
        names = sorted(r.file for r in manifest.collect())
        files = {p.name: p.read_bytes() for p in (tmp_path / f"w{parts}").glob("*.warc.gz")}
        assert sorted(files) == names and len(names) > 5
        assert {r.file: r.sha256 for r in manifest.collect()} == {k: hashlib.sha256(v).hexdigest() for k, v in files.items()}
        assert not list((tmp_path / f"w{parts}").glob(".tmp*"))
        found.append(files)
    assert found[0] == found[1]
    data = gzip.decompress(next(iter(found[0].values())))
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and b"\r\nX: y" not in data


def test_shards_are_bounded_whatever_the_ids(spark):
    from pyspark.sql import functions as F

    low, high = -(1 << 63), (1 << 63) - 1
    crowd = spark.range(20_000).select(F.col("id").alias("id_"), F.lit(2000).cast("long").alias("bytes_"))
    few = spark.createDataFrame([(low, 10), (high, 10), (1 << 61, 10), (None, 10)], "id_ long, bytes_ long")
    one = spark.range(20_000).select(F.lit(5).cast("long").alias("id_"), F.lit(2000).cast("long").alias("bytes_"))
    none = spark.range(20_000).select(F.lit(None).cast("long").alias("id_"), F.lit(2000).cast("long").alias("bytes_"))
    for rows in (crowd.unionByName(few), one.unionByName(few), none.unionByName(few)):
        light = rows.withColumn("key_", F.unhex(F.md5(F.monotonically_increasing_id().cast("string")))).select("id_", "key_", "bytes_")
        light = spark.createDataFrame(light.collect(), light.schema)
        cuts = warc._cuts(light, 1 << 20)
        sizes = [r.s for r in light.groupBy(warc._shard(cuts).alias("shard")).agg(F.sum(F.col("bytes_") + warc._HEADERS).alias("s")).collect()]
        assert max(sizes) <= 2 << 20 and len(sizes) == len(cuts) + 1 > 40
        mine = sorted((r.n_, r.i_, r.k_, r.shard) for r in light.select(*warc._place(), warc._shard(cuts).alias("shard")).collect())
        assert [r[3] for r in mine] == [sum(c <= r[:3] for c in cuts) for r in mine]


def test_ids_at_both_ends_and_other_columns(spark, tmp_path):
    rows = [(-(1 << 63), "a", "x"), ((1 << 63) - 1, "b", "x"), (None, "c", "y"), ((1 << 53) + 1, "d", "x" * 50_000_000)]
    more = spark.createDataFrame(rows, PAGES).selectExpr("*", "'k' as key_", "1 as kind_", "2 as bucket_", "3 as shard_", "'p' as payload")
    manifest = warc.write(more, f"file://{tmp_path}/w", shard_bytes=1000)
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.read(manifest, f"file://{tmp_path}/w").drop("payload").collect()}
    assert got == {rows[0][0]: (1, "response", None), rows[1][0]: (1, "revisit", rows[0][0]), None: (1, "response", None), rows[3][0]: (50_000_000, "response", None)}


def test_files_are_read_by_several_tasks(spark, tmp_path):
    manifest = warc.write(spark.createDataFrame([(i, "u", f"page {i}" * 200) for i in range(200)], PAGES), f"file://{tmp_path}/w", shard_bytes=20_000)
    found = warc.read(manifest, f"file://{tmp_path}/w")
    assert manifest.count() > 10 and found.rdd.getNumPartitions() > 3


def test_only_large_payloads_revisit(spark, tmp_path):
    rows = [(1, "a", "xx"), (2, "b", "xx"), (3, "c", "long enough"), (4, "d", "long enough")]
    got = _run(spark, rows, f"file://{tmp_path}/w", 2, revisit_from=5)[1]
    assert [r[3] for r in got] == ["response", "response", "response", "revisit"]


def test_nothing(spark, tmp_path):
    assert _run(spark, [], f"file://{tmp_path}/w", 1)[1] == []


def test_damage_is_found(spark, tmp_path):
    import pytest

    manifest, _ = _run(spark, [(1, "a", "hello")], f"file://{tmp_path}/w", 1)
    file = tmp_path / "w" / manifest.first().file
    records = gzip.decompress(file.read_bytes()).replace(b"hello", b"jello")
    file.write_bytes(b"".join(gzip.compress(b"WARC/1.1" + r) for r in records.split(b"WARC/1.1")[1:]))
    with pytest.raises(Exception, match="does not match"):
        warc.read(manifest, f"file://{tmp_path}/w").collect()
