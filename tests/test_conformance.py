"""What every log must do: unique keys, ordered ids, ranges, sections, tracking, at once or not at all."""

import threading

import pytest
from pyspark.sql import functions as F

from eventlake.operators import reads, versions
from eventlake.schema import EVENT, IntegrityError
from eventlake.sources.log import EventLog

A, B = "0a" * 16, "0b" * 16


def events(spark, *rows):
    return spark.createDataFrame([(i, v, t, s.encode()) for i, v, t, s in rows], EVENT)


@pytest.fixture
def log(spark, tmp_path):
    return EventLog(spark, str(tmp_path / "log")).create()


def versions_of(frame):
    return [r.originator_version for r in frame.collect()]


def test_select_events_ranges(spark, log):
    assert log.select_events(A).count() == 0 and log.max_notification_id() == 0
    log.append(events(spark, (A, 1, "t1", "a"), (A, 2, "t2", "b"), (A, 3, "t3", "c"), (B, 1, "t1", "d")))
    assert versions_of(log.select_events(A)) == [1, 2, 3]
    assert versions_of(log.select_events(A, desc=True, limit=1)) == [3]
    assert versions_of(log.select_events(A, lte=2, desc=True, limit=1)) == [2]
    assert versions_of(log.select_events(A, gt=1, lte=2)) == [2]
    assert versions_of(log.select_events(A, limit=0)) == []
    assert bytes(log.select_events(A, gt=2).first().state) == b"c"


def test_conflicts_write_nothing(spark, log):
    first = events(spark, (A, 1, "t", "a"))
    log.append(first)
    for batch in (events(spark, (A, 1, "t", "a"), (A, 2, "t", "b")), events(spark, (A, 2, "t", "b"), (A, 2, "t", "c"))):
        with pytest.raises(IntegrityError):
            log.append(batch)
        assert log.notifications().count() == 1
    assert log.append(events(spark)).count() == 0


def test_ids_follow_input_order(spark, log):
    rows = [(A, v, "t", str(v)) for v in range(1, 41)]
    got = log.append(events(spark, *rows).repartition(4, "originator_version"), order="originator_version").orderBy("notification_id").collect()
    assert [(r.notification_id, r.originator_version) for r in got] == [(v, v) for v in range(1, 41)]
    assert [r.notification_id for r in log.append(events(spark, (B, 0, "t", ""))).collect()] == [41]


def test_select_notifications(spark, log):
    log.append(events(spark, (A, 1, "topic1", "a"), (A, 2, "topic2", "b")))
    log.append(events(spark, (B, 1, "topic3", "c")))
    ids = lambda *a, **k: [r.notification_id for r in log.select_notifications(*a, **k).collect()]
    assert ids(1, 10) == [1, 2, 3] and ids(2, 10) == [2, 3] and ids(4, 10) == [] and ids(1, 1) == [1] and ids(1, 0) == []
    assert ids(1, 10, stop=2) == [1, 2] and ids(2, 10, stop=2) == [2] and ids(3, 10, stop=2) == []
    assert ids(1, 10, topics=["topic2", "topic3"]) == [2, 3] and ids(1, 1, topics=["topic3"]) == [3] and ids(1, 3, topics=["none"]) == []


@pytest.mark.parametrize(
    ("n", "size", "asked", "id_", "following", "count"),
    [
        (5, 5, "1,10", "1,5", "6,10", 5), (5, 5, "6,10", None, None, 0), (9, 5, "6,10", "6,9", None, 4), (9, 5, "3,7", "3,7", "8,12", 5),
        (9, 5, "3,10", "3,7", "8,12", 5), (9, 5, "3,4", "3,4", "5,6", 2), (9, 5, "3,2", None, None, 0), (9, 5, "-3,2", "1,2", "3,4", 2),
    ],
)
def test_sections(spark, n, size, asked, id_, following, count):
    log = spark.range(1, n + 1).select(F.col("id").alias("notification_id"), F.lit("t").alias("topic"))
    got = reads.section(log, asked, size)
    assert (got["id"], got["next_id"], len(got["items"])) == (id_, following, count)


def test_reader_and_limits(spark):
    log = spark.range(1, 10).select(F.col("id").alias("notification_id"), F.lit("t").alias("topic"))
    assert [reads.read_log(log, s).count() for s in (1, 2, 3, 4, 8, 9, 10)] == [9, 8, 7, 6, 2, 1, 0]
    with pytest.raises(ValueError):
        reads.check_limit(20, 10)


def test_tracking(spark, log):
    assert log.max_tracking_id("up") == 0 and not log.has_tracking_id("up", 1)
    log.append(events(spark, (A, 1, "t", "")), tracking=("up", 1))
    with pytest.raises(IntegrityError):
        log.append(events(spark, (A, 2, "t", "")), tracking=("up", 1))
    assert log.notifications().count() == 1
    log.append(None, tracking=("up", 5))
    log.append(events(spark), tracking=("up", 3))
    log.append(events(spark, (A, 2, "t", "")), tracking=("other", 1))
    assert log.max_tracking_id("up") == 5 and log.has_tracking_id("up", 3) and not log.has_tracking_id("up", 4)
    assert {(r.application_name, r.max_tracking_id) for r in reads.max_tracking_ids(log.tracking()).collect()} == {("up", 5), ("other", 1)}
    with pytest.raises(IntegrityError):  # the events conflict: the tracking record is not written either
        log.append(events(spark, (A, 2, "t", "")), tracking=("up", 9))
    assert log.max_tracking_id("up") == 5


def test_batches_are_committed_once(spark, log):
    assert log.append(events(spark, (A, 1, "t", "")), batch=("q", 0)) is not None
    assert log.append(events(spark, (A, 1, "t", "")), batch=("q", 0)) is None
    assert log.notifications().count() == 1


def test_writers_do_not_interleave(spark, log):
    def write(name):
        for k in range(3):
            log_ = EventLog(spark, log.path)
            log_.append(events(spark, *[(name, k * 10 + v, "t", "") for v in range(10)]))

    threads = [threading.Thread(target=write, args=(x * 32,)) for x in "cde"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    rows = log.notifications().orderBy("notification_id").collect()
    assert [r.notification_id for r in rows] == list(range(1, 91))
    for at in range(0, 90, 10):
        part = rows[at : at + 10]
        assert len({r.originator_id for r in part}) == 1 and [r.originator_version for r in part] == list(range(part[0].originator_version, part[0].originator_version + 10))


def test_a_key_is_taken_once_by_racing_writers(spark, log):
    outcome = []

    def write():
        try:
            EventLog(spark, log.path).append(events(spark, (A, 1, "t", "")))
            outcome.append("ok")
        except IntegrityError:
            outcome.append("conflict")

    threads = [threading.Thread(target=write) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(outcome) == ["conflict"] * 3 + ["ok"] and log.notifications().count() == 1


def test_versions_go_on(spark, log):
    log.append(events(spark, (A, 1, "t", ""), (A, 2, "t", "")))
    new = spark.createDataFrame([(A, 10), (B, 7), (A, 3_000_000), (B, 9)], "originator_id string, at long")
    got = {(r.originator_id, r.at): r.originator_version for r in log.next_versions(new, "at").collect()}
    assert got == {(A, 10): 3, (A, 3_000_000): 4, (B, 7): 1, (B, 9): 2}
    assert [r.expected_version for r in versions.gaps(spark.createDataFrame([(A, 1), (A, 3)], "originator_id string, originator_version long")).collect()] == [2]


def test_data_source(spark, log):
    from eventlake.sources.log_source import register

    log.append(events(spark, (A, 1, "t1", "a"), (A, 2, "t2", "b")))
    log.append(events(spark, (B, 1, "t1", "c")))
    read = register(spark).read.format("eventlake").option("path", log.path)
    assert {r.notification_id for r in read.load().collect()} == {1, 2, 3}
    assert {r.notification_id for r in read.option("topics", "t1").option("start", 2).load().collect()} == {3}


def test_an_append_reads_only_commits_that_may_conflict(spark, tmp_path):
    from eventlake.sources import marks
    from eventlake.sources.log import EventLog

    log = EventLog(spark, str(tmp_path / "log")).create()
    make = lambda *keys: spark.createDataFrame([(i, v, "t", b"") for i, v in keys], "originator_id string, originator_version long, topic string, state binary")
    for name in "abc":
        log.append(make((name, 1), (name, 2)), order="originator_version")
    read, rows = [], log._rows
    log._rows = lambda entries: (read.append(len(entries)), rows(entries))[1]
    log.append(make(("d", 1)))
    assert read == [1]  # what it returns
    with pytest.raises(IntegrityError):
        log.append(make(("b", 2), ("e", 1)))
    assert read == [1, 1]
    many = spark.range(marks.MOST + 50).selectExpr("cast(id as string) as originator_id")
    assert marks.of(many) is None and marks.intersects(None, "x")
    assert not marks.intersects(marks.of(make(("a", 1))), marks.of(make(("b", 1)))) and marks.intersects(marks.of(make(("a", 1))), marks.of(make(("a", 7), ("b", 1))))


def test_a_projection_writes_only_touched_buckets(spark, tmp_path):
    from eventlake.streaming.folds import Projection

    table = Projection(str(tmp_path / "t"), "k string, v long, x string", "k", "v", buckets=8)
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v long, x string")
    assert table.table(spark).count() == 0
    table.upsert(rows(*[(f"k{i}", 1, "old") for i in range(50)]), 0)
    before = table._folders()
    table.upsert(rows(("k7", 2, "new"), ("k7", 1, "late")), 1)
    after = table._folders()
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    table.upsert(rows(("k7", 2, "new")), 1)  # the batch runs again
    got = {r.k: (r.v, r.x) for r in table.table(spark).collect()}
    assert len(got) == 50 and got["k7"] == (2, "new") and got["k8"] == (1, "old")
    table.upsert(rows(), 2)
    table.upsert(rows(("k7", 3, "newer")), 3)
    table.upsert(rows(("k7", 4, "newest")), 4)
    assert table.table(spark).where("k = 'k7'").first().x == "newest" and table.table(spark).count() == 50
    assert len(list((tmp_path / "t" / "data").glob("*/bucket_=*"))) <= 8 + 1


def test_retry_bare_and_its_arguments():
    from eventlake.functions.config import retry

    calls = []

    @retry
    def once():
        calls.append(1)
        raise ValueError

    with pytest.raises(ValueError):
        once()
    assert len(calls) == 1
    for wrong in ({"on": 5}, {"on": (ValueError, "x")}, {"attempts": "2"}, {"attempts": True}, {"wait": "1"}):
        with pytest.raises(TypeError):
            retry(**wrong)


def test_topics_that_resolve_to_nothing():
    from eventlake.functions.topics import TopicRegistry
    from eventlake.schema import TopicError

    registry = TopicRegistry({"old:A": "new:B"})
    assert registry.require("old:A", {"new:B"}) == "new:B"
    with pytest.raises(TopicError, match="new:B"):
        registry.require("old:A", {"new:C"})
