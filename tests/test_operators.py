"""Folds, history, snapshots, codec, topics and settings."""

import base64
import random
from datetime import datetime, timedelta, timezone
from decimal import Decimal
from uuid import UUID, uuid5, NAMESPACE_URL

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventlake.application import Application, EventSourcedLog
from eventlake.functions import codec, ids, topics
from eventlake.functions.config import Settings, retry, strtobool
from eventlake.functions.patch import apply_patch, create_diff
from eventlake.operators import folds, history, search, snapshots
from eventlake.schema import AggregateNotFoundError, ProgrammingError, TopicError
from eventlake.sources.log import EventLog

T0 = datetime(2024, 1, 1)
SCHEMA = "originator_id string, originator_version long, topic string, timestamp timestamp_ntz, amount decimal(12,2)"


def balance():
    return F.sum(F.col("amount").cast("decimal(28,2)"))


def account(spark, *amounts, id_="a"):
    rows = [(id_, v, "Opened" if v == 1 else "Appended", T0 + timedelta(hours=v), Decimal(x)) for v, x in enumerate(amounts, 1)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def spec():
    return folds.AggregateSpec("Account", {"balance": balance(), "last": folds.last_value(F.col("amount"))})


def test_folds_check_ids_versions_and_beginnings(spark):
    from eventlake.schema import OriginatorIDError, OriginatorVersionError

    row = lambda v, topic="b", id_="x": (id_, v, topic, T0, None)
    make = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    count = {"n": F.count(F.lit(1))}
    plain = folds.AggregateSpec("A", count)
    assert folds.project(make(row(1, "a"), row(2), row(3)), plain).first().version == 3
    for broken in ([1, 3], [2, 3], [1, 2, 2], [1, 1, 4, 4], [1, 2, 2, 4], [0, 1]):
        rows = make(*[row(v) for v in broken])
        with pytest.raises(Exception, match="OriginatorVersionError"):
            folds.project(rows, plain).collect()
        assert folds.project(rows, plain, checked=False).first().n == len(broken)
        with pytest.raises(Exception, match="OriginatorVersionError"):
            folds.fold_python(rows, lambda: 0, lambda s, e: s + 1, lambda s: {"n": s}, "n long", []).collect()
    later = folds.AggregateSpec("A", count, initial_version=5)
    assert folds.project(make(row(5), row(6)), later).first().version == 6
    with pytest.raises(Exception, match="OriginatorVersionError"):
        folds.project(make(row(1), row(2)), later).collect()
    begun = folds.AggregateSpec("A", count, created=("a",))
    assert folds.project(make(row(1, "a"), row(2)), begun).first().version == 2
    with pytest.raises(Exception, match="begins with b"):
        folds.project(make(row(1), row(2, "a")), begun).collect()
    ended = folds.AggregateSpec("A", count, discarded=("z",))
    assert folds.project(make(row(1), row(2, "z"), row(3), row(4)), ended).first().version == 4
    assert folds.continues(make(row(4), row(5)), "x", 3) == 5 and folds.continues(make(), "x", 3) == 3
    with pytest.raises(OriginatorIDError):
        folds.continues(make(row(4), row(5, id_="y")), "x", 3)
    for wrong in (make(row(5)), make(row(4), row(6)), make(row(4), row(4))):
        with pytest.raises(OriginatorVersionError):
            folds.continues(wrong, "x", 3)


def test_repository_starts_from_snapshots(spark, tmp_path):
    from eventlake.application import Application
    from eventlake.operators import snapshots

    total = snapshots.Continued(F.sum("amount"), "sum")
    spec = folds.AggregateSpec("A", {"total": F.sum("amount")}, discarded=("z",), continued={"total": total}, types={"total": "decimal(38,2)"})
    app = Application(spark, f"file://{tmp_path}", {"IS_SNAPSHOTTING_ENABLED": "y"})
    seen = spark.sparkContext.accumulator(0)

    def decode(rows):
        def count(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        rows = rows.mapInArrow(count, rows.schema)
        amount = F.get_json_object(F.col("state"), "$.amount").cast("decimal(12,2)").alias("amount")
        return rows.select("originator_id", "originator_version", "topic", F.lit(T0).cast("timestamp_ntz").alias("timestamp"), amount)

    def save(*events):
        rows = [(i, v, t, '{"amount": "%s"}' % a) for i, v, t, a in events]
        app.save(spark.createDataFrame(rows, "originator_id string, originator_version long, topic string, state string"), order="originator_version")

    users = app.repository(spec, decode)
    save(*[("x", v, "b", v) for v in range(1, 11)], ("y", 1, "b", 5), ("w", 1, "b", 1))
    app.take_snapshots(users, spec)
    save(("x", 11, "b", 100), ("y", 2, "z", 0), ("y", 3, "b", 7), ("v", 1, "b", 2))
    seen.value = 0
    got = {r.originator_id: (r.version, int(r.total)) for r in users.get().collect()}
    assert got == {"x": (11, 155), "y": (3, 7), "w": (1, 1), "v": (1, 2)} and seen.value <= 3 * 4  # the four later events: for the states, and twice for what ends them
    assert users.get_one("x", 10).total == 55 and users.get_one("x", 4).total == 10
    assert users.get(["w"]).first().version == 1
    save(("x", 13, "b", 1))
    with pytest.raises(Exception, match="OriginatorVersionError"):
        users.get().collect()


def test_time_travel(spark):
    rows = account(spark, "0.00", "10.00", "25.00", "30.00")
    for version, balance in ((1, "0.00"), (2, "10.00"), (3, "35.00"), (4, "65.00")):
        assert history.state_at_version(rows, spec(), version).first().balance == Decimal(balance)
    at = lambda h: history.state_at(rows, spec(), F.lit(T0 + timedelta(hours=h, minutes=30)).cast("timestamp_ntz")).collect()
    assert at(0) == [] and at(2)[0].balance == Decimal("10.00") and at(9)[0].balance == Decimal("65.00")
    assert history.version_at(rows, F.lit(T0).cast("timestamp_ntz")).first().version == 0
    state = folds.project(rows, spec()).first()
    assert (state.version, state.created_on, state.modified_on, state.last) == (4, T0 + timedelta(hours=1), T0 + timedelta(hours=4), Decimal("30.00"))


def test_ordered_folds_agree_and_check_versions(spark):
    rows = account(spark, "1", "2", "3", "4").unionByName(account(spark, "5", id_="b"))
    zero = F.lit(0).cast("decimal(38,2)")
    step = lambda s, e: (s * 2 + e["amount"]).cast("decimal(38,2)")
    by_expression = {r.originator_id: r.state for r in folds.fold(rows, zero, step, ["amount"]).collect()}
    by_python = {r.originator_id: r.x for r in folds.fold_python(rows, lambda: Decimal(0), lambda s, e: s * 2 + e["amount"], lambda s: {"x": s}, "x decimal(38,2)", ["amount"]).collect()}
    assert by_expression == by_python == {"a": Decimal(26), "b": Decimal(5)}
    with pytest.raises(Exception, match="OriginatorVersionError"):
        folds.fold(rows.where("originator_version <> 2"), zero, step, ["amount"]).collect()
    seeds = spark.createDataFrame([("a", 2, Decimal(4))], "originator_id string, seed_version long, seed decimal(38,2)")
    seeded = folds.fold(rows.where("originator_id = 'b' or originator_version > 2"), zero, step, ["amount"], seeds=seeds)
    assert {r.originator_id: r.state for r in seeded.collect()} == by_expression


def test_discarding(spark):
    rows = spark.createDataFrame(
        [("a", 1, "Created"), ("a", 2, "Discarded"), ("b", 1, "Created"), ("b", 2, "Discarded"), ("b", 3, "Created"), ("c", 1, "Created")],
        "originator_id string, originator_version long, topic string",
    ).selectExpr("*", "timestamp_ntz'2024-01-01' as timestamp")
    one = folds.AggregateSpec("X", {"n": folds.counter()}, discarded=("Discarded",))
    assert {r.originator_id: (r.version, r.n) for r in folds.project(rows, one).collect()} == {"b": (3, 1), "c": (1, 1)}
    assert [r.originator_id for r in folds.discarded(rows, ("Discarded",)).collect()] == ["a"]
    gone = folds.fold_python(rows, lambda: 0, lambda s, e: None if e["topic"] == "Discarded" else s + 1, lambda s: {"n": s}, "n long", ["topic"])
    assert {r.originator_id: r.n for r in gone.collect()} == {"b": 1, "c": 1}


def test_specs_are_checked():
    with pytest.raises(ProgrammingError):
        folds.AggregateSpec("X", {"version": "v"})
    with pytest.raises(ProgrammingError):
        folds.AggregateSpec("X", {}, (folds.EventType("A"), folds.EventType("A")))
    with pytest.raises(ProgrammingError):
        folds.AggregateSpec("X", {}, (folds.EventType("A"),), discarded=("B",))


def test_guards_and_intervals(spark):
    rows = account(spark, "10", "-5", "-60", "100")
    assert [r.originator_version for r in folds.violations(rows, F.col("amount"), F.lit(50)).collect()] == [3]
    day = datetime(2024, 1, 1)
    points = spark.createDataFrame([("v", day + timedelta(hours=h)) for h in (1, 30, 80)] + [("w", day + timedelta(hours=30))], "k string, at timestamp_ntz")
    spans = spark.createDataFrame([("v", day, day + timedelta(hours=40)), ("v", day + timedelta(hours=80), day + timedelta(hours=90))], "k string, s timestamp_ntz, f timestamp_ntz")
    assert {(r.k, r.at.hour, r.at.day) for r in folds.uncovered(points, spans, "k", "at", "s", "f").collect()} == {("v", 8, 4), ("w", 6, 2)}


def continued():
    big = folds.flag(F.col("amount") > 90)
    return {"balance": snapshots.Continued(balance(), "sum"), "last": snapshots.Continued(folds.last_value(F.col("amount")), "last"), "big": snapshots.Continued(big, "any")}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 9), min_size=1, max_size=6), st.integers(1, 4), st.integers(0, 9))
def test_replay_from_snapshots_equals_replay(spark, lengths, interval, split):
    rng = random.Random(sum(lengths))
    rows = [(str(i), v, "t", T0, Decimal(rng.randint(0, 9999)) / 100) for i, n in enumerate(lengths) for v in range(1, n + 1)]
    events = spark.createDataFrame(rows, SCHEMA)
    fields = continued()
    over = {n: c.over for n, c in fields.items()}
    key = lambda frame: sorted(tuple(r) for r in frame.select("originator_id", "version", *fields).collect())
    fold = lambda e: e.groupBy("originator_id").agg(F.max("originator_version").alias("version"), *[c.alias(n) for n, c in over.items()])
    want = key(fold(events))
    assert key(snapshots.replay(events, snapshots.every(events, over, interval), fields)) == want
    assert key(snapshots.fast_forward(fold(events.where(F.col("originator_version") <= split)), events, fields)) == want


def test_automatic_snapshot_versions(spark):
    rows = account(spark, *["1"] * 13)
    assert sorted(r.originator_version for r in snapshots.every(rows, {"balance": balance()}, 5).collect()) == [5, 10]


def test_application(spark, tmp_path):
    env = {"CIPHER_KEY": codec.new_key(16), "COMPRESSOR_TOPIC": "zlib"}
    app = Application(spark, str(tmp_path), env, {"Account": 2})
    decode = lambda rows: rows.select("originator_id", "originator_version", "topic", F.lit(T0).cast("timestamp_ntz").alias("timestamp"), F.get_json_object("state", "$.amount").cast("decimal(12,2)").alias("amount"))
    new = account(spark, "1", "2", "3").select("originator_id", "originator_version", "topic", F.to_json(F.struct("amount")).alias("state"))
    saved = app.save(new, order="originator_version")
    assert saved.count() == 3 and b"amount" not in bytes(saved.first().state)
    repository = app.repository(spec(), decode)
    assert repository.get_one("a").balance == Decimal(6) and repository.get_one("a", 2).balance == Decimal(3)
    assert "a" in repository and "b" not in repository
    with pytest.raises(AggregateNotFoundError):
        repository.get_one("b")
    app.take_automatic_snapshots(repository, spec(), saved)
    assert [r.originator_version for r in app.snapshots.notifications().collect()] == [2]
    assert app.notification_log("1,10")["id"] == "1,3"
    fields = {"balance": continued()["balance"], "last": continued()["last"]}
    types = {"balance": "decimal(38,2)", "last": "decimal(12,2)"}
    for version in (None, 2, 1):
        want = repository.get(version=version).select("originator_id", "version", "balance", "last")
        assert repository.replay(fields, types, version).collect() == want.collect()
    with pytest.raises(ProgrammingError):
        plain = Application(spark, str(tmp_path / "p"))
        plain.take_snapshots(plain.repository(spec(), decode), spec())


def test_transcoder():
    t = codec.Transcoder()
    value = {"a": [UUID(int=1), Decimal("1.10"), {"b": datetime(2024, 1, 1, tzinfo=timezone.utc)}], "_type_": 1, "é": None}
    assert t.decode(t.encode(value)) == value
    assert t.encode({"x": Decimal("1.10")}) == b'{"x":{"_type_":"decimal_str","_data_":"1.10"}}'
    assert t.decode(b'{"_type_":"decimal_str"}') == {"_type_": "decimal_str"}
    assert t.decode(b'{"_type_":"x","_data_":1,"y":2}') == {"_type_": "x", "_data_": 1, "y": 2}
    with pytest.raises(TypeError):
        t.decode(b'{"_type_":"unknown","_data_":1}')
    with pytest.raises(TypeError):
        t.encode({"x": object()})
    t.register(complex, "complex", str, complex)
    assert t.decode(t.encode([1j])) == [1j]


def test_encryption_layout_and_damage(spark):
    key = codec.new_key()
    rows = spark.createDataFrame([(b"some state",), (b"",)], "s binary").select("s", codec.encrypt(F.col("s"), key).alias("e"))
    for r in rows.collect():
        assert len(r.e) == len(r.s) + 28
    kept = spark.createDataFrame(rows.collect(), "s binary, e binary")
    assert all(bytes(r.s) == bytes(r.d) for r in kept.select("s", codec.decrypt(F.col("e"), key).alias("d")).collect())
    nonce_tag_text = bytes(kept.first().e)
    from pyspark.sql.functions import aes_decrypt, lit

    spark_order = nonce_tag_text[:12] + nonce_tag_text[28:] + nonce_tag_text[12:28]
    assert bytes(spark.range(1).select(aes_decrypt(lit(spark_order), lit(base64.b64decode(key)), lit("GCM")).alias("d")).first().d) == b"some state"
    with pytest.raises(Exception):
        kept.select(codec.decrypt(F.concat(F.col("e"), F.lit(b"x")), key)).collect()
    with pytest.raises(ValueError):
        codec.new_key(20)


def test_ids(spark):
    names = ["welcome", "é", ""]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", ids.slug_id(F.col("n")).alias("i")).collect()
    assert {r.n: r.i for r in got} == {n: uuid5(NAMESPACE_URL, f"/slugs/{n}").hex for n in names}


def test_topics():
    r = topics.TopicRegistry({"old.module": "new.module", "new.module:Outer": "new.module:Renamed"})
    assert r.resolve("old.module:Outer.Inner") == "new.module:Renamed.Inner" and r.resolve("other:X") == "other:X"
    r.register("old.module", "new.module")
    with pytest.raises(TopicError):
        r.register("old.module", "elsewhere")


def test_upcasting(spark):
    rows = spark.createDataFrame([("x", None, None, None, 1), ("Y", 3, None, None, 2), ("Z", 3, "q", None, 3), ("W", 4, "r", 9, 4)], "a string, b int, c string, d int, v int")
    steps = [{"a": lambda s: F.upper(s["a"]), "b": lambda s: F.lit(0)}, {"c": lambda s: F.lit("new")}, {"d": lambda s: F.lit(None).cast("int")}]
    now = topics.upcast({c: F.col(c) for c in "abcd"}, F.col("v"), steps)
    got = [tuple(r) for r in rows.orderBy("v").select(*[c.alias(n) for n, c in now.items()]).collect()]
    assert got == [("X", 0, "new", None), ("Y", 3, "new", None), ("Z", 3, "q", None), ("W", 4, "r", 9)]


def test_search(spark):
    pages = spark.createDataFrame([(1, "The dog and the Cat."), (2, "A rose"), (3, "Zebra, zebra!"), (4, None)], "id int, body string")
    for query, found in (("dog cat", {1}), ("rose zebra", set()), ("rose OR zebra", {2, 3}), ("CAT", {1}), ("", set())):
        assert {r.id for r in search.search(pages, "body", query).collect()} == found
        assert {r.id for r in search.search_postings(search.postings(pages, "id", "body"), "id", query).collect()} == found


def test_settings():
    assert strtobool("Yes") and not strtobool("off")
    with pytest.raises(ValueError):
        strtobool("maybe")
    s = Settings("app", {"APP_KEY": "1", "KEY": "2", "OTHER": "3"}, {"DEFAULT": "4"})
    assert (s.get("KEY"), s.get("OTHER"), s.get("DEFAULT"), s.get("NONE"), s.flag("KEY")) == ("1", "3", "4", None, True)
    calls = []

    @retry(KeyError, attempts=3)
    def fails():
        calls.append(1)
        raise KeyError

    with pytest.raises(KeyError):
        fails()
    assert len(calls) == 3


@settings(max_examples=200, deadline=None)
@given(st.text("ab\n", max_size=30), st.text("ab\n", max_size=30))
def test_patches(old, new):
    diff = create_diff(old, new)
    assert apply_patch(old, diff) == new
    assert diff or old == new


def test_patch_format():
    assert create_diff("a\nb\nc\n", "a\nx\nc\nd\n") == "2c2\n< b\n---\n> x\n3a4\n> d\n"
    assert apply_patch("one\ntwo\n", "1d0\n< one\n") == "two\n"
    with pytest.raises(ValueError):
        apply_patch("a\n", "nonsense\n")


def test_event_sourced_log(spark, tmp_path):
    log = EventSourcedLog(EventLog(spark, str(tmp_path)).create(), "f" * 32, "PageLogged")
    log.trigger_events(spark.createDataFrame([(b"id1", 1), (b"id2", 2)], "state binary, at long"), "at")
    log.trigger_events(spark.createDataFrame([(b"id3", 1)], "state binary, at long"), "at")
    get = lambda frame: [bytes(r.state).decode() for r in frame.collect()]
    assert get(log.get()) == ["id1", "id2", "id3"] and get(log.get(gt=1)) == ["id2", "id3"] and get(log.get(lte=1)) == ["id1"]
    assert get(log.get(limit=1)) == ["id1"] and get(log.get(desc=True)) == ["id3", "id2", "id1"] and get(log.get_first()) == ["id1"] and get(log.get_last()) == ["id3"]


def test_windows_over_event_time(spark, tmp_path):
    from eventlake.streaming.folds import windowed

    rows = [(T0 + timedelta(minutes=m), "t") for m in (0, 1, 6, 30)]
    spark.createDataFrame(rows, "timestamp timestamp, topic string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("timestamp timestamp, topic string").parquet(str(tmp_path / "in"))
    query = windowed(stream, "timestamp", "1 minute", "5 minutes", F.count(F.lit(1)).alias("n")).writeStream.format("memory").queryName("w_").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.n for r in spark.sql("select n from w_").collect()) == [1, 1, 2]
