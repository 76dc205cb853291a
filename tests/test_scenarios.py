"""Whole stories told to the engine: a dog school, a bank, cargo, invoices, a car park and a wiki."""

from datetime import datetime, timedelta
from decimal import Decimal
from enum import Enum

import pytest
from pyspark.sql import functions as F

from eventlake.application import Application, EventSourcedLog
from eventlake.functions import codec, ids
from eventlake.functions.patch import apply_patch, create_diff
from eventlake.operators import folds, reads, search
from eventlake.schema import IntegrityError
from eventlake.sources.log import EventLog
from eventlake.streaming.system import Node, SingleThreadedRunner, System

ENVELOPE = "originator_id string, originator_version long, topic string, state string"
NOW = datetime(2024, 5, 1)


def field(name, kind="string"):
    return F.get_json_object("state", f"$.{name}").cast(kind).alias(name)


def test_dog_school_in_three_styles(spark, tmp_path):
    school = Application(spark, str(tmp_path))
    events = [("fido", 1, "Registered", '{"name":"Fido"}'), ("fido", 2, "TrickAdded", '{"trick":"roll over"}'), ("fido", 3, "TrickAdded", '{"trick":"play dead"}'), ("rex", 1, "Registered", '{"name":"Rex"}')]
    school.save(spark.createDataFrame(events, ENVELOPE))
    rows = school.decode(school.log.notifications()).select("originator_id", "originator_version", "topic", F.lit(NOW).alias("timestamp"), field("name"), field("trick"))
    algebraic = folds.project(rows, folds.AggregateSpec("Dog", {"name": folds.last_value(F.col("name"), F.col("name").isNotNull()), "tricks": folds.appended(F.col("trick"), F.col("trick").isNotNull())}))
    zero = F.struct(F.lit(None).cast("string").alias("name"), F.array().cast("array<string>").alias("tricks"))
    added = lambda s, e: F.when(e["trick"].isNotNull(), F.concat(s["tricks"], F.array(e["trick"]))).otherwise(s["tricks"])
    ordered = folds.fold(rows, zero, lambda s, e: F.struct(F.coalesce(e["name"], s["name"]).alias("name"), added(s, e).alias("tricks")), ["name", "trick"])

    def mutate(dog, event):
        if event["topic"] == "Registered":
            return {"name": event["name"], "tricks": []}
        return {**dog, "tricks": [*dog["tricks"], event["trick"]]}

    python = folds.fold_python(rows, dict, mutate, lambda dog: dog, "name string, tricks array<string>", ["topic", "name", "trick"])
    want = {"fido": ("Fido", ["roll over", "play dead"]), "rex": ("Rex", [])}
    assert {r.originator_id: (r.name, r.tricks) for r in algebraic.collect()} == want
    assert {r.originator_id: (r.state.name, r.state.tricks) for r in ordered.collect()} == want
    assert {r.originator_id: (r.name, list(r.tricks)) for r in python.collect()} == want
    tricks = rows.where("trick is not null").groupBy("trick").agg(folds.counter().alias("n"))
    assert {r.trick: r.n for r in tricks.collect()} == {"roll over": 1, "play dead": 1}


def test_bank_transfers_are_atomic(spark, tmp_path):
    bank = Application(spark, str(tmp_path), {"CIPHER_KEY": codec.new_key(16)})
    event = lambda i, v, topic, amount: (i, v, topic, f'{{"amount":"{amount}"}}')
    save = lambda *rows: bank.save(spark.createDataFrame(list(rows), ENVELOPE))
    save(event("a", 1, "Opened", 0), event("a", 2, "Credited", "100.00"), event("b", 1, "Opened", 0))
    save(event("a", 3, "Debited", "30.00"), event("b", 2, "Credited", "30.00"))  # a transfer: both or neither
    with pytest.raises(IntegrityError):
        save(event("b", 3, "Credited", "1.00"), event("a", 3, "Debited", "1.00"))
    amount = field("amount", "decimal(12,2)")
    rows = bank.decode(bank.log.notifications()).select("originator_id", "originator_version", "topic", F.lit(NOW).alias("timestamp"), amount)
    delta = folds.dispatch(F.col("topic"), {"Debited": -F.col("amount")}, F.col("amount"))
    state = folds.project(rows, folds.AggregateSpec("Account", {"balance": F.sum(delta)}))
    assert {r.originator_id: r.balance for r in state.collect()} == {"a": Decimal("70.00"), "b": Decimal("30.00")}
    asked = rows.select("originator_id", "originator_version", delta.alias("d")).unionByName(spark.createDataFrame([("b", 3, Decimal("-200"))], "originator_id string, originator_version long, d decimal(12,2)"))
    assert [(r.originator_id, r.balance) for r in folds.violations(asked, F.col("d"), F.lit(50)).collect()] == [("b", Decimal("-170.00"))]


def test_cargo_is_a_state_machine(spark):
    legs = [("HONGKONG", "NEWYORK"), ("NEWYORK", "STOCKHOLM")]
    rows = [("c", 1, "BookingStarted", "HONGKONG", None, None), ("c", 2, "RouteAssigned", None, legs, None)]
    for n, (place, what) in enumerate([("HONGKONG", "RECEIVE"), ("HONGKONG", "LOAD"), ("NEWYORK", "UNLOAD"), ("TOKYO", "LOAD")], 3):
        rows.append(("c", n, "Handled", place, None, what))
    events = spark.createDataFrame(rows, "originator_id string, originator_version long, topic string, place string, legs array<struct<f: string, t: string>>, what string")
    zero = F.struct(F.lit("NOT_RECEIVED").alias("status"), F.lit(None).cast("array<struct<f: string, t: string>>").alias("legs"), F.lit(False).alias("misdirected"))

    def step(s, e):
        status = folds.dispatch(e["what"], {"RECEIVE": F.lit("IN_PORT"), "LOAD": F.lit("ONBOARD"), "UNLOAD": F.lit("IN_PORT"), "CLAIM": F.lit("CLAIMED")}, s["status"])
        expected = F.exists(s["legs"], lambda leg: F.when(e["what"] == "UNLOAD", leg["t"] == e["place"]).otherwise(leg["f"] == e["place"]))
        wrong = F.when(e["topic"] == "Handled", ~expected).otherwise(s["misdirected"])
        return F.struct(status.alias("status"), F.coalesce(e["legs"], s["legs"]).alias("legs"), wrong.alias("misdirected"))

    at = lambda v: folds.fold(events.where(F.col("originator_version") <= v), zero, step, ["topic", "place", "legs", "what"]).first().state
    assert (at(2).status, at(3).status, at(4).status, at(5).status, at(5).misdirected) == ("NOT_RECEIVED", "IN_PORT", "ONBOARD", "IN_PORT", False)
    assert at(6).misdirected and at(6).legs[1].t == "STOCKHOLM"


def test_invoices_have_enums_and_value_objects():
    class Via(Enum):
        EMAIL = "email"

    class Person:
        def __init__(self, name, address):
            self.name, self.address = name, address

        def __eq__(self, other):
            return vars(self) == vars(other)

    t = codec.Transcoder()
    t.register(Via, "via", lambda x: x.name, Via.__getitem__)
    t.register(Person, "person", vars, lambda x: Person(**x))
    value = {"to": Person("A", "B"), "via": Via.EMAIL, "amount": Decimal("7.00")}
    assert t.encode({"via": Via.EMAIL}) == b'{"via":{"_type_":"via","_data_":"EMAIL"}}' and t.decode(t.encode(value)) == value


def test_car_park_inspections(spark):
    booked = spark.createDataFrame([("ABC", NOW, NOW + timedelta(days=3))], "plate string, start timestamp, finish timestamp")
    seen = spark.createDataFrame([("ABC", NOW + timedelta(days=1)), ("ABC", NOW + timedelta(days=4)), ("XYZ", NOW + timedelta(days=1))], "plate string, at timestamp")
    failed = folds.uncovered(seen, booked, "plate", "at", "start", "finish")
    assert {(r.plate, r["at"].day) for r in failed.collect()} == {("ABC", 5), ("XYZ", 2)}


def test_wiki_with_a_search_follower(spark, tmp_path):
    wiki = Application(spark, str(tmp_path / "wiki"), {"COMPRESSOR_TOPIC": "gzip"})
    page = spark.range(1).select(ids.slug_id(F.lit("welcome")).alias("i")).first().i
    texts = ["", "Hello dog\n", "Hello dog\nand cat\n", "Goodbye rose\nand cat\n"]
    rows = [(page, 1, "Created", '{"slug":"welcome"}')]
    diffs = [create_diff(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    import json

    rows += [(page, v, "BodyUpdated", json.dumps({"diff": d})) for v, d in enumerate(diffs, 2)]
    wiki.save(spark.createDataFrame(rows, ENVELOPE))
    EventSourcedLog(wiki.log, "0" * 32, "PageLogged").trigger_events(spark.createDataFrame([(page.encode(), 1)], "state binary, at long"), "at")

    def bodies(log):
        events = wiki.decode(log).where("topic in ('Created', 'BodyUpdated')").select("originator_id", "originator_version", "topic", field("diff"))
        return folds.fold_python(events, lambda: "", lambda body, e: apply_patch(body, e["diff"]) if e["diff"] else body, lambda b: {"body": b}, "body string", ["topic", "diff"])

    assert [r.body for r in bodies(wiki.log.notifications()).collect()] == [texts[-1]]
    entries = wiki.log.select_events("0" * 32).select(F.decode("state", "UTF-8").alias("originator_id"), F.lit(1).cast("long").alias("notification_id"))
    assert [r.body for r in reads.entries_with_state(entries, bodies(wiki.log.notifications())).collect()] == [texts[-1]]

    def index(new, node):  # re-reads the bodies of changed pages from the wiki and records them
        changed = new.where("topic = 'BodyUpdated'").groupBy("originator_id").agg(F.max("originator_version").alias("originator_version"))
        now = bodies(wiki.log.notifications().join(changed.select("originator_id"), "originator_id", "left_semi"))
        return changed.join(now.select("originator_id", "body"), "originator_id").select("originator_id", "originator_version", F.lit("Indexed").alias("topic"), F.encode("body", "UTF-8").alias("state"))

    follower = Node("search", EventLog(spark, str(tmp_path / "search")).create(), index)
    SingleThreadedRunner(System({"wiki": Node("wiki", wiki.log), "search": follower}, [["wiki", "search"]])).run()
    kept = reads.last_events(follower.log.notifications().select("originator_id", "originator_version", F.decode("state", "UTF-8").alias("body")))
    assert search.search(kept, "body", "cat rose").count() == 1 and search.search(kept, "body", "dog").count() == 0
