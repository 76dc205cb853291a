"""Every registered query of the event log against its SQL; systems and streams on small logs."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from eventlake.plans import catalog
from eventlake.schema import IntegrityError, ProgrammingError
from eventlake.sources.log import EventLog
from eventlake.streaming.system import Node, SingleThreadedRunner, StreamingRunner, System, process

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(None if x is None or x != x else str(x) for x in row) for row in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got, want = catalog.QUERIES[name](spark, SF), con.sql(catalog.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert plain(got.select(columns).collect()) == plain(want.select(quoted).fetchall())


def test_slugs_that_pages_share(spark, tmp_path):
    urls = [(0, "a"), (1, "a"), (2, "a"), (-2, "b"), (-3, "b"), (4, None), (5, None), (6, None), (6, ""), (7, ""), (8, "c"), (8, "c"), (None, "a"), (None, None)]
    spark.createDataFrame(urls, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    for t, place in (("events", f"{SF}/events.parquet"), ("orders", f"{SF}/orders.parquet"), ("pages", f"{tmp_path}/pages.parquet/*.parquet")):
        con.sql(f"create view {t} as select * from '{place}'")
    got = plain(catalog.QUERIES["slug_index_lookup"](spark, str(tmp_path)).select("page_id", "url").collect())
    assert got == plain(con.sql(f"select page_id, url from ({catalog.ORACLES['slug_index_lookup']})").fetchall())
    assert got == plain((i if i is not None and i % 2 == 0 else None, url) for i, url in urls)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(catalog.ORACLES) <= set(__spark_entry__.oracle_sql())


def _log(spark, path, n=5):
    log = EventLog(spark, str(path)).create()
    rows = spark.range(1, n + 1).select(F.lit("x").alias("originator_id"), F.col("id").alias("originator_version"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("topic"), F.lit(b"").alias("state"))
    log.append(rows, order="originator_version")
    return log


def copy(rows, node):
    return rows.select(F.concat(F.lit("copy-"), F.col("notification_id").cast("string")).alias("originator_id"), F.lit(1).cast("long").alias("originator_version"), "topic", "state")


def test_graph(spark, tmp_path):
    nodes = {n: Node(n, EventLog(spark, str(tmp_path / n)), copy) for n in "abcd"}
    system = System(nodes, [["a", "b", "c"], ["a", "b"], ["d"]])
    assert system.edges == [("a", "b"), ("b", "c")] and system.leaders == ["a", "b"] and system.followers == ["b", "c"]
    assert system.processors == ["b"] and system.singles == ["d"]
    with pytest.raises(ProgrammingError):
        System(nodes, [["a", "zz"]])
    with pytest.raises(ProgrammingError):
        System({"a": nodes["a"], "p": Node("p", nodes["b"].log)}, [["a", "p"]])


def test_graph_roles_and_types(spark, tmp_path):
    nodes = {n: Node(n, EventLog(spark, str(tmp_path / n)), copy) for n in "abc"}
    assert System(nodes, [["a", "b", "c"]]).leaders_only == ["a"]
    with pytest.raises(ProgrammingError, match="b processes a"):
        System({**nodes, "b": Node("b", nodes["b"].log, "no policy")}, [["a", "b", "c"]])
    with pytest.raises(ProgrammingError):
        System({**nodes, "c": "not a node"}, [["a", "b"]])


def test_topics_are_pushed_into_streams(spark, tmp_path):
    seen = []

    def policy(rows, node):
        seen.append(sorted(r.topic for r in rows.collect()))
        return copy(rows, node)

    lead = Node("lead", _log(spark, tmp_path / "lead"), notify_topics=("even", "other"))
    follow = Node("follow", EventLog(spark, str(tmp_path / "follow")).create(), policy, ("even",))
    StreamingRunner(spark, System({"lead": lead, "follow": follow}, [["lead", "follow"]]), str(tmp_path / "offsets")).run()
    assert seen == [["even", "even"], []]  # the odd last one is passed over
    assert follow.log.max_tracking_id("lead") == 5 and follow.log.max_notification_id() == 2


def test_errors_of_a_policy_come_up(spark, tmp_path):
    def broken(rows, node):
        raise ValueError("the policy failed")

    lead, follow = Node("lead", _log(spark, tmp_path / "lead")), Node("follow", EventLog(spark, str(tmp_path / "follow")).create(), broken)
    runner = StreamingRunner(spark, System({"lead": lead, "follow": follow}, [["lead", "follow"]]), str(tmp_path / "offsets"))
    runner.start()
    with pytest.raises(Exception, match="the policy failed"):
        runner.watch_for_errors(120)
    with pytest.raises(Exception, match="the policy failed"):
        runner.stop()
    with pytest.raises(ValueError, match="the policy failed"):
        SingleThreadedRunner(runner.system).run()
    assert follow.log.max_notification_id() == 0 and follow.log.max_tracking_id("lead") == 0
    spark.streams.resetTerminated()


def test_processing_is_exactly_once(spark, tmp_path):
    lead, follow = Node("lead", _log(spark, tmp_path / "lead")), Node("follow", EventLog(spark, str(tmp_path / "follow")).create(), copy, ("even",), 2)
    runner = SingleThreadedRunner(System({"lead": lead, "follow": follow}, [["lead", "follow"]]))
    assert runner.run() == 1 and runner.run() == 0
    assert sorted(r.originator_id for r in follow.log.notifications().collect()) == ["copy-2", "copy-4"]
    assert follow.log.max_tracking_id("lead") == 5
    assert not process("lead", follow, lead.log.notifications(), 5)  # seen already: nothing happens
    with pytest.raises(IntegrityError):  # the same events under a new position: a true conflict
        process("lead", follow, lead.log.notifications(), 6)


def test_streams_catch_up_and_go_on(spark, tmp_path):
    lead, follow = Node("lead", _log(spark, tmp_path / "lead")), Node("follow", EventLog(spark, str(tmp_path / "follow")).create(), copy)
    runner = StreamingRunner(spark, System({"lead": lead, "follow": follow}, [["lead", "follow"]]), str(tmp_path / "offsets"))
    runner.run()
    lead.log.append(spark.createDataFrame([("y", 1, "odd", b"")], "originator_id string, originator_version long, topic string, state binary"))
    runner.run()
    assert sorted(r.originator_id for r in follow.log.notifications().collect()) == [f"copy-{i}" for i in range(1, 7)]
