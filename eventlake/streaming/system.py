"""Applications that follow each other's logs, exactly once.

A node is an application with a log; an edge lets a follower process what its leader records.  A
follower's position is its tracking record for the leader, committed together with the events it
made of them, so a repeat does nothing and nothing is lost.  A position also passes over events
whose topic is not followed.

``SingleThreadedRunner`` takes the edges in order, a range of ids at a time, until no follower is
behind; cyclic systems end when no new events appear.  ``StreamingRunner`` keeps a streaming query
per edge.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.schema import IntegrityError, ProgrammingError
from eventlake.sources.log import EventLog
from eventlake.sources.log_source import register

Policy = Callable[[DataFrame, "Node"], DataFrame | None]


@dataclass
class Node:
    """An application: its log, and for followers the policy that makes events of events.

    ``policy(notifications, node)`` returns events to record (envelope columns), or None.  Followers
    take the topics they follow of those their leader notifies about (all, where none are named).
    """

    name: str
    log: EventLog
    policy: Policy | None = None
    follow_topics: Sequence[str] = ()
    notify_topics: Sequence[str] = ()
    pull_section_size: int | None = None
    events_order: str | None = None


@dataclass
class System:
    """Nodes, and pipes of them: each name leads the next in its pipe."""

    nodes: dict[str, Node]
    pipes: Sequence[Sequence[str]]
    edges: list[tuple[str, str]] = field(init=False)

    def __post_init__(self):
        self.edges = list(dict.fromkeys((a, b) for pipe in self.pipes for a, b in zip(pipe, pipe[1:], strict=False)))
        for name in {n for pipe in self.pipes for n in pipe}:
            if name not in self.nodes:
                raise ProgrammingError(f"no node is named {name}")
        for name, node in self.nodes.items():
            if not isinstance(node, Node) or not isinstance(node.log, EventLog):
                raise ProgrammingError(f"{name} is not a node with a log")
        for leader, follower in self.edges:
            role = "processes" if follower in self.leaders else "follows"
            if not callable(self.nodes[follower].policy):
                raise ProgrammingError(f"{follower} {role} {leader} but has no policy")

    @property
    def leaders(self) -> list[str]:
        return list(dict.fromkeys(a for a, _ in self.edges))

    @property
    def followers(self) -> list[str]:
        return list(dict.fromkeys(b for _, b in self.edges))

    @property
    def processors(self) -> list[str]:
        return [n for n in self.leaders if n in self.followers]

    @property
    def leaders_only(self) -> list[str]:
        return [n for n in self.leaders if n not in self.followers]

    @property
    def singles(self) -> list[str]:
        linked = {n for edge in self.edges for n in edge}
        return [n for pipe in self.pipes for n in pipe if n not in linked]


def topics_of(leader: Node, follower: Node) -> list[str] | None:
    """The topics that go from one to the other; None if all do."""
    if leader.notify_topics and follower.follow_topics:
        return sorted(set(leader.notify_topics) & set(follower.follow_topics))
    return sorted(leader.notify_topics or follower.follow_topics) or None


def process(leader: str, follower: Node, notifications: DataFrame, last: int, batch: tuple[str, int] | None = None) -> bool:
    """Apply the policy to a range of notifications ending at ``last`` and record what it makes, once.

    A tracking record that exists already means the range was processed: nothing happens.  Any
    other conflict is an error.
    """
    rows = notifications.where(F.col("topic").isin(*follower.follow_topics)) if follower.follow_topics else notifications
    made = follower.policy(rows, follower)
    try:
        return follower.log.append(made, tracking=(leader, last), batch=batch, order=follower.events_order if made is not None else None) is not None
    except IntegrityError:
        if follower.log.has_tracking_id(leader, last):
            return False
        raise


def pull_and_process(leader: Node, follower: Node, start: int | None = None, stop: int | None = None) -> int:
    """Process what the follower has not seen (or an id range), a section at a time; the number of ranges."""
    at = follower.log.max_tracking_id(leader.name) + 1 if start is None else start
    end = leader.log.max_notification_id() if stop is None else min(stop, leader.log.max_notification_id())
    done = 0
    while at <= end:
        last = end if not follower.pull_section_size else min(end, at + follower.pull_section_size - 1)
        rows, wanted = leader.log.notifications(at, last), topics_of(leader, follower)
        process(leader.name, follower, rows if wanted is None else rows.where(F.col("topic").isin(wanted)), last)
        at, done = last + 1, done + 1
    return done


class SingleThreadedRunner:
    """Runs a system until it is quiescent."""

    def __init__(self, system: System):
        self.system = system

    def get(self, name: str) -> Node:
        return self.system.nodes[name]

    def run(self, most_rounds: int = 10_000) -> int:
        for rounds in range(most_rounds):
            if not sum(pull_and_process(self.get(a), self.get(b)) for a, b in self.system.edges):
                return rounds
        raise RuntimeError(f"the system is not quiescent after {most_rounds} rounds")


class StreamingRunner:
    """One streaming query per edge; offsets are kept below ``checkpoints``."""

    def __init__(self, spark: SparkSession, system: System, checkpoints: str):
        self.spark, self.system, self.checkpoints = register(spark), system, checkpoints.rstrip("/")
        self.queries: list = []

    def _start(self, leader: Node, follower: Node, available_now: bool):
        name = f"{leader.name}-{follower.name}"

        wanted = topics_of(leader, follower)

        def record(batch: DataFrame, batch_id: int) -> None:
            last = batch.agg(F.max("notification_id")).first()[0]
            if last is not None and last > follower.log.max_tracking_id(leader.name):
                process(leader.name, follower, batch, last, (name, batch_id))

        source = self.spark.readStream.format("eventlake").option("path", leader.log.path)
        stream = (source if wanted is None else source.option("topics", ",".join(wanted))).load()
        writer = stream.writeStream.foreachBatch(record).option("checkpointLocation", f"{self.checkpoints}/{name}")
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()

    def start(self) -> None:
        """Follow continuously."""
        self.queries = [self._start(self.get(a), self.get(b), False) for a, b in self.system.edges]

    def run(self, most_rounds: int = 1000) -> int:
        """Catch up, edge after edge, until every follower has seen its leader's last notification."""
        for rounds in range(most_rounds):
            behind = [(a, b) for a, b in self.system.edges if self.get(a).log.max_notification_id() > self.get(b).log.max_tracking_id(self.get(a).name)]
            if not behind:
                return rounds
            for a, b in behind:
                leader, follower = self.get(a), self.get(b)
                last = leader.log.max_notification_id()
                self._start(leader, follower, True).awaitTermination()
                if last > follower.log.max_tracking_id(a):  # what came after the last followed topic is passed over
                    process(a, follower, leader.log.notifications(last + 1, last), last)
        raise RuntimeError(f"the system is not quiescent after {most_rounds} rounds")

    def get(self, name: str) -> Node:
        return self.system.nodes[name]

    def watch_for_errors(self, timeout: float | None = None) -> bool:
        """Wait for one of this runner's queries to end; raises what ended it.  False if none did in time."""
        until = None if timeout is None else time.monotonic() + timeout
        while until is None or time.monotonic() < until:
            for query in self.queries:
                if not query.isActive:
                    query.awaitTermination()
                    return True
            time.sleep(0.1)
        return False

    def stop(self) -> None:
        for query in self.queries:
            query.stop()
        for query in self.queries:
            if query.exception() is not None:
                raise query.exception()
