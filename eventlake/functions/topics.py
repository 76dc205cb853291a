"""Topics: renamed and moved classes, and states of earlier class versions."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventlake.schema import TopicError


class TopicRegistry:
    """Aliases of topics.  An alias may name a module, a class or a nested class ("module:Outer.Inner")."""

    def __init__(self, aliases: Mapping[str, str] | None = None):
        self._aliases: dict[str, str] = {}
        for alias, topic in (aliases or {}).items():
            self.register(alias, topic)

    def register(self, alias: str, topic: str) -> None:
        if self._aliases.get(alias, topic) != topic:
            raise TopicError(f"{alias} is registered already, as {self._aliases[alias]}")
        self._aliases[alias] = topic

    def resolve(self, topic: str) -> str:
        """The topic that is meant: the longest registered beginning (up to a . or :) is replaced, again and again."""
        seen = set()
        while topic not in seen:
            seen.add(topic)
            for end in sorted((i for i, c in enumerate(topic) if c in ".:"), reverse=True):
                if topic in self._aliases:
                    break
                if topic[:end] in self._aliases:
                    topic = self._aliases[topic[:end]] + topic[end:]
                    break
            topic = self._aliases.get(topic, topic)
        return topic

    def require(self, topic: str, known: Collection[str]) -> str:
        """The topic that is meant, which must be one of the ``known`` ones."""
        found = self.resolve(topic)
        if found not in known:
            raise TopicError(f"nothing is known as {topic}" + (f", which is now {found}" if found != topic else ""))
        return found

    def column(self, topic: Column, topics: Sequence[str]) -> Column:
        """``topic`` resolved, for the topics that occur: a map lookup within the scan's stage."""
        moved = {t: r for t in topics if (r := self.resolve(t)) != t}
        if not moved:
            return topic
        pairs = [F.lit(x) for pair in moved.items() for x in pair]
        return F.coalesce(F.element_at(F.create_map(*pairs), topic), topic)


def upcast(state: Mapping[str, Column], class_version: Column, steps: Sequence[Mapping[str, object]]) -> dict[str, Column]:
    """Fields of the newest class version.  ``steps[i]`` takes version i + 1 to i + 2: field -> f(fields) -> Column.

    Rows of a version above a step pass it unchanged, so one expression serves a mix of versions.
    """
    now = dict(state)
    for i, step in enumerate(steps):
        old = F.coalesce(class_version, F.lit(1)) <= i + 1
        made = {name: make(now) for name, make in step.items()}
        now |= {name: F.when(old, made[name]).otherwise(now[name]) if name in now else F.when(old, made[name]) for name in made}
    return now
