"""Schemas of the tables and the errors of the engine."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT = T.StructType(
    [
        T.StructField("originator_id", T.StringType(), False),
        T.StructField("originator_version", T.LongType(), False),
        T.StructField("topic", T.StringType(), False),
        T.StructField("state", T.BinaryType(), True),
    ]
)
NOTIFICATION = T.StructType([T.StructField("notification_id", T.LongType(), False), *EVENT.fields])
TRACKING = T.StructType(
    [T.StructField("application_name", T.StringType(), False), T.StructField("notification_id", T.LongType(), False)]
)
KEY = ["originator_id", "originator_version"]


class IntegrityError(Exception):
    """A key or tracking record exists already."""


class ProgrammingError(Exception):
    """Something is not enabled or not registered."""


class AggregateNotFoundError(Exception):
    """No event makes up the aggregate asked for."""


class OriginatorIDError(Exception):
    """An event of another aggregate in a sequence."""


class OriginatorVersionError(Exception):
    """A gap or repeat in the versions of a sequence."""


class TopicError(Exception):
    """A topic cannot be resolved or is registered twice."""
