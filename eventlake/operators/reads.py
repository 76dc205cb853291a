"""Reads of event sequences and of the notification log, over DataFrames.

Every read is a filter, an order and a limit, so bounds reach the Parquet scan and a limit becomes
a top-k; nothing here gathers a sequence on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def select_events(
    events: DataFrame, originator_id: str | None = None, gt: int | None = None, lte: int | None = None, desc: bool = False, limit: int | None = None
) -> DataFrame:
    """One aggregate's events (of all aggregates if no id is given) with gt < version <= lte, by version."""
    if originator_id is not None:
        events = events.where(F.col("originator_id") == originator_id)
    if gt is not None:
        events = events.where(F.col("originator_version") > gt)
    if lte is not None:
        events = events.where(F.col("originator_version") <= lte)
    order = F.col("originator_version").desc() if desc else F.col("originator_version").asc()
    events = events.orderBy(order)
    return events if limit is None else events.limit(limit)


def last_events(events: DataFrame, lte: int | None = None) -> DataFrame:
    """Of every aggregate the last event (with version <= lte): a maximum, merged before the shuffle."""
    if lte is not None:
        events = events.where(F.col("originator_version") <= lte)
    rest = [c for c in events.columns if c not in ("originator_id", "originator_version")]
    best = F.max_by(F.struct(*rest), F.col("originator_version")).alias("e_")
    last = events.groupBy("originator_id").agg(F.max("originator_version").alias("originator_version"), best)
    return last.select("originator_id", "originator_version", "e_.*")


def select_notifications(log: DataFrame, start: int, limit: int | None = None, stop: int | None = None, topics: Sequence[str] = ()) -> DataFrame:
    """Notifications with start <= id <= stop and one of the topics, by id; the limit counts what passes the filter."""
    log = log.where(F.col("notification_id") >= start)
    if stop is not None:
        log = log.where(F.col("notification_id") <= stop)
    if topics:
        log = log.where(F.col("topic").isin(*topics))
    log = log.orderBy("notification_id")
    return log if limit is None else log.limit(limit)


def max_notification_id(log: DataFrame) -> DataFrame:
    """One row; 0 for an empty log."""
    return log.agg(F.coalesce(F.max("notification_id"), F.lit(0).cast("long")).alias("max_notification_id"))


def max_tracking_ids(tracking: DataFrame, application_name: str | None = None) -> DataFrame:
    """The highest id tracked, of each application; with a name one row, 0 if nothing is tracked."""
    if application_name is None:
        return tracking.groupBy("application_name").agg(F.max("notification_id").alias("max_tracking_id"))
    own = tracking.where(F.col("application_name") == application_name)
    return own.agg(F.coalesce(F.max("notification_id"), F.lit(0).cast("long")).alias("max_tracking_id"))


def tracked(asked: DataFrame, tracking: DataFrame) -> DataFrame:
    """The rows of ``asked`` (application_name, notification_id) that are tracked."""
    return asked.join(tracking, ["application_name", "notification_id"], "left_semi")


def unprocessed(log: DataFrame, tracking: DataFrame, application_name: str) -> DataFrame:
    """Notifications that an application has not tracked."""
    return log.join(tracking.where(F.col("application_name") == application_name).select("notification_id"), "notification_id", "left_anti")


def check_limit(limit: int, section_size: int) -> None:
    if limit > section_size:
        raise ValueError(f"limit {limit} is more than the section size {section_size}")


def section_bounds(section_id: str, section_size: int) -> tuple[int, int]:
    """(start, limit) that a section id "first,last" asks for."""
    first, last = (int(x) for x in section_id.split(","))
    start = max(1, first)
    return start, min(max(0, last - start + 1), section_size)


def section(log: DataFrame, section_id: str, section_size: int = 10) -> dict:
    """One section: its id (from its own first and last row), the next id (only if it is full) and its items."""
    start, limit = section_bounds(section_id, section_size)
    items = select_notifications(log, start, limit).collect() if limit else []  # at most section_size rows
    if not items:
        return {"id": None, "items": [], "next_id": None}
    first, last = items[0]["notification_id"], items[-1]["notification_id"]
    following = f"{last + 1},{last + limit}" if len(items) == limit else None
    return {"id": f"{first},{last}", "items": items, "next_id": following}


def sections(log: DataFrame, size: int = 10, rank: Column | None = None) -> DataFrame:
    """The whole log in linked sections: section_no, section_id, next_id, n_items.

    A page is a group by the rank of its rows.  Gapless logs have it for free, as id - 1; for
    others give ``rank`` (``ranked`` adds one without sorting the log in one task).
    """
    at = F.col("notification_id") - 1 if rank is None else rank
    page = F.floor(at / size).cast("long").alias("section_no")
    ids = log.groupBy(page).agg(F.min("notification_id").alias("f_"), F.max("notification_id").alias("l_"), F.count(F.lit(1)).alias("n_items"))
    text = lambda a, b: F.concat_ws(",", a.cast("string"), b.cast("string"))
    return ids.select(
        "section_no",
        text(F.col("f_"), F.col("l_")).alias("section_id"),
        F.when(F.col("n_items") == size, text(F.col("l_") + 1, F.col("l_") + size)).alias("next_id"),
        "n_items",
    )


def ranked(log: DataFrame, width: int = 1 << 20) -> DataFrame:
    """``log`` with rank_, the 0-based position by notification_id, tolerating gaps.

    Ranges of ``width`` ids are numbered each for itself and shifted by a prefix sum of their counts.
    """
    cut = log.withColumn("range_", F.expr(f"notification_id div {width}"))
    inside = F.row_number().over(Window.partitionBy("range_").orderBy("notification_id")) - 1
    counts = cut.groupBy("range_").agg(F.count(F.lit(1)).alias("n_"))
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    shift = counts.select("range_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("shift_"))
    return cut.withColumn("inside_", inside).join(shift, "range_").withColumn("rank_", F.col("inside_") + F.col("shift_")).drop("range_", "inside_", "shift_")


def read_log(log: DataFrame, start: int) -> DataFrame:
    """All notifications from ``start``, in order: what following linked sections to their end yields."""
    return select_notifications(log, start)


def first_and_last(events: DataFrame, column: str) -> DataFrame:
    """first_ and last_ value of a column in each sequence, by version."""
    by = F.col("originator_version")
    return events.groupBy("originator_id").agg(F.min_by(column, by).alias(f"first_{column}"), F.max_by(column, by).alias(f"last_{column}"))


def entries_with_state(log: DataFrame, states: DataFrame, gt: int | None = None, lte: int | None = None, desc: bool = False, limit: int | None = None) -> DataFrame:
    """Entries of a log of ids in a range, each with the current state of the entity it names, in log order."""
    entries = log if gt is None else log.where(F.col("notification_id") > gt)
    entries = entries if lte is None else entries.where(F.col("notification_id") <= lte)
    if limit is not None:
        entries = entries.orderBy(F.col("notification_id").desc() if desc else "notification_id").limit(limit)
    joined = entries.join(states, "originator_id")
    return joined.orderBy(F.col("notification_id").desc() if desc else F.col("notification_id"))


def lag(logs: DataFrame, tracking: DataFrame) -> DataFrame:
    """How far each application is behind its leader: leader_name, max id, max tracked, lag.

    ``logs`` has leader_name and notification_id; tracking names the leader as application_name.
    """
    heads = logs.groupBy("leader_name").agg(F.max("notification_id").alias("max_notification_id"))
    done = tracking.groupBy(F.col("application_name").alias("leader_name")).agg(F.max("notification_id").alias("t_"))
    joined = heads.join(done, "leader_name", "left")
    done_id = F.coalesce("t_", F.lit(0).cast("long"))
    return joined.select("leader_name", "max_notification_id", done_id.alias("max_tracking_id"), (F.col("max_notification_id") - done_id).alias("lag"))
