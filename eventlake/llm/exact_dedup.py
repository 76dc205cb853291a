"""Exact duplicates by skew-safe combining.

Rows are combined three times, and each time the whole normalised text is part of the grouping
key, so that two texts are one group only if their contents are equal, whatever their digests:

1. local: every map task merges its own rows (Spark's partial aggregation);
2. salted: rows of a hot digest are spread over ``salts`` groups, rows of other digests meet at once;
3. global: the salt winners of hot digests, at most ``salts`` for each text, are merged.

A digest is hot if it has more than one in ``hot_share`` of all rows, so there are fewer than
``hot_share`` of them; only those are ever broadcast.  Texts are shuffled once.

Defined results: a null text counts as empty, and empty texts are equal to each other.  A null id
loses against any other id.  Rows repeated with the same id and text are separate rows that name
the same ``keep_id``; ``kept`` is true for one of them.  An empty table gives an empty result.
Columns other than id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlake.plans import scratch

_SPAN = "36893488147419103232BD"  # 2**65: room for every id below one code point of length
_TOP = "9223372036854775808BD"  # 2**63


def normalised(text: Column) -> Column:
    """The text without white space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]", "")


def digest_of(norm: Column, hex_digits: int = 64) -> Column:
    """SHA-256 of the UTF-8 text as bytes; fewer digits only serve tests of colliding digests."""
    return F.unhex(F.substring(F.sha2(F.encode(norm, "UTF-8"), 256), 1, hex_digits))


def _columns(docs: DataFrame, id_col: str, text_col: str, hex_digits: int) -> DataFrame:
    norm = normalised(F.col("text_"))
    return (
        docs.select(F.col(id_col).cast("long").alias("id_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
        .select("id_", F.length("text_").alias("points_"), norm.alias("norm_"))
        .withColumn("digest_", digest_of(F.col("norm_"), hex_digits))
    )


def _rank() -> Column:
    """One fixed-width number that orders rows by code points, then by smallest id (null last)."""
    return F.max(F.expr(f"cast(points_ as decimal(10,0)) * {_SPAN} + coalesce({_TOP} - id_, 0BD)")).alias("best_")


def _winner(best: Column) -> Column:
    left = F.pmod(best, F.expr(_SPAN))
    return F.when(left > 0, (F.expr(_TOP) - left)).cast("long")


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    hot_share: int = 1000,
    salts: int = 64,
    hex_digits: int = 64,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 and points (code points)."""
    base = _columns(docs, id_col, text_col, hex_digits)
    light = scratch.keep(base.select("id_", "points_", "digest_"), "dedup-rows")
    counts = light.groupBy("digest_").agg(F.count(F.lit(1)).alias("n_"))
    total = light.count()
    hot = scratch.keep(
        counts.where((F.col("n_") > 1) & (F.col("n_") * hot_share > total)).select("digest_", F.lit(True).alias("hot_")),
        "dedup-hot",
    )  # fewer than hot_share rows

    salted = base.join(F.broadcast(hot), "digest_", "left").withColumn(
        "salt_", F.when(F.col("hot_"), F.pmod(F.xxhash64("id_"), F.lit(salts))).otherwise(F.lit(0).cast("long"))
    )
    merged = salted.groupBy("digest_", "norm_", "salt_", "hot_").agg(_rank(), F.count(F.lit(1)).alias("n_"))
    stage = scratch.keep(
        merged.select("digest_", F.when(F.col("hot_"), F.col("norm_")).alias("norm_"), "hot_", "best_", "n_"), "dedup-salted"
    )
    cold_groups = stage.where(F.col("hot_").isNull()).select("digest_", "best_", "n_")
    hot_groups = (
        stage.where(F.col("hot_"))
        .groupBy("digest_", "norm_")
        .agg(F.max("best_").alias("best_"), F.sum("n_").alias("n_"))
        .select("digest_", "best_", "n_")
    )
    contents = cold_groups.unionByName(hot_groups).groupBy("digest_").agg(F.count(F.lit(1)).alias("contents_"))
    shared = contents.where(F.col("contents_") > 1).select("digest_")
    if shared.limit(1).count():
        rows = _by_content(base, scratch.keep(shared, "dedup-collided"), light, cold_groups, hot_groups, hot)
    else:
        rows = _by_digest(light, cold_groups, hot_groups, hot)

    result = rows.withColumn("keep_id", _winner(F.col("best_")))
    first = Window.partitionBy("digest_", "best_").orderBy("at_")
    chosen = (F.col("id_").eqNullSafe(F.col("keep_id"))) & (F.col("points_") == F.floor(F.col("best_") / F.expr(_SPAN)))
    result = result.withColumn("chosen_", chosen)
    # Only rows that may be kept are numbered, so no group larger than the repeats of one id meets in a task.
    kept = result.where("chosen_").withColumn("at_", F.monotonically_increasing_id()).withColumn("kept", F.row_number().over(first) == 1)
    dropped = result.where(~F.col("chosen_")).withColumn("kept", F.lit(False))
    columns = [
        F.col("id_").alias(id_col), "keep_id", F.col("n_").alias("group_size"), "kept",
        F.lower(F.hex("digest_")).alias("text_sha256"), F.col("points_").alias("points"),
    ]
    return kept.select(*columns).unionByName(dropped.select(*columns))


def _by_digest(light: DataFrame, cold: DataFrame, hot_groups: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows with their group where every digest has one content."""
    of_hot = light.join(F.broadcast(hot_groups), "digest_")
    of_cold = light.join(F.broadcast(hot.select("digest_")), "digest_", "left_anti").join(cold, "digest_")
    columns = ["id_", "points_", "digest_", "best_", "n_"]
    return of_hot.select(columns).unionByName(of_cold.select(columns))


def _by_content(base: DataFrame, shared: DataFrame, light: DataFrame, cold: DataFrame, hot_groups: DataFrame, hot: DataFrame) -> DataFrame:
    """As _by_digest, but the rows of digests that several contents share are joined on the content."""
    alone = _by_digest(
        light.join(shared, "digest_", "left_anti"),
        cold.join(shared, "digest_", "left_anti"),
        hot_groups.join(shared, "digest_", "left_anti"),
        hot,
    )
    rows = base.join(shared, "digest_", "left_semi")
    groups = rows.groupBy("digest_", "norm_").agg(_rank(), F.count(F.lit(1)).alias("n_"))
    return alone.unionByName(rows.join(groups, ["digest_", "norm_"]).select("id_", "points_", "digest_", "best_", "n_"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with all columns of ``docs``."""
    kept = exact_groups(docs, id_col, text_col, **options).where("kept")
    keys = kept.select(
        F.col(id_col).alias("keep_id_"), F.col("points").alias("keep_points_"), F.unhex("text_sha256").alias("keep_digest_")
    )
    again = scratch.keep(keys, "dedup-kept")
    names = docs.columns
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row_"),
        F.col(id_col).cast("long").alias("row_id_"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("row_points_"),
        digest_of(normalised(F.col(text_col)), options.get("hex_digits", 64)).alias("row_digest_"),
    )
    on = (
        F.col("row_id_").eqNullSafe(F.col("keep_id_"))
        & (F.col("row_digest_") == F.col("keep_digest_"))
        & (F.col("row_points_") == F.col("keep_points_"))
    )
    rows = rows.join(again, on, "left_semi")
    if rows.select("row_id_").count() > again.count():  # ids that are repeated with their text
        rows = rows.dropDuplicates(["row_id_", "row_digest_"])
    return rows.select("row_.*")
