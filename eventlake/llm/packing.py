"""Packing documents into training windows by minimum bin slack.

Every document's ids, closed by ``end_id``, are cut into full windows and one tail.  A full window
is a sequence by itself.  Tails differ only by their length, so the search for fillings works on a
histogram of at most ``window`` lengths: the largest tail left is set in a window, a bitset
subset-sum dynamic program over the multiset of remaining lengths finds the sum closest to the
capacity, and counts are backtracked from its prefixes.  The filling is repeated as often as the
counts allow.  If a filling leaves slack, the next tail is cut to close it and its rest goes back
to the multiset, so at most the very last sequence is padded.

The plan names ranks within a length, not documents.  Its size depends on the window only, so it is
planned on the driver and broadcast; documents find their sequences by length and rank in a
distributed join.  Ranks come from counters per task and prefix sums over tasks.

Defined results: null and empty texts are the end id alone.  Repeated rows are packed each for
itself.  A null id stays null.  Other columns are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlake.llm.memory import released
from eventlake.llm.tokens import default_path, tokenizer
from eventlake.plans import scratch

_ROWS = "part_ int, row_ long, id_ string, tokens_ long, crcs_ array<long>, tail_ int, rank_ long, full_ long, ids_ binary"
_PLAN = "length_ int, lo_ long, hi_ long, a_ int, b_ int, seq_ long, at_ int, each_ int, t0_ long"


MOST_BROADCAST = 1 << 18


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, with the largest that is left, whose sum comes closest to capacity."""
    first = max(counts)
    room = capacity - first
    mask = (1 << (room + 1)) - 1
    reach, prefixes = 1, []  # bit s: the sum s can be made from the lengths so far
    for length in sorted(counts, reverse=True):
        left = counts[length] - (length == first)
        most = min(left, room // length)
        if most <= 0:
            continue
        prefixes.append((length, most, reach))
        step = 1
        while most > 0:  # a bounded count by doubling
            take = min(step, most)
            reach |= (reach << (take * length)) & mask
            most, step = most - take, step * 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    chosen = {first: 1}
    for length, most, before in reversed(prefixes):
        used = next(j for j in range(most + 1) if total >= j * length and before >> (total - j * length) & 1)
        if used:
            chosen[length] = chosen.get(length, 0) + used
            total -= used * length
    return chosen


def plan(histogram: dict[int, int], window: int) -> tuple[list[tuple], int]:
    """(rows of the plan, number of sequences) for tails of these lengths.

    A row says: of the tails of length_, those ranked [lo_, hi_) give the ids [a_, b_) to sequence
    seq_ + t // each_ at at_ + t % each_ * (b_ - a_), where t = t0_ + rank - lo_.
    """
    counts = {k: n for k, n in histogram.items() if n > 0}
    stock = {k: deque([(k, 0, n, 0, k)]) for k, n in counts.items()}
    rows: list[tuple] = []
    sequences = 0

    def take(length: int, pieces: int) -> Iterator[tuple]:
        counts[length] -= pieces
        if not counts[length]:
            del counts[length]
        while pieces:
            origin, lo, hi, a, b = stock[length].popleft()
            n = min(pieces, hi - lo)
            if lo + n < hi:
                stock[length].appendleft((origin, lo + n, hi, a, b))
            pieces -= n
            yield origin, lo, lo + n, a, b

    while counts:
        chosen = fill(counts, window)
        slack = window - sum(k * n for k, n in chosen.items())
        need, cut = dict(chosen), None
        if slack:
            spare = [k for k in counts if counts[k] > chosen.get(k, 0)]
            if spare:
                cut = max(spare)
                need[cut] = need.get(cut, 0) + 1
        times = min(counts[k] // n for k, n in need.items())
        at = 0
        for length, n in sorted(chosen.items(), reverse=True):
            t0 = 0
            for origin, lo, hi, a, b in take(length, times * n):
                rows.append((origin, lo, hi, a, b, sequences, at, n, t0))
                t0 += hi - lo
            at += n * length
        if cut:
            t0, rest = 0, cut - slack
            for origin, lo, hi, a, b in list(take(cut, times)):
                rows.append((origin, lo, hi, a, a + slack, sequences, at, 1, t0))
                stock.setdefault(rest, deque()).append((origin, lo, hi, a + slack, b))
                counts[rest] = counts.get(rest, 0) + hi - lo
                t0 += hi - lo
        sequences += times
    return rows, sequences


def _tokenised(docs: DataFrame, id_col: str, text_col: str, window: int, path: str, end_id: int, cached_words: int) -> DataFrame:
    """A row per document with its checksums of natural pieces, its tail and its counters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), tokenizer(path, entries=cached_words).encode
        end, of_length, full, row = np.array([end_id], "<u4").tobytes(), [0] * window, 0, 0
        for batch in batches:
            out = []
            for id_, text in zip(batch["id_"], batch["text_"], strict=True):
                ids = memoryview(encode(text) + end)
                n = len(ids) // 4
                crcs = [zlib.crc32(ids[4 * a : 4 * min(a + window, n)]) for a in range(0, n, window)]
                tail = n % window
                kept = np.frombuffer(ids[4 * (n - tail) :], "<u4")
                kept = kept.astype("<u2") if not tail or kept.max() < 65_536 else kept  # two bytes an id where they do
                out.append((part, row, id_, n, crcs, tail, of_length[tail], full, kept.tobytes()))
                of_length[tail] += 1
                full, row = full + n // window, row + 1
            frame = pd.DataFrame(out, columns=["part_", "row_", "id_", "tokens_", "crcs_", "tail_", "rank_", "full_", "ids_"])
            yield frame

    # The id goes as text, as pandas has no long that may be null.
    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("id_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    return rows.mapInPandas(released(run, words=True), _ROWS).withColumn("id_", F.col("id_").cast("long"))


def _cut_checksums(rows: DataFrame) -> DataFrame:
    """crc_ of the ids [a_, b_) of the tail in ids_."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            crcs = []
            for ids, tail, a, b in zip(batch["ids_"], batch["tail_"], batch["a_"], batch["b_"], strict=True):
                wide = np.frombuffer(ids, "<u2" if len(ids) == 2 * tail else "<u4")[a:b].astype("<u4")
                crcs.append(zlib.crc32(wide.tobytes()))
            yield batch.drop(columns=["ids_"]).assign(crc_=np.array(crcs, np.int64))

    found = rows.withColumn("id_", F.col("id_").cast("string")).mapInPandas(released(run, words=True), "id_ string, tokens_ long, tail_ int, a_ int, b_ int, sequence_id long, offset long, crc_ long")
    return found.withColumn("id_", F.col("id_").cast("long"))


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 2048,
    tokenizer_path: str | None = None,
    end_id: int = 1,
    cached_words: int = 800_000,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.  A worker caches ``cached_words`` words, which the result does not depend on."""
    spark = docs.sparkSession
    rows = scratch.keep(_tokenised(docs, id_col, text_col, window, tokenizer_path or default_path(), end_id, cached_words), "pack-rows", batch_rows=500)

    by_part = scratch.keep(rows.groupBy("part_", "tail_").agg(F.count(F.lit(1)).alias("n_"), F.sum(F.expr(f"tokens_ div {window}")).alias("f_")), "pack-counts")
    histogram = {r["tail_"]: r["n_"] for r in by_part.groupBy("tail_").agg(F.sum("n_").alias("n_")).collect()}  # at most `window` rows
    histogram.pop(0, None)
    planned, sequences = plan(histogram, window)
    plan_rows = spark.createDataFrame(pd.DataFrame(planned, columns=[c.split()[0] for c in _PLAN.split(", ")]), _PLAN) if planned else spark.createDataFrame([], _PLAN)
    if len(planned) <= MOST_BROADCAST:  # follows from the window; beyond it the join is left to the planner
        plan_rows = F.broadcast(plan_rows)

    before = Window.partitionBy("tail_").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    tail_from = by_part.select("part_", "tail_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("rank_from_"))
    parts = by_part.groupBy("part_").agg(F.sum("f_").alias("f_"))  # a row per input partition
    full_before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    full_from = parts.select("part_", F.coalesce(F.sum("f_").over(full_before), F.lit(0)).alias("full_from_"))

    whole = (
        rows.where(F.col("tokens_") >= window)
        .select("part_", "id_", "tokens_", "full_", F.slice("crcs_", F.lit(1), F.expr(f"int(tokens_ div {window})")).alias("crcs_"))
        .join(full_from, "part_")
        .select("id_", "tokens_", "full_", "full_from_", F.posexplode("crcs_").alias("k_", "crc_"))
        .select(
            F.col("id_").alias(id_col), (F.col("k_").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"),
            F.col("crc_").alias("ids_crc32"), F.col("tokens_").alias("doc_tokens"),
            (F.col("full_") + F.col("full_from_") + F.col("k_") + sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        )
    )

    t = F.col("t0_") + F.col("rank_") - F.col("lo_")
    placed = (
        rows.where(F.col("tail_") > 0)
        .select("part_", "row_", "id_", "tokens_", "tail_", "rank_", F.element_at("crcs_", -1).alias("crc_"))
        .join(tail_from, ["part_", "tail_"])
        .withColumn("rank_", F.col("rank_") + F.col("rank_from_"))
        .join(plan_rows, (F.col("tail_") == F.col("length_")) & (F.col("rank_") >= F.col("lo_")) & (F.col("rank_") < F.col("hi_")))
        .withColumn("sequence_id", F.col("seq_") + F.floor(t / F.col("each_")))
        .withColumn("offset", (F.col("at_") + F.pmod(t, F.col("each_")) * (F.col("b_") - F.col("a_"))).cast("long"))
    )
    uncut = placed.where((F.col("a_") == 0) & (F.col("b_") == F.col("tail_"))).select(
        "id_", "tokens_", "tail_", "a_", "b_", "sequence_id", "offset", "crc_"
    )
    pieces = uncut
    cut_lengths = sorted({r[0] for r in planned if r[4] - r[3] < r[0]})
    if cut_lengths:
        cut = placed.where((F.col("a_") > 0) | (F.col("b_") < F.col("tail_"))).select(
            "part_", "row_", "id_", "tokens_", "tail_", "a_", "b_", "sequence_id", "offset"
        )
        ids = rows.where(F.col("tail_").isin(cut_lengths)).select("part_", "row_", "ids_")
        pieces = pieces.unionByName(_cut_checksums(cut.join(ids, ["part_", "row_"]).drop("part_", "row_")))
    tails = pieces.select(
        F.col("id_").alias(id_col), (F.col("tokens_") - F.col("tail_") + F.col("a_")).alias("start"),
        (F.col("b_") - F.col("a_")).cast("long").alias("length"), F.col("crc_").alias("ids_crc32"),
        F.col("tokens_").alias("doc_tokens"), "sequence_id", "offset",
    )
    return whole.unionByName(tails)
