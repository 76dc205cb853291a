"""Placing rows on shards through a permutation-filled lookup table.

Each shard has its own permutation of the slots of a prime-sized table.  The shards take turns,
each claiming the first slot of its permutation that is still free (as many in a turn as its
weight), until the table is full.  A key's slot is its hash modulo the table size, and its shard is
what stands there: constant time, near-even shares, and few moves when shards come or go.

The table depends on shard names, weights and size only.  It has ``size`` rows (65,537 by default,
under 1 MB; at most ``MAX_TABLE``) however large the data are; that bounds the broadcast, and the
driver's memory while the table is filled.

Defined results: a null key is placed like the empty string.  Equal keys share a shard, so repeated
rows do.  An empty table gives an empty result.  All columns stay, whatever their names, but for
shard_slot and shard, which are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TABLE = 1 << 20


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: list[str], size: int = 65_537, weights: list[int] | None = None) -> np.ndarray:
    """The shard's position in ``shards`` for each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each once")
    if not _is_prime(size) or not len(shards) <= size <= MAX_TABLE:
        raise ValueError(f"size must be a prime from the number of shards to {MAX_TABLE}")
    weights = weights or [1] * len(shards)
    if len(weights) != len(shards) or min(weights) < 0 or not any(weights):
        raise ValueError("weights must be counts, one for each shard, not all zero")
    # Slot j of shard i's permutation is (offset_i + j * skip_i) mod size; size is prime, so all slots occur.
    # Only the next slot of each is held, so memory is that of the table however many shards there are.
    at = [_hash(s, "offset") % size for s in shards]
    skip = [_hash(s, "skip") % (size - 1) + 1 for s in shards]
    table, free = [-1] * size, size
    while True:
        for i, turns in enumerate(weights):
            for _ in range(turns):
                slot, step = at[i], skip[i]
                while table[slot] >= 0:
                    slot = (slot + step) % size
                table[slot], at[i] = i, slot
                free -= 1
                if not free:
                    return np.array(table, np.int32)


def slot_of(key: Column, size: int) -> Column:
    """The slot of a key: 60 bits of the MD5 of its text, modulo the table size."""
    digits = F.substring(F.md5(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")), 1, 15)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(size)).cast("int")


def place(rows: DataFrame, key_col: str, shards: list[str], size: int = 65_537, weights: list[int] | None = None) -> DataFrame:
    """``rows`` with the columns shard_slot and shard; columns of these names are replaced."""
    table = pd.DataFrame({"slot_": np.arange(size, dtype=np.int32), "shard_": lookup_table(shards, size, weights)})
    lookup = rows.sparkSession.createDataFrame(table, "slot_ int, shard_ int")
    names = F.array(*[F.lit(s) for s in shards])
    own = [c for c in rows.columns if c not in ("shard_slot", "shard")]
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row_"), slot_of(F.col(f"`{key_col}`"), size).alias("slot_"))
    placed = packed.join(F.broadcast(lookup), "slot_")
    return placed.select("row_.*", F.col("slot_").alias("shard_slot"), F.element_at(names, F.col("shard_") + 1).alias("shard"))
