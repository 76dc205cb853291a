"""Which aggregates a commit may hold: one mark of ``SIZE`` for each id, by its hash.

Two commits without a common mark have no common id.  A commit with very many aggregates would have
nearly all marks; it is noted as holding any.
"""

from __future__ import annotations

import base64
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, MOST = 1 << 22, 1 << 14


def of(rows: DataFrame) -> str | None:
    """The marks of the rows' ids as text; None if there are more than ``MOST``, which bounds an entry."""
    found = rows.select(F.pmod(F.xxhash64("originator_id"), F.lit(SIZE)).cast("int").alias("m")).distinct().limit(MOST + 1).collect()
    if len(found) > MOST:
        return None
    data = b"".join(m.to_bytes(4, "little") for m in sorted(r["m"] for r in found))
    return base64.b64encode(zlib.compress(data)).decode()


def _read(text: str) -> set[int]:
    data = zlib.decompress(base64.b64decode(text))
    return {int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data), 4)}


def intersects(a: str | None, b: str | None) -> bool:
    """False only if no id can be in both."""
    return a is None or b is None or not _read(a).isdisjoint(_read(b))
