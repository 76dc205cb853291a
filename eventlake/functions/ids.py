"""Ids made from names, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"  # fixed value of RFC 9562


def uuid5(name: Column, namespace: str = NAMESPACE_URL) -> Column:
    """The version-5 UUID of a name, as 32 hex digits."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15))


def uuid_hex(text: Column) -> Column:
    """A UUID in any usual spelling as 32 lower-case hex digits."""
    return F.regexp_replace(F.lower(text), "[-{}]|^urn:uuid:", "")


def slug_id(slug: Column) -> Column:
    """Id of the index entry of a slug."""
    return uuid5(F.concat(F.lit("/slugs/"), slug))


def new_id() -> Column:
    return F.regexp_replace(F.uuid(), "-", "")
