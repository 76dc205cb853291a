"""Encoding of event states: tagged JSON, compression, encryption, and notifications as text.

The write path is JSON, then compression, then encryption; the read path is the reverse.  JSON and
AES are expressions; Spark has no expression for zlib, so compression is an Arrow-batched function.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from collections.abc import Callable, Mapping
from datetime import datetime
from decimal import Decimal
from importlib import import_module
from uuid import UUID

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Transcoder:
    """JSON with tagged objects {"_type_": name, "_data_": data} for types that JSON lacks.

    An object is a tagged value only if these are its two keys.  An unknown tag and a type that is
    not registered raise TypeError.  Encoding is from outside in, decoding from inside out.
    """

    def __init__(self):
        self._by_type: dict[type, tuple[str, Callable]] = {}
        self._by_name: dict[str, Callable] = {}
        self.register(UUID, "uuid_hex", lambda x: x.hex, UUID)
        self.register(Decimal, "decimal_str", str, Decimal)
        self.register(datetime, "datetime_iso", datetime.isoformat, datetime.fromisoformat)

    def register(self, kind: type, name: str, encode: Callable, decode: Callable) -> None:
        """A later registration takes the place of an earlier one."""
        self._by_type[kind] = (name, encode)
        self._by_name[name] = decode

    def _tag(self, value: object) -> dict:
        if type(value) not in self._by_type:
            raise TypeError(f"{type(value).__name__} is not registered for encoding")
        name, encode = self._by_type[type(value)]
        return {"_type_": name, "_data_": encode(value)}

    def _untag(self, found: dict) -> object:
        if found.keys() != {"_type_", "_data_"}:
            return found
        if found["_type_"] not in self._by_name:
            raise TypeError(f"{found['_type_']} is not registered for decoding")
        return self._by_name[found["_type_"]](found["_data_"])

    def encode(self, value: object) -> bytes:
        return json.dumps(value, separators=(",", ":"), ensure_ascii=False, default=self._tag).encode()

    def decode(self, data: bytes) -> object:
        return json.loads(data, object_hook=self._untag)


def tagged(name: str, data: Column) -> Column:
    """A tagged value as a struct, for to_json."""
    return F.struct(F.lit(name).alias("_type_"), data.alias("_data_"))


def tag_data(state: Column, path: str, name: str) -> Column:
    """The data of the tagged value at a JSON path, null if what stands there is not tagged so."""
    is_tagged = F.get_json_object(state, f"{path}._type_") == name
    two_keys = F.size(F.json_object_keys(F.get_json_object(state, path))) == 2
    return F.when(is_tagged & two_keys, F.get_json_object(state, f"{path}._data_"))


def json_state(fields: Mapping[str, Column], class_version: int = 1) -> Column:
    """Fields as compact JSON; the class version is written if it is above 1.  Null fields are written."""
    own = [c.alias(n) for n, c in fields.items()]
    own += [F.lit(class_version).alias("class_version")] if class_version > 1 else []
    return F.to_json(F.struct(*own), {"ignoreNullFields": "false"})


def decimal_of(text: Column, scale: int = 2) -> Column:
    return text.cast(f"decimal(38,{scale})")


def timestamp_of(text: Column) -> Column:
    return text.cast("timestamp")


def iso_of(stamp: Column) -> Column:
    return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def _codec(module: str) -> tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]:
    found = zlib if module == "zlib" else import_module(module)
    return found.compress, found.decompress


def compress(data: Column, module: str = "zlib") -> Column:
    """Bytes compressed by a module with compress and decompress (zlib, gzip, bz2, lzma ...)."""

    @F.pandas_udf("binary")
    def packed(values: pd.Series) -> pd.Series:
        pack = _codec(module)[0]
        return values.map(lambda x: None if x is None else pack(bytes(x)))

    return packed(data)


def decompress(data: Column, module: str = "zlib") -> Column:
    @F.pandas_udf("binary")
    def unpacked(values: pd.Series) -> pd.Series:
        unpack = _codec(module)[1]
        return values.map(lambda x: None if x is None else unpack(bytes(x)))

    return unpacked(data)


def new_key(size: int = 32) -> str:
    """A random AES key of 16, 24 or 32 bytes, in base 64."""
    if size not in (16, 24, 32):
        raise ValueError(f"{size} is not a size of AES keys")
    return base64.b64encode(os.urandom(size)).decode()


def _key(key: str) -> Column:
    raw = base64.b64decode(key)
    if len(raw) not in (16, 24, 32):
        raise ValueError(f"{len(raw)} is not a size of AES keys")
    return F.lit(raw)


def encrypt(data: Column, key: str) -> Column:
    """AES-GCM as nonce, tag, ciphertext (Spark's own order is nonce, ciphertext, tag)."""
    spark_order = F.aes_encrypt(data, _key(key), F.lit("GCM"), F.lit("DEFAULT"))
    # The random nonce makes each evaluation differ, so the result is bound once, in a lambda.
    tag = lambda x: x.substr(F.length(x) - 15, F.lit(16))
    return F.transform(F.array(spark_order), lambda x: F.concat(F.substring(x, 1, 12), tag(x), x.substr(F.lit(13), F.length(x) - 28)))[0]


def decrypt(data: Column, key: str) -> Column:
    """Damaged data raise an error."""
    cipher = F.concat(F.substring(data, 1, 12), data.substr(F.lit(29), F.greatest(F.length(data) - 28, F.lit(0))), F.substring(data, 13, 16))
    return F.aes_decrypt(cipher, _key(key), F.lit("GCM"), F.lit("DEFAULT"))


def encode_state(state: Column, key: str | None = None, compressor: str | None = None) -> Column:
    out = F.encode(state, "UTF-8")
    out = compress(out, compressor) if compressor else out
    return encrypt(out, key) if key else out


def decode_state(data: Column, key: str | None = None, compressor: str | None = None) -> Column:
    out = decrypt(data, key) if key else data
    out = decompress(out, compressor) if compressor else out
    return F.decode(out, "UTF-8")


def notifications_as_json(log: DataFrame) -> DataFrame:
    """(notification_id, json): what a remote reader gets; ids as hex, states in base 64."""
    item = F.struct(
        F.col("notification_id").alias("id"), "originator_id", "originator_version", "topic", F.base64("state").alias("state")
    )
    return log.select("notification_id", F.to_json(item).alias("json"))


def notifications_from_json(rows: DataFrame, column: str = "json") -> DataFrame:
    """Inverse of notifications_as_json."""
    schema = "id long, originator_id string, originator_version long, topic string, state string"
    got = rows.select(F.from_json(column, schema).alias("x_"))
    return got.select(
        F.col("x_.id").alias("notification_id"), "x_.originator_id", "x_.originator_version", "x_.topic", F.unbase64("x_.state").alias("state")
    )


def sections_as_json(log: DataFrame, size: int = 10) -> DataFrame:
    """Whole sections as JSON, a row each: section_id, next_id and their items in order."""
    from eventlake.operators.reads import sections

    page = F.floor((F.col("notification_id") - 1) / size).cast("long")
    item = F.struct(F.col("notification_id").alias("id"), "originator_id", "originator_version", "topic", F.base64("state").alias("state"))
    items = log.groupBy(page.alias("section_no")).agg(F.array_sort(F.collect_list(item)).alias("items"))  # at most `size` rows each
    whole = items.join(sections(log, size), "section_no")
    return whole.select("section_id", F.to_json(F.struct(F.col("section_id").alias("id"), "next_id", "items"), {"ignoreNullFields": "false"}).alias("json"))
