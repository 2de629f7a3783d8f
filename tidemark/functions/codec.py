"""Binary codec of entries, in built-in functions.

An entry is ``key length (2 bytes), key, seqno (8), value type (1), value length (4), value``, all
numbers big-endian; an internal key stops after the value type. Keys longer than 65,535 bytes raise
an error instead of wrapping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import MAX_KEY_BYTES, checked_value_type

#: Bytes around the key, and around key and value.
KEY_EXTRA, ENTRY_EXTRA = 11, 15


def _number(value: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))


def _unnumber(data: Column, start: Column, size: int) -> Column:
    return F.conv(F.hex(F.substring(data, start, F.lit(size))), 16, -10).cast("long")


def _payload() -> Column:
    return F.coalesce(F.col("value").cast("binary"), F.unhex(F.lit("")))


def encoded_size() -> Column:
    return F.octet_length("user_key") + F.octet_length(_payload()) + ENTRY_EXTRA


def encoded_key_size() -> Column:
    return F.octet_length("user_key") + KEY_EXTRA


def encode_key() -> Column:
    """Bytes of the internal key (user_key, seqno, value_type)."""
    key = F.col("user_key").cast("binary")
    too_long = F.raise_error(F.lit("key longer than 65535 bytes")).cast("binary")
    head = F.when(F.octet_length(key) <= MAX_KEY_BYTES, _number(F.octet_length(key), 2)).otherwise(too_long)
    return F.concat(head, key, _number(F.col("seqno"), 8), _number(F.col("value_type"), 1))


def encode_entry() -> Column:
    """Bytes of the whole entry; a tombstone's null value is written as empty."""
    return F.concat(encode_key(), _number(F.octet_length(_payload()), 4), _payload())


def decode_key(data: Column) -> Column:
    """Struct (user_key, seqno, value_type, used), or null if the bytes are too few or the value
    type is unknown."""
    n = F.octet_length(data)
    k = F.when(n >= 2, _unnumber(data, F.lit(1), 2)).cast("int")
    kind = F.when(n >= k + KEY_EXTRA, _unnumber(data, k + 11, 1))
    out = F.struct(
        F.substring(data, F.lit(3), k).alias("user_key"),
        _unnumber(data, k + 3, 8).alias("seqno"),
        kind.cast("int").alias("value_type"),
        (k + KEY_EXTRA).alias("used"),
    )
    return F.when((n >= k + KEY_EXTRA) & kind.isin(0, 1), out)


def decode_entry(data: Column) -> Column:
    """Struct (user_key, seqno, value_type, value, used), or null if the bytes do not hold one."""
    key = decode_key(data)
    at = key["used"]
    n = F.when(F.octet_length(data) >= at + 4, _unnumber(data, at + 1, 4))
    out = F.struct(
        key["user_key"].alias("user_key"),
        key["seqno"].alias("seqno"),
        key["value_type"].alias("value_type"),
        F.substring(data, at + 5, n.cast("int")).alias("value"),
        (at + 4 + n).cast("int").alias("used"),
    )
    return F.when(F.octet_length(data) >= at + 4 + n, out)


def strict_value_type(code: Column) -> Column:
    """0 or 1, anything else is an error."""
    return checked_value_type(code)
