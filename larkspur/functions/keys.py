"""Keys, shards, checksums and JSON fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hexadecimal digits of a key, and of a shard's name.
KEY_DIGITS, SHARD_DIGITS = 32, 2


def url_key(url: Column) -> Column:
    """The first half of a URL's SHA-256, in hexadecimal digits."""
    return F.substring(F.sha2(url, 256), 1, KEY_DIGITS)


def shard_of(key: Column) -> Column:
    """The shard of a key: its first two digits, as a number from 0 to 255."""
    return F.conv(F.substring(key, 1, SHARD_DIGITS), 16, 10).cast("int")


def shard_name(shard: Column) -> Column:
    return F.lpad(F.lower(F.hex(shard)), SHARD_DIGITS, "0")


def bucket_of(key: Column, buckets: int) -> Column:
    """The slot a fixed table of so many buckets starts to look in: the key's first eight bytes, little-endian, as an unsigned number, modulo buckets."""
    digits = F.substring(key, 1, 16)
    turned = F.concat(*[F.substring(digits, i, 2) for i in range(15, 0, -2)])
    high, low = (F.conv(F.substring(turned, i, 8), 16, 10).cast("long") for i in (1, 9))
    return ((high % buckets) * ((1 << 32) % buckets) + low) % buckets


def json_field(document: Column, name: str, default: Column | None = None) -> Column:
    """A field of a JSON object as text, or the default if it is missing or the document isn't JSON."""
    value = F.get_json_object(document, f"$.{name}")
    return value if default is None else F.coalesce(value, default)


def is_filled(metadata: Column) -> Column:
    """True for JSON objects with a key."""
    return F.coalesce(F.size(F.json_object_keys(metadata)) > 0, F.lit(False))


def checksum(content: Column) -> Column:
    return F.md5(content.cast("binary"))


def crc(content: Column) -> Column:
    return F.crc32(content.cast("binary"))
