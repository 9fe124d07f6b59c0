"""Membership in key sets too large to broadcast: a bitmap of key hashes first, the exact join after.

A bitmap of fixed size goes to the scans. Rows whose key's bit is not set cannot be members
and are dropped there, before any shuffle; the others, members and a known share of chance
hits, take the exact semi join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from .keys import KEY, distinct_keys

#: Bits of the bitmap as a power of two: 2 ** 27 are 16 MB, whatever the number of keys.
BITS = 27


def _position(key: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << bits))


def key_bitmap(keys: DataFrame, key: str = KEY, bits: int = BITS) -> DataFrame:
    """bucket, bitmap: the set bits of the keys' hashes, 32,768 to a row; NULL sets none.

    Written to the shared folder once, to be used by several scans.
    """
    place = keys.where(F.col(key).isNotNull()).select(_position(key, bits).alias("_at"))
    maps = place.groupBy(F.bitmap_bucket_number("_at").alias("bucket"))
    return stored(maps.agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("bitmap")), "key_bitmap")


def _marked(df: DataFrame, bitmap: DataFrame, key: str, bits: int) -> DataFrame:
    """The rows whose key's bit is set, with ``_bucket`` of the bitmap's row."""
    at = _position(key, bits)
    small = F.broadcast(bitmap.select(F.col("bucket").alias("_bucket"), "bitmap"))  # at most 2 ** bits / 8 bytes
    placed = df.select(*df.columns, at.alias("_at"))
    joined = placed.join(small, F.bitmap_bucket_number("_at") == F.col("_bucket"))
    bit = F.bitmap_bit_position("_at")
    byte = F.conv(F.hex(F.substring("bitmap", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return joined.where(F.getbit(byte, (bit % 8).cast("int")) == 1).select(*df.columns, "_bucket")


def possible_members(df: DataFrame, bitmap: DataFrame, key: str = KEY, bits: int = BITS) -> DataFrame:
    """Rows whose key's bit is set: every member, and others in the share of bits that are set."""
    return _marked(df, bitmap, key, bits).drop("_bucket")


def restrict_large(df: DataFrame, keys: DataFrame, key: str = KEY, bitmap: DataFrame | None = None, bits: int = BITS) -> DataFrame:
    """Rows whose key is in the set, exactly, like ``restrict``; rows of other keys are dropped at the scan."""
    bitmap = key_bitmap(keys, key, bits) if bitmap is None else bitmap
    members = distinct_keys(keys, key).withColumn("_bucket", F.bitmap_bucket_number(_position(key, bits)))
    # a key column of either side of the join above: Spark would else move the semi join below the bitmap
    return _marked(df, bitmap, key, bits).join(members, [key, "_bucket"], "left_semi").drop("_bucket")
