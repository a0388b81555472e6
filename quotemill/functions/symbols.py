"""Symbols of eight bytes, their hash and their shard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The hash's start and factor, the symbol's length, the most shards.
HASH_START, HASH_FACTOR, SYMBOL_BYTES, MOST_SHARDS = 1469598103934665603, 1099511628211, 8, 16
_MOD = 1 << 64


def hash_text(symbol: str) -> int:
    """The unsigned 64-bit hash of one padded symbol, outside of Spark."""
    h = HASH_START
    for b in symbol.encode("latin-1", "replace")[:SYMBOL_BYTES].ljust(SYMBOL_BYTES, b"\0"):
        h = (h ^ b) * HASH_FACTOR % _MOD
    return h


def make_symbol(name: Column) -> Column:
    """Eight characters: cut, or padded with NUL."""
    return F.rpad(F.substring(name, 1, SYMBOL_BYTES), SYMBOL_BYTES, "\0")


def symbol_view(symbol: Column) -> Column:
    """The symbol up to its first NUL."""
    return F.substring_index(symbol, "\0", 1)


def symbol_hash(symbol: Column) -> Column:
    """The unsigned 64-bit hash of the padded symbol, as DECIMAL(20,0).

    A signed product would overflow, so the steps are taken in decimals, on high and low halves: this is for
    distinct symbols (``add_shard``), not for every message.
    """
    digits = F.hex(F.encode(make_symbol(symbol), "ISO-8859-1"))
    wide = lambda c: c.cast("decimal(38,0)")
    whole = F.transform(F.sequence(F.lit(0), F.lit(SYMBOL_BYTES - 1)), lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("int"))

    def step(h: Column, byte: Column) -> Column:
        low = F.pmod(h, wide(F.lit(256))).cast("int")
        mixed = (h - wide(low) + wide(low.bitwiseXOR(byte))).cast("decimal(21,0)")
        return wide(F.pmod(wide(mixed * F.lit(HASH_FACTOR).cast("decimal(16,0)")), wide(F.lit(str(_MOD)))))

    return F.when(symbol.isNotNull(), F.aggregate(whole, wide(F.lit(HASH_START)), step)).cast("decimal(20,0)")


def shard_of(symbol: Column, shards: int) -> Column:
    """hash modulo shards."""
    if not 1 <= shards <= MOST_SHARDS:
        raise ValueError(f"shards must be from 1 to {MOST_SHARDS}")
    return F.pmod(symbol_hash(symbol), F.lit(shards).cast("decimal(20,0)")).cast("int")


def add_shard(df: DataFrame, shards: int, symbol: str = "symbol") -> DataFrame:
    """Adds the shard of each row's symbol, hashed once per distinct symbol. Null symbols have no shard."""
    dim = df.select(F.col(symbol).alias("_symbol")).distinct().withColumn("shard", shard_of(F.col("_symbol"), shards))
    return df.join(dim, F.col(symbol) == F.col("_symbol"), "left").drop("_symbol")
