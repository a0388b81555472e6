"""Sharding 10: rendezvous hashing of stable record keys over weighted shards.

Every shard scores a key with -ln(u) / weight, u from a hash of key and shard; the least score wins (ties: the lower
shard). So a shard gets keys in proportion to its weight, key and shard list alone decide, and a shard that is added
takes keys only into itself. The law is ``key``: records with equal texts but different keys may part.

Slots number the records of a shard without gaps, in no special order. They come from ranks within buckets, as many as the records ask for, so no
task holds a whole shard. The records' sizes and shards are written once, without texts, and numbered there.

Edge cases: a null key is a key of its own; a null text has no bytes (size 16, CRC 0). Repeated rows go to the same
shard and take separate slots. A very long text is one record. Further columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, ranks_in_groups, salted, shared

SHARDS = 40
#: Bytes that a record takes besides its text.
OVERHEAD = 16


def score(key: Column, shard: Column, weight: Column) -> Column:
    """The shard's score for the key: exponential with rate ``weight``."""
    bits = F.shiftrightunsigned(F.xxhash64(F.coalesce(key.cast("string"), F.lit("\0null")), shard.cast("int")), 11)
    return -F.log((bits + F.lit(0.5)) * F.lit(2.0**-53)) / weight


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard, 0 to len(weights) - 1, of a key."""
    return best(key, weights)["s"]


def best(key: Column, weights: list[float]) -> Column:
    """The winning (score, s)."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    table = F.array(*(F.lit(float(w)) for w in weights))
    return F.array_min(F.transform(table, lambda w, s: F.struct(score(key, s, w).alias("score"), s.cast("int").alias("s"))))


def assign(df: DataFrame, key_col: str = "doc_id", weights: list[float] | None = None, *, name: str = "shard", grown: str | None = None, grown_weight: float = 1.0) -> DataFrame:
    """Adds the shard of each row and, if ``grown`` is given, its shard after one more shard. No shuffle."""
    weights = [1.0] * SHARDS if weights is None else weights
    won = free_name(df.columns, "won")
    out = df.withColumn(won, best(F.col(key_col), weights)).withColumn(name, F.col(f"{won}.s"))
    if grown:
        n = len(weights)
        rival = score(F.col(key_col), F.lit(n), F.lit(float(grown_weight)))
        out = out.withColumn(grown, F.when(rival < F.col(f"{won}.score"), F.lit(n)).otherwise(F.col(name)))
    return out.drop(won)


def manifest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", weights: list[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every record; texts are not shuffled."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    placed = assign(rows, "doc_id", weights, grown="grown_shard")
    ranked = ranks_in_groups(shared(salted(placed, "salt", "doc_id", "text_crc32", "size"), "records"), "shard", "salt", "slot")
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, *, key_col: str = "doc_id", weights: list[float] | None = None, files_per_shard: int = 1) -> None:
    """Writes the records as Parquet, a folder ``shard=N`` each; ``files_per_shard`` tasks share a shard."""
    placed = assign(docs, key_col, weights)
    part = F.pmod(F.xxhash64(F.col(key_col), F.lit("file")), F.lit(files_per_shard))
    placed.repartition(len(weights or [1.0] * SHARDS) * files_per_shard, F.col("shard"), part).write.partitionBy("shard").parquet(path)
