"""What several text operators share: words, Arrow slices, ranks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import free_name, importable, shared, unshare

__all__ = ["Ids", "as_bytes", "free_name", "importable", "join_hot", "parted", "ranks_in_groups", "salted", "shared", "steps", "unshare", "words_of"]

#: Bytes of text that one vectorised step works on; longer single texts make a step of their own.
STEP_BYTES = 2 << 20


class Ids(dict):
    """Numbers words 0, 1, 2, ... as they are first met."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def words_of(text: bytes | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text, unchanged; none of a null."""
    return text.split() if text else []


def steps(batches: Iterable[pa.RecordBatch], column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices the batches so that each slice holds at most ``most`` bytes of ``column``, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def as_bytes(name: str) -> Column:
    """The column's UTF-8 bytes, so that Python splits without decoding."""
    return F.col(name).cast("binary")


# ---- ranks within groups, without one task per group ----

#: Rows of one bucket of ranks, about; buckets that a table has at least, so that a table of any size is the work of many tasks.
PER_BUCKET, LEAST_BUCKETS = 1_000_000, 64


def salted(df: DataFrame, name: str, *key: str) -> DataFrame:
    """Adds a hash of the key that differs among equal rows too. Write the rows before they are shuffled: then each has one salt, whatever is lost and run again."""
    return df.withColumn(name, F.xxhash64(*key, F.monotonically_increasing_id()))


def ranks_in_groups(table: DataFrame, group: str, salt: str, name: str, per_bucket: int = PER_BUCKET) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... within each ``group``, gapless, in any order; drops the salt.

    ``table`` is written, with a salt (see ``salted``). Rows of a group are spread by it over as many buckets as the table's size asks for; each bucket is
    ranked alone and starts after the counts of the buckets before it. So neither a group that holds a third of all rows nor repeated
    rows are the work of one task. The counts are at most groups x buckets rows.
    """
    b, n, base = (free_name(table.columns, x) for x in ("bucket", "count", "base"))
    buckets = max(LEAST_BUCKETS, -(-table.count() // per_bucket))
    spread = table.withColumn(b, F.pmod(F.col(salt), F.lit(buckets)))
    counts = spread.groupBy(group, b).agg(F.count(F.lit(1)).alias(n))
    bases = counts.withColumn(base, F.sum(n).over(Window.partitionBy(group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1))).select(
        F.col(group).alias(f"__{group}"), F.col(b).alias(f"__{b}"), F.coalesce(base, F.lit(0)).alias(base))
    local = spread.withColumn(name, F.row_number().over(Window.partitionBy(group, b).orderBy(salt)).cast("long") - 1)
    out = local.join(bases, (F.col(group) == F.col(f"__{group}")) & (F.col(b) == F.col(f"__{b}")))
    return out.withColumn(name, F.col(name) + F.col(base)).drop(b, base, f"__{group}", f"__{b}", salt)


# ---- joins whose keys may be hot ----

#: Keys that may be broadcast with what belongs to them are fewer than this.
HOT = 1000


def join_hot(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, hot: int = HOT) -> DataFrame:
    """``rows`` with what ``table`` holds for their ``key``; a row without it goes.

    ``rows`` is written; ``table`` has one row for each key, and in ``count`` how many of the ``total`` rows have it; that column goes too. Keys of more than one in ``hot`` rows are fewer
    than ``hot``, so they are broadcast: a group that holds a third of all rows is joined where its rows are. Only the others are shuffled.
    """
    own = free_name([*rows.columns, *table.columns], "own_key")
    named, often = table.withColumnRenamed(key, own), F.col(count) * hot > total
    few = F.broadcast(named.filter(often).drop(count))
    here = rows.join(few, F.col(key) == F.col(own))
    others = rows.join(F.broadcast(few.select(own)), F.col(key) == F.col(own), "left_anti").join(named.filter(~often).drop(count), F.col(key) == F.col(own))
    return here.unionByName(others).drop(own)


# ---- joins that few rows need ----

#: Bits of what ``parted`` broadcasts: 131,072 rows of two longs at most, whatever the tables' sizes.
SLOTS = 1 << 23


def parted(rows: DataFrame, key: Column, table: DataFrame, table_key: Column, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two parts: those whose ``key`` (a long) may be in ``table``, and those whose key surely isn't, which need no join with it. No shuffle of rows.

    A Bloom filter with one hash: a table of 64-bit words is broadcast. Of n keys, n / slots of the other rows are taken for members, so they only meet a join that they don't need.
    """
    at, bits, word = (free_name(rows.columns, x) for x in ("slot_word", "slot_bits", "own_word"))
    slot = lambda k: F.pmod(F.xxhash64(k), F.lit(slots))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), slot(k).bitwiseAND(F.lit(63)).cast("int"))
    words = table.select(F.shiftright(slot(table_key), 6).alias(at), bit(table_key).alias(bits)).groupBy(at).agg(F.bit_or(bits).alias(bits))
    marked = rows.withColumn(word, F.shiftright(slot(key), 6)).join(F.broadcast(words), F.col(word) == F.col(at), "left")
    may = F.coalesce(F.col(bits).bitwiseAND(bit(key)), F.lit(0)) != 0
    return tuple(marked.filter(x).select(*rows.columns) for x in (may, ~may))
