"""The whole pipeline over a batch: packets to messages, routes, gaps, books and deltas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codec import decode
from ..operators import gaps as gap_ops
from ..operators import levels as level_ops
from ..operators import lifecycle, retention
from ..operators.lineage import with_lineage


@dataclass(frozen=True)
class Batch:
    """What a batch comes to; every part is a plan that runs when it is used (deltas and gaps write what they read twice when they are asked for).

    Parts share the fold. Use ``persisted`` if several of them are wanted.
    """

    folded: DataFrame  # messages with symbol, shard, error, legs
    undecodable: DataFrame | None = None

    def persisted(self) -> Batch:
        """The same with the fold kept; a lost executor's part is computed anew."""
        return Batch(self.folded.persist(), self.undecodable)

    @property
    def routed(self) -> DataFrame:
        return lifecycle.observed(self.folded)

    @property
    def rejects(self) -> DataFrame:
        out = lifecycle.rejects_of(self.folded)
        if self.undecodable is not None:
            out = out.unionByName(self.undecodable.select("arrival_no", F.lit("decode").alias("stage"), F.col("decode_error").alias("reason")))
        return out

    @property
    def gaps(self) -> DataFrame:
        """Every routed message as its shard's detector sees it."""
        return gap_ops.classify(self.routed.select("arrival_no", "shard", "seq_num"))

    @property
    def legs(self) -> DataFrame:
        return lifecycle.legs_of(self.folded)

    @property
    def deltas(self) -> DataFrame:
        return level_ops.deltas(self.legs)

    @property
    def levels(self) -> DataFrame:
        return level_ops.levels(self.legs)

    @property
    def resting(self) -> DataFrame:
        return lifecycle.resting_orders(self.folded)


@dataclass(frozen=True)
class Queues:
    """A bounded queue before each shard, drained after every ``burst`` arrivals; the newest ``capacity`` messages in between stay.

    Which messages overflow is decided on the routes that the pipeline without queues finds. An evicted message is routed, but neither observed nor
    applied: it shows as a sequence gap, and what follows an evicted add finds no order.
    """

    capacity: int = retention.CAPACITY
    burst: int = retention.CAPACITY


def run_messages(messages: DataFrame, shards: int = 4, key: str | list[str] | None = None, *, queues: Queues | None = None, trace: bool = False) -> Batch:
    """The pipeline over decoded messages. ``key``: a column that holds lineages whole; without one they are searched for. ``trace``: with the clock of each step."""
    if key is None:
        messages, key = with_lineage(messages), "lineage"
    if queues:
        seen = lifecycle.observed(lifecycle.fold(messages, key, shards=shards)).select("arrival_no", "shard")
        marked = retention.overflow(seen, ["shard"], capacity=queues.capacity, burst=queues.burst).filter("evicted").select("arrival_no", "evicted")
        messages = messages.join(marked, "arrival_no", "left").withColumn("evicted", F.coalesce("evicted", F.lit(False)))
    return Batch(lifecycle.fold(messages, key, shards=shards, trace=trace))


def run_packets(packets: DataFrame, shards: int = 4, key: str | None = None, *, queues: Queues | None = None, trace: bool = False) -> Batch:
    """The pipeline over (arrival_no, raw): lost packets are null, and leave no trace but their number."""
    decoded = decode(packets.filter(F.col("raw").isNotNull()))
    good = decoded.filter(F.col("decode_error").isNull())
    batch = run_messages(good, shards, key, queues=queues, trace=trace)
    return Batch(batch.folded, decoded.filter(F.col("decode_error").isNotNull()))
