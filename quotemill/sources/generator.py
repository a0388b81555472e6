"""A seeded feed of encoded messages as a Spark data source, for batches and streams.

    spark.dataSource.register(FeedSource)
    spark.read.format("order_feed").option("symbols", "AAPL,MSFT").option("messages", 5000).load()

Shards are dealt out to channels, and a channel carries the symbols of its shards, so a shard's sequence numbers are in one channel; rows are (channel,
arrival_no, raw), raw null where the packet was lost. Channels take turns in arrival.

A channel is made in blocks of ``BLOCK`` messages. A block is known from the seed, the channel and its number alone: it names only orders that it added itself,
ids follow from a message's position, and each full block has the same number of messages of each symbol, so
sequence numbers before it are known too. So any range of a feed is generated at once, by as many tasks as it has blocks, and a stream's offset, a position, is all the
state that a restart needs.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..functions import wire
from ..functions.symbols import MOST_SHARDS, hash_text

# The shares of adds, cancels, executes and replaces.
MIX = {wire.ADD: 0.50, wire.CANCEL: 0.15, wire.EXECUTE: 0.20, wire.REPLACE: 0.15}
SCHEMA = "channel int, arrival_no long, raw binary"
#: Messages of a block; blocks of one task.
BLOCK, BLOCKS_PER_TASK = 8192, 8
#: Nanoseconds of the first message, and between messages.
EPOCH, TICK = 1_700_000_000_000_000_000, 1_000


@dataclass(frozen=True)
class Block:
    """Some consecutive messages of a channel."""

    kind: np.ndarray
    fields: dict[str, np.ndarray]
    lost: np.ndarray

    def packets(self) -> pa.Array:
        return wire.pack(self.kind, self.fields, ~self.lost)


@dataclass(frozen=True)
class Feed:
    """One channel's generator."""

    symbols: tuple[str, ...]
    shards: int = 4
    messages: int = 1000
    loss: float = 0.0
    seed: int = 0
    channel: int = 0
    first_id: int = 1
    block: int = BLOCK

    def __post_init__(self) -> None:
        if not self.symbols or not 1 <= self.shards <= MOST_SHARDS or not 0 <= self.loss <= 1:
            raise ValueError(f"a feed needs symbols, 1 to {MOST_SHARDS} shards and a loss from 0 to 1")

    @property
    def blocks(self) -> int:
        return -(-self.messages // self.block)

    def make(self, number: int) -> Block:
        """The block of this number; the generator's own orders know nothing of losses."""
        draw = np.random.Generator(np.random.Philox(key=[self.seed, self.channel], counter=[0, 0, 0, number]))
        size, begin = self.block, number * self.block
        count = min(size, self.messages - begin)
        turns = np.arange(size) % len(self.symbols)
        book = draw.permutation(turns)[:count]
        kind = draw.choice(list(MIX), size, p=list(MIX.values()))[:count]
        which = draw.random(size)[:count]
        side, price = draw.integers(0, 2, size)[:count], 5_000 + 250 * book + draw.integers(-40, 41, size)[:count]
        added, executed = draw.integers(1, 400, size)[:count], draw.integers(1, 120, size)[:count]
        stamp = EPOCH + (begin + np.arange(count)) * TICK + draw.integers(0, TICK, size)[:count]
        lost = draw.random(size)[:count] < self.loss
        home = np.array([hash_text(s) % self.shards for s in self.symbols])
        seq = np.zeros(count, np.int64)
        for shard in set(home.tolist()):
            here = home[book] == shard
            seq[here] = number * int((home[turns] == shard).sum()) + np.arange(1, int(here.sum()) + 1)
        new = self.first_id + begin + np.arange(count)
        named = new.copy()
        for n in range(len(self.symbols)):
            rows = np.flatnonzero(book == n)
            self._name(kind, named, rows, which)
        words = np.array([wire.symbol_word(s) for s in self.symbols], np.uint64)
        quantity = np.where(kind == wire.EXECUTE, executed, added)
        return Block(kind, {"seq_num": seq, "order_id": named, "new_order_id": new, "symbol": words[book], "side": side, "price": price, "quantity": quantity, "timestamp": stamp}, lost)

    @staticmethod
    def _name(kind: np.ndarray, named: np.ndarray, rows: np.ndarray, which: np.ndarray) -> None:
        """Gives the messages of one symbol the orders that they name; young orders are named more often. A message that finds none is an add.

        An executed order stays in the list, so it may be named again after the book has filled it.
        """
        orders: list[int] = []
        for i, k, w in zip(rows.tolist(), kind[rows].tolist(), which[rows].tolist(), strict=True):
            if not orders or k == wire.ADD:
                kind[i] = wire.ADD
                orders.append(int(named[i]))
                continue
            at = -1 - int(w * w * len(orders))
            own = int(named[i])
            named[i] = orders[at]
            if k == wire.REPLACE:
                orders[at] = own
            elif k == wire.CANCEL:
                orders[at] = orders[-1]
                orders.pop()

    def packets(self) -> Iterator[bytes | None]:
        """All messages, or None for each that is lost on its way."""
        for number in range(self.blocks):
            yield from self.make(number).packets().to_pylist()


def feeds(options: dict) -> list[Feed]:
    """The channels that the options ask for, as far as there are shards with symbols."""
    names = [s for s in options.get("symbols", "AAPL,MSFT,GOOG").split(",") if s]
    shards, channels, each = int(options.get("shards", 4)), int(options.get("channels", 1)), int(options.get("messages", 1000))
    whole = -(-each // BLOCK) * BLOCK
    if not names:
        raise ValueError("a feed needs symbols")
    used = sorted({hash_text(s) % shards for s in names})
    own = [tuple(s for s in names if used.index(hash_text(s) % shards) % channels == c) for c in range(channels)]
    return [Feed(own[c], shards, each, float(options.get("loss", 0)), int(options.get("seed", 0)), c, 1 + c * whole) for c in range(channels) if own[c]]


class _Range(InputPartition):
    """Positions from ``start`` to ``end`` of a channel, within a few blocks."""

    def __init__(self, channel: int, start: int, end: int) -> None:
        self.channel, self.start, self.end = channel, start, end


def _ranges(options: dict, start: int, end: int) -> list[InputPartition]:
    step = BLOCK * BLOCKS_PER_TASK
    return [_Range(f.channel, max(start, at), min(end, f.messages, at + step)) for f in feeds(options) for at in range(start // step * step, min(end, f.messages), step)]


def _read(options: dict, part: _Range) -> Iterator[pa.RecordBatch]:
    feed = next(f for f in feeds(options) if f.channel == part.channel)
    channels = int(options.get("channels", 1))
    for number in range(part.start // BLOCK, -(-part.end // BLOCK)):
        packets = feed.make(number).packets()
        begin = number * BLOCK
        a, b = max(part.start - begin, 0), min(part.end - begin, len(packets))
        at = begin + np.arange(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, feed.channel, np.int32)), pa.array(at * channels + feed.channel), packets.slice(a, b - a)], names=["channel", "arrival_no", "raw"])


class _Batch(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return _ranges(self.options, 0, int(self.options.get("messages", 1000)))

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        return _read(self.options, partition)


class _Stream(DataSourceStreamReader):
    """An offset is a position in every channel; new packets come in as many tasks as they have blocks.

    All packets are there at once, or come ``perSecond`` in each channel since ``began`` (seconds of the epoch), so that a restart finds the same clock.
    """

    def __init__(self, options: dict) -> None:
        self.options = dict(options)
        self.messages, self.rate, self.began = int(options.get("messages", 1000)), options.get("perSecond"), options.get("began")
        if self.rate and not self.began:
            raise ValueError("perSecond needs began")

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        come = int((time.time() - float(self.began)) * float(self.rate)) if self.rate else self.messages
        return {"at": max(0, min(self.messages, come))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _ranges(self.options, start["at"], end["at"])

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        return _read(self.options, partition)


class FeedSource(DataSource):
    """Format ``order_feed``; options symbols, shards, messages (per channel), loss, seed, channels; for streams perSecond and began."""

    @classmethod
    def name(cls) -> str:
        return "order_feed"

    def schema(self) -> StructType | str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options)
