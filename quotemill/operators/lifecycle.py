"""The fold over messages: which are routed, which the book accepts, and what they change at which price level.

Whether a message is accepted depends on its own ids only, never on level totals. So messages are dealt out by a key that holds
lineages whole, sorted by arrival within it, and folded as they stream by: a task keeps the live orders of the one
key at hand, not the key's messages.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codec import ADD, CANCEL, EXECUTE, REPLACE
from ..functions.symbols import MOST_SHARDS, hash_text
from ..plans.storage import importable

EVICTED = "QueueOverflow"
UNROUTABLE, NOT_FOUND, DUPLICATE, OVER_EXECUTED = "UnroutableOrderId", "OrderNotFound", "DuplicateOrderId", "ExecutedQuantityExceedsRemaining"
#: What a message did: one or two changes of a level.
LEG = "struct<side:int,price:long,d_qty:long,d_count:int>"
FOLDED = f"arrival_no long, msg_type int, seq_num long, order_id long, new_order_id long, timestamp long, symbol string, shard int, error string, legs array<{LEG}>"
_LEG = [("side", pa.int32()), ("price", pa.int64()), ("d_qty", pa.int64()), ("d_count", pa.int32())]
#: When a message came, and when each step was done with it, in nanoseconds; a sink adds the last two.
TRACE = ["t_received", "t_decoded", "t_demuxed", "t_dequeued", "t_book_updated"]
_INPUT = ["arrival_no", "msg_type", "seq_num", "order_id", "new_order_id", "timestamp", "symbol", "side", "price", "quantity"]


class Fold:
    """State of one key: routes of ids, and the resting orders of each symbol's book.

    ``routed``: messages find their book by the route of their id, as in the whole pipeline; else each carries its symbol.
    """

    def __init__(self, routed: bool = True) -> None:
        self.routed = routed
        self.routes: dict[int, str] = {}
        self.resting: dict[tuple[str, int], list] = {}  # (symbol, id) -> [side, price, quantity]

    def apply(self, kind: int, oid: int, new: int | None, symbol: str | None, side: int | None, price: int | None, qty: int | None, evicted: bool = False) -> tuple[str | None, str | None, list[tuple]]:
        """(symbol, error, legs) of one message. One that its queue evicted is routed, but reaches neither detector nor book."""
        routes, resting = self.routes, self.resting
        if self.routed:
            if kind == ADD:
                routes[oid] = symbol
            else:
                symbol = routes.get(oid)
                if symbol is None:
                    return None, UNROUTABLE, []
                if kind == CANCEL:
                    del routes[oid]
                elif kind == REPLACE:
                    del routes[oid]
                    routes[new] = symbol
        if evicted:
            return symbol, EVICTED, []
        at = (symbol, oid)
        order = resting.get(at)
        if kind == ADD:
            if order is not None:
                return symbol, DUPLICATE, []
            side = 1 if side else 0
            resting[at] = [side, price, qty]
            return symbol, None, [(side, price, qty, 1)]
        if order is None:
            if kind == EXECUTE:
                routes.pop(oid, None)
            return symbol, NOT_FOUND, []
        side, old_price, left = order
        if kind == CANCEL:
            del resting[at]
            return symbol, None, [(side, old_price, -left, -1)]
        if kind == EXECUTE:
            if qty > left:
                return symbol, OVER_EXECUTED, []
            if qty < left:
                resting[at] = [side, old_price, left - qty]
                return symbol, None, [(side, old_price, -qty, 0)]
            del resting[at]
            routes.pop(oid, None)
            return symbol, None, [(side, old_price, -qty, -1)]
        if (symbol, new) in resting:
            return symbol, DUPLICATE, []
        del resting[at]
        resting[symbol, new] = [side, price, qty]
        return symbol, None, [(side, old_price, -left, -1), (side, price, qty, 1)]


def _legs_array(ends: list[int], flat: list[tuple]) -> pa.Array:
    """Legs of all messages as one list array; ``ends``: how many legs there are up to each message."""
    columns = zip(*flat, strict=True) if flat else ((),) * len(_LEG)
    items = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _LEG, strict=True)], names=[n for n, _ in _LEG])
    return pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), items)


def fold(messages: DataFrame, key: str | list[str], *, shards: int = 1, routed: bool = True, order: str = "arrival_no", trace: bool = False) -> DataFrame:
    """One row per message, with its symbol, shard, error and legs. ``key`` must hold lineages whole (see ``with_lineage``).

    Messages may hold ``evicted``, as ``retention.overflow`` marks it. ``trace``: adds the clock of each step (``t_received`` of the messages, if they hold it).
    """
    importable(messages.sparkSession)
    if not 1 <= shards <= MOST_SHARDS:
        raise ValueError(f"shards must be from 1 to {MOST_SHARDS}")
    names = [key] if isinstance(key, str) else key
    keys = [f"_key{i}" for i in range(len(names))]
    mark = F.col("evicted") if "evicted" in messages.columns else F.lit(False)
    came = F.col("t_received").cast("long") if "t_received" in messages.columns else F.lit(None).cast("long")
    rows = messages.select(*(F.col(c) for c in _INPUT), mark.alias("evicted"), *([came.alias("t_received")] if trace else []), *(F.col(c).alias(k) for c, k in zip(names, keys, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last, home = Fold(routed), None, {None: None}
        for batch in batches:
            col = [batch.column(c).to_pylist() for c in ("msg_type", "order_id", "new_order_id", "symbol", "side", "price", "quantity", "evicted")]
            clock = time.time_ns()
            before, after = [], []
            whole = zip(*(batch.column(k).to_pylist() for k in keys), strict=True)
            symbols, errors, ends, flat = [], [], [], []
            for now, *message in zip(whole, *col, strict=True):
                if now != last:
                    state, last = Fold(routed), now
                if trace:
                    before.append(time.time_ns())
                s, e, legs = state.apply(*message)
                if trace:
                    after.append(time.time_ns())
                symbols.append(s)
                errors.append(e)
                flat += legs
                ends.append(len(flat))
                if s not in home:
                    home[s] = hash_text(s) % shards
            out = [*(batch.column(c) for c in _INPUT[:6]), pa.array(symbols, pa.string()), pa.array([home[s] for s in symbols], pa.int32()), pa.array(errors, pa.string()), _legs_array(ends, flat)]
            if trace:
                here = pa.array([clock] * len(after), pa.int64())
                out += [pc.coalesce(batch.column("t_received"), here), here, pa.array(before, pa.int64()), pa.array(before, pa.int64()), pa.array(after, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=[*_INPUT[:6], "symbol", "shard", "error", "legs", *(TRACE if trace else [])])

    return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, FOLDED + "".join(f", {c} long" for c in TRACE if trace))


def legs_of(folded: DataFrame) -> DataFrame:
    """arrival_no, leg, symbol, side, price, d_qty, d_count, seq_num, timestamp, and shard and the trace if they are there: the accepted changes."""
    more = [c for c in ("shard", *TRACE) if c in folded.columns]
    out = folded.select("arrival_no", "symbol", *more, "seq_num", "timestamp", F.posexplode("legs").alias("leg", "x"))
    return out.select("arrival_no", "leg", "symbol", "x.side", "x.price", "x.d_qty", "x.d_count", "seq_num", "timestamp", *more)


def observed(folded: DataFrame) -> DataFrame:
    """What reaches a shard's gap detector: routed messages that no queue evicted."""
    return folded.filter(F.col("error").isNull() | ~F.col("error").isin(UNROUTABLE, EVICTED))


def rejects_of(folded: DataFrame) -> DataFrame:
    """arrival_no, stage, reason: route, queue or book."""
    bad = folded.filter(F.col("error").isNotNull())
    return bad.select("arrival_no", F.when(F.col("error") == UNROUTABLE, "route").when(F.col("error") == EVICTED, "queue").otherwise("book").alias("stage"), F.col("error").alias("reason"))


def resting_orders(folded: DataFrame) -> DataFrame:
    """order_id, symbol, side, price, remaining, entered: accepted orders that still rest, with their entry (arrival_no, leg).

    An order's rows are those that name its id in its symbol; the latest entry counts, and what was taken off it since.
    """
    leg = folded.filter("error is null").select("arrival_no", "msg_type", "order_id", "new_order_id", "symbol", F.posexplode("legs").alias("leg", "x"))
    enters = (F.col("msg_type") == ADD) | ((F.col("msg_type") == REPLACE) & (F.col("leg") == 1))
    own = leg.select(F.when(F.col("leg") == 1, F.col("new_order_id")).otherwise(F.col("order_id")).alias("order_id"), "symbol", "x.*", "arrival_no", "leg", enters.alias("enters"))
    total = own.groupBy("symbol", "order_id").agg(F.sum("d_count").alias("n"), F.sum("d_qty").alias("remaining"), F.max(F.when(F.col("enters"), F.struct("arrival_no", "leg", "side", "price"))).alias("last"))
    return total.filter("n > 0").select("order_id", "symbol", "last.side", "last.price", "remaining", F.struct("last.arrival_no", "last.leg").alias("entered"))


def has_order(resting: DataFrame, ids: DataFrame, id_col: str = "order_id") -> DataFrame:
    """The ids that rest in some book."""
    return ids.join(resting.select(F.col("order_id").alias("_resting")), F.col(id_col) == F.col("_resting"), "left_semi")


def order_lifecycle(folded: DataFrame) -> DataFrame:
    """order_id, fills, executed, final_state of every order accepted (over all its lives, if its id is reused)."""
    leg = folded.filter("error is null").select("arrival_no", "msg_type", "order_id", "new_order_id", F.posexplode("legs").alias("leg", "x"))
    own = leg.select(F.when(F.col("leg") == 1, F.col("new_order_id")).otherwise(F.col("order_id")).alias("order_id"), "arrival_no", "leg", "msg_type", "x.d_qty", "x.d_count")
    executed = F.col("msg_type") == EXECUTE
    state = F.when(F.col("d_count") >= 0, "RESTING").when(F.col("msg_type") == CANCEL, "CANCELLED").when(executed, "FILLED").otherwise("REPLACED")
    return own.groupBy("order_id").agg(F.count_if(executed).alias("fills"), F.coalesce(F.sum(F.when(executed, -F.col("d_qty"))), F.lit(0)).alias("executed"), F.max_by(state, F.struct("arrival_no", "leg")).alias("final_state"))


def routed_ids(folded: DataFrame) -> DataFrame:
    """(order_id, symbol): ids that are routed after the last message. An id's last word decides it."""
    add, cancel, execute, replace = (F.col("msg_type") == k for k in (ADD, CANCEL, EXECUTE, REPLACE))
    gone = cancel | (execute & ((F.col("error") == NOT_FOUND) | (F.try_element_at("legs", F.lit(1))["d_count"] == -1)))
    ok = folded.filter(F.col("error").isNull() | (F.col("error") != UNROUTABLE))
    word = lambda on, oid, part, symbol: F.when(on, F.struct(oid.alias("order_id"), F.lit(part).alias("part"), symbol.alias("symbol")))
    none = F.lit(None).cast("string")
    said = F.array(word(add | gone, F.col("order_id"), 1, F.when(add, F.col("symbol"))), word(replace, F.col("order_id"), 0, none), word(replace, F.col("new_order_id"), 1, F.col("symbol")))
    words = ok.select("arrival_no", F.explode(F.array_compact(said)).alias("w")).select("arrival_no", "w.*")
    last = words.groupBy("order_id").agg(F.max(F.struct("arrival_no", "part", "symbol")).alias("last"))
    return last.filter("last.symbol is not null").select("order_id", "last.symbol")
