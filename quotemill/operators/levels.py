"""Price levels: totals after each message, final and as-of levels, best prices, depth, queues, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import free_name, shared
from .prefix import CHUNK, running

LEVEL = ["symbol", "side", "price"]


def better() -> Column:
    """Sorts a side's prices best first: bids high to low, asks low to high."""
    return F.when(F.col("side") == 0, -F.col("price")).otherwise(F.col("price"))


def deltas(legs: DataFrame, chunk: int = 2 * CHUNK) -> DataFrame:
    """legs with total_quantity and order_count of the level after each. A level's changes are summed in chunks of arrival, so a hot level is the work of many tasks."""
    order = free_name(legs.columns, "order")
    rows = shared(legs.withColumn(order, F.col("arrival_no") * 2 + F.col("leg")), "legs")  # read twice, folded once
    return running(rows, LEVEL, order, {"total_quantity": ("sum", F.col("d_qty"), True), "order_count": ("sum", F.col("d_count").cast("long"), True)}, chunk).drop(order)


def levels(legs: DataFrame, until: int | None = None) -> DataFrame:
    """The levels that hold orders, at the end or after message ``until``. Changes are summed map-side."""
    if until is not None:
        legs = legs.filter(F.col("arrival_no") <= until)
    return legs.groupBy(*LEVEL).agg(F.sum("d_qty").alias("total_quantity"), F.sum("d_count").alias("order_count")).filter("order_count > 0")


def best_bid_ask(live: DataFrame) -> DataFrame:
    """symbol, bid_price, bid_quantity, bid_count, ask_price, ...: null on a side without orders."""
    out = []
    for name, side, pick in (("bid", 0, F.max_by), ("ask", 1, F.min_by)):
        mine = F.col("side") == side
        for what, of in (("price", "price"), ("quantity", "total_quantity"), ("count", "order_count")):
            out.append(pick(F.when(mine, F.col(of)), F.when(mine, F.col("price"))).alias(f"{name}_{what}"))
    return live.groupBy("symbol").agg(*out)


def depth(live: DataFrame, n: int) -> DataFrame:
    """The n best levels of each side, rank 1 first; none if n is 0."""
    rank = F.row_number().over(Window.partitionBy("symbol", "side").orderBy(better()))
    return live.withColumn("rank", rank).filter(F.col("rank") <= n)


def depth_snapshot(live: DataFrame, n: int) -> DataFrame:
    """symbol, bids, asks: arrays of (price, total_quantity, order_count), best first."""
    row = F.struct("price", "total_quantity", "order_count")
    per = depth(live, n).groupBy("symbol").agg(*(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("rank", row.alias("level"))))).alias(name) for name, side in (("bids", 0), ("asks", 1))))
    return per.select("symbol", *(F.transform(name, lambda x: x["level"]).alias(name) for name in ("bids", "asks")))


def replay(published: DataFrame) -> DataFrame:
    """Levels a consumer of deltas ends with: the last total of each, where not 0."""
    last = published.groupBy(*LEVEL).agg(F.max_by("total_quantity", F.struct("arrival_no", "leg")).alias("total_quantity"))
    return last.filter("total_quantity <> 0")


def replay_difference(published: DataFrame, live: DataFrame) -> DataFrame:
    """Levels whose replayed and live totals differ (a level of total 0 counts as absent)."""
    a = replay(published).withColumnRenamed("total_quantity", "replayed")
    b = live.filter("total_quantity <> 0").select(*LEVEL, F.col("total_quantity").alias("live"))
    return a.join(b, LEVEL, "full").filter(~F.col("replayed").eqNullSafe(F.col("live")))


def queue_positions(resting: DataFrame, chunk: int = 2 * CHUNK) -> DataFrame:
    """resting orders with queue_pos (1 is next to trade) and qty_ahead in their level."""
    rows = shared(resting.select("order_id", *LEVEL, "remaining", (F.col("entered.arrival_no") * 2 + F.col("entered.leg")).alias("line")), "resting")
    return running(rows, LEVEL, "line", {"queue_pos": ("sum", F.lit(1).cast("long"), True), "qty_ahead": ("sum", F.col("remaining"), False)}, chunk).drop("line")
