"""Lineages: order ids that replaces connect. They are folded apart, so they are what the work is divided by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codec import REPLACE
from ..plans.storage import free_name, shared, unshare
from .components import components


def with_lineage(messages: DataFrame, name: str = "lineage") -> DataFrame:
    """Adds the smallest id that each message's ids are connected with.

    All replaces count, also those that will be rejected: a lineage may be larger than need be, never smaller. Ids that
    are never replaced are lineages of their own, and never enter the search for components.
    """
    edges = messages.filter(F.col("msg_type") == REPLACE).select(F.col("order_id").alias("a"), F.col("new_order_id").alias("b"))
    node, component = (free_name(messages.columns, x) for x in ("node", "component"))
    found = components(edges).select(F.col("node").alias(node), F.col("component").alias(component))
    return messages.join(found, F.col("order_id") == F.col(node), "left").withColumn(name, F.coalesce(component, "order_id")).drop(node, component)


def replace_tree(messages: DataFrame) -> DataFrame:
    """(order_id, root_id, depth) of every id that some replace names, by pointer doubling.

    For feeds whose ids are new whenever a replace introduces them (each id is introduced by one replace at most; if not, by the
    earliest).
    """
    edges = messages.filter((F.col("msg_type") == REPLACE) & (F.col("order_id") != F.col("new_order_id")))
    up = edges.groupBy(F.col("new_order_id").alias("id")).agg(F.min_by("order_id", "arrival_no").alias("up"))
    now = up.select("id", "up", F.lit(1).cast("long").alias("depth"))
    roots = now.select(F.col("up").alias("id")).join(now.select("id"), "id", "left_anti").distinct().select("id", F.col("id").alias("up"), F.lit(0).cast("long").alias("depth"))
    now = shared(now.unionByName(roots), "tree")
    while True:
        above = now.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        after = shared(now.join(above, F.col("up") == F.col("_id")).select("id", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"), (F.col("_up") != F.col("up")).alias("moved")), "tree")
        moved = after.filter("moved").limit(1).count()
        unshare(now)
        now = after.drop("moved")
        now.shared_path = after.shared_path  # type: ignore[attr-defined]
        if not moved:
            return now.select(F.col("id").alias("order_id"), F.col("up").alias("root_id"), "depth")
