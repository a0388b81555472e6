"""An order feed derived from the ``events`` table by integer rules, the same in any engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codec import ADD, REPLACE
from ..functions.symbols import shard_of
from ..operators.prefix import running

SHARDS, SYMBOLS = 4, 16


def generated(spark: SparkSession, sf_dir: str, shards: int = SHARDS) -> DataFrame:
    """All messages with ``lost``: those that never arrive. ``channel`` holds lineages whole."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "props")
    kind = F.when(F.col("event_type").isin("signup", "view"), ADD).when(F.col("event_type") == "error", 2).when(F.col("event_type") == "click", 3).when(F.col("event_type") == "purchase", REPLACE)
    key = F.regexp_extract("props", r"(\d+)", 1).cast("long")
    base = events.select(
        F.col("event_id").alias("arrival_no"), kind.alias("msg_type"), (F.col("event_id") + 1).alias("own_id"), F.col("user_id").alias("channel"),
        F.concat(F.lit("SYM"), F.lpad((F.col("user_id") % SYMBOLS).cast("string"), 2, "0")).alias("feed_symbol"),
        (F.col("event_id") % 2).cast("int").alias("feed_side"), (2_000 + key * 7 % 90).alias("feed_price"), (5 + F.col("event_id") * 3 % 28).alias("qty"), (2 + F.col("event_id") * 5 % 17).alias("exec_qty"),
        (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") * 1000).alias("timestamp"))
    names = spark.range(SYMBOLS).select(F.concat(F.lit("SYM"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("feed_symbol"))
    base = base.join(F.broadcast(names.withColumn("shard", shard_of(F.col("feed_symbol"), shards))), "feed_symbol")  # 16 rows
    numbered = running(base, ["shard"], "arrival_no", {"seq_num": ("sum", F.lit(1).cast("long"), True)})
    earlier = Window.partitionBy("channel").orderBy("arrival_no").rowsBetween(Window.unboundedPreceding, -1)
    ref = F.last(F.when(F.col("msg_type").isin(ADD, REPLACE), F.col("own_id")), ignorenulls=True).over(earlier)
    rows = numbered.withColumn("ref_id", ref)
    is_add, is_replace = F.col("msg_type") == ADD, F.col("msg_type") == REPLACE
    lost = F.col("arrival_no") % 97 == 13
    early = ~is_add & F.col("ref_id").isNull()
    return rows.select(
        "arrival_no", "msg_type", "seq_num", F.when(is_add, F.col("own_id")).otherwise(F.col("ref_id")).alias("order_id"), F.when(is_replace, F.col("own_id")).alias("new_order_id"),
        F.when(is_add, F.col("feed_symbol")).alias("symbol"), F.when(is_add, F.col("feed_side")).alias("side"), F.when(is_add | is_replace, F.col("feed_price")).alias("price"),
        F.when(F.col("msg_type") == 3, F.col("exec_qty")).when(is_add | is_replace, F.col("qty")).alias("quantity"), "timestamp", "channel", F.col("shard").alias("feed_shard"), lost.alias("lost"), early.alias("before_start"))


def messages(spark: SparkSession, sf_dir: str, shards: int = SHARDS) -> DataFrame:
    """The messages that arrive."""
    return generated(spark, sf_dir, shards).filter("not lost and not before_start").drop("lost", "before_start")
