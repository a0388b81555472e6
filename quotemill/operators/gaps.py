"""Sequence gaps per shard: in order, gap or duplicate; live or stale; resynchronisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import shared
from .prefix import CHUNK, running


def classify(observed: DataFrame, shard: str = "shard", order: str = "arrival_no", chunk: int = CHUNK) -> DataFrame:
    """Adds last_seq, kind (InOrder, Gap, Duplicate), expected, missing, stale, gaps_total, as of after each row.

    ``observed`` holds seq_num, and may hold ``resync``: rows where it is true set the last number and make the shard live
    again; they have kind Resync. The last number is a running maximum since the last resync: a duplicate leaves it.
    """
    # What runs below reads its rows several times: written once, they aren't computed anew each time.
    rows = shared(observed, "observed")
    resyncs = "resync" in observed.columns
    segment = F.lit(0).cast("long")
    if resyncs:
        rows = running(rows, [shard], order, {"_segment": ("sum", F.col("resync").cast("long"), True)}, chunk)
        segment = F.col("_segment")
    rows = running(rows, [shard], order, {"_last": ("max", F.struct(segment.alias("segment"), F.col("seq_num").alias("seq")), False)}, chunk)
    rows = rows.withColumn("last_seq", F.when(F.col("_last.segment") == segment, F.col("_last.seq")))
    kind = F.when(F.col("last_seq").isNull() | (F.col("seq_num") == F.col("last_seq") + 1), "InOrder").when(F.col("seq_num") > F.col("last_seq"), "Gap").otherwise("Duplicate")
    rows = rows.withColumn("kind", F.when(F.col("resync"), "Resync").otherwise(kind) if resyncs else kind)
    gap = F.col("kind") == "Gap"
    rows = rows.withColumn("expected", F.when(gap, F.col("last_seq") + 1)).withColumn("missing", F.when(gap, F.col("seq_num") - F.col("last_seq") - 1))
    if not resyncs:
        return running(rows, [shard], order, {"gaps_total": ("sum", gap.cast("long"), True)}, chunk).withColumn("stale", F.col("gaps_total") > 0).drop("_last")
    rows = running(rows, [shard], order, {"gaps_total": ("sum", gap.cast("long"), True), "_stale": ("max", F.struct(segment.alias("segment"), gap.cast("int").alias("gap")), True)}, chunk)
    stale = (F.col("_stale.segment") == segment) & (F.col("_stale.gap") == 1)
    return rows.withColumn("stale", stale).drop("_segment", "_last", "_stale")


def gap_events(classified: DataFrame, shard: str = "shard", order: str = "arrival_no") -> DataFrame:
    """shard, arrival_no, expected, got, missing: a row for each gap."""
    return classified.filter("kind = 'Gap'").select(shard, order, "expected", F.col("seq_num").alias("got"), "missing")


def gap_summary(classified: DataFrame, shard: str = "shard", order: str = "arrival_no") -> DataFrame:
    """shard, gaps_total, missing, duplicates, last_seq, stale after the last row."""
    is_dup = F.col("kind") == "Duplicate"
    after = F.when(is_dup, F.col("last_seq")).otherwise(F.col("seq_num"))
    return classified.groupBy(shard).agg(F.count_if(F.col("kind") == "Gap").alias("gaps_total"), F.coalesce(F.sum("missing"), F.lit(0)).alias("missing"), F.count_if(is_dup).alias("duplicates"), F.max_by(after, order).alias("last_seq"), F.max_by("stale", order).alias("stale"))
