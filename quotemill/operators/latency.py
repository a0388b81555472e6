"""Latency: intervals between the time stamps of a delta, and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import shared
from .prefix import CHUNK, running

# Each interval with the stamps it ends and begins with.
INTERVALS = [
    ("receive_to_decode", "t_decoded", "t_received"),
    ("decode_to_demux", "t_demuxed", "t_decoded"),
    ("input_queue_wait", "t_dequeued", "t_demuxed"),
    ("book_update", "t_book_updated", "t_dequeued"),
    ("output_queue_wait", "t_delta_dequeued", "t_book_updated"),
    ("publish", "t_published", "t_delta_dequeued"),
    ("tick_to_book_update", "t_book_updated", "t_received"),
    ("end_to_end", "t_published", "t_received"),
]


def intervals(trace: DataFrame) -> DataFrame:
    """Adds the eight intervals, in nanoseconds."""
    return trace.withColumns({name: F.col(end) - F.col(begin) for name, end, begin in INTERVALS})


def statistics(trace: DataFrame, keys: list[str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """stage, n, mean, p50, p99, p999, max (and keys): percentiles are nearest-rank, exact.

    Equal values are counted before they are shuffled, and ranks come from running counts over chunks of values, so no task holds a stage's values.
    """
    by = [*(keys or []), "stage"]
    long = intervals(trace).select(*by[:-1], F.explode(F.array(*(F.struct(F.lit(name).alias("stage"), F.col(name).alias("ns")) for name, _, _ in INTERVALS))).alias("x")).select(*by[:-1], "x.*")
    counts = shared(long.filter("ns is not null").groupBy(*by, "ns").agg(F.count(F.lit(1)).alias("n")), "latencies")
    total = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    upto = running(counts, by, "ns", {"upto": ("sum", F.col("n"), True)}, chunk).join(total, by)

    def rank(p: str) -> Column:
        need = F.ceil(F.col("total") * F.lit(p).cast("decimal(4,3)")).cast("long")
        return F.min(F.when(F.col("upto") >= F.greatest(need, F.lit(1)), F.col("ns")))

    return upto.groupBy(*by).agg(F.max("total").alias("n"), (F.sum(F.col("ns") * F.col("n")) / F.max("total")).alias("mean"), rank("0.5").alias("p50"), rank("0.99").alias("p99"), rank("0.999").alias("p999"), F.max("ns").alias("max"))


def percent_change(base: Column, other: Column) -> Column:
    """By how many percent of ``base`` the other is larger; null of a base of 0."""
    return F.when(base != 0, (other - base) * 100.0 / base)


def per_message(seconds: Column, messages: Column) -> Column:
    """Nanoseconds a message."""
    return F.when(messages > 0, seconds * 1e9 / messages)


def wall_time(samples: DataFrame, key: str, value: str) -> DataFrame:
    """n, mean, population standard deviation, min and max of repeated runs."""
    return samples.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("stddev"), F.min(value).alias("min"), F.max(value).alias("max"))
