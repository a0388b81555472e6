"""Bounded queues that drop their oldest entry, with counts of what they dropped."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import free_name, importable

CAPACITY = 4096


def retain_newest(df: DataFrame, keys: list[str], order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """A burst into idle queues: the newest ``capacity`` rows of each key. The rest was dropped.

    The rank is cut while it is counted, so a key keeps no more than its capacity after the map side.
    """
    newest = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    rank = free_name(df.columns, "rank")
    return df.withColumn(rank, F.row_number().over(newest)).filter(F.col(rank) <= capacity).drop(rank)


def dropped(df: DataFrame, keys: list[str], capacity: int = CAPACITY) -> DataFrame:
    """keys, pushed, retained, dropped of a burst."""
    n = F.count(F.lit(1))
    return df.groupBy(*keys).agg(n.alias("pushed"), F.least(n, F.lit(capacity)).alias("retained"), F.greatest(n - capacity, F.lit(0)).alias("dropped"))


def overflow(rows: DataFrame, keys: list[str], order: str = "arrival_no", capacity: int = CAPACITY, burst: int = CAPACITY) -> DataFrame:
    """Adds ``evicted``: whether a row is pushed out of its queue. Queues are drained after every ``burst`` numbers of the order column, and keep the newest
    ``capacity`` rows in between; so work is divided by queue and burst."""
    newest = Window.partitionBy(*keys, F.floor(F.col(order) / burst)).orderBy(F.col(order).desc())
    return rows.withColumn("evicted", F.row_number().over(newest) > capacity)


def run_queues(ops: DataFrame, queue: str = "queue", order: str = "n", capacity: int | str = CAPACITY) -> DataFrame:
    """Interleaved pushes and pops: queue, n, op, value, popped (of a pop; null if empty), evicted (by a push).

    ``capacity``: a number, or a column that is constant within a queue. Operations stream by sorted; a task
    keeps the content of one queue.
    """
    importable(ops.sparkSession)
    cap = F.lit(capacity) if isinstance(capacity, int) else F.col(capacity)
    rows = ops.select(F.col(queue).cast("string").alias("queue"), F.col(order).cast("long").alias("n"), F.col("op").alias("op"), F.col("value").cast("long").alias("value"), cap.cast("long").alias("cap"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: deque = deque()
        last = object()
        for batch in batches:
            popped, evicted = [], []
            for q, op, value, size in zip(*(batch.column(c).to_pylist() for c in ("queue", "op", "value", "cap")), strict=True):
                if q != last:
                    held, last = deque(), q
                out = gone = None
                if op == "push":
                    if len(held) >= size:
                        gone = held.popleft()
                    held.append(value)
                elif held:
                    out = held.popleft()
                popped.append(out)
                evicted.append(gone)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("queue", "n", "op", "value")), pa.array(popped, pa.int64()), pa.array(evicted, pa.int64())], names=["queue", "n", "op", "value", "popped", "evicted"])

    return rows.repartition("queue").sortWithinPartitions("queue", "n").mapInArrow(run, "queue string, n long, op string, value long, popped long, evicted long")


def queue_summary(done: DataFrame) -> DataFrame:
    """queue, pushed, received, dropped, left."""
    per = done.groupBy("queue").agg(F.count_if(F.col("op") == "push").alias("pushed"), F.count("popped").alias("received"), F.count("evicted").alias("dropped"))
    return per.withColumn("left", F.col("pushed") - F.col("received") - F.col("dropped"))
