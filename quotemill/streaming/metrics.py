"""Counters of running streams, read while they run."""

from __future__ import annotations

from collections import Counter, defaultdict
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.lifecycle import EVICTED, UNROUTABLE


def counted(fold: DataFrame, name: str = "feed") -> DataFrame:
    """A folded stream whose messages, rejects and changes are counted as they pass."""
    error = F.col("error")
    return fold.observe(
        name, F.count(F.lit(1)).alias("messages"), F.count_if(error.isNull()).alias("accepted"), F.count_if(error == UNROUTABLE).alias("unroutable"), F.count_if(error == EVICTED).alias("evicted"),
        F.count_if(error.isNotNull() & ~error.isin(UNROUTABLE, EVICTED)).alias("rejected"), F.sum(F.size("legs")).alias("deltas"))


def counted_gaps(classified: DataFrame, name: str = "gaps") -> DataFrame:
    """A stream of classified messages whose gaps are counted as they pass."""
    gap = F.col("kind") == "Gap"
    return classified.observe(name, F.count_if(gap).alias("gaps"), F.sum(F.when(gap, F.col("seq_num") - F.col("last_seq") - 1)).alias("missing"), F.count_if(F.col("kind") == "Duplicate").alias("duplicates"))


class Counters(StreamingQueryListener):
    """Sums what streams count; register it with ``spark.streams.addListener``. ``totals[name][counter]`` can be read at any time."""

    def __init__(self) -> None:
        self.totals: dict[str, Counter] = defaultdict(Counter)

    def onQueryStarted(self, event: Any) -> None:
        pass

    def onQueryProgress(self, event: Any) -> None:
        for name, row in event.progress.observedMetrics.items():
            self.totals[name].update({k: v or 0 for k, v in row.asDict().items()})

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        pass
