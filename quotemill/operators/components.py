"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import importable, shared, unshare

#: Links that are contracted together.
TOGETHER = 200_000


def contracted(links: DataFrame, together: int = TOGETHER) -> DataFrame:
    """(u, v) with v < u: links with the same components, each node of some consecutive rows linked to the smallest it reaches by them. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (y := up.setdefault(top, top)) != top:
                top = y
            while x != top:
                up[x], x = top, up[x]
            return top

        def made() -> pa.RecordBatch:
            pairs = [(x, root(x)) for x in list(up)]
            kept = [p for p in pairs if p[0] != p[1]]
            up.clear()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in kept], pa.int64()), pa.array([y for _, y in kept], pa.int64())], names=["u", "v"])

        for batch in batches:
            for x, y in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                a, b = root(x), root(y)
                up[max(a, b)] = min(a, b)
            if len(up) > together:
                yield made()
        if up:
            yield made()

    return links.mapInArrow(run, "u long, v long")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for each node that has a link.

    Alternating large-star and small-star steps (Kiveris et al. 2014), each a map-side-combined minimum and a join,
    until nothing changes: about log2 of the longest path rounds. Each round is written to the shared folder, so lineage stays short;
    only a count and a checksum of it come to the driver. Links that stand together are contracted first, so chains of them take no rounds. A node with very many links is only ever aggregated or
    joined, never gathered. Nulls and loops are left out; an empty table gives no rows.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    importable(links.sparkSession)
    now = shared(contracted(links.filter(F.col(a) != F.col(b)).select(high.cast("long").alias("u"), low.cast("long").alias("v"))).distinct(), "links")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = shared(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        unshare(now)
        now = after
        n, total = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, total) == mark or not n:
            break
        mark = (n, total)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
