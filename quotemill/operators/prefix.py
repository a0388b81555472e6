"""Running aggregates that do not need a key's rows in one task.

A key's rows are cut into chunks of the order column (say, a million arrival numbers). Each chunk is aggregated alone;
chunk results, few rows, are accumulated; and a row's value is its running value within the chunk plus what came
before. So 16 shards can use more than 16 tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import free_name

CHUNK = 1_000_000


def running(df: DataFrame, keys: list[str], order: str, columns: dict[str, tuple[str, Column, bool]], chunk: int = CHUNK) -> DataFrame:
    """Adds running aggregates. columns: name -> (sum | max, value, whether the row itself counts).

    A sum over no rows is 0, a maximum over no rows null. ``order`` must be a whole number, unique within the keys; rows with
    a null key are left out.
    """
    names: set[str] = set(df.columns)

    def own(base: str) -> str:
        found = free_name(names, base)
        names.add(found)
        return found

    c, k_chunk = own("chunk"), own("k_chunk")
    v, r, t, b = ({name: own(f"{x}_{name}") for name in columns} for x in "vrtb")
    k = {key: own(f"k_{key}") for key in keys}
    rows = df.withColumn(c, F.floor(F.col(order) / chunk)).withColumns({v[name]: value for name, (_, value, _) in columns.items()})
    agg = {"sum": F.sum, "max": F.max}
    per = rows.groupBy(*keys, c).agg(*(agg[how](v[name]).alias(t[name]) for name, (how, _, _) in columns.items()))
    before = Window.partitionBy(*keys).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*(F.col(key).alias(k[key]) for key in keys), F.col(c).alias(k_chunk), *(agg[how](t[name]).over(before).alias(b[name]) for name, (how, _, _) in columns.items()))
    here = Window.partitionBy(*keys, c).orderBy(order)
    rows = rows.withColumns({r[name]: agg[how](v[name]).over(here.rowsBetween(Window.unboundedPreceding, 0 if itself else -1)) for name, (how, _, itself) in columns.items()})
    on = F.col(c) == F.col(k_chunk)
    for key in keys:
        on = on & (F.col(key) == F.col(k[key]))
    both = rows.join(per, on)
    out = [F.col(x) for x in df.columns]
    for name, (how, _, _) in columns.items():
        local, base = F.col(r[name]), F.col(b[name])
        out.append((F.coalesce(local, F.lit(0)) + F.coalesce(base, F.lit(0)) if how == "sum" else F.greatest(local, base)).alias(name))
    return both.select(*out)
