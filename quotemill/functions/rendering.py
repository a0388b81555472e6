"""Text forms of deltas and gaps. The wording of the lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(c: Column) -> Column:
    return c.cast("string")


def delta_line() -> Column:
    """seq=... ts=... symbol=... side=BUY|SELL price=... qty=N|REMOVED, of a row of deltas."""
    side = F.when(F.col("side") == 0, "BUY").otherwise("SELL")
    left = F.when(F.col("total_quantity") == 0, "REMOVED").otherwise(_text(F.col("total_quantity")))
    return F.concat(F.lit("seq="), _text(F.col("seq_num")), F.lit(" ts="), _text(F.col("timestamp")), F.lit(" symbol="), F.col("symbol"), F.lit(" side="), side, F.lit(" price="), _text(F.col("price")), F.lit(" qty="), left)


def gap_line() -> Column:
    """The warning for a row of gap events."""
    return F.concat(F.lit("[gap_detector] sequence gap: expected "), _text(F.col("expected")), F.lit(", got "), _text(F.col("got")), F.lit(" ("), _text(F.col("missing")), F.lit(" message(s) missing) -- marking STALE"))
