"""Deviations of sliding windows in linear work, by moments of block prefixes and suffixes.

Rows of a key are cut into blocks as long as the window, so a window is the end of one block and the beginning of the next. Running
(count, mean, squares) from both ends of every block are two unbounded frames, which Spark carries on from row to row; merging one of each gives
the window, where a bounded frame would be summed anew for every row. Values are taken from their block's end, so large means don't cancel
and equal values give exactly 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sliding_std(rows: DataFrame, value: str, window: int, keys: list[str], order: str, out: str, least: int | None = None) -> DataFrame:
    """``rows`` with ``out``, the sample deviation of the values of the last ``window`` rows of a key; null below ``least`` (the window's length by default).

    Null values are rows without a value. ``order`` must order a key's rows without ties. One exchange by ``keys`` at most.
    """
    least = max(2, window if least is None else least)
    line = Window.partitionBy(*keys).orderBy(order)
    place, x = F.col("__place"), F.col(value)
    rows = rows.withColumn("__place", F.row_number().over(line) - 1).withColumn("__block", F.floor(place / window))
    for side, by in (("a", F.col(order).asc()), ("z", F.col(order).desc())):
        run = Window.partitionBy(*keys, "__block").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("__base", F.first(x, ignorenulls=True).over(run))
        off = x - F.col("__base")
        n = F.count(off).over(run)
        moments = F.struct(n.alias("n"), F.col("__base").alias("base"), F.avg(off).over(run).alias("mean"), (F.var_pop(off).over(run) * n).alias("squares"))
        rows = rows.withColumn(f"__{side}", moments).drop("__base")
    rows = rows.withColumn("__z", F.lag("__z", window - 1).over(line)) if window > 1 else rows
    whole = place % window == window - 1  # the block's own beginning is the window
    part = lambda side, name: F.col(f"__{side}.{name}")
    na = part("a", "n")
    nz = F.when(whole, 0).otherwise(F.coalesce(part("z", "n"), F.lit(0)))
    n = na + nz
    apart = (part("a", "base") - part("z", "base")) + (part("a", "mean") - part("z", "mean"))
    squares = F.when(na > 0, part("a", "squares")).otherwise(0.0) + F.when(nz > 0, part("z", "squares")).otherwise(0.0)
    squares = squares + F.when((na > 0) & (nz > 0), apart * apart * na * nz / n).otherwise(0.0)
    return rows.withColumn(out, F.when(n >= least, F.sqrt(squares / (n - 1)))).drop("__place", "__block", "__a", "__z")
