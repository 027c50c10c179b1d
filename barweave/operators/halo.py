"""Windows over series cut into blocks of rows, so that one series is the work of many tasks.

A block takes along the rows before it that its frames reach back to. These come once more only for that: each row's
results are those of its own block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from .blocks import blocked

#: Rows of a block, and the rows before it that the daily features reach back to: a year's frame, and the memory of an
#: exponential mean of 26 rows (older weights are below double precision).
ROWS, BEFORE = 100_000, 512


def numbered(df: DataFrame, by: list[str], on: str, rows: int = ROWS) -> DataFrame:
    """The rows with their number in the series, from 0, in ``__position``, and the series' length in ``__length``.

    Ranges of (by, on) are counted, and numbered from the counts of those before; no task holds more than a range.
    Times of a series must differ. Null keys are a series of their own.
    """
    table = blocked(df, by, on, rows)
    key = [*by, "block"]
    series = Window.partitionBy(*by)
    counts = table.groupBy(*key).agg(F.count("*").alias("__count"))
    counts = counts.select(*(F.col(c).alias(f"__of_{c}") for c in key), (F.sum("__count").over(series.orderBy("block")) - F.col("__count")).alias("__first"), F.sum("__count").over(series).alias("__length"))
    same = [table[c].eqNullSafe(counts[f"__of_{c}"]) for c in key]
    inside = Window.partitionBy(*key).orderBy(on)
    out = table.join(counts, same).withColumn("__position", F.col("__first") + F.row_number().over(inside) - 1)
    return out.drop("block", "__first", *(f"__of_{c}" for c in key))


def apart(df: DataFrame, on: str = "date", rows: int = ROWS, before: int = BEFORE) -> DataFrame:
    """Rows whose ``symbol`` is (symbol, block), so that windows by symbol stay within ``rows + before`` rows.

    ``own_row`` tells a block's own rows from those that it only reaches back to.
    """
    if "own_row" in df.columns or "block" in df.columns:
        raise ValueError("own_row and block are names of this operator")
    position = F.col("__position")
    own, last = F.floor(position / rows), F.floor(F.least(position + before, F.col("__length") - 1) / rows)
    out = numbered(df, ["symbol"], on, rows).withColumn("__own", own)
    out = out.withColumn("__block", F.explode(F.sequence("__own", last)))
    out = out.withColumns({"symbol": F.struct("symbol", F.col("__block").alias("block")), "own_row": F.col("__own") == F.col("__block")})
    return out.drop("__position", "__length", "__own", "__block")


def over_blocks(df: DataFrame, make: Callable[[DataFrame], DataFrame], on: str = "date", rows: int = ROWS, before: int = BEFORE) -> DataFrame:
    """As ``make(df)``, whose windows by symbol look back over at most ``before`` rows, with no task for a whole series."""
    out = make(apart(df, on, rows, before)).where("own_row").drop("own_row")
    return out.withColumn("symbol", F.col("symbol.symbol"))
