"""Resampling, and runs of equal labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def resample(ticks: DataFrame, unit: str, value: str = "price", order: str = "event_id") -> DataFrame:
    """Bars of ticks by minute, hour or day: (symbol, bar, open, high, low, close, n); empty bars never appear."""
    key = F.when(F.col(value).isNotNull(), F.struct("ts", order))
    return ticks.groupBy("symbol", F.date_trunc(unit, "ts").alias("bar")).agg(F.min_by(value, key).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, key).alias("close"), F.count(value).alias("n"))


def resample_bars(bars: DataFrame, bucket: Column, on: str = "ts") -> DataFrame:
    """Longer bars out of bars: first open, highest, lowest, last close, summed volume; nulls are no first or last."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(on)))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(on)))
    out = bars.groupBy("symbol", bucket.alias("bar")).agg(first("open").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), last("close").alias("close"), F.sum("volume").alias("volume"))
    return out.where(F.col("close").isNotNull())


def bucket(interval: str, offset: str | None = None, on: str = "ts") -> Column:
    """Starts of intervals of any length, such as hours that begin at :30."""
    return F.window(on, interval, interval, offset)["start"] if offset else F.window(on, interval)["start"]


def traded(bars: DataFrame, index: bool = False) -> DataFrame:
    """Bars with volume, or of an index, with a close above zero."""
    return bars.where(F.col("close") > 0) if index else bars.where(F.col("volume") > 0)


def with_history(bars: DataFrame, least: int, by: str | list[str] = "symbol") -> DataFrame:
    """Only groups of at least so many rows."""
    w = Window.partitionBy(*([by] if isinstance(by, str) else by))
    return bars.withColumn("__rows", F.count("*").over(w)).where(F.col("__rows") >= least).drop("__rows")


def runs(df: DataFrame, label: str, on: str, by: list[str]) -> DataFrame:
    """Runs of one label in the order of ``on``: (by, label, start, end, n)."""
    w = Window.partitionBy(*by).orderBy(on)
    new = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)) & F.lag(on).over(w).isNotNull(), 0).otherwise(1)
    marked = df.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "__run", label).agg(F.min(on).alias("start"), F.max(on).alias("end"), F.count("*").alias("n")).drop("__run")


def max_row(df: DataFrame, value: str, where: Column, by: list[str], on: str = "date") -> DataFrame:
    """Of each group the row with the greatest value among those that ``where`` holds for; of equal ones the first in time.

    Groups without such a row, or with nulls only, have none. One pass, combined before the shuffle.
    """
    rest = [c for c in df.columns if c not in by]
    order = F.struct(F.col(value), (-F.unix_date(on) if df.schema[on].dataType.typeName() == "date" else -F.col(on)).alias("first"))
    best = df.where(where & F.col(value).isNotNull()).groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("row"))
    return best.select(*by, *(F.col(f"row.{c}").alias(c) for c in rest))
