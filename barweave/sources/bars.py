"""Sources of bars: scans, snapshots out of a table of many intervals, summaries and quality checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

BARS = "symbol STRING, ts TIMESTAMP, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume BIGINT"
PRICES = ("open", "high", "low", "close")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan(bars: DataFrame, symbols: str | Iterable[str], start: str | None = None, end: str | None = None, on: str = "ts") -> DataFrame:
    """Bars of some symbols, both ends of the range included; symbols without rows are simply not there."""
    out = bars.where(F.col("symbol").isin([symbols] if isinstance(symbols, str) else list(symbols)))
    if start is not None:
        out = out.where(F.col(on) >= F.lit(start).cast(bars.schema[on].dataType))
    if end is not None:
        out = out.where(F.col(on) <= F.lit(end).cast(bars.schema[on].dataType))
    return out


def first_of_each(bars: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """One row for each key: the first in an order, which must be total for a repeatable result."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return bars.withColumn("__n", n).where("__n = 1").drop("__n")


def from_epoch(market: DataFrame) -> Column:
    return F.timestamp_seconds(F.col("timestamp").cast("long"))


def snapshot_minute(market: DataFrame, symbols: list[str]) -> DataFrame:
    """Distinct one-minute bars of some symbols."""
    rows = market.where((F.col("interval") == "1m") & F.col("symbol").isin(symbols))
    return rows.select(from_epoch(market).alias("ts"), "symbol", *PRICES, "volume").distinct()


def snapshot_context(market: DataFrame, symbols: list[str]) -> DataFrame:
    """Distinct daily closes, highs and lows under the names of a previous day's: values of the same row, not lagged."""
    rows = market.where((F.col("interval") == "D") & F.col("symbol").isin(symbols))
    return rows.select(from_epoch(market).alias("ts"), "symbol", *(F.col(c).alias(f"prev_{c}") for c in ("close", "high", "low"))).distinct()


def lagged_context(daily: DataFrame) -> DataFrame:
    """The context that the names promise: close, high and low of the row before."""
    w = Window.partitionBy("symbol").orderBy("date")
    return daily.select("date", "symbol", *(F.lag(c).over(w).alias(f"prev_{c}") for c in ("close", "high", "low")))


def snapshot_daily(market: DataFrame, start: str, end: str) -> DataFrame:
    """Distinct daily bars between two dates, both included."""
    day = F.to_date(from_epoch(market))
    rows = market.where(F.col("interval") == "D").withColumn("date", day).where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return rows.select("date", "symbol", *PRICES, "volume").distinct()


def symbols(bars: DataFrame, without: str | None = None) -> DataFrame:
    out = bars.select("symbol").distinct()
    return out.where(F.col("symbol") != without) if without else out


def summary(bars: DataFrame, on: str, rows_a_day: float, days_a_year: float = 250.0) -> DataFrame:
    """Rows, first and last time, days and years of each symbol."""
    out = bars.groupBy("symbol").agg(F.count("*").alias("n"), F.min(on).alias("first"), F.max(on).alias("last"))
    days = F.col("n") / F.lit(rows_a_day)
    return out.withColumn("days", days).withColumn("years", days / F.lit(days_a_year))


def counts(bars: DataFrame, on: str) -> DataFrame:
    return bars.groupBy("symbol").agg(F.count("*").alias("n"), F.min(on).alias("first"), F.max(on).alias("last"))


def quality(bars: DataFrame, on: str = "ts") -> DataFrame:
    """Of each symbol: rows, share of null prices, non-positive prices, highs below lows, repeated times, and a status."""
    nulls = sum((F.count_if(F.col(c).isNull()) for c in PRICES[1:]), F.count_if(F.col(PRICES[0]).isNull()))
    out = bars.groupBy("symbol").agg(
        F.count("*").alias("n"),
        (100.0 * nulls / (4 * F.count("*"))).alias("null_pct"),
        F.count_if(F.col("close") == 0).alias("zero_prices"),
        F.count_if(F.col("close") < 0).alias("negative_prices"),
        F.count_if(F.col("high") < F.col("low")).alias("high_below_low"),
        (F.count("*") - F.countDistinct(on)).alias("repeated"),
    )
    bad = (F.col("null_pct") > 0) | (F.col("zero_prices") + F.col("negative_prices") + F.col("high_below_low") + F.col("repeated") > 0)
    return out.withColumn("status", F.when(bad, "WARN").otherwise("OK"))


def normalised(bars: DataFrame) -> DataFrame:
    """NaN and infinite prices become null: the engine's only missing value."""
    return bars.withColumns({c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)) for c in PRICES})
