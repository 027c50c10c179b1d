"""Bars made from tables of orders and events, for queries and tests where there is no market data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .bars import table


def _daily(ticks: DataFrame) -> DataFrame:
    """Daily bars of ticks (symbol, date, price, quantity, order)."""
    return ticks.groupBy("symbol", "date").agg(F.min_by("price", "order").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "order").alias("close"), F.sum("quantity").cast("long").alias("volume"))


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six symbols of about ten years: line items as ticks. The divisor keeps means off decimal ties, which engines round differently."""
    rows = table(spark, sf_dir, "lineitem")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")
    return _daily(rows.select(F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.to_date("l_shipdate").alias("date"), (1000.0 + F.col("l_extendedprice") / 997.0).alias("price"), F.col("l_quantity").alias("quantity"), order.alias("order")))


def index_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index: orders as ticks."""
    rows = table(spark, sf_dir, "orders")
    order = F.struct("o_orderdate", "o_orderkey")
    return _daily(rows.select(F.lit("INDEX").alias("symbol"), F.to_date("o_orderdate").alias("date"), (10000.0 + F.col("o_totalprice") / 100.0).alias("price"), F.lit(1).alias("quantity"), order.alias("order")))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of a month: (symbol, ts, price, event_id)."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), "event_id")


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of many intervals with epoch seconds, each row twice."""
    from ..operators.bars import resample

    day = daily_bars(spark, sf_dir).select(F.unix_seconds(F.col("date").cast("timestamp")).alias("timestamp"), "symbol", F.lit("D").alias("interval"), "open", "high", "low", "close", "volume")
    minute = resample(ticks(spark, sf_dir), "minute").select(F.unix_seconds(F.col("bar").cast("timestamp")).alias("timestamp"), "symbol", F.lit("1m").alias("interval"), "open", "high", "low", "close", F.col("n").alias("volume"))
    both = day.union(minute)
    return both.union(both)
