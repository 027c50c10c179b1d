"""Market regimes by threshold and by given probabilities, and what is told about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.rolling import EPS, change, mean, smooth, std, with_extremes
from .align import filled

#: Labels, and the order in which ties are decided.
LABELS = ("BULL", "BEAR", "FLAT")
STATES = ("bull_quiet", "crisis", "sideways_bear", "volatile")


def label(trend: str = "trend_50d_return", bull: float = 0.05, bear: float = -0.05) -> Column:
    return F.when(F.col(trend) > bull, "BULL").when(F.col(trend) < bear, "BEAR").otherwise("FLAT")


def labelled(df: DataFrame, trend: str = "trend_50d_return") -> DataFrame:
    """With a column ``regime``; FLAT throughout if there is no trend column."""
    return df.withColumn("regime", label(trend) if trend in df.columns else F.lit("FLAT"))


def trend(bars: DataFrame, rows: int = 50) -> DataFrame:
    return bars.withColumn("trend_50d_return", change("close", rows))


def distribution(df: DataFrame) -> DataFrame:
    """All labels with rows, share and mean trend in per cent; zero where a label does not occur."""
    spark: SparkSession = df.sparkSession
    total = df.agg(F.count("*").alias("total"))
    counts = df.groupBy("regime").agg(F.count("*").alias("n"), (100 * F.avg("trend_50d_return")).alias("avg_trend"))
    names = F.broadcast(spark.createDataFrame([(x,) for x in LABELS], "regime string").join(total))
    return names.join(counts, "regime", "left").select("regime", F.coalesce("n", F.lit(0)).alias("n"), (100.0 * F.coalesce("n", F.lit(0)) / F.greatest(F.col("total"), F.lit(1))).alias("pct"), F.coalesce("avg_trend", F.lit(0.0)).alias("avg_trend"))


def yearly(df: DataFrame, labels: tuple[str, ...] = LABELS, on: str = "date") -> DataFrame:
    return df.groupBy(F.year(on).alias("year")).pivot("regime", list(labels)).count().na.fill(0)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).count().withColumnRenamed("count", "n")


def state_features(index: DataFrame) -> DataFrame:
    """What regimes are learned from: returns, volatilities, trend and drawdown of closes; rows with any null go."""
    df = index.withColumns({f"ret_{k}d": change("close", k) for k in (1, 5, 20)})
    df = df.withColumns({**{f"vol_{n}d": std("ret_1d", n) for n in (5, 20, 60)}, "sma50": mean("close", 50), "sma200": mean("close", 200)})
    df = with_extremes(df, {"high_52w": ("max", "close", 252)})
    df = df.withColumns({"trend": (F.col("close") - F.col("sma50")) / (F.col("sma50") + EPS), "drawdown": (F.col("close") - F.col("high_52w")) / (F.col("high_52w") + EPS)})
    return df.dropna()


def scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean, over their population deviation (1 where that is 0)."""
    one = df.agg(*(F.avg(c).alias(f"__m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"__s_{c}") for c in columns))
    out = df.join(F.broadcast(one))
    return out.withColumns({c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") == 0, 1.0).otherwise(F.col(f"__s_{c}")) for c in columns}).select(df.columns)


def state_stats(df: DataFrame, state: str = "regime") -> DataFrame:
    total = df.agg(F.count("*").alias("__total"))
    out = df.groupBy(state).agg(F.count("*").alias("days"), *(F.avg(c).alias(f"avg_{c}") for c in ("ret_1d", "ret_20d", "vol_20d", "drawdown")))
    return out.join(F.broadcast(total)).withColumn("pct", 100.0 * F.col("days") / F.col("__total")).drop("__total")


def smoothed(df: DataFrame, rows: int = 5, on: str = "date") -> DataFrame:
    """Running means of the states' probabilities, and the label of the greatest; ties go to the first in STATES."""
    df = df.withColumns({f"smooth_{s}": smooth(f"prob_{s}", rows, on) for s in STATES})
    values = F.array(*(F.col(f"smooth_{s}") for s in STATES))
    names = F.array(*(F.lit(s.upper()) for s in STATES))
    return df.withColumn("regime_smooth", F.element_at(names, F.array_position(values, F.array_max(values)).cast("int")))


def transitions(df: DataFrame, label_col: str = "regime", on: str = "date", by: list[str] = ["symbol"]) -> DataFrame:
    """How often each label follows each, and its share of what follows."""
    w = Window.partitionBy(*by).orderBy(on)
    pairs = df.withColumn("from", F.lag(label_col).over(w)).where(F.col("from").isNotNull()).groupBy("from", F.col(label_col).alias("to")).agg(F.count("*").alias("n"))
    return pairs.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("from")))


def merged(dataset: DataFrame, regimes: DataFrame, columns: list[str], on: str = "date", across_symbols: bool = False) -> DataFrame:
    """The dataset with the regimes of its dates; gaps take the value before, else after, within each symbol.

    ``across_symbols`` fills along (symbol, time) as one sequence, so a symbol's first rows can take another's last.
    """
    out = dataset.drop(*columns).join(regimes.select(on, *columns), on, "left")
    for c in columns:
        out = filled(out, c, on, None if across_symbols else ["symbol"])
    return out
