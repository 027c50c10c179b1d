"""Technical features of daily bars, as window columns over one partitioning by symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.rolling import EPS, along, change, mean, roll, rsi, std, with_ema, with_extremes
from .align import asof, exact_filled, gated

INDEX_FEATURES = ("index_ret_1d", "index_ret_5d", "index_ret_20d", "index_vs_sma20", "index_rsi14", "rel_strength")


def _relative(a, b):
    return (a - b) / (b + EPS)


def base(bars: DataFrame) -> DataFrame:
    """Columns that several features share: the close before, gains, losses and the true range."""
    c, before = F.col("close"), F.lag("close").over(along())
    df = bars.withColumn("__before", before).withColumn("__delta", c - F.col("__before"))
    high_low = F.col("high") - F.col("low")
    return df.withColumns({
        "__gain": F.when(F.col("__delta").isNotNull(), F.greatest(F.col("__delta"), F.lit(0.0))),
        "__loss": F.when(F.col("__delta").isNotNull(), F.greatest(-F.col("__delta"), F.lit(0.0))),
        "__range": F.greatest(high_low, F.abs(F.col("high") - F.col("__before")), F.abs(F.col("low") - F.col("__before"))),
        "__volume": F.col("volume").cast("double"),
        **{f"ret_{k}d": change("close", k) for k in (1, 3, 5, 10, 20)},
    })


def daily_features(bars: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Bars (symbol, date, open, high, low, close, volume) with 54 features; the index (date, close) is aligned as-of.

    Without an index its features are 0, its relative strength index 0.5.
    """
    df = base(bars)
    c, o, h, low, v = (F.col(x) for x in ("close", "open", "high", "low", "__volume"))
    w = along()
    df = df.withColumns({f"sma_{n}": mean("close", n) for n in (5, 10, 20, 50, 200)})
    df = df.withColumns({f"close_vs_sma{n}": _relative(c, F.col(f"sma_{n}")) for n in (5, 10, 20, 50, 200)})
    df = df.withColumns({f"rsi_{n}": rsi("__gain", "__loss", n) for n in (7, 14, 21)})
    mid, sd = F.col("sma_20"), F.col("__std")
    df = df.withColumn("__std", std("close", 20)).withColumns({
        "bb_upper_20": (mid + 2 * sd - c) / (c + EPS),
        "bb_lower_20": (c - (mid - 2 * sd)) / (c + EPS),
        "bb_width_20": 4 * sd / (mid + EPS),
        "bb_pos_20": (c - (mid - 2 * sd)) / (4 * sd + EPS),
    })
    df = df.withColumns({f"atr_{n}": mean("__range", n) for n in (7, 14)})
    df = df.withColumns({f"atr_pct_{n}": F.col(f"atr_{n}") / (c + EPS) for n in (7, 14)})
    last_volume = F.lag("__volume").over(w)
    df = df.withColumns({
        "vol_sma20": mean("__volume", 20),
        "__vol_ret": F.when((last_volume == 0) & (v > 0), 5.0).otherwise(F.try_divide(v, last_volume) - 1),
        **{f"mom_{k}": c / (F.lag("close", k).over(w) + EPS) - 1 for k in (5, 10, 20)},
        "high_20d": roll(F.max, "high", 20), "low_20d": roll(F.min, "low", 20),
        "vol_20d": std("ret_1d", 20), "vol_60d": std("ret_1d", 60),
        "body": (c - o) / (o + EPS), "upper_wick": (h - F.greatest(c, o)) / (c + EPS), "lower_wick": (F.least(c, o) - low) / (c + EPS),
    })
    df = with_extremes(df, {"high_52w": ("max", "high", 252), "low_52w": ("min", "low", 252)})
    df = df.withColumns({
        "vol_ratio": v / (F.col("vol_sma20") + EPS),
        "vol_ret": F.when(F.col("__vol_ret").isNotNull(), F.greatest(F.lit(-5.0), F.least(F.lit(5.0), F.col("__vol_ret")))),
        "pct_from_high20": _relative(c, F.col("high_20d")), "pct_from_low20": _relative(c, F.col("low_20d")),
        "pct_from_high52w": _relative(c, F.col("high_52w")), "pct_from_low52w": _relative(c, F.col("low_52w")),
    })
    df = with_ema(df, "close", {"ema_12": 12, "ema_26": 26})
    df = df.withColumn("macd", (F.col("ema_12") - F.col("ema_26")) / (c + EPS))
    df = with_index(df, index) if index is not None else df.withColumns({f: F.lit(0.5 if f == "index_rsi14" else 0.0) for f in INDEX_FEATURES})
    return df.drop(*[x for x in df.columns if x.startswith("__")])


def with_index(df: DataFrame, index: DataFrame) -> DataFrame:
    """Features of the aligned index, over the stock's rows; needs ret_20d."""
    df = asof(df, index, "date", "close", "__index")
    x = F.col("__index")
    df = df.withColumn("__idelta", x - F.lag("__index").over(along())).withColumns({
        "__igain": F.when(F.col("__idelta").isNotNull(), F.greatest(F.col("__idelta"), F.lit(0.0))),
        "__iloss": F.when(F.col("__idelta").isNotNull(), F.greatest(-F.col("__idelta"), F.lit(0.0))),
        **{f"index_ret_{k}d": change("__index", k) for k in (1, 5, 20)},
        "__ima": mean("__index", 20),
    })
    return df.withColumns({"index_vs_sma20": _relative(x, F.col("__ima")), "index_rsi14": rsi("__igain", "__iloss", 14), "rel_strength": F.col("ret_20d") - F.col("index_ret_20d")})


def warm(df: DataFrame) -> DataFrame:
    """Without the rows before the slowest required feature."""
    return df.dropna(subset=["sma_200", "rsi_14", "atr_14"])


def minute_features(bars: DataFrame, index: DataFrame | None = None, gate: float = 0.8) -> DataFrame:
    """The first generation's features: recursive exponential means, exact dates with fills, eps of 1e-8."""
    eps, c = 1e-8, F.col("close")
    df = base(bars)
    df = df.withColumns({f"close_vs_sma{n}": F.try_divide(c, mean("close", n)) - 1 for n in (10, 20, 50, 200)})
    ratio = mean("__gain", 14) / (mean("__loss", 14) + eps)
    df = df.withColumn("rsi_14", (100 - 100 / (1 + ratio)) / 100)
    df = with_ema(df, "close", {"__fast": 12, "__slow": 26}, adjust=False).withColumn("__line", F.col("__fast") - F.col("__slow"))
    df = with_ema(df, "__line", {"__signal": 9}, adjust=False)
    df = df.withColumns({"macd_signal": F.col("__signal") / (c + eps), "macd_hist": (F.col("__line") - F.col("__signal")) / (c + eps)})
    df = df.withColumns({"__mid": mean("close", 20), "__std": std("close", 20), "atr_pct_14": mean("__range", 14) / (c + eps), "volume_rel_20": F.col("__volume") / (mean("__volume", 20) + eps)})
    df = df.withColumn("bb_pct", (c - (F.col("__mid") - 2 * F.col("__std"))) / (4 * F.col("__std") + eps))
    if index is not None:
        df = gated(exact_filled(df, index, "date", "close", "__index"), "__index", gate)
        df = df.withColumns({"index_ret_5d": change("__index", 5), "index_ret_20d": change("__index", 20), "index_vs_sma50": F.try_divide(F.col("__index"), mean("__index", 50)) - 1})
        df = df.withColumns({"rs_5d": F.col("ret_5d") - F.col("index_ret_5d"), "rs_20d": F.col("ret_20d") - F.col("index_ret_20d")})
        none = (F.col("__index") == 0).alias("none")
        df = df.withColumns({f: F.when(none, 0.0).otherwise(F.col(f)) for f in ("index_ret_5d", "index_ret_20d", "index_vs_sma50", "rs_5d", "rs_20d")})
    else:
        df = df.withColumns({f: F.lit(0.0) for f in ("index_ret_5d", "index_ret_20d", "index_vs_sma50", "rs_5d", "rs_20d")})
    return df.drop(*[x for x in df.columns if x.startswith("__")], "ret_3d")


def forward_target(df: DataFrame, column: str = "ret_5d", ahead: int = 5) -> DataFrame:
    """The column's value some rows ahead, zero where there is none."""
    return df.withColumn("target", F.coalesce(F.lead(column, ahead).over(Window.partitionBy("symbol").orderBy("date")), F.lit(0.0)))
