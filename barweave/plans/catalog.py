"""The queries over bars and formulas, by name, each with its SQL where SQL can say it."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Config
from ..functions import rolling, safe
from ..operators import align, backtest, bars as B, blocks, evolve, features, formula, halo, hmm, metrics, regimes, selection
from ..session import shared_folder, written
from ..sources import bars as S, fixtures, sinks
from . import sql as Q

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
#: Dates of the splits of the fixture bars.
SPLITS = ("1998-12-31", "1999-01-01", "1999-12-31", "2000-01-01")
#: Formulas that together use every operator.
FORMULAS = {
    "f1": "sub(rsi_7, half)",
    "f2": "close_vs_sma200",
    "f3": "sub(mul(rel_strength, bb_width_20), div(ret_5d, vol_20d))",
    "f4": "max(neg(ret_20d), log(vol_60d))",
    "f5": "sqrt(exp(ret_5d))",
    "f6": "add(min(ret_5d, ret_20d), tenth)",
}


def query(name: str, oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({f.name: F.round(f.name, digits) for f in df.schema if f.dataType.simpleString() == "double"})


def plain_bars(df: DataFrame) -> DataFrame:
    return df.withColumn("bar", F.col("bar").cast("timestamp_ntz"))


# -- sources

for unit in ("minute", "hour", "day"):
    query(f"bars_{unit}", f"WITH {Q.TICKS} {Q.bars(unit)}")(lambda spark, d, unit=unit: plain_bars(B.resample(fixtures.ticks(spark, d), unit)))


@query("bars_daily", f"WITH {Q.DAILY} SELECT * FROM daily")
def bars_daily(spark, d):
    return fixtures.daily_bars(spark, d)


@query("index_daily", f"WITH {Q.INDEX} SELECT * FROM idx")
def index_daily(spark, d):
    return fixtures.index_bars(spark, d)


@query("bars_monthly_from_daily", f"WITH {Q.DAILY} SELECT symbol, date_trunc('month', date)::DATE AS bar, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close, sum(volume)::BIGINT AS volume FROM daily GROUP BY ALL")
def bars_monthly(spark, d):
    return B.resample_bars(fixtures.daily_bars(spark, d), F.trunc("date", "month"), "date")


@query("bars_half_hour_offset", f"WITH {Q.TICKS} SELECT symbol, time_bucket(INTERVAL '1 hour', ts, INTERVAL '30 minutes')::TIMESTAMP AS bar, arg_min(price, row(ts, event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, row(ts, event_id)) AS close, count(*) AS volume FROM ticks GROUP BY ALL")
def bars_half_hour(spark, d):
    t = fixtures.ticks(spark, d).select("symbol", F.struct("ts", "event_id").alias("order"), "ts", *(F.col("price").alias(c) for c in S.PRICES), F.lit(1).cast("long").alias("volume"))
    return plain_bars(B.resample_bars(t.withColumn("bar_", B.bucket("1 hour", "30 minutes")), F.col("bar_"), "order"))


@query("dedupe_ts", f"WITH {Q.DAILY}, twice AS (SELECT *, 0 AS copy FROM daily UNION ALL SELECT * REPLACE (close + 1 AS close), 1 FROM daily) SELECT symbol, date, close FROM twice QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY copy) = 1")
def dedupe_ts(spark, d):
    bars = fixtures.daily_bars(spark, d).withColumn("copy", F.lit(0))
    twice = bars.union(bars.withColumns({"close": F.col("close") + 1, "copy": F.lit(1)}))
    return S.first_of_each(twice, ["symbol", "date"], ["copy"]).select("symbol", "date", "close")


@query("symbol_scan_range", f"WITH {Q.DAILY} SELECT * FROM daily WHERE symbol = 'RF' AND date BETWEEN '1994-01-01' AND '1995-06-30'")
def symbol_scan(spark, d):
    return S.scan(fixtures.daily_bars(spark, d), "RF", "1994-01-01", "1995-06-30", "date")


@query("symbols_scan", f"WITH {Q.DAILY} SELECT symbol, count(*) AS n FROM daily WHERE symbol IN ('RF', 'AF', 'XX') GROUP BY symbol")
def symbols_scan(spark, d):
    return S.scan(fixtures.daily_bars(spark, d), ["RF", "AF", "XX"], on="date").groupBy("symbol").agg(F.count("*").alias("n"))


@query("symbols_distinct", f"WITH {Q.DAILY}, {Q.INDEX} SELECT DISTINCT symbol FROM (SELECT symbol FROM daily UNION ALL SELECT symbol FROM idx) WHERE symbol <> 'INDEX'")
def symbols_distinct(spark, d):
    return S.symbols(fixtures.daily_bars(spark, d).unionByName(fixtures.index_bars(spark, d)), without="INDEX")


@query("symbols_first", f"WITH {Q.DAILY} SELECT DISTINCT symbol FROM daily ORDER BY symbol LIMIT 20")
def symbols_first(spark, d):
    """A look at what is there: the first twenty symbols."""
    return S.symbols(fixtures.daily_bars(spark, d)).orderBy("symbol").limit(20)


_SNAP = f"WITH {Q.TICKS}, {Q.DAILY}, {Q.MARKET}"


@query("snapshot_minute", f"{_SNAP} SELECT DISTINCT make_timestamp(timestamp * 1000000) AS ts, symbol, open, high, low, close, volume FROM market WHERE interval = '1m' AND symbol IN ('click', 'view')")
def snapshot_minute(spark, d):
    return S.snapshot_minute(fixtures.market(spark, d), ["click", "view"]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("snapshot_context", f"{_SNAP} SELECT DISTINCT make_timestamp(timestamp * 1000000) AS ts, symbol, close AS prev_close, high AS prev_high, low AS prev_low FROM market WHERE interval = 'D' AND symbol IN ('RF', 'AF')")
def snapshot_context(spark, d):
    return S.snapshot_context(fixtures.market(spark, d), ["RF", "AF"]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("snapshot_daily", f"{_SNAP} SELECT DISTINCT make_timestamp(timestamp * 1000000)::DATE AS date, symbol, open, high, low, close, volume FROM market WHERE interval = 'D' AND make_timestamp(timestamp * 1000000)::DATE BETWEEN '1995-01-01' AND '1999-12-31'")
def snapshot_daily(spark, d):
    return S.snapshot_daily(fixtures.market(spark, d), "1995-01-01", "1999-12-31")


@query("lagged_context", f"WITH {Q.DAILY} SELECT date, symbol, {Q.lag('close')} AS prev_close, {Q.lag('high')} AS prev_high, {Q.lag('low')} AS prev_low FROM daily")
def lagged_context(spark, d):
    return S.lagged_context(fixtures.daily_bars(spark, d))


@query("db_summary", f"WITH {Q.TICKS} SELECT symbol, count(*) AS n, min(ts) AS first, max(ts) AS last, round(count(*) / 375e0, 6) AS days, round(count(*) / 375e0 / 250e0, 8) AS years FROM ticks GROUP BY symbol")
def db_summary(spark, d):
    return S.summary(fixtures.ticks(spark, d), "ts", 375.0).withColumns({"days": F.round("days", 6), "years": F.round("years", 8)})


@query("snapshot_counts", f"WITH {Q.DAILY} SELECT symbol, count(*) AS n, min(date) AS first, max(date) AS last FROM daily GROUP BY symbol")
def snapshot_counts(spark, d):
    return S.counts(fixtures.daily_bars(spark, d), "date")


@query("quality_checks", f"WITH {Q.TICKS} SELECT symbol, count(*) AS n, 0e0 AS null_pct, count(*) FILTER (price = 0) AS zero_prices, count(*) FILTER (price < 0) AS negative_prices, 0::BIGINT AS high_below_low, count(*) - count(DISTINCT ts) AS repeated, CASE WHEN count(*) FILTER (price <= 0) + count(*) - count(DISTINCT ts) > 0 THEN 'WARN' ELSE 'OK' END AS status FROM ticks GROUP BY symbol")
def quality_checks(spark, d):
    return S.quality(fixtures.ticks(spark, d).select("symbol", "ts", *(F.col("price").alias(c) for c in S.PRICES)))


_PLAIN = "SELECT '{}' AS sink, symbol, date, {} AS close, {} AS volume FROM daily"


@query("sinks_round_trip", f"WITH {Q.DAILY} " + " UNION ALL ".join(_PLAIN.format(*x) for x in (("parquet", "close", "volume"), ("replaced", "close", "volume + 1"), ("csv", "round_even(close, 2)", "volume"), ("table", "close", "volume"))))
def sinks_round_trip(spark, d):
    """Bars as they come back from each sink: Parquet by symbol, the same read, changed and replaced, CSV of display, a catalogue table."""
    import uuid

    place, name = f"{shared_folder(spark)}/sinks_{uuid.uuid4().hex}", f"bars_{uuid.uuid4().hex}"
    bars = fixtures.daily_bars(spark, d)
    columns = ["symbol", "date", "close", "volume"]
    for folder in ("parquet", "replaced"):
        sinks.write_bars(bars, f"{place}/{folder}")
    sinks.replace_table(spark.read.parquet(f"{place}/replaced").withColumn("volume", F.col("volume") + 1), f"{place}/replaced")
    sinks.write_csv(sinks.display_rounded(bars.select(*columns), {"close": 2}), f"{place}/csv")
    back = {k: spark.read.parquet(f"{place}/{k}") for k in ("parquet", "replaced")}
    back["csv"] = spark.read.schema("symbol string, date date, close double, volume long").csv(f"{place}/csv", header=True)
    back["table"] = sinks.save_bucketed(bars, name, f"{place}/table")
    return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("sink"), *columns) for k, df in back.items()])


# -- features


def _features(spark, d, with_index=False):
    return features.daily_features(fixtures.daily_bars(spark, d), fixtures.index_bars(spark, d) if with_index else None)


for group, columns in Q.FEATURES.items():
    query(f"feat_{group}", Q.features(columns))(lambda spark, d, columns=tuple(columns): rounded(_features(spark, d).select("symbol", "date", *columns)))


@query("feat_index", f"WITH {Q.DAILY}, {Q.INDEX}, {Q.BASE}, {Q.WITH_INDEX} SELECT symbol, date, " + ", ".join(f"round({x}, 6) AS {c}" for c, x in Q.INDEX_FEATURES.items()) + " FROM moved")
def feat_index(spark, d):
    return rounded(_features(spark, d, True).select("symbol", "date", *features.INDEX_FEATURES))


_LINE = f"lines AS (SELECT *, {Q.ema('close', 12, False)} - {Q.ema('close', 26, False)} AS line FROM base), signals_ AS (SELECT *, {Q.ema('line', 9, False)} AS sig FROM lines)"


@query("feat_macd_signal", f"WITH {Q.DAILY}, {Q.BASE}, {_LINE} SELECT symbol, date, round(sig / (close + 1e-8), 8) AS macd_signal, round((line - sig) / (close + 1e-8), 8) AS macd_hist FROM signals_")
def feat_macd_signal(spark, d):
    return rounded(features.minute_features(fixtures.daily_bars(spark, d)).select("symbol", "date", "macd_signal", "macd_hist"), 8)


_FIRST = {
    "close_vs_sma10": f"close / ({Q.roll('avg', 'close', 10)}) - 1",
    "close_vs_sma50": f"close / ({Q.roll('avg', 'close', 50)}) - 1",
    "bb_pct": f"(close - ({Q._MID} - 2 * {Q._SD})) / (4 * {Q._SD} + 1e-8)",
    "volume_rel_20": f"v / (({Q.roll('avg', 'v', 20)}) + 1e-8)",
    "index_ret_5d": Q.change("index_close", 5),
    "index_vs_sma50": f"index_close / ({Q.roll('avg', 'index_close', 50)}) - 1",
    "index_ret_20d": Q.change("index_close", 20),
    "rs_5d": f"ret_5d - ({Q.change('index_close', 5)})",
    "atr_pct_14": f"({Q.roll('avg', 'tr', 14)}) / (close + 1e-8)",
    "rsi_14": f"(100 - 100 / (1 + ({Q.roll('avg', 'gain', 14)}) / (({Q.roll('avg', 'loss', 14)}) + 1e-8))) / 100",
    "close_vs_sma20": f"close / ({Q.roll('avg', 'close', 20)}) - 1",
    "close_vs_sma200": f"close / ({Q.roll('avg', 'close', 200)}) - 1",
    "rs_20d": f"ret_20d - ({Q.change('index_close', 20)})",
}
_EXACT = f"exact0 AS (SELECT b.*, i.close AS ic FROM base b LEFT JOIN idx i ON b.date = i.date), exact AS (SELECT *, COALESCE(last_value(ic IGNORE NULLS) OVER ({Q.W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(ic IGNORE NULLS) OVER ({Q.W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS index_close FROM exact0)"


@query("feat_first_generation", f"WITH {Q.DAILY}, {Q.INDEX}, {Q.BASE}, {_EXACT} SELECT symbol, date, " + ", ".join(f"round({x}, 6) AS {c}" for c, x in _FIRST.items()) + " FROM exact")
def feat_first(spark, d):
    return rounded(features.minute_features(fixtures.daily_bars(spark, d), fixtures.index_bars(spark, d)).select("symbol", "date", *_FIRST))


#: All features of the dataset, as SQL: those of the bars, then those of the aligned index.
_DATASET = {c: x for columns in Q.FEATURES.values() for c, x in columns.items()} | Q.INDEX_FEATURES
_INDEXED = f"WITH {Q.DAILY}, {Q.INDEX}, {Q.BASE}, {Q.WITH_INDEX}"
_FINITE = ("pct_from_high52w", "pct_from_low52w", "high_52w", "low_52w")


_DATASET_SQL = f"{_INDEXED}, f AS (SELECT symbol, date, open, high, low, close, volume, {Q.roll('avg', 'close', 200)} AS warm, " + ", ".join(f"round({'COALESCE((' + x + '), 0)' if c in _FINITE else x}, 6) AS {c}" for c, x in _DATASET.items()) + " FROM moved) SELECT * EXCLUDE (warm, open, high, low, close), round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, CASE WHEN date <= '1998-12-31' THEN 'train' WHEN date >= '1999-01-01' AND date <= '1999-12-31' THEN 'val' WHEN date >= '2000-01-01' THEN 'test' END AS split FROM f WHERE warm IS NOT NULL AND rsi_14 IS NOT NULL AND atr_14 IS NOT NULL"


@query("feature_dataset", _DATASET_SQL)
def feature_dataset(spark, d):
    """The whole dataset: bars, 54 features, split."""
    return _dataset(_features(spark, d, True))


def _dataset(df: DataFrame) -> DataFrame:
    df = align.sanitised(features.warm(df), list(_FINITE))
    df = df.withColumn("split", align.split(F.col("date"), *SPLITS, val_end_included=True))
    return rounded(df.select("symbol", "date", *S.PRICES, "volume", *_DATASET, "split"))


#: Rows of a block of windows in the query: few, so that the smallest table has several to a symbol.
HALO_ROWS = 700


@query("feature_dataset_blocks", _DATASET_SQL)
def feature_dataset_blocks(spark, d):
    """The same dataset from blocks of rows, several to a symbol, each with the rows before it that it reaches back to."""
    index = fixtures.index_bars(spark, d)
    return _dataset(halo.over_blocks(fixtures.daily_bars(spark, d), lambda bars: features.daily_features(bars, index), rows=HALO_ROWS))


@query("regime_of_features", f"{_INDEXED}, f AS (SELECT symbol, date, {Q.INDEX_FEATURES['index_vs_sma20']} AS x FROM moved) SELECT symbol, date, CASE WHEN COALESCE(round(x, 9), 0) >= 0 THEN 1 ELSE -1 END AS regime FROM f")
def regime_of_features(spark, d):
    """The side that trades may take by the index in the feature table."""
    df = _features(spark, d, True).withColumn("index_vs_sma20", F.round("index_vs_sma20", 9))
    return df.select("symbol", "date", backtest.regime_of(df, "index_vs_sma20").alias("regime"))


# -- alignment


@query("asof_index", f"WITH {Q.DAILY}, {Q.INDEX} SELECT d.symbol, d.date, i.close AS index_close FROM daily d ASOF LEFT JOIN idx i ON d.date >= i.date")
def asof_index(spark, d):
    return align.asof(fixtures.daily_bars(spark, d).select("symbol", "date"), fixtures.index_bars(spark, d), "date", "close", "index_close")


@query("exact_ffill_bfill", f"WITH {Q.DAILY}, {Q.INDEX}, {Q.BASE}, {_EXACT} SELECT symbol, date, index_close FROM exact")
def exact_fill(spark, d):
    return align.exact_filled(fixtures.daily_bars(spark, d).select("symbol", "date"), fixtures.index_bars(spark, d), "date", "close", "index_close")


@query("match_gate", f"WITH {Q.DAILY}, {Q.INDEX} SELECT d.symbol, d.date, CASE WHEN count(i.close) OVER (PARTITION BY d.symbol) >= 0.95 * count(*) OVER (PARTITION BY d.symbol) THEN i.close ELSE 0 END AS index_close FROM daily d LEFT JOIN idx i ON d.date = i.date")
def match_gate(spark, d):
    index = fixtures.index_bars(spark, d).select("date", F.col("close").alias("index_close"))
    return align.gated(fixtures.daily_bars(spark, d).select("symbol", "date").join(index, "date", "left"), "index_close", 0.95).select("symbol", "date", "index_close")


_NOTES = [("1995-01-17", "a"), ("1998-08-17", "b"), ("2001-12-24", "c")]


@query("nearest_bar", f"WITH {Q.INDEX}, notes(asked, note) AS (VALUES " + ", ".join(f"(DATE '{a}', '{n}')" for a, n in _NOTES) + ") SELECT asked, note, date, close FROM notes, idx QUALIFY row_number() OVER (PARTITION BY asked, note ORDER BY abs(date_diff('day', asked, date)), date) = 1")
def nearest_bar(spark, d):
    notes = spark.createDataFrame(_NOTES, "date string, note string").withColumn("date", F.col("date").cast("date"))
    return align.nearest(notes, fixtures.index_bars(spark, d), "date", ["close"])


_SPLIT = "CASE WHEN date <= '1998-12-31' THEN 'train' WHEN date >= '1999-01-01' AND date {op} '1999-12-31' THEN 'val' WHEN date >= '2000-01-01' THEN 'test' END"


@query("split_windows", f"WITH {Q.DAILY} SELECT symbol, {_SPLIT.format(op='<')} AS excluded, {_SPLIT.format(op='<=')} AS included, count(*) AS n FROM daily GROUP BY ALL")
def split_windows(spark, d):
    df = fixtures.daily_bars(spark, d)
    return df.groupBy("symbol", align.split(F.col("date"), *SPLITS).alias("excluded"), align.split(F.col("date"), *SPLITS, val_end_included=True).alias("included")).agg(F.count("*").alias("n"))


@query("half_open_range", f"WITH {Q.DAILY} SELECT symbol, count(*) AS n FROM daily WHERE date >= '1996-01-01' AND date < '1997-01-01' GROUP BY symbol")
def half_open(spark, d):
    return align.between(fixtures.daily_bars(spark, d), "date", "1996-01-01", "1997-01-01").groupBy("symbol").agg(F.count("*").alias("n"))


@query("sanitize", f"WITH {Q.DAILY}, {Q.BASE} SELECT symbol, date, round(COALESCE(ret_20d, 0), 6) AS ret_20d FROM base")
def sanitize(spark, d):
    return rounded(align.sanitised(features.base(fixtures.daily_bars(spark, d)), ["ret_20d"]).select("symbol", "date", "ret_20d"))


@query("min_history", f"WITH {Q.DAILY} SELECT symbol, date FROM daily QUALIFY count(*) OVER (PARTITION BY symbol) >= (SELECT avg(n) FROM (SELECT count(*) AS n FROM daily GROUP BY symbol))")
def min_history(spark, d):
    """Symbols with as many rows as symbols have on average."""
    bars = fixtures.daily_bars(spark, d).select("symbol", "date")
    least = math.ceil(bars.groupBy("symbol").count().agg(F.avg("count")).first()[0] or 0)
    return B.with_history(bars, least)


@query("traded_bars", f"WITH {Q.DAILY} SELECT symbol, count(*) AS n FROM daily WHERE volume > 0 GROUP BY symbol")
def traded_bars(spark, d):
    return B.traded(fixtures.daily_bars(spark, d)).groupBy("symbol").agg(F.count("*").alias("n"))


@query("forward_target", f"WITH {Q.DAILY}, {Q.BASE} SELECT symbol, date, round(COALESCE(lead(ret_5d, 5) OVER ({Q.W}), 0), 6) AS target FROM base")
def forward_target(spark, d):
    return rounded(features.forward_target(features.base(fixtures.daily_bars(spark, d))).select("symbol", "date", "target"))


# -- formulas

_ONE = {
    "div": (safe.div, "CASE WHEN abs(b) < 1e-8 THEN 0 ELSE a / NULLIF(b, 0) END"), "add": (safe.add, "a + b"), "sub": (safe.sub, "a - b"), "mul": (safe.mul, "a * b"),
    "max": (safe.greater, "greatest(a, b)"), "min": (safe.lesser, "least(a, b)"), "neg": (lambda a, b: safe.neg(a), "-a"), "abs": (lambda a, b: safe.absolute(a), "abs(a)"),
    "exp": (lambda a, b: safe.exp(a * 100), "CASE WHEN a * 100 > 10 THEN 1e0 ELSE exp(a * 100) END"), "log": (lambda a, b: safe.log(a), "CASE WHEN a <= 0 THEN 0 ELSE ln(CASE WHEN a <= 0 THEN 1 ELSE a END) END"), "sqrt": (lambda a, b: safe.sqrt(a), "CASE WHEN a < 0 THEN 0 ELSE sqrt(CASE WHEN a < 0 THEN 0 ELSE a END) END"), "tanh": (lambda a, b: safe.squashed(a), "tanh(COALESCE(a, 0))"),
}


@query("safe_functions", f"WITH {Q.DAILY}, {Q.BASE}, ab AS (SELECT symbol, date, ret_5d AS a, ret_20d AS b FROM base) SELECT symbol, date, " + ", ".join(f"round(COALESCE({x}, 0), 6) AS f_{n}" for n, (_, x) in _ONE.items()) + " FROM ab")
def safe_functions(spark, d):
    df = features.base(fixtures.daily_bars(spark, d)).select("symbol", "date", F.col("ret_5d").alias("a"), F.col("ret_20d").alias("b"))
    return rounded(df.select("symbol", "date", *(f(F.col("a"), F.col("b")).alias(f"f_{n}") for n, (f, _) in _ONE.items())))


_fin = Q.fin
_FSQL = f"WITH {Q.DAILY}, {Q.INDEX}, {Q.BASE}, {Q.WITH_INDEX}, feats AS (SELECT symbol, date, {_fin(Q.rsi('gain', 'loss', 7))} AS rsi_7, {_fin(Q.FEATURES['sma']['close_vs_sma200'])} AS close_vs_sma200, {_fin(Q.INDEX_FEATURES['rel_strength'])} AS rel_strength, {_fin(Q.FEATURES['bollinger']['bb_width_20'])} AS bb_width_20, COALESCE(ret_5d, 0) AS ret_5d, COALESCE(ret_20d, 0) AS ret_20d, {_fin(Q.FEATURES['volatility']['vol_20d'])} AS vol_20d, {_fin(Q.FEATURES['volatility']['vol_60d'])} AS vol_60d FROM moved)"
_FEXPR = {
    "f1": "rsi_7 - 0.5",
    "f2": "close_vs_sma200",
    "f3": "rel_strength * bb_width_20 - CASE WHEN abs(vol_20d) < 1e-8 THEN 0 ELSE ret_5d / NULLIF(vol_20d, 0) END",
    "f4": "greatest(-ret_20d, CASE WHEN vol_60d <= 0 THEN 0 ELSE ln(CASE WHEN vol_60d <= 0 THEN 1 ELSE vol_60d END) END)",
    "f5": "sqrt(exp(ret_5d))",
    "f6": "least(ret_5d, ret_20d) + 0.1",
}


@query("formula_signal", f"{_FSQL} SELECT symbol, date, " + ", ".join(f"round({x}, 6) AS {n}" for n, x in _FEXPR.items()) + " FROM feats")
def formula_signal(spark, d):
    df = _features(spark, d, True)
    return rounded(df.select("symbol", "date", *(formula.column(text).alias(n) for n, text in FORMULAS.items())))


@query("signal_diversity", f"WITH {Q.DAILY}, {Q.BASE}, s AS (SELECT COALESCE(ret_5d, 0) AS x FROM base) SELECT count(*) AS n, round(stddev_pop(tanh(x)), 6) AS spread, stddev_pop(tanh(x)) >= 0.01 AS diverse FROM s")
def signal_diversity(spark, d):
    df = features.base(fixtures.daily_bars(spark, d))
    return rounded(formula.diverse(df, "ret_5d", rows=2**31 - 1))


@query("signal_sample")
def signal_sample(spark, d):
    """The spread of each formula over a repeatable sample of 500 rows: a look before a formula is searched with."""
    df = _features(spark, d, True).select("symbol", "date", *{f for text in FORMULAS.values() for f in sorted(formula.parse(text).features())})
    df = written(df, "sampled")
    looks = [formula.diverse(df, text).withColumn("tree", F.lit(n)) for n, text in FORMULAS.items()]
    return rounded(reduce(DataFrame.unionByName, looks))


@query("max_row", f"WITH {Q.DAILY}, {Q.BASE} SELECT symbol, date, round(ret_5d, 6) AS ret_5d, round(base.close, 6) AS close, volume FROM base WHERE base.close > base.open AND volume >= 20 AND ret_5d IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ret_5d DESC, date) = 1")
def max_row(spark, d):
    """Each symbol's best five days among those that end with a gain on some volume."""
    df = features.base(fixtures.daily_bars(spark, d)).select("symbol", "date", "open", "close", "volume", "ret_5d")
    return rounded(B.max_row(df, "ret_5d", (F.col("close") > F.col("open")) & (F.col("volume") >= 20), ["symbol"]).drop("open"))


# -- backtest


def signals(spark, d) -> DataFrame:
    """Bars with a signal of the first formula and a regime of the index against its mean; both rounded before they decide."""
    return signals_of(align.asof(fixtures.daily_bars(spark, d), fixtures.index_bars(spark, d), "date", "close", "index_close"))


def signals_of(bars: DataFrame) -> DataFrame:
    """The same of bars that have the index's close."""
    df = features.base(bars)
    df = df.withColumns({"rsi_7": rolling.rsi("__gain", "__loss", 7), "index_mean": F.avg("index_close").over(rolling.rows(50))})
    regime = F.when(F.round("index_close", 4) >= F.round("index_mean", 4), 1).otherwise(-1)
    return df.select("symbol", "date", "open", "close", F.round(formula.column(FORMULAS["f1"]), 6).alias("signal"), regime.alias("regime"))


#: Rows of a block of time in the query: few, so that the smallest table has several.
BLOCK_ROWS = 1000
_TRADE_COLS = ("symbol", "direction", "entry_day", "exit_day", "entry_price", "exit_price", "hold_days", "net_return", "signal_entry", "exit_reason")
_TRADE_SQL = "SELECT symbol, direction::INT AS direction, entry_day::INT AS entry_day, exit_day::INT AS exit_day, round(entry_price, 6) AS entry_price, round(exit_price, 6) AS exit_price, hold_days::INT AS hold_days, round(net_return, 6) AS net_return, signal_entry, exit_reason FROM trades"


@query("backtest_trades", f"{Q.TRADES} {_TRADE_SQL}")
def backtest_trades(spark, d):
    return rounded(backtest.trades(signals(spark, d)).select(*_TRADE_COLS))


@query("backtest_trades_folded", f"{Q.TRADES} {_TRADE_SQL}")
def backtest_folded(spark, d):
    return rounded(backtest.trades_folded(signals(spark, d)).select(*_TRADE_COLS))


@query("backtest_trades_blocks", f"{Q.TRADES} {_TRADE_SQL}")
def backtest_blocks(spark, d):
    """The same trades from blocks of time, several to a symbol, each a task of its own."""
    return rounded(blocks.trades(signals(spark, d), rows=BLOCK_ROWS).select(*_TRADE_COLS))


def bucketed_bars(spark, d) -> DataFrame:
    """Bars with the index's close as a catalogue table in buckets of symbols."""
    import uuid

    name = f"bars_{uuid.uuid4().hex}"
    aligned = align.asof(fixtures.daily_bars(spark, d), fixtures.index_bars(spark, d), "date", "close", "index_close")
    return sinks.save_bucketed(aligned, name, f"{shared_folder(spark)}/{name}")


@query("backtest_trades_bucketed", f"{Q.TRADES} {_TRADE_SQL}")
def backtest_bucketed(spark, d):
    """The same trades from a stored table in buckets: from there on without an exchange."""
    return rounded(backtest.trades(signals_of(bucketed_bars(spark, d))).select(*_TRADE_COLS))


@query("stream_trades", f"{Q.TRADES} {_TRADE_SQL}")
def stream_trades(spark, d):
    """The same trades from a stream of bars in three batches, stopped and restarted after each."""
    import uuid

    from ..streaming import machine

    bars = signals(spark, d).withColumn("ts", F.col("date").cast("timestamp"))
    return rounded(machine.replayed(bars, f"{shared_folder(spark)}/trades_{uuid.uuid4().hex}").select(*_TRADE_COLS))


@query("equity_curve", f"{Q.TRADES}, {Q.CURVE} SELECT symbol, date, round(equity, 6) AS equity, round(drawdown, 6) AS drawdown FROM curve")
def equity_curve(spark, d):
    s = signals(spark, d)
    return rounded(metrics.equity(s, backtest.trades(s)).select("symbol", "date", "equity", "drawdown"))


_M = ("total_return_pct", "annual_return_pct", "sharpe_ratio", "sortino_ratio", "max_drawdown_pct", "win_rate", "avg_hold_days", "trades_per_year", "profit_factor")
_MSQL = ", ".join(f"round({m}, 6) AS {m}" for m in _M)


def _metrics(spark, d):
    s = signals(spark, d)
    return metrics.metrics(s, backtest.trades(s))


@query("metrics_of_trades", f"{Q.TRADES}, {Q.CURVE}, {Q.METRICS} SELECT symbol, n_trades, {_MSQL} FROM metrics")
def metrics_of_trades(spark, d):
    """The same metrics from the trades and the number of rows of a symbol, without a curve of every row."""
    lengths = fixtures.daily_bars(spark, d).groupBy("symbol").agg(F.count("*").alias("n_days"))
    return rounded(metrics.of_trades(lengths, backtest.trades(signals(spark, d))))


@query("backtest_metrics", f"{Q.TRADES}, {Q.CURVE}, {Q.METRICS} SELECT symbol, n_trades, {_MSQL} FROM metrics")
def backtest_metrics(spark, d):
    return rounded(_metrics(spark, d))


_LOG_TRADES = f"WITH RECURSIVE {Q.DAILY}, {Q.INDEX}, {Q.BASE}, {Q.ASOF}, {Q.SIGNAL}, {Q.machine(False, False)}, log AS (SELECT t.symbol, CASE WHEN direction = 1 THEN 'LONG' ELSE 'SHORT' END AS direction, strftime(e.date, '%Y-%m-%d') AS entry_date, CASE WHEN exit_reason = 'OPEN_TRADE' THEN 'OPEN' ELSE strftime(x.date, '%Y-%m-%d') END AS exit_date, entry_price, exit_price, hold_days, 100 * net_return AS pnl_pct, exit_reason, signal_entry AS entry_signal, x.signal AS exit_signal FROM trades t JOIN rows_ e ON e.symbol = t.symbol AND e.i = t.entry_day JOIN rows_ x ON x.symbol = t.symbol AND x.i = t.exit_day)"


def _log(spark, d):
    s = signals(spark, d)
    return backtest.log(s, backtest.trades(s, rules=backtest.LOG_RULES))


@query("trade_log", f"{_LOG_TRADES} SELECT symbol, direction, entry_date, exit_date, round(entry_price, 6) AS entry_price, round(exit_price, 6) AS exit_price, hold_days::INT AS hold_days, round(pnl_pct, 6) AS pnl_pct, exit_reason, entry_signal, exit_signal FROM log")
def trade_log(spark, d):
    return rounded(_log(spark, d))


_CLOSED = "FILTER (exit_date <> 'OPEN')"


@query("trade_summary", f"{_LOG_TRADES} SELECT count(*) AS n_trades, count(*) FILTER (exit_date = 'OPEN') AS n_open, count(*) {_CLOSED} AS n_closed, round(100 * avg(CASE WHEN pnl_pct > 0 THEN 1e0 ELSE 0 END) {_CLOSED}, 6) AS win_rate, round(avg(pnl_pct) {_CLOSED}, 6) AS avg_pnl, round(max(pnl_pct) {_CLOSED}, 6) AS best_pnl, round(min(pnl_pct) {_CLOSED}, 6) AS worst_pnl, round(sum(pnl_pct) {_CLOSED}, 6) AS total_pnl, round(avg(hold_days) {_CLOSED}, 6) AS avg_hold FROM log")
def trade_summary(spark, d):
    return rounded(metrics.trade_summary(_log(spark, d)))


@query("per_stock_summary", f"{_LOG_TRADES} SELECT symbol, count(*) AS n_closed, round(100 * avg(CASE WHEN pnl_pct > 0 THEN 1e0 ELSE 0 END), 6) AS win_rate, round(avg(pnl_pct), 6) AS avg_pnl, round(sum(pnl_pct), 6) AS total_pnl FROM log WHERE exit_date <> 'OPEN' GROUP BY symbol")
def per_stock(spark, d):
    return rounded(metrics.per_symbol_summary(_log(spark, d)))


@query("open_trades", f"{_LOG_TRADES} SELECT symbol, direction, entry_date, round(entry_price, 6) AS entry_price, round(exit_price, 6) AS exit_price, round(pnl_pct, 6) AS pnl_pct, hold_days::INT AS hold_days FROM log WHERE exit_date = 'OPEN'")
def open_trades(spark, d):
    return rounded(metrics.open_trades(_log(spark, d)))


@query("hold_histogram", f"{_LOG_TRADES} SELECT CASE WHEN hold_days >= 60 THEN 31 ELSE floor(hold_days / 2)::BIGINT + 1 END AS bin, count(*) AS n, count(*) FILTER (pnl_pct > 0) AS wins, count(*) FILTER (pnl_pct <= 0) AS losses FROM log GROUP BY 1")
def hold_histogram(spark, d):
    return metrics.return_histogram(_log(spark, d), "hold_days", 30, 0.0, 60.0)


@query("return_distribution", f"{_LOG_TRADES} SELECT CASE WHEN round(pnl_pct, 6) < -20 THEN 0 WHEN round(pnl_pct, 6) >= 20 THEN 41 ELSE floor(round(pnl_pct, 6) + 20)::BIGINT + 1 END AS bin, count(*) AS n, count(*) FILTER (pnl_pct > 0) AS wins, count(*) FILTER (pnl_pct <= 0) AS losses FROM log GROUP BY 1")
def return_distribution(spark, d):
    """Trades by their result, in bins of one per cent."""
    return metrics.return_histogram(_log(spark, d).withColumn("pnl_pct", F.round("pnl_pct", 6)), "pnl_pct", 40, -20.0, 20.0)


@query("trades_per_symbol", f"{_LOG_TRADES} SELECT symbol, direction, count(*) AS n FROM log GROUP BY ALL")
def trades_per_symbol(spark, d):
    return _log(spark, d).groupBy("symbol", "direction").agg(F.count("*").alias("n"))


@query("results_by_split", f"{Q.TRADES}, {Q.CURVE}, {Q.METRICS} SELECT 'all' AS split, count(*) AS n_symbols, sum(n_trades)::BIGINT AS n_trades, " + ", ".join(f"round(avg({m}), 6) AS avg_{m}, round(stddev_pop({m}), 6) AS std_{m}" for m in ("total_return_pct", "annual_return_pct", "sharpe_ratio", "max_drawdown_pct", "win_rate")) + " FROM metrics")
def results_by_split(spark, d):
    return rounded(metrics.across_symbols(_metrics(spark, d).withColumn("split", F.lit("all")), "split"))


def _grouped_sql(group: str, of: str, where: str) -> str:
    """Metrics by symbol and group: the machine walks over names that hold both."""
    start = f"WITH RECURSIVE {Q.DAILY}, {Q.INDEX}, {Q.BASE}, {Q.ASOF}, {Q.SIGNAL.replace('signals AS', 'signals0 AS')}, {of}"
    named = f"signals AS (SELECT symbol || '|' || {group} AS symbol, date, open, close, signal, regime, row_number() OVER (PARTITION BY symbol, {group} ORDER BY date) - 1 AS i FROM grouped WHERE {where})"
    return f"{start}, {named}, {Q.machine()}, {Q.CURVE}, {Q.METRICS} SELECT split_part(symbol, '|', 1) AS symbol, split_part(symbol, '|', 2) AS {group}, n_trades, {_MSQL} FROM metrics"


@query("portfolio_by_split", _grouped_sql("split", f"grouped AS (SELECT *, {_SPLIT.format(op='<')} AS split FROM signals0)", "split IS NOT NULL"))
def portfolio_by_split(spark, d):
    """Metrics of each symbol within each split: the machine starts anew in each."""
    s = signals(spark, d).withColumn("split", align.split(F.col("date"), *SPLITS)).where("split IS NOT NULL")
    return rounded(metrics.metrics(s, backtest.trades(s, ["split", "symbol"]), ["split", "symbol"]))


_ACROSS = ("total_return_pct", "annual_return_pct", "sharpe_ratio", "max_drawdown_pct", "win_rate")


def _across_sql(group: str, of: str) -> str:
    return f"SELECT {group}, count(*) AS n_symbols, sum(n_trades)::BIGINT AS n_trades, " + ", ".join(f"round(avg({m}), 4) AS avg_{m}, round(stddev_pop({m}), 4) AS std_{m}" for m in _ACROSS) + f" FROM ({of}) GROUP BY {group}"


@query("results_table", _across_sql("split", ORACLE["portfolio_by_split"]))
def results_table(spark, d):
    """Mean and deviation over symbols: training, validation and test rows."""
    return rounded(metrics.across_symbols(portfolio_by_split(spark, d), "split"), 4)


@query("fitness_single", f"{Q.TRADES}, {Q.CURVE}, {Q.METRICS} SELECT symbol, round({Q.SINGLE}, 6) AS fitness FROM metrics")
def fitness_single(spark, d):
    return rounded(_metrics(spark, d).select("symbol", metrics.single_fitness(3).alias("fitness")))


_PORT = f"{Q.TRADES}, {Q.CURVE}, {Q.METRICS}, s AS (SELECT {Q.SINGLE} AS f, n_trades FROM metrics), p AS (SELECT CASE WHEN count(*) FILTER (f > -50) < 3 THEN -50 + 5e0 * count(*) FILTER (f > -50) ELSE avg(f) FILTER (f > -50) - 1.5e0 * stddev_pop(f) FILTER (f > -50) END AS fitness, sum(n_trades)::BIGINT AS n_trades FROM s)"


@query("fitness_portfolio", f"{_PORT} SELECT 'f1' AS tree, round(fitness, 6) AS fitness, n_trades FROM p")
def fitness_portfolio(spark, d):
    scores = _metrics(spark, d).withColumns({"fitness": metrics.single_fitness(3), "tree": F.lit("f1")})
    return rounded(metrics.portfolio_fitness(scores, ["tree"]))


# Formulas on the rows of each split, symbol by symbol: what a search makes of a population.
_FINAL = "CASE WHEN n_train < 10 OR train <= -40 THEN -50e0 ELSE (0.4e0 * train + 0.6e0 * val) * (CASE WHEN train > 1e-8 THEN CASE WHEN val <= 0 THEN 0.1e0 WHEN val / (train + 1e-8) < 0.3 THEN 0.2e0 WHEN val / (train + 1e-8) < 0.6 THEN 0.6e0 ELSE 1e0 END ELSE 0.5e0 END) END"
_SIZE = "CASE tree " + " ".join(f"WHEN '{n}' THEN {formula.parse(text).size()}" for n, text in FORMULAS.items()) + " END"
_TREES_SQL = f"{_FSQL[_FSQL.index('feats AS'):]}, trees AS (SELECT symbol, date, unnest([" + ", ".join(f"{{'tree': '{n}', 'signal': round({x}, 6)}}" for n, x in _FEXPR.items()) + "], recursive := true) FROM feats)"
_TREES_SQL += f", grouped AS (SELECT s.* EXCLUDE (signal), t.signal, tree || '~' || {_SPLIT.format(op='<')} AS cell FROM signals0 s JOIN trees t USING (symbol, date))"
_SCORES_SQL = _grouped_sql("cell", _TREES_SQL, "cell IS NOT NULL AND cell NOT LIKE '%~test'").replace(Q.ASOF, Q.WITH_INDEX)
_SCORES_SQL = f"WITH c AS (SELECT split_part(cell, '~', 1) AS tree, split_part(cell, '~', 2) AS split, * FROM ({_SCORES_SQL})), s AS (SELECT tree, split, {Q.SINGLE.replace('0.02e0 * 3', f'0.02e0 * {_SIZE}')} AS f, n_trades FROM c), p AS (SELECT tree, split, CASE WHEN count(*) FILTER (f > -50) < 3 THEN -50 + 5e0 * count(*) FILTER (f > -50) ELSE avg(f) FILTER (f > -50) - 1.5e0 * stddev_pop(f) FILTER (f > -50) END AS fitness, sum(n_trades)::BIGINT AS n_trades FROM s GROUP BY ALL)"


def _scores(spark, d) -> DataFrame:
    """(tree, split, fitness, n_trades) of the six formulas over all symbols, trained and validated."""
    sized = spark.createDataFrame([(n, formula.parse(text).size()) for n, text in FORMULAS.items()], "tree string, size int")
    trees = F.explode(F.array(*(F.struct(F.lit(n).alias("tree"), F.round(formula.column(text), 6).alias("signal")) for n, text in FORMULAS.items()))).alias("t")
    rows = _features(spark, d, True).select("symbol", "date", trees).select("symbol", "date", "t.tree", "t.signal")
    rows = rows.join(signals(spark, d).drop("signal"), ["symbol", "date"]).withColumn("split", align.split(F.col("date"), *SPLITS)).where("split IN ('train', 'val')")
    rows = written(rows, "populations")
    by = ["tree", "split", "symbol"]
    scored = metrics.metrics(rows, backtest.trades(rows, by), by).join(F.broadcast(sized), "tree")
    return metrics.portfolio_fitness(scored.withColumn("fitness", metrics.single_fitness(F.col("size"))), ["tree", "split"])


_FITNESS_SQL = f"{_SCORES_SQL}, t AS (SELECT tree, COALESCE(max(fitness) FILTER (split = 'train'), -50) AS train, COALESCE(max(fitness) FILTER (split = 'val'), -50) AS val, COALESCE(max(n_trades) FILTER (split = 'train'), 0)::BIGINT AS n_train FROM p GROUP BY tree)"


@query("fitness_final", f"{_FITNESS_SQL} SELECT tree, round(train, 4) AS train, round(val, 4) AS val, n_train, round({_FINAL}, 4) AS fitness FROM t")
def fitness_final(spark, d):
    """Each formula's fitness on training and validation rows, and both together."""
    by_tree = _scores(spark, d).groupBy("tree")
    of = lambda split, c: F.max(F.when(F.col("split") == split, F.col(c)))
    both = by_tree.agg(F.coalesce(of("train", "fitness"), F.lit(metrics.FAILED)).alias("train"), F.coalesce(of("val", "fitness"), F.lit(metrics.FAILED)).alias("val"), F.coalesce(of("train", "n_trades"), F.lit(0)).alias("n_train"))
    return rounded(both.withColumn("fitness", metrics.final_fitness()), 4)


@query("gen_stats", f"{_SCORES_SQL} SELECT CASE split WHEN 'train' THEN 0 ELSE 1 END AS gen, round(max(f), 4) AS best, round(avg(f), 4) AS avg, round(stddev_pop(f), 4) AS std, round(min(f), 4) AS min, count(f)::INT AS n_valid, count(*)::INT AS n_total FROM (SELECT split, CASE WHEN tree <> 'f6' OR split = 'train' THEN fitness ELSE NULL END AS f FROM p) GROUP BY ALL")
def gen_stats(spark, d):
    """Statistics of the formulas' fitness, the training rows as generation 0 and the validation rows as 1; one that could not be evaluated (f6 in the second) is left out."""
    scores = _scores(spark, d).select(F.when(F.col("split") == "train", 0).otherwise(1).alias("gen"), F.when((F.col("tree") == "f6") & (F.col("split") == "val"), -99.0).otherwise(F.col("fitness")).alias("fitness"))
    return rounded(metrics.generation_stats(scores), 4)


#: A population over the signals of the formulas, with parts in common; its SQL takes the same numbers.
POPULATION = {
    "f1": "f1", "neg(f1)": "-f1", "max(f2, f4)": "greatest(f2, f4)", "sub(f3, f6)": "f3 - f6", "mul(f1, f2)": "f1 * f2",
    "add(f2, mul(f1, f2))": "f2 + f1 * f2", "add(mul(f2, f1), f2)": "f2 + f1 * f2", "neg(add(f2, mul(f1, f2)))": "-(f2 + f1 * f2)", "min(sub(f3, f6), f1)": "least(f3 - f6, f1)",
}
_POP_SIZE = "CASE tree " + " ".join(f"WHEN '{t}' THEN {formula.parse(t).size()}" for t in POPULATION) + " END"
_POP_TREES = f"rounded_ AS (SELECT symbol, date, {', '.join(f'round({x}, 6) AS {n}' for n, x in _FEXPR.items())} FROM feats), trees AS (SELECT symbol, date, unnest([" + ", ".join(f"{{'tree': '{t}', 'signal': {x}}}" for t, x in POPULATION.items()) + "], recursive := true) FROM rounded_)"
_POP_SQL = _FITNESS_SQL.replace(_TREES_SQL[_TREES_SQL.index("trees AS") : _TREES_SQL.index(", grouped AS")], _POP_TREES).replace(_SIZE, _POP_SIZE)


def searchable(spark, d) -> DataFrame:
    """Rows of the training and validation splits with the formulas' signals, as features to search over."""
    of = _features(spark, d, True).select("symbol", "date", *(F.round(formula.column(text), 6).alias(n) for n, text in FORMULAS.items()))
    rows = of.join(signals(spark, d).drop("signal"), ["symbol", "date"])
    return rows.withColumn("split", align.split(F.col("date"), *SPLITS)).where("split IN ('train', 'val')")


@query("population_fitness", f"{_POP_SQL} SELECT tree, round({_FINAL}, 4) AS fitness FROM t")
def population_fitness(spark, d):
    """Fitness of a population as a search has it: one graph of expressions over each series."""
    series = evolve.prepare(searchable(spark, d), list(FORMULAS))
    return rounded(evolve.evaluate(series, [formula.parse(t) for t in POPULATION], list(FORMULAS), chunks=2), 4)


@query("population_fitness_blocks", f"{_POP_SQL} SELECT tree, round({_FINAL}, 4) AS fitness FROM t")
def population_fitness_blocks(spark, d):
    """The same fitness from blocks of time, several to a series, each with the whole population as one graph."""
    return rounded(evolve.evaluate_blocks(evolve.prepare_blocks(searchable(spark, d), list(FORMULAS), BLOCK_ROWS), [formula.parse(t) for t in POPULATION], list(FORMULAS)), 4)


# -- regimes

_REG = f"WITH {Q.DAILY}, reg0 AS (SELECT symbol, date, close, {Q.change('close', 50)} AS trend FROM daily), reg AS (SELECT *, CASE WHEN trend > 0.05 THEN 'BULL' WHEN trend < -0.05 THEN 'BEAR' ELSE 'FLAT' END AS regime FROM reg0)"


def _reg(spark, d):
    return regimes.labelled(regimes.trend(fixtures.daily_bars(spark, d)))


@query("regime_label", f"{_REG} SELECT symbol, date, regime FROM reg")
def regime_label(spark, d):
    return _reg(spark, d).select("symbol", "date", "regime")


@query("regime_distribution", f"{_REG} SELECT l.regime, count(r.regime) AS n, round(100e0 * count(r.regime) / (SELECT count(*) FROM reg), 6) AS pct, round(COALESCE(100 * avg(trend), 0), 6) AS avg_trend FROM (VALUES ('BULL'), ('BEAR'), ('FLAT')) l(regime) LEFT JOIN reg r ON r.regime = l.regime GROUP BY l.regime")
def regime_distribution(spark, d):
    return rounded(regimes.distribution(_reg(spark, d)))


@query("regime_runs", f"{_REG}, marked AS (SELECT *, CASE WHEN lag(regime) OVER ({Q.W}) = regime THEN 0 ELSE 1 END AS new FROM reg), numbered AS (SELECT *, sum(new) OVER ({Q.W}) AS run FROM marked) SELECT symbol, regime, min(date) AS start, max(date) AS \"end\", count(*) AS n FROM numbered GROUP BY symbol, run, regime")
def regime_runs(spark, d):
    return B.runs(_reg(spark, d), "regime", "date", ["symbol"])


@query("regime_yearly_pivot", f"{_REG} SELECT year(date)::INT AS year, count(*) FILTER (regime = 'BULL') AS \"BULL\", count(*) FILTER (regime = 'BEAR') AS \"BEAR\", count(*) FILTER (regime = 'FLAT') AS \"FLAT\" FROM reg GROUP BY 1")
def regime_yearly(spark, d):
    return regimes.yearly(_reg(spark, d))


@query("regime_value_counts", f"{_REG} SELECT regime, count(*) AS n FROM reg GROUP BY regime")
def regime_counts(spark, d):
    return regimes.value_counts(_reg(spark, d), "regime")


@query("regime_transition_counts", f"{_REG}, p AS (SELECT lag(regime) OVER ({Q.W}) AS f, regime AS t FROM reg), c AS (SELECT f, t, count(*) AS n FROM p WHERE f IS NOT NULL GROUP BY ALL) SELECT f AS \"from\", t AS \"to\", n, round(n / sum(n) OVER (PARTITION BY f), 6) AS share FROM c")
def regime_transitions(spark, d):
    return rounded(regimes.transitions(_reg(spark, d)))


_IREG = f"{Q.INDEX}, ireg AS (SELECT date, CASE WHEN x > 0.05 THEN 'BULL' WHEN x < -0.05 THEN 'BEAR' ELSE 'FLAT' END AS regime FROM (SELECT symbol, date, {Q.change('close', 20)} AS x FROM idx))"


@query("regime_merge_fill", f"WITH {Q.DAILY}, {_IREG}, j AS (SELECT d.symbol, d.date, r.regime FROM daily d LEFT JOIN ireg r USING (date)) SELECT symbol, date, COALESCE(last_value(regime IGNORE NULLS) OVER ({Q.W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(regime IGNORE NULLS) OVER ({Q.W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS regime FROM j")
def regime_merge(spark, d):
    index = regimes.labelled(regimes.trend(fixtures.index_bars(spark, d), 20))
    return regimes.merged(fixtures.daily_bars(spark, d).select("symbol", "date"), index, ["regime"]).select("symbol", "date", "regime")


def _probabilities(df: DataFrame) -> DataFrame:
    """Four numbers a row that sum to one, from the candle: a stand-in for a model's probabilities."""
    raw = {"bull_quiet": F.col("close") - F.col("low") + 1, "crisis": F.col("high") - F.col("close") + 1, "sideways_bear": F.col("high") - F.col("open") + 1, "volatile": F.col("open") - F.col("low") + 1}
    return df.withColumns({f"prob_{k}": v / (2 * (F.col("high") - F.col("low")) + 4) for k, v in raw.items()})


_PROB = {"bull_quiet": "close - low + 1", "crisis": "high - close + 1", "sideways_bear": "high - open + 1", "volatile": "open - low + 1"}
_SMOOTH = f"WITH {Q.DAILY}, pr AS (SELECT symbol, date, " + ", ".join(f"({v}) / (2 * (high - low) + 4) AS prob_{k}" for k, v in _PROB.items()) + " FROM daily), sm AS (SELECT symbol, date, " + ", ".join(f"round(avg(prob_{k}) OVER ({Q.W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS smooth_{k}" for k in _PROB) + " FROM pr)"


@query("regime_smooth", f"{_SMOOTH} SELECT *, CASE greatest(" + ", ".join(f"smooth_{k}" for k in _PROB) + ") " + " ".join(f"WHEN smooth_{k} THEN '{k.upper()}'" for k in _PROB) + " END AS regime_smooth FROM sm")
def regime_smooth(spark, d):
    df = regimes.smoothed(_probabilities(fixtures.daily_bars(spark, d)))
    # Rounded before they are compared, so that ties are ties on either side.
    df = rounded(df.select("symbol", "date", *(f"smooth_{s}" for s in regimes.STATES)))
    values = F.array(*(F.col(f"smooth_{s}") for s in regimes.STATES))
    return df.withColumn("regime_smooth", F.element_at(F.array(*(F.lit(s.upper()) for s in regimes.STATES)), F.array_position(values, F.array_max(values)).cast("int")))


_STATE = f"sf0 AS (SELECT symbol, date, close, {Q.change('close', 1)} AS ret_1d, {Q.change('close', 5)} AS ret_5d, {Q.change('close', 20)} AS ret_20d FROM idx), sf1 AS (SELECT *, {Q.roll('stddev_samp', 'ret_1d', 5)} AS vol_5d, {Q.roll('stddev_samp', 'ret_1d', 20)} AS vol_20d, {Q.roll('stddev_samp', 'ret_1d', 60)} AS vol_60d, {Q.roll('avg', 'close', 50)} AS sma50, {Q.roll('avg', 'close', 200)} AS sma200, {Q.roll('max', 'close', 252)} AS high_52w FROM sf0), sf AS (SELECT *, (close - sma50) / (sma50 + 1e-9) AS trend, (close - high_52w) / (high_52w + 1e-9) AS drawdown FROM sf1 WHERE high_52w IS NOT NULL AND vol_60d IS NOT NULL AND sma200 IS NOT NULL)"


@query("regime_features", f"WITH {Q.INDEX}, {_STATE} SELECT symbol, date, round(vol_5d, 6) AS vol_5d, round(vol_60d, 6) AS vol_60d, round(trend, 6) AS trend, round(drawdown, 6) AS drawdown FROM sf")
def regime_features(spark, d):
    return rounded(regimes.state_features(fixtures.index_bars(spark, d)).select("symbol", "date", "vol_5d", "vol_60d", "trend", "drawdown"))


@query("standard_scaling", f"WITH {Q.INDEX}, {_STATE}, o AS (SELECT avg(trend) AS mt, stddev_pop(trend) AS st, avg(drawdown) AS md, stddev_pop(drawdown) AS sd FROM sf) SELECT symbol, date, round((trend - mt) / st, 6) AS trend, round((drawdown - md) / sd, 6) AS drawdown FROM sf, o")
def standard_scaling(spark, d):
    return rounded(regimes.scaled(regimes.state_features(fixtures.index_bars(spark, d)), ["trend", "drawdown"]).select("symbol", "date", "trend", "drawdown"))


@query("regime_state_stats", f"WITH {Q.INDEX}, {_STATE}, r AS (SELECT *, CASE WHEN trend > 0.05 THEN 'BULL' WHEN trend < -0.05 THEN 'BEAR' ELSE 'FLAT' END AS regime FROM sf) SELECT regime, count(*) AS days, round(100e0 * count(*) / (SELECT count(*) FROM r), 6) AS pct, round(avg(ret_1d), 6) AS avg_ret_1d, round(avg(ret_20d), 6) AS avg_ret_20d, round(avg(vol_20d), 6) AS avg_vol_20d, round(avg(drawdown), 6) AS avg_drawdown FROM r GROUP BY regime")
def regime_state_stats(spark, d):
    df = regimes.state_features(fixtures.index_bars(spark, d))
    return rounded(regimes.state_stats(df.withColumn("regime", regimes.label("trend"))))


_MODELS: dict[tuple[str, str], tuple] = {}


def _hmm(spark, d):
    """The states' features, written once, and the models fitted to them: one fit a session for all that read it."""
    key = spark.sparkContext.applicationId, d
    if key not in _MODELS:
        df = written(regimes.state_features(fixtures.index_bars(spark, d)), "states")
        _MODELS[key] = df, hmm.fitted(df)
    return _MODELS[key]


@query("hmm_labels")
def hmm_labels(spark, d):
    df, models = _hmm(spark, d)
    return hmm.detect(df, models=models)


_MARKET_SQL = f"reg0 AS (SELECT symbol, date, {Q.change('close', 50)} AS trend FROM daily), grouped0 AS (SELECT g.*, CASE WHEN trend > 0.05 THEN 'BULL' WHEN trend < -0.05 THEN 'BEAR' ELSE 'FLAT' END AS market FROM signals0 g JOIN reg0 USING (symbol, date)), grouped AS (SELECT * FROM grouped0 QUALIFY count(*) OVER (PARTITION BY market) >= 100 AND count(*) OVER (PARTITION BY market, symbol) >= 50)"


@query("regime_backtest", _grouped_sql("market", _MARKET_SQL, "true"))
def regime_backtest(spark, d):
    """Metrics of each symbol on the rows of each regime, where there are enough: those rows need not follow each other."""
    s = signals(spark, d).join(_reg(spark, d).select("symbol", "date", F.col("regime").alias("market")), ["symbol", "date"])
    s = B.with_history(B.with_history(s, 100, "market"), 50, ["market", "symbol"])
    return rounded(metrics.metrics(s, backtest.trades(s, ["market", "symbol"]), ["market", "symbol"]))


@query("across_by_regime", f"SELECT market, count(*) AS n_symbols, sum(n_trades)::BIGINT AS n_trades, " + ", ".join(f"round(avg({m}), 4) AS avg_{m}, round(stddev_pop({m}), 4) AS std_{m}" for m in _ACROSS) + f" FROM ({_grouped_sql('market', _MARKET_SQL, 'true')}) GROUP BY market")
def across_by_regime(spark, d):
    """Mean and deviation over symbols, regime by regime."""
    return rounded(metrics.across_symbols(regime_backtest(spark, d), "market"), 4)


_SPLIT_MARKET = _MARKET_SQL[: _MARKET_SQL.index(", grouped AS")] + f", grouped1 AS (SELECT *, {_SPLIT.format(op='<')} AS split FROM grouped0), grouped AS (SELECT *, split || '~' || market AS cell FROM grouped1 WHERE split IS NOT NULL QUALIFY count(*) OVER (PARTITION BY split, market, symbol) >= 50)"


@query("regime_backtest_by_split", f"SELECT split_part(cell, '~', 1) AS split, split_part(cell, '~', 2) AS market, * EXCLUDE (cell) FROM ({_grouped_sql('cell', _SPLIT_MARKET, 'true')})")
def regime_backtest_by_split(spark, d):
    """The full analysis: by split, regime and symbol."""
    s = signals(spark, d).join(_reg(spark, d).select("symbol", "date", F.col("regime").alias("market")), ["symbol", "date"])
    s = s.withColumn("split", align.split(F.col("date"), *SPLITS)).where("split IS NOT NULL")
    by = ["split", "market", "symbol"]
    s = B.with_history(s, 50, by)
    return rounded(metrics.metrics(s, backtest.trades(s, by), by))


@query("hmm_transitions")
def hmm_transitions(spark, d):
    """The fitted model's probabilities of a move from state to state, and the states' own statistics."""
    df, models = _hmm(spark, d)
    return hmm.transitions(df, models=models)


# -- selection and search

_PAIRS = [(a, b) for j, b in enumerate(selection.CANDIDATES) for a in selection.CANDIDATES[:j]]


def _corr_sql(rows: str = "") -> str:
    """Tables up to ``pairs``: the correlation of every pair of candidates, over all rows or those that ``rows`` leaves."""
    return f"{_INDEXED}, c AS (SELECT " + ", ".join(f"COALESCE({_DATASET[n]}, 0) AS {n}" for n in selection.CANDIDATES) + f" FROM moved{rows}), pairs AS (SELECT unnest([" + ", ".join(f"{{'first': '{a}', 'second': '{b}', 'corr': abs(corr({a}, {b}))}}" for a, b in _PAIRS) + "], recursive := true) FROM c)"


@query("corr_pairs", f"{_corr_sql()} SELECT first, second, round(corr, 6) AS corr FROM pairs")
def corr_pairs(spark, d):
    """All pairs of the candidate features, over all rows."""
    return rounded(selection.correlations(_features(spark, d, True), list(selection.CANDIDATES)))


_CORR_SQL = _corr_sql(f" QUALIFY date <= '{SPLITS[0]}'")


@query("corr_pairs_train", f"{_CORR_SQL} SELECT first, second, round(corr, 6) AS corr FROM pairs")
def corr_pairs_train(spark, d):
    """The same on the training rows, which pruning goes by."""
    return rounded(selection.correlations(_trained(spark, d), list(selection.CANDIDATES)))


_AT = "list_position([" + ", ".join(f"'{f}'" for f in selection.CANDIDATES) + "], {})"


@query("corr_prune", f"WITH RECURSIVE {_CORR_SQL[5:]}, ranked AS MATERIALIZED (SELECT first, second, row_number() OVER (ORDER BY corr DESC, {_AT.format('second')}, {_AT.format('first')}) AS i FROM pairs WHERE corr > {selection.THRESHOLD}), walk AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS gone UNION ALL SELECT r.i, CASE WHEN list_contains(gone, first) OR list_contains(gone, second) THEN gone ELSE list_append(gone, second) END FROM walk w JOIN ranked r ON r.i = w.i + 1) SELECT feature FROM (SELECT unnest([" + ", ".join(f"'{f}'" for f in selection.CANDIDATES) + "]) AS feature), (SELECT arg_max(gone, i) AS gone FROM walk) WHERE NOT list_contains(gone, feature)")
def corr_prune(spark, d):
    pairs = [tuple(r) for r in selection.correlations(_trained(spark, d), list(selection.CANDIDATES)).collect()]
    return spark.createDataFrame([(f,) for f in selection.pruned(pairs, list(selection.CANDIDATES))], "feature string")


def _trained(spark, d):
    return _features(spark, d, True).where(F.col("date") <= F.lit(SPLITS[0]).cast("date"))


def _train(spark, d):
    return features.forward_target(_trained(spark, d))


@query("rf_importance")
def rf_importance(spark, d):
    """Ranks of all candidates by the whole forest."""
    return selection.importance(_train(spark, d), list(selection.CANDIDATES))


@query("selected_features")
def selected_features(spark, d):
    """The selection as one flow: pruned by correlation, the best fifteen of the forest, every category covered."""
    return spark.createDataFrame([(i + 1, f) for i, f in enumerate(selection.select(_train(spark, d)))], "rank int, feature string")


def _search(spark, d, **kw) -> evolve.Result:
    """A search over the whole table, ``kw`` as by ``evolve``; the size of a population and its generations may differ."""
    config = Config(population=kw.pop("population", 20), generations=kw.pop("generations", 3), elite=2, max_depth=3)
    return evolve.evolve(searchable(spark, d), list(FORMULAS), config, seeds=["f1"], hall=5, **kw)


def _hall(spark, found: evolve.Result) -> DataFrame:
    return spark.createDataFrame([(i + 1, str(t), formula.infix(t), float(f)) for i, (t, f) in enumerate(found.best)], "rank int, tree string, infix string, fitness double")


@query("evolve_resumed")
def evolve_resumed(spark, d):
    """A search that stops after two of three generations, and goes on from its checkpoint: the end of one that does not stop."""
    import uuid

    place = f"{shared_folder(spark)}/search_{uuid.uuid4().hex}"
    _search(spark, d, generations=2, checkpoint=place, every=1)
    return _hall(spark, _search(spark, d, checkpoint=place, every=1, resume=True))


@query("evolve_seeded")
def evolve_seeded(spark, d):
    """A search that starts with a model read from its file, and the model's mutated clones."""
    import uuid

    place = f"{shared_folder(spark)}/model_{uuid.uuid4().hex}"
    sinks.save_model(spark, {"tree": "sub(f3, f6)"}, place)
    return _hall(spark, _search(spark, d, generations=2, model=sinks.load_model(spark, place)["tree"]))


@query("evolve_smoke")
def evolve_smoke(spark, d):
    names = ["rsi_7", "ret_5d", "ret_20d", "close_vs_sma20", "vol_20d"]
    df = _features(spark, d).withColumns({"split": align.split(F.col("date"), *SPLITS), "regime": F.lit(1)})
    config = Config(population=30, generations=3, elite=3, max_depth=3)
    found = evolve.evolve(align.sanitised(df, names), names, config, seeds=[FORMULAS["f1"]], hall=5)
    return spark.createDataFrame([(i + 1, str(t), formula.infix(t), float(f)) for i, (t, f) in enumerate(found.best)], "rank int, tree string, infix string, fitness double")


@query("stream_bars", f"WITH {Q.TICKS} {Q.bars('hour')}")
def stream_bars(spark, d):
    """Hourly bars of ticks that arrive in three batches, stopped and restarted after each."""
    import uuid

    from ..streaming import ticks

    return plain_bars(ticks.replayed(spark.read.parquet(f"{d}/events.parquet"), f"{shared_folder(spark)}/bars_{uuid.uuid4().hex}"))
