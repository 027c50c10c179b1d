"""The state machine on a stream of bars: keyed state, rows put in order by event time, restarts from a checkpoint."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.backtest import TRADE, Machine, Rules
from . import ticks

#: A bar that waits for the watermark to pass it; without a close it ends the series.
BAR = "at long, signal double, close double, open double, regime int"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_NAMES = [x.split()[0] for x in TRADE.split(", ")]


class _Trades(StatefulProcessor):
    """Bars wait until the watermark has passed them, and are then taken in order of time, whatever order they came in."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle) -> None:
        self.handle = handle
        self.machine = handle.getValueState("machine", Machine.FIELDS)
        self.waiting = handle.getListState("waiting", BAR)

    def handleInputRows(self, key, rows, timerValues):
        new = [r for pdf in rows for r in zip(pdf["at"].tolist(), *(_floats(pdf[c]) for c in ("signal", "close", "open")), pdf["regime"].tolist(), strict=True)]
        self.waiting.appendList(new)
        # One timer a key is enough, at its first bar that waits.
        timers = list(self.handle.listTimers())
        first = min(r[0] for r in new)
        if not timers or first < min(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        bars = [tuple(r) for r in self.waiting.get()]
        due, later = sorted((b for b in bars if b[0] <= passed), key=lambda b: b[0]), [b for b in bars if b[0] > passed]
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(min(b[0] for b in later))
        else:
            self.waiting.clear()
        machine, found = Machine(self.rules, tuple(self.machine.get()) if self.machine.exists() else None), []
        for _, signal, close, open_, regime in due:
            trade = machine.end() if close is None else machine.step(signal, close, regime, open_)
            if trade:
                found.append(trade)
        self.machine.update(machine.state)
        if found:
            out = pd.DataFrame(found, columns=_NAMES)
            out.insert(0, "symbol", key[0])
            yield out

    def close(self) -> None:
        pass


def _floats(column) -> list:
    return [None if pd.isna(x) else float(x) for x in column]


def stream_trades(bars: DataFrame, rules: Rules = Rules(), late: str = "0 seconds") -> DataFrame:
    """The trades of a stream (symbol, ts, signal, close, open, regime), each as soon as it has ended for certain.

    Bars may come in any order within ``late``; later ones are dropped by the watermark. A bar without a close ends its
    symbol's series: a trade that is open then is closed at the last bar, as at the end of a table.
    """
    rows = bars.withWatermark("ts", late).select("symbol", "ts", F.unix_millis("ts").alias("at"), "signal", "close", "open", F.col("regime").cast("int").alias("regime"))
    return rows.groupBy("symbol").transformWithStateInPandas(_Trades(rules), f"symbol string, {TRADE}", "append", "eventtime")


def drained(out: DataFrame, folder: str, checkpoint: str) -> None:
    """As ``ticks.appended``, with the state store that keyed state needs."""
    spark = out.sparkSession
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        ticks.appended(out, folder, checkpoint)
    finally:
        if old is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def replayed(bars: DataFrame, folder: str, parts: int = 3, rules: Rules = Rules()) -> DataFrame:
    """The trades of a table (symbol, ts, ...) that arrives as a stream: in ``parts`` stretches of time, with a restart after each."""
    spark: SparkSession = bars.sparkSession
    low, high = bars.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    columns = ["symbol", "ts", "signal", "close", "open", "regime"]
    bars = bars.select(*columns)
    if low is None:
        return spark.createDataFrame([], f"symbol string, {TRADE}")
    nothing = lambda c: F.lit(None).cast(bars.schema[c].dataType).alias(c)
    ends = bars.select("symbol").distinct().select("symbol", F.timestamp_seconds(F.lit(high + 86_400)).alias("ts"), *(nothing(c) for c in columns[2:]))
    for part in range(parts + 1):
        a, b = (low + (high + 1 - low) * k // parts for k in (part, part + 1))
        new = bars.where((F.unix_seconds("ts") >= a) & (F.unix_seconds("ts") < b)) if part < parts else ends
        new.write.mode("append").parquet(f"{folder}/bars")
        stream = spark.readStream.schema(bars.schema).parquet(f"{folder}/bars")
        drained(stream_trades(stream, rules), f"{folder}/trades", f"{folder}/checkpoint")
    return spark.read.schema(f"symbol string, {TRADE}, batch long").parquet(f"{folder}/trades").drop("batch")
