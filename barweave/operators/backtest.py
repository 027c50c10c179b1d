"""The long/short state machine over a signal, one group of rows at a time.

Both sides are one: with s = 1 for long and -1 for short, a price moves against a position when s times it falls.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..config import Config

_D = Config()


@dataclass(frozen=True)
class Rules:
    min_hold: int = _D.min_hold
    max_hold: int = _D.max_hold
    cost: float = _D.cost
    stop_loss: float = _D.stop_loss
    trailing_stop: float = _D.trailing_stop
    threshold: float = 0.0
    #: Entries are filled at the next row's open, where there is one, or at this row's close.
    entry_at_next_open: bool = True
    #: At the longest hold a stop's price gives way to the close, or stays.
    max_hold_at_close: bool = True


#: As the trade log has it: filled at the close, stops keep their price.
LOG_RULES = Rules(entry_at_next_open=False, max_hold_at_close=False)

TRADE = "direction int, entry_day int, exit_day int, entry_price double, exit_price double, weight double, hold_days int, gross_return double, net_return double, signal_entry double, signal_exit double, exit_reason string"


def run(signal: np.ndarray, close: np.ndarray, regime: np.ndarray, opens: np.ndarray | None = None, rules: Rules = Rules()) -> list[tuple]:
    """Trades of one series, in the order of TRADE. The first row only supplies the signal before the second's."""
    n, r, out = len(signal), rules, []
    signal, close, regime = signal.tolist(), close.tolist(), regime.tolist()
    opens = None if opens is None else opens.tolist()
    side = 0
    day = entry = peak = entry_signal = None

    def leave(i: int, price: float, reason: str) -> None:
        price = price * (1 - side * r.cost)
        gain = price / entry - 1 if side == 1 else entry / price - 1
        out.append((side, day, i, entry, price, 1.0, i - day, gain, gain, entry_signal, signal[i], reason))

    for i in range(1, n):
        now, price, held = signal[i], close[i], i - (day or 0)
        if not side:
            s = regime[i]
            if s in (1, -1) and s * signal[i - 1] <= 0 < s * now and s * now >= r.threshold:
                fill = opens[i + 1] if r.entry_at_next_open and opens is not None and i + 1 < n else price
                side, day, entry, entry_signal = s, i, fill * (1 + s * r.cost), now
                peak = entry
            continue
        peak = max(peak, price) if side == 1 else min(peak, price)
        stop, trail = entry * (1 - side * r.stop_loss), peak * (1 - side * r.trailing_stop)
        reason, at = None, price
        if side * price <= side * stop:
            reason, at = "STOP_LOSS", stop
        elif side * price <= side * trail:
            reason, at = "TRAIL_STOP", trail
        elif held >= r.min_hold and side * now <= 0:
            reason = "SIGNAL"
        elif regime[i] == -side:
            reason = "REGIME_FLIP"
        if held >= r.max_hold:
            reason = "MAX_HOLD"
            at = price if r.max_hold_at_close else at
        if reason:
            leave(i, at, reason)
            side = 0
    if side:
        leave(n - 1, close[-1], "OPEN_TRADE")
    return out


class Machine:
    """The state machine a row at a time, for series that do not come whole: ``state`` is all that it knows of earlier rows.

    A position that waits is filled at the next row's open, or at its own row's close if there is none.
    """

    FIELDS = "i long, before double, side int, day long, entry double, peak double, signal double, waits boolean, close double"

    def __init__(self, rules: Rules = Rules(), state: tuple | None = None):
        self.rules = rules
        self.i, self.before, self.side, self.day, self.entry, self.peak, self.signal, self.waits, self.close = state or (0, 0.0, 0, 0, 0.0, 0.0, 0.0, False, 0.0)

    @property
    def state(self) -> tuple:
        return self.i, self.before, self.side, self.day, self.entry, self.peak, self.signal, self.waits, self.close

    def _fill(self, price: float) -> None:
        self.entry = self.peak = price * (1 + self.side * self.rules.cost)
        self.waits = False

    def _leave(self, i: int, price: float, now: float, reason: str) -> tuple:
        price = price * (1 - self.side * self.rules.cost)
        gain = price / self.entry - 1 if self.side == 1 else self.entry / price - 1
        return self.side, self.day, i, self.entry, price, 1.0, i - self.day, gain, gain, self.signal, now, reason

    def step(self, now: float, price: float, regime: int, opens: float | None = None) -> tuple | None:
        """Take a row; the trade that ends with it, in the order of TRADE."""
        r, i, before, trade = self.rules, self.i, self.before, None
        self.i, self.before, last, self.close = i + 1, now, self.close, price
        if self.waits:
            self._fill(last if opens is None else opens)
        if not self.side:
            if i and regime in (1, -1) and regime * before <= 0 < regime * now and regime * now >= r.threshold:
                self.side, self.day, self.signal, self.waits = regime, i, now, True
                if not r.entry_at_next_open:
                    self._fill(price)
            return None
        side, held = self.side, i - self.day
        self.peak = max(self.peak, price) if side == 1 else min(self.peak, price)
        stop, trail = self.entry * (1 - side * r.stop_loss), self.peak * (1 - side * r.trailing_stop)
        reason, at = None, price
        if side * price <= side * stop:
            reason, at = "STOP_LOSS", stop
        elif side * price <= side * trail:
            reason, at = "TRAIL_STOP", trail
        elif held >= r.min_hold and side * now <= 0:
            reason = "SIGNAL"
        elif regime == -side:
            reason = "REGIME_FLIP"
        if held >= r.max_hold:
            reason, at = "MAX_HOLD", price if r.max_hold_at_close else at
        if reason:
            trade = self._leave(i, at, now, reason)
            self.side = 0
        return trade

    def end(self) -> tuple | None:
        """The trade that is open after the last row."""
        if not self.side:
            return None
        if self.waits:
            self._fill(self.close)
        trade = self._leave(self.i - 1, self.close, self.before, "OPEN_TRADE")
        self.side = 0
        return trade


def regime_of(df: DataFrame, column: str = "index_vs_sma50") -> Column:
    """1 where the index is not below its mean, -1 where it is; 1 throughout if the table has no such column."""
    return F.when(F.coalesce(F.col(column), F.lit(0.0)) >= 0, 1).otherwise(-1) if column in df.columns else F.lit(1)


def trades(bars: DataFrame, by: list[str] = ["symbol"], on: str = "date", rules: Rules = Rules()) -> DataFrame:
    """Trades of every group of rows (by, on, signal, close, open, regime): one shuffle, a group at a time in memory.

    Days are numbers of rows from 0. A group without rows has no trades; ``open`` may be missing.
    """
    columns = [*by, on, "signal", "close", "regime", *(["open"] if "open" in bars.columns else [])]
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in bars.select(*by).schema)
    names = [x.split()[0] for x in TRADE.split(", ")]

    def group(key, pdf):
        pdf = pdf.sort_values(on, kind="stable")
        opens = pdf["open"].to_numpy() if "open" in pdf else None
        found = run(pdf["signal"].to_numpy(), pdf["close"].to_numpy(), pdf["regime"].to_numpy(), opens, rules)
        out = pd.DataFrame(found, columns=names)
        for k, v in reversed(list(zip(by, key, strict=True))):
            out.insert(0, k, v)
        return out

    return bars.select(*columns).groupBy(*by).applyInPandas(group, f"{keys}, {TRADE}")


def trades_folded(bars: DataFrame, by: list[str] = ["symbol"], on: str = "date", rules: Rules = Rules()) -> DataFrame:
    """The same trades by a fold over each group's sorted rows, without Python."""
    r = rules
    row = F.struct(F.col(on).alias("date"), "signal", "close", "open", F.col("regime").cast("int").alias("regime"))
    rows = bars.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    trade = "struct<direction:int,entry_day:int,exit_day:int,entry_price:double,exit_price:double,hold_days:int,net_return:double,signal_entry:double,exit_reason:string>"
    state = f"struct<i:int,side:int,day:int,entry:double,peak:double,sig:double,prev:double,out:array<{trade}>>"
    zero = F.lit(0.0)
    init = F.struct(F.lit(-1).alias("i"), F.lit(0).alias("side"), F.lit(0).alias("day"), zero.alias("entry"), zero.alias("peak"), zero.alias("sig"), zero.alias("prev"), F.expr(f"cast(array() as array<{trade}>)").alias("out")).cast(state)

    def leave(s, i, price, reason) -> Column:
        exit_ = price * (1 - s["side"] * F.lit(r.cost))
        gain = F.when(s["side"] == 1, exit_ / s["entry"] - 1).otherwise(s["entry"] / exit_ - 1)
        return F.struct(s["side"].alias("direction"), s["day"].alias("entry_day"), i.alias("exit_day"), s["entry"].alias("entry_price"), exit_.alias("exit_price"), (i - s["day"]).alias("hold_days"), gain.alias("net_return"), s["sig"].alias("signal_entry"), reason.alias("exit_reason")).cast(trade)

    def make(i, side, day, entry, peak, sig, prev, out) -> Column:
        return F.struct(i.alias("i"), side.alias("side"), day.alias("day"), entry.alias("entry"), peak.alias("peak"), sig.alias("sig"), prev.alias("prev"), out.alias("out")).cast(state)

    def step(s, x) -> Column:
        i, now, price = s["i"] + 1, x["signal"], x["close"]
        enters = (i >= 1) & (x["regime"] * s["prev"] <= 0) & (x["regime"] * now > 0) & (x["regime"] * now >= r.threshold)
        fill = F.coalesce(x["next"], price) if r.entry_at_next_open else price
        entry = fill * (1 + x["regime"] * F.lit(r.cost))
        flat = F.when(enters, make(i, x["regime"], i, entry, entry, now, now, s["out"])).otherwise(make(i, F.lit(0), s["day"], s["entry"], s["peak"], s["sig"], now, s["out"]))
        peak = F.when(s["side"] == 1, F.greatest(s["peak"], price)).otherwise(F.least(s["peak"], price))
        stop, trail, held = s["entry"] * (1 - s["side"] * F.lit(r.stop_loss)), peak * (1 - s["side"] * F.lit(r.trailing_stop)), i - s["day"]
        by_stop, by_trail = s["side"] * price <= s["side"] * stop, s["side"] * price <= s["side"] * trail
        reason = F.when(held >= r.max_hold, "MAX_HOLD").when(by_stop, "STOP_LOSS").when(by_trail, "TRAIL_STOP").when((held >= r.min_hold) & (s["side"] * now <= 0), "SIGNAL").when(x["regime"] == -s["side"], "REGIME_FLIP")
        at = F.when(by_stop, stop).when(by_trail, trail).otherwise(price)
        at = F.when(held >= r.max_hold, price).otherwise(at) if r.max_hold_at_close else at
        stays = make(i, s["side"], s["day"], s["entry"], peak, s["sig"], now, s["out"])
        leaves = make(i, F.lit(0), s["day"], s["entry"], peak, s["sig"], now, F.array_append(s["out"], leave(s, i, at, reason)))
        return F.when(s["side"] == 0, flat).otherwise(F.when(reason.isNotNull(), leaves).otherwise(stays))

    ahead = F.transform("rows", lambda x, k: F.struct(x["signal"].alias("signal"), x["close"].alias("close"), x["regime"].alias("regime"), F.get("rows", k + 1)["open"].alias("next")))
    last = F.get("rows", F.size("rows") - 1)["close"]
    ended = rows.withColumn("ahead", ahead).withColumn("end", F.aggregate("ahead", init, step))
    end = F.col("end")
    closed = F.when(end["side"] != 0, F.array_append(end["out"], leave(end, F.size("rows") - 1, last, F.lit("OPEN_TRADE")))).otherwise(end["out"])
    return ended.select(*by, F.inline(closed))


def log(bars: DataFrame, found: DataFrame, on: str = "date") -> DataFrame:
    """Trades for people: dates for days, sides by name, per cent; open trades have the date OPEN. Nothing is rounded."""
    from pyspark.sql import Window

    days = bars.select("symbol", on, (F.row_number().over(Window.partitionBy("symbol").orderBy(on)) - 1).alias("day"))
    at = lambda name: days.select("symbol", F.col("day").alias(f"{name}_day"), F.date_format(on, "yyyy-MM-dd").alias(f"{name}_date"))
    out = found.join(at("entry"), ["symbol", "entry_day"]).join(at("exit"), ["symbol", "exit_day"])
    open_ = F.col("exit_reason") == "OPEN_TRADE"
    return out.select("symbol", F.when(F.col("direction") == 1, "LONG").otherwise("SHORT").alias("direction"), "entry_date", F.when(open_, "OPEN").otherwise(F.col("exit_date")).alias("exit_date"), "entry_price", "exit_price", "hold_days", (100 * F.col("net_return")).alias("pnl_pct"), "exit_reason", F.col("signal_entry").alias("entry_signal"), F.col("signal_exit").alias("exit_signal"))
