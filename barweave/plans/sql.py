"""Pieces of the SQL that queries are held against."""

from __future__ import annotations

DAILY = """
daily AS (SELECT symbol, date, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close, CAST(sum(q) AS BIGINT) AS volume
  FROM (SELECT l_returnflag || l_linestatus AS symbol, CAST(l_shipdate AS DATE) AS date, 1000e0 + l_extendedprice / 997e0 AS price, l_quantity AS q, row(l_shipdate, l_orderkey, l_linenumber, l_extendedprice) AS k FROM lineitem) GROUP BY symbol, date)"""
INDEX = """
idx AS (SELECT 'INDEX' AS symbol, date, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close, count(*) AS volume
  FROM (SELECT CAST(o_orderdate AS DATE) AS date, 10000e0 + o_totalprice / 100e0 AS price, row(o_orderdate, o_orderkey) AS k FROM orders) GROUP BY date)"""
TICKS = "ticks AS (SELECT event_type AS symbol, ts, value AS price, event_id FROM events)"

W = "PARTITION BY symbol ORDER BY date"


def roll(fn: str, x: str, n: int) -> str:
    frame = f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {frame} = {n} THEN {fn}({x}) {frame} END"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({W})"


def change(x: str, k: int) -> str:
    return f"{x} / NULLIF({lag(x, k)}, 0) - 1"


def bars(unit: str) -> str:
    return f"SELECT symbol, date_trunc('{unit}', ts)::TIMESTAMP AS bar, arg_min(price, row(ts, event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, row(ts, event_id)) AS close, count(price) AS n FROM ticks GROUP BY ALL"


#: Columns that features share, then the features: each with what it is computed from.
BASE = f"""base0 AS (SELECT *, {lag('close')} AS before, volume::DOUBLE AS v, {change('close', 1)} AS ret_1d, {change('close', 3)} AS ret_3d, {change('close', 5)} AS ret_5d, {change('close', 10)} AS ret_10d, {change('close', 20)} AS ret_20d FROM daily),
base AS (SELECT *, CASE WHEN before IS NOT NULL THEN greatest(close - before, 0e0) END AS gain, CASE WHEN before IS NOT NULL THEN greatest(before - close, 0e0) END AS loss, greatest(high - low, abs(high - before), abs(low - before)) AS tr FROM base0)"""


def rsi(gain: str, loss: str, n: int) -> str:
    return f"(100 - 100 / (1 + ({roll('avg', gain, n)}) / (({roll('avg', loss, n)}) + 1e-9))) / 100"


def ema(x: str, span: int, adjust: bool) -> str:
    """From the whole history of a row: a sum by Horner's rule."""
    q = 1 - 2.0 / (span + 1)
    top = f"list_reduce(list({x}) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda a, y: a * {q!r} + y)"
    n = f"(row_number() OVER ({W}) - 1)"
    if adjust:
        return f"{top} * {2.0 / (span + 1)!r} / (1 - pow({q!r}, {n} + 1))"
    return f"({2.0 / (span + 1)!r} * {top} + {q!r} * pow({q!r}, {n}) * first_value({x}) OVER ({W}))"


E = "1e-9"


def relative(b: str) -> str:
    return f"(close - {b}) / ({b} + {E})"


FEATURES = {
    "returns": {f"ret_{k}d": f"ret_{k}d" for k in (1, 3, 5, 10, 20)},
    "sma": {f"sma_{n}": roll("avg", "close", n) for n in (5, 10, 20, 50, 200)} | {f"close_vs_sma{n}": f"(close - ({roll('avg', 'close', n)})) / (({roll('avg', 'close', n)}) + {E})" for n in (5, 10, 20, 50, 200)},
    "ema_macd": {"ema_12": ema("close", 12, True), "ema_26": ema("close", 26, True), "macd": f"({ema('close', 12, True)} - {ema('close', 26, True)}) / (close + {E})"},
    "rsi": {f"rsi_{n}": rsi("gain", "loss", n) for n in (7, 14, 21)},
    "atr": {f"atr_{n}": roll("avg", "tr", n) for n in (7, 14)} | {f"atr_pct_{n}": f"({roll('avg', 'tr', n)}) / (close + {E})" for n in (7, 14)},
    "volume": {"vol_sma20": roll("avg", "v", 20), "vol_ratio": f"v / (({roll('avg', 'v', 20)}) + {E})", "vol_ret": f"CASE WHEN {lag('v')} IS NULL THEN NULL WHEN {lag('v')} = 0 AND v > 0 THEN 5 WHEN {lag('v')} = 0 THEN NULL ELSE greatest(-5e0, least(5e0, v / {lag('v')} - 1)) END"},
    "momentum": {f"mom_{k}": f"close / ({lag('close', k)} + {E}) - 1" for k in (5, 10, 20)},
    "range": {"high_20d": roll("max", "high", 20), "low_20d": roll("min", "low", 20), "high_52w": roll("max", "high", 252), "low_52w": roll("min", "low", 252), "pct_from_high20": relative(f"({roll('max', 'high', 20)})"), "pct_from_low20": relative(f"({roll('min', 'low', 20)})"), "pct_from_high52w": relative(f"({roll('max', 'high', 252)})"), "pct_from_low52w": relative(f"({roll('min', 'low', 252)})")},
    "candle": {"body": f"(close - open) / (open + {E})", "upper_wick": f"(high - greatest(close, open)) / (close + {E})", "lower_wick": f"(least(close, open) - low) / (close + {E})"},
    "volatility": {"vol_20d": roll("stddev_samp", "ret_1d", 20), "vol_60d": roll("stddev_samp", "ret_1d", 60)},
}
_MID, _SD = f"({roll('avg', 'close', 20)})", f"({roll('stddev_samp', 'close', 20)})"
FEATURES["bollinger"] = {"bb_upper_20": f"({_MID} + 2 * {_SD} - close) / (close + {E})", "bb_lower_20": f"(close - ({_MID} - 2 * {_SD})) / (close + {E})", "bb_width_20": f"4 * {_SD} / ({_MID} + {E})", "bb_pos_20": f"(close - ({_MID} - 2 * {_SD})) / (4 * {_SD} + {E})"}


def features(columns: dict[str, str], digits: int = 6) -> str:
    return f"WITH {DAILY}, {BASE} SELECT symbol, date, " + ", ".join(f"round({x}, {digits}) AS {c}" for c, x in columns.items()) + " FROM base"


ASOF = f"aligned AS (SELECT d.*, i.close AS index_close FROM base d ASOF LEFT JOIN idx i ON d.date >= i.date)"
INDEX_FEATURES = {
    "index_ret_1d": change("index_close", 1),
    "index_ret_5d": change("index_close", 5),
    "index_ret_20d": change("index_close", 20),
    "index_vs_sma20": f"(index_close - ({roll('avg', 'index_close', 20)})) / (({roll('avg', 'index_close', 20)}) + {E})",
    "index_rsi14": rsi("igain", "iloss", 14),
    "rel_strength": f"ret_20d - ({change('index_close', 20)})",
}
WITH_INDEX = f"{ASOF}, moved AS (SELECT *, CASE WHEN {lag('index_close')} IS NOT NULL THEN greatest(index_close - {lag('index_close')}, 0e0) END AS igain, CASE WHEN {lag('index_close')} IS NOT NULL THEN greatest({lag('index_close')} - index_close, 0e0) END AS iloss FROM aligned)"


def fin(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NULL OR isnan({x}) OR isinf({x}) THEN 0e0 ELSE ({x}) END)"


SIGNAL = f"signals AS (SELECT symbol, date, open, close, round({fin(rsi('gain', 'loss', 7))} - 0.5, 6) AS signal, CASE WHEN round(index_close, 4) >= round(avg(index_close) OVER ({W} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 4) THEN 1 ELSE -1 END AS regime, row_number() OVER ({W}) - 1 AS i FROM aligned)"


def machine(next_open: bool = True, at_close: bool = True) -> str:
    """The trades of ``signals`` by a recursive walk over rows."""
    fill = "COALESCE(x.next, x.close)" if next_open else "x.close"
    at = "CASE WHEN m.held >= 60 THEN m.close " if at_close else "CASE "
    return f"""
rows_ AS (SELECT *, lead(open) OVER ({W}) AS next, lag(signal) OVER ({W}) AS prev, max(i) OVER (PARTITION BY symbol) AS n FROM signals),
walk AS (
  SELECT symbol, i, 0 AS side, 0::BIGINT AS day, 0e0 AS entry, 0e0 AS peak, 0e0 AS sig, NULL::VARCHAR AS reason, NULL::DOUBLE AS price, 0 AS was, 0::BIGINT AS was_day, 0e0 AS was_entry FROM rows_ WHERE i = 0
  UNION ALL
  SELECT symbol, i, CASE WHEN side = 0 THEN enter WHEN reason IS NOT NULL THEN 0 ELSE side END, CASE WHEN side = 0 AND enter <> 0 THEN i ELSE day END, CASE WHEN side = 0 AND enter <> 0 THEN fill ELSE entry END, CASE WHEN side = 0 THEN fill ELSE newpeak END, CASE WHEN side = 0 AND enter <> 0 THEN signal ELSE sig END, reason, {at} WHEN reason = 'STOP_LOSS' OR hit = 1 THEN stop WHEN reason = 'TRAIL_STOP' OR hit = 2 THEN trail ELSE m.close END, side, day, entry FROM (
    SELECT *, CASE WHEN side = 0 THEN NULL WHEN held >= 60 THEN 'MAX_HOLD' WHEN hit = 1 THEN 'STOP_LOSS' WHEN hit = 2 THEN 'TRAIL_STOP' WHEN held >= 5 AND side * signal <= 0 THEN 'SIGNAL' WHEN regime = -side THEN 'REGIME_FLIP' END AS reason FROM (
      SELECT *, CASE WHEN side * close <= side * stop THEN 1 WHEN side * close <= side * trail THEN 2 ELSE 0 END AS hit FROM (
        SELECT *, entry * (1 - side * 0.05e0) AS stop, newpeak * (1 - side * 0.07e0) AS trail FROM (
          SELECT x.symbol, x.i, x.close, x.signal, x.regime, w.side, w.day, w.entry, w.sig, x.i - w.day AS held, CASE WHEN w.side = 1 THEN greatest(w.peak, x.close) ELSE least(w.peak, x.close) END AS newpeak,
            CASE WHEN x.regime * x.prev <= 0 AND x.regime * x.signal > 0 THEN x.regime ELSE 0 END AS enter, {fill} * (1 + x.regime * 0.0005e0) AS fill
          FROM walk w JOIN rows_ x ON x.symbol = w.symbol AND x.i = w.i + 1)))) m),
exits AS (
  SELECT symbol, was AS direction, was_day AS entry_day, i AS exit_day, was_entry AS entry_price, price * (1 - was * 0.0005e0) AS exit_price, sig AS signal_entry, reason AS exit_reason FROM walk WHERE reason IS NOT NULL
  UNION ALL
  SELECT w.symbol, w.side, w.day, w.i, w.entry, x.close * (1 - w.side * 0.0005e0), w.sig, 'OPEN_TRADE' FROM walk w JOIN rows_ x USING (symbol, i) WHERE x.i = x.n AND w.side <> 0),
trades AS (SELECT *, exit_day - entry_day AS hold_days, CASE WHEN direction = 1 THEN exit_price / entry_price - 1 ELSE entry_price / exit_price - 1 END AS net_return FROM exits)"""


TRADES = f"WITH RECURSIVE {DAILY}, {INDEX}, {BASE}, {ASOF}, {SIGNAL}, {machine()}"
CURVE = f"""
pnl AS (SELECT symbol, exit_day AS i, sum(net_return) AS pnl FROM trades GROUP BY ALL),
curve0 AS (SELECT symbol, date, i, COALESCE(pnl, 0) AS pnl, exp(sum(CASE WHEN i > 0 THEN ln(1 + COALESCE(pnl, 0)) ELSE 0 END) OVER (PARTITION BY symbol ORDER BY i)) AS equity FROM rows_ LEFT JOIN pnl USING (symbol, i)),
curve1 AS (SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY i) AS peak, lag(equity) OVER (PARTITION BY symbol ORDER BY i) AS before FROM curve0),
curve AS (SELECT *, (equity - peak) / (peak + 1e-8) AS drawdown, (equity - before) / (before + 1e-8) AS ret FROM curve1)"""
METRICS = f"""
c AS (SELECT symbol, count(*) AS n, arg_max(equity, i) AS last, avg(ret) AS m, stddev_pop(ret) AS sd, stddev_pop(ret) FILTER (ret < -1e-12) AS dsd, count(*) FILTER (ret < -1e-12) AS nd, min(drawdown) AS dd FROM curve GROUP BY symbol),
t AS (SELECT symbol, count(*)::INT AS n_trades, avg(CASE WHEN net_return > 0 THEN 1e0 ELSE 0 END) AS wins, avg(hold_days) AS hold, sum(CASE WHEN net_return > 0 THEN net_return ELSE 0 END) AS won, COALESCE(-sum(net_return) FILTER (net_return <= 0), 1e-8) AS lost FROM trades GROUP BY symbol),
metrics AS (SELECT symbol, COALESCE(n_trades, 0) AS n_trades, """ + ", ".join(f"CASE WHEN n_trades > 0 THEN {x} ELSE 0e0 END AS {name}" for name, x in {
    "total_return_pct": "(last - 1) * 100",
    "annual_return_pct": "(pow(last, 252e0 / n) - 1) * 100",
    "sharpe_ratio": "CASE WHEN sd > 1e-8 THEN m / sd * sqrt(252e0) ELSE 0 END",
    "sortino_ratio": "CASE WHEN nd > 1 AND dsd > 1e-8 THEN m / dsd * sqrt(252e0) ELSE 0 END",
    "max_drawdown_pct": "dd * 100",
    "win_rate": "wins * 100",
    "avg_hold_days": "hold",
    "trades_per_year": "n_trades / (n / 252e0)",
    "profit_factor": "won / greatest(lost, 1e-8)",
}.items()) + " FROM c LEFT JOIN t USING (symbol))"
SINGLE = "CASE WHEN n_trades < 2 THEN -50e0 ELSE 3e0 * annual_return_pct / 100 + 2e0 * sharpe_ratio + sortino_ratio + win_rate / 100 - 2e0 * abs(max_drawdown_pct) / 100 + 0.5e0 * (CASE WHEN trades_per_year < 4 THEN -1e0 WHEN trades_per_year <= 50 THEN 0.5e0 ELSE -0.5e0 END) - 0.02e0 * 3 END"
MARKET = f"market0 AS (SELECT epoch(date)::BIGINT AS timestamp, symbol, 'D' AS interval, open, high, low, close, volume FROM daily UNION ALL SELECT epoch(bar)::BIGINT, symbol, '1m', open, high, low, close, n FROM ({bars('minute')})), market AS (SELECT * FROM market0 UNION ALL SELECT * FROM market0)"
