"""One case for each transition of the state machine, and the fold against the grouped kernel."""

from __future__ import annotations

import numpy as np
import pytest

from barweave.operators import backtest as B
from barweave.operators.backtest import LOG_RULES, Rules, run

C = 0.0005


def go(signal, close, regime=None, opens=None, **rules):
    n = len(signal)
    regime = [1] * n if regime is None else regime
    return run(np.array(signal, float), np.array(close, float), np.array(regime), None if opens is None else np.array(opens, float), Rules(**rules))


def reasons(trades):
    return [t[-1] for t in trades]


def test_no_signal_no_trades():
    assert go([0] * 5, [100] * 5) == []
    assert go([1], [100]) == [] and go([], []) == []


def test_long_entry_at_next_open_and_open_trade():
    (t,) = go([-1, 1, 1], [100, 100, 102], opens=[99, 99, 101])
    assert t[:3] == (1, 1, 2) and t[3] == pytest.approx(101 * (1 + C)) and t[4] == pytest.approx(102 * (1 - C))
    assert t[-1] == "OPEN_TRADE" and t[6] == 1 and t[7] == pytest.approx(102 * (1 - C) / (101 * (1 + C)) - 1)


def test_entry_on_last_row_has_no_next_open():
    (t,) = go([-1, 1], [100, 103], opens=[1, 2])
    assert t[1:3] == (1, 1) and t[3] == pytest.approx(103 * (1 + C)) and t[6] == 0


def test_long_stop_exits_at_stop_price():
    (t,) = go([-1, 1, 1], [100, 100, 90])
    assert t[-1] == "STOP_LOSS" and t[4] == pytest.approx(100 * (1 + C) * 0.95 * (1 - C))


def test_long_trailing_stop():
    (t,) = go([-1, 1, 1, 1], [100, 100, 120, 111])
    assert t[-1] == "TRAIL_STOP" and t[4] == pytest.approx(120 * 0.93 * (1 - C))


def test_short_stop_and_trail():
    (t,) = go([1, -1, -1], [100, 100, 110], regime=[-1] * 3)
    assert t[0] == -1 and t[-1] == "STOP_LOSS" and t[4] == pytest.approx(100 * (1 - C) * 1.05 * (1 + C))
    (t,) = go([1, -1, -1, -1], [100, 100, 80, 86], regime=[-1] * 4)
    assert t[-1] == "TRAIL_STOP" and t[4] == pytest.approx(80 * 1.07 * (1 + C))
    assert t[7] == pytest.approx(100 * (1 - C) / t[4] - 1)


def test_gap_through_both_stops_counts_as_hard_stop():
    assert reasons(go([-1, 1, 1, 1], [100, 100, 101, 50])) == ["STOP_LOSS"]


def test_signal_exit_waits_for_min_hold():
    (t,) = go([-1, 1, -1, -1, -1, -1, -1], [100] * 7)
    assert t[2] == 6 and t[-1] == "SIGNAL" and t[6] == 5


def test_regime_flip_ignores_min_hold():
    (t,) = go([-1, 1, 1, 1], [100] * 4, regime=[1, 1, -1, -1])
    assert t[2] == 2 and t[-1] == "REGIME_FLIP"


def test_max_hold_overrides_stop_price_or_keeps_it():
    n = 70
    close = [100.0] * n
    close[61] = 90
    signal = [-1.0] + [1.0] * (n - 1)
    (t, *_) = go(signal, close)
    assert t[2] == 61 and t[-1] == "MAX_HOLD" and t[4] == pytest.approx(90 * (1 - C))
    (t, *_) = go(signal, close, entry_at_next_open=False, max_hold_at_close=False)
    assert t[4] == pytest.approx(100 * (1 + C) * 0.95 * (1 - C))


def test_no_reentry_on_exit_row_and_threshold():
    assert go([-1, 0.4, 1], [100] * 3, threshold=0.5) == []
    trades = go([-1, 1, 1, -1, 1, 1], [100, 100, 90, 90, 90, 90])
    assert [t[1] for t in trades] == [1, 4]


def test_bear_regime_takes_no_longs():
    assert go([-1, 1, 1], [100] * 3, regime=[-1] * 3) == []


def frame(spark, seed, n=300, symbols=("A", "B", "C")):
    rng = np.random.default_rng(seed)
    rows = []
    for s in symbols:
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.03, n)))
        for i in range(n):
            rows.append((s, i, float(round(close[i] * 1.001, 4)), float(round(close[i], 4)), float(round(rng.normal(), 3)), int(rng.choice([1, 1, 1, -1]))))
    return spark.createDataFrame(rows, "symbol string, date int, open double, close double, signal double, regime int")


@pytest.mark.parametrize("rules", [Rules(), LOG_RULES, Rules(min_hold=1, max_hold=4)])
def test_fold_equals_kernel(spark, rules):
    bars = frame(spark, 7)
    cols = ["symbol", "direction", "entry_day", "exit_day", "entry_price", "exit_price", "hold_days", "net_return", "signal_entry", "exit_reason"]
    a = sorted(map(tuple, B.trades(bars, rules=rules).select(*cols).collect()))
    b = sorted(map(tuple, B.trades_folded(bars, rules=rules).select(*cols).collect()))
    assert a == b and len(a) > 20
    for s in "ABC":  # trades of a symbol do not overlap
        spans = sorted((t[2], t[3]) for t in a if t[0] == s)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


def test_metrics_equal_numpy(spark):
    from barweave.operators import evolve, metrics

    bars = frame(spark, 3)
    trades = B.trades(bars)
    got = {r["symbol"]: r for r in metrics.metrics(bars, trades).collect()}
    names = [x.split()[0] for x in B.TRADE.split(", ")]
    for s, pdf in bars.toPandas().groupby("symbol"):
        found = run(pdf.signal.to_numpy(), pdf.close.to_numpy(), pdf.regime.to_numpy(), pdf.open.to_numpy())
        for m, v in zip(evolve.METRICS, evolve.summary(found, len(pdf), names), strict=True):
            assert got[s][m] == pytest.approx(v, rel=1e-9, abs=1e-9), m
    curve = metrics.equity(bars, trades).toPandas()
    assert (curve.drawdown <= 0).all() and (curve[curve.day == 0].equity == 1).all()


def test_group_without_trades_has_zero_metrics(spark):
    from barweave.operators import metrics

    bars = spark.createDataFrame([("A", i, 1.0, 1.0, 0.0, 1) for i in range(5)], "symbol string, date int, open double, close double, signal double, regime int")
    (row,) = metrics.metrics(bars, B.trades(bars)).collect()
    assert row["n_trades"] == 0 and row["sharpe_ratio"] == 0 and row["total_return_pct"] == 0


def test_a_total_loss_ends_the_curve(spark):
    from barweave.operators import metrics

    bars = spark.createDataFrame([("A", i) for i in range(6)], "symbol string, date int")
    trades = spark.createDataFrame([("A", 1, 0.5), ("A", 3, -1.0), ("A", 4, 0.5)], "symbol string, exit_day int, net_return double")
    got = metrics.equity(bars, trades).orderBy("day").collect()
    assert [r["equity"] for r in got] == pytest.approx([1, 1.5, 1.5, 0, 0, 0]) and got[-1]["drawdown"] == pytest.approx(-1)
