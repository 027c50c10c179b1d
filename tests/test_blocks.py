"""Series in blocks of time and as streams, against the same work on whole series."""

from __future__ import annotations

import datetime
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barweave.operators import align, backtest, blocks, hmm
from barweave.operators.backtest import LOG_RULES, Machine, Rules, run
from barweave.streaming import machine

RULES = [Rules(), LOG_RULES, Rules(min_hold=2, max_hold=9, stop_loss=0.02, trailing_stop=0.03)]


def walk(rng, n):
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    return rng.normal(size=n), close, rng.choice([1, -1, 0], n, p=[0.6, 0.3, 0.1]), close * (1 + rng.normal(0, 0.003, n))


@pytest.fixture(scope="module")
def bars(spark):
    rng, out = np.random.default_rng(7), []
    for symbol, n in (("A", 900), ("B", 350), ("C", 1), ("D", 2)):
        signal, close, regime, opens = walk(rng, n)
        day = [datetime.date(2000, 1, 1) + datetime.timedelta(days=int(k)) for k in np.cumsum(rng.integers(1, 4, n))]
        out += [(symbol, *x) for x in zip(day, signal.tolist(), close.tolist(), regime.tolist(), opens.tolist(), strict=True)]
    return spark.createDataFrame(out, "symbol string, date date, signal double, close double, regime int, open double").cache()


def plain(df):
    return sorted(tuple(r) for r in df.select("symbol", *machine._NAMES).collect())


@pytest.mark.parametrize("rules", RULES)
@pytest.mark.parametrize("n", [0, 1, 2, 3, 60, 700])
def test_machine_by_rows_equals_kernel(rules, n):
    signal, close, regime, opens = walk(np.random.default_rng(n), n)
    one, found = Machine(rules), []
    for row in zip(signal.tolist(), close.tolist(), regime.tolist(), opens.tolist(), strict=True):
        one = Machine(rules, one.state)  # state is all that it knows
        found += filter(None, [one.step(*row)])
    found += filter(None, [one.end()])
    assert found == run(signal, close, regime, opens, rules) and one.end() is None


@pytest.mark.parametrize("rules", RULES[:2])
@pytest.mark.parametrize("rows", [5, 40, 333, 10_000])
def test_blocks_of_any_length_give_the_same_trades(spark, bars, rows, rules):
    want = plain(backtest.trades(bars, rules=rules))
    found = blocks.trades(bars, rules=rules, rows=rows)
    assert plain(found) == want and len(want) > 50


def test_a_position_through_many_blocks(spark):
    """Nothing ends it but the longest hold, so several blocks hand it on."""
    n = 200
    rows = [("A", k, 1.0 if k else -1.0, 100.0, 1, 100.0) for k in range(n)]
    df = spark.createDataFrame(rows, "symbol string, date int, signal double, close double, regime int, open double")
    want = plain(backtest.trades(df))
    assert plain(blocks.trades(df, rows=8)) == want and want[0][-1] == "MAX_HOLD"
    assert plain(blocks.trades(df.drop("open"), rows=8)) == plain(backtest.trades(df.drop("open")))
    assert blocks.trades(df.where("date < 0")).count() == 0


def test_blocks_by_several_keys(spark, bars):
    both = bars.withColumn("split", F.when(F.col("date") < F.lit("2001-01-01").cast("date"), "x").otherwise("y"))
    by = ["split", "symbol"]
    want = sorted(tuple(r) for r in backtest.trades(both, by).collect())
    assert sorted(tuple(r) for r in blocks.trades(both, by, rows=60).select(*by, *machine._NAMES).collect()) == want


def test_a_block_holds_a_bounded_share_of_a_series(spark, bars):
    sizes = [r["count"] for r in blocks.blocked(bars, ["symbol"], "date", 50).where("symbol = 'A'").groupBy("block").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 200


def test_stream_with_restarts_equals_the_table(spark, bars, tmp_path):
    found = machine.replayed(bars.withColumn("ts", F.col("date").cast("timestamp")), str(tmp_path), parts=3)
    assert plain(found) == plain(backtest.trades(bars))
    # All batches are there already: nothing is taken twice, and a batch that is written again replaces itself.
    schema = "symbol string, ts timestamp, signal double, close double, open double, regime int"
    again = machine.stream_trades(spark.readStream.schema(schema).parquet(f"{tmp_path}/bars"))
    machine.drained(again, f"{tmp_path}/trades", f"{tmp_path}/checkpoint")
    assert plain(found) == plain(backtest.trades(bars))


def test_stream_puts_bars_in_order_and_closes_open_trades(spark, bars, tmp_path):
    one = bars.where("symbol = 'B'").withColumn("ts", F.col("date").cast("timestamp")).select("symbol", "ts", "signal", "close", "open", "regime")
    rows = [tuple(r) for r in one.orderBy("ts").collect()]
    rng = np.random.default_rng(3)
    order = np.argsort(np.arange(len(rows)) + rng.uniform(0, 6, len(rows)))  # bars up to six places late
    for part in np.array_split(order, 3):
        spark.createDataFrame([rows[k] for k in part], one.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/bars")
        stream = spark.readStream.schema(one.schema).parquet(f"{tmp_path}/bars")
        machine.drained(machine.stream_trades(stream, late="30 days"), f"{tmp_path}/trades", f"{tmp_path}/checkpoint")
    early = plain(spark.read.parquet(f"{tmp_path}/trades").drop("batch"))
    want = plain(backtest.trades(bars.where("symbol = 'B'")))
    assert early and set(early) < set(want)
    spark.createDataFrame([("B", rows[-1][1] + datetime.timedelta(days=1), None, None, None, None), ("Z", rows[-1][1] + datetime.timedelta(days=99), None, None, None, None)], one.schema).write.mode("append").parquet(f"{tmp_path}/bars")
    machine.drained(machine.stream_trades(spark.readStream.schema(one.schema).parquet(f"{tmp_path}/bars"), late="30 days"), f"{tmp_path}/trades", f"{tmp_path}/checkpoint")
    assert plain(spark.read.parquet(f"{tmp_path}/trades").drop("batch")) == want


# Hidden states


def planted(rng, n, symbol="I"):
    state = np.cumsum(rng.random(n) < 0.02) % 4
    x = rng.normal(size=(n, 6)) * (0.3 + 0.4 * state[:, None]) + 2 * state[:, None] * np.array([1, -1, 0.5, 1, -0.5, -1])
    frame = pd.DataFrame(x, columns=hmm.FEATURES)
    frame["symbol"], frame["date"] = symbol, [datetime.date(1990, 1, 1) + datetime.timedelta(days=k) for k in range(n)]
    return frame.assign(close=1.0, ret_20d=0.0)


@pytest.mark.parametrize("rows", [17, 100, 5000])
def test_hidden_states_by_blocks_equal_the_kernel(spark, rows):
    frame = planted(np.random.default_rng(5), 600)
    raw = frame[list(hmm.FEATURES)].to_numpy()
    x = (raw - raw.mean(axis=0)) / raw.std(axis=0)
    df = spark.createDataFrame(frame)
    own = hmm.series(df, "date", rows)
    assert (own.blocks.count() > 600 // rows // 2) and own.n == 600
    start = hmm.begin(x[[3, 150, 300, 590]], np.cov(x.T, bias=True), 1e-3)
    blocked, e = hmm.fit_blocks(own, start, steps=12)
    whole = start
    for _ in range(len(blocked.history) - 1):  # the same steps on the whole series
        b = whole._density(x)
        f, g, total = whole._passes(b)
        p = np.exp(f + g - total)
        p /= p.sum(axis=1, keepdims=True)
        pair = np.exp(f[:-1, :, None] + np.log(whole.move + 1e-300)[None] + (b[1:] + g[1:])[:, None, :] - total).sum(axis=0)
        w = p.sum(axis=0)
        means = (p.T @ x) / w[:, None]
        covs = np.stack([((x - m) * p[:, [k]]).T @ (x - m) / w[k] + 1e-3 * np.eye(6) for k, m in enumerate(means)])
        whole = hmm.Hmm(p[0], pair / pair.sum(axis=1, keepdims=True), means, covs, [])
    if len(blocked.history) == 12:  # it ended by its number of steps: one more than these
        blocked, e = hmm.fit_blocks(own, start, steps=11)
    for name in ("start", "move", "means", "covs"):
        assert np.abs(getattr(blocked, name) - getattr(whole, name)).max() < 1e-8, name
    fitted = hmm.Fitted("I", own, blocked, e, [2, 0, 1, 3])
    got = hmm.detect(df, models=[fitted]).orderBy("date").toPandas()
    p, path = whole.posterior(x), whole.path(x)
    assert (got["state"].to_numpy() == np.array([2, 0, 1, 3])[path]).all()
    assert max(np.abs(got[f"prob_{hmm.STATES[c]}"] - p[:, k]).max() for k, c in enumerate([2, 0, 1, 3])) < 1e-8


def test_hidden_states_of_several_series_and_short_ones(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame(pd.concat([planted(rng, 200, "I"), planted(rng, 300, "J"), planted(rng, hmm.SHORT - 1, "K")]))
    models = hmm.fitted(df, steps=30, rows=64)
    assert [f.symbol for f in models] == ["I", "J"]
    got = hmm.detect(df, models=models).groupBy("symbol").agg(F.count("*").alias("n"), F.count("state").alias("k"), F.max(F.abs(sum(F.col(f"prob_{s}") for s in hmm.STATES) - 1)).alias("off")).collect()
    assert {(r["symbol"], r["n"], r["k"]) for r in got} == {("I", 200, 200), ("J", 300, 300), ("K", 59, 0)}
    assert all(r["off"] is None or r["off"] < 1e-9 for r in got)
    moves = hmm.transitions(df, models=models).groupBy("symbol", "state").agg(F.sum("probability").alias("p")).collect()
    assert len(moves) == 8 and all(abs(r["p"] - 1) < 1e-9 for r in moves)


def test_spread_draws_as_the_kernel(spark):
    frame = planted(np.random.default_rng(2), 400)
    raw = frame[list(hmm.FEATURES)].to_numpy()
    x = (raw - raw.mean(axis=0)) / raw.std(axis=0)
    own = hmm.series(spark.createDataFrame(frame), "date", 50)
    assert np.allclose(hmm.spread(own, 4, 42), hmm.fit(x, steps=0).means)


# Fills


def test_fills_take_time_in_proportion_to_rows(spark):
    def took(n):
        df = spark.range(n).select(F.lit("A").alias("symbol"), F.col("id").alias("t"), F.when(F.col("id") % 50_000 == 7, F.col("id")).alias("v"))
        began = time.perf_counter()
        row = align.filled(df, "v", "t", ["symbol"]).agg(F.count("v").alias("n"), F.sum("v").alias("s")).first()
        assert row["n"] == n and row["s"] == sum(7 + max(0, k - 7) // 50_000 * 50_000 for k in range(n))
        return time.perf_counter() - began

    took(1000)
    assert took(160_000) < 15


# Co-moments


def test_comoments_merge_to_those_of_all_rows(spark):
    from barweave.operators import selection

    rng = np.random.default_rng(1)
    x = rng.normal(size=(5000, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 1e-3]]) + np.array([1e6, -3.0, 1e3])
    frame = pd.DataFrame(x, columns=list("abc")).assign(same=0.1)
    df = spark.createDataFrame(frame).repartition(7)
    n, mean, c = selection.comoments(df, ["a", "b", "c", "same"])
    assert n == 5000 and np.allclose(mean[:3], x.mean(axis=0), rtol=1e-14)
    want = np.cov(x.T) * 4999
    assert np.abs(c[:3, :3] / want - 1).max() < 1e-9 and (c[3] == 0).all()
    pairs = {(r["first"], r["second"]): r["corr"] for r in selection.correlations(df, ["a", "b", "c", "same"]).collect()}
    assert abs(pairs["a", "b"] - abs(np.corrcoef(x.T)[0, 1])) < 1e-9 and pairs["a", "same"] is None and len(pairs) == 6
    empty = selection.correlations(df.where("a < 0"), ["a", "b"]).collect()
    assert [tuple(r) for r in empty] == [("a", "b", None)]
    assert selection.comoments(df.where("a < 0"), ["a"])[0] == 0


def test_pairs_of_all_rows_and_of_training_rows(spark):
    from barweave.operators import selection
    from barweave.plans import catalog
    from tests.oracle import DATA

    names = list(selection.CANDIDATES)
    rows = align.sanitised(catalog._features(spark, DATA, True), names).select("date", *names).toPandas()
    old = rows["date"] <= datetime.date.fromisoformat(catalog.SPLITS[0])
    assert 0 < old.sum() < len(rows)
    for query, part in ((catalog.corr_pairs, rows), (catalog.corr_pairs_train, rows[old])):
        want = part[names].corr().abs()
        got = [tuple(r) for r in query(spark, DATA).collect()]
        assert len(got) == len(names) * (len(names) - 1) // 2
        assert all(abs(c - want.loc[a, b]) < 2e-6 for a, b, c in got)


def test_selection_as_a_whole(spark):
    from barweave.operators import selection

    rng = np.random.default_rng(4)
    base = rng.normal(size=(3000, 4))
    frame = pd.DataFrame({"ret_1d": base[:, 0], "mom_20": base[:, 0] + 1e-3 * base[:, 1], "body": base[:, 2], "vol_20d": base[:, 3], "target": base[:, 2] + 0.1 * base[:, 1]})
    chosen = selection.select(spark.createDataFrame(frame), top=1, trees=10)
    assert chosen[0] == "body" and "mom_20" not in chosen and set(chosen) == {"body", "ret_1d", "vol_20d"}
    assert selection.covered([("a", 3.0), ("b", 2.0), ("c", 1.0)], 1, {"x": ("b", "c"), "y": ("a",), "z": ("none",)}) == ["a", "b"]


# Catalogue tables


def test_trades_of_a_bucketed_table_need_no_exchange(spark):
    from barweave.operators import metrics
    from barweave.plans import catalog
    from barweave.sources import sinks
    from tests.oracle import DATA

    table = catalog.bucketed_bars(spark, DATA)
    signals = catalog.signals_of(table)
    found = backtest.trades(signals)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "FlatMapGroupsInPandas" in plan and "Window" in plan
    curve = metrics.equity(signals, found)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in curve or curve.count("Exchange hashpartitioning") < backtest_exchanges(spark, catalog, DATA)
    name = next(t for t in sinks.tables(spark) if t.startswith("bars_"))
    sinks.drop_table(spark, name)
    assert name not in sinks.tables(spark)


def backtest_exchanges(spark, catalog, data):
    from barweave.operators import metrics

    s = catalog.signals(spark, data)
    return metrics.equity(s, backtest.trades(s))._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_bucketed_tables_are_replaced(spark, tmp_path):
    from barweave.sources import sinks

    df = spark.createDataFrame([("a", 1), ("b", 2)], "symbol string, date int")
    for rows in (df, df.where("date = 2")):
        table = sinks.save_bucketed(rows, "some_bars", str(tmp_path / "t"), buckets=3)
    assert [tuple(r) for r in table.collect()] == [("b", 2)] and "some_bars" in sinks.tables(spark)
    sinks.drop_table(spark, "some_bars")


# Sliding extremes


@pytest.mark.parametrize("n", [1, 2, 7, 40, 500])
def test_extremes_by_blocks_equal_frames(spark, n):
    from barweave.functions.rolling import roll, with_extremes

    rng = np.random.default_rng(n)
    frame = pd.DataFrame({"symbol": rng.choice(list("abc"), 600), "date": np.arange(600), "x": rng.normal(size=600), "y": rng.integers(0, 5, 600).astype(float), "kept": 1})
    df = spark.createDataFrame(frame).withColumn("x", F.when(F.rand(2) < 0.97, F.col("x")))
    df = df.withColumns({"high": roll(F.max, "x", n), "low": roll(F.min, "y", n)})
    both = with_extremes(df, {"h": ("max", "x", n), "k": ("min", "y", n), "one": ("max", "y", 3)})
    assert both.columns == [*df.columns, "h", "k", "one"]
    assert both.where("NOT (high <=> h AND low <=> k)").count() == 0 and both.where("one IS NULL").count() == 6


def test_max_row_with_a_filter(spark):
    from barweave.operators import bars as B

    df = spark.createDataFrame([("a", 1, 5.0, True), ("a", 2, 7.0, False), ("a", 3, 5.0, True), ("b", 1, None, True), ("c", 1, 1.0, False)], "symbol string, date int, x double, ok boolean")
    assert [tuple(r) for r in B.max_row(df, "x", F.col("ok"), ["symbol"]).collect()] == [("a", 1, 5.0, True)]
