"""Formulas as one graph against formulas one by one."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barweave.config import Config
from barweave.operators import backtest, blocks, evolve, formula, metrics

NAMES = ["a", "b", "c"]


def population(n, seed=0):
    rng = random.Random(seed)
    config = Config(population=n, elite=2, max_depth=5)
    trees = [evolve.ramped(rng, NAMES, config) for _ in range(n // 2)]
    while len(trees) < n:
        trees += evolve.crossover(rng, rng.choice(trees), rng.choice(trees), config)
    return trees[:n]


def arrays(n=80):
    rng = np.random.default_rng(3)
    out = {f: rng.normal(0, 3, n) for f in NAMES}
    out["a"][:4] = [np.nan, np.inf, -np.inf, 0.0]
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_signals_equal_those_of_single_formulas(seed):
    trees, got = population(120, seed), {}
    graph = formula.Graph(trees)
    for which, signal in graph.signals(arrays(), 80):
        got |= {i: signal.copy() for i in which}
    assert sorted(got) == list(range(120))
    for i, t in enumerate(trees):
        np.testing.assert_array_equal(got[i], formula.evaluate(t, arrays(), 80), err_msg=str(t))
    assert len(graph) < sum(t.size() for t in trees) / 2


def test_commutative_order_and_names_of_numbers():
    same = [formula.parse(t) for t in ("add(mul(a, b), one)", "add(1.0, mul(b, a))", "add(mul(a, b), 1)")]
    assert len({str(formula.normal(t)) for t in same}) == 1 and len(formula.Graph(same)) == 5 and len(formula.Graph(same).roots) == 1
    other = [formula.parse(t) for t in ("sub(a, b)", "sub(b, a)", "div(a, b)", "div(b, a)")]
    assert len({str(formula.normal(t)) for t in other}) == 4 and len(formula.Graph(other).roots) == 4
    assert formula.normal(formula.normal(same[0])) == formula.normal(same[0]) and formula.normal(same[0]).size() == same[0].size()
    assert list(formula.Graph([]).signals({}, 3)) == []


def test_nodes_are_kept_until_their_last_use(monkeypatch):
    """A chain of a thousand sums never holds more than a few arrays."""
    import weakref

    tree, alive, most = formula.Node("a"), weakref.WeakSet(), 0
    for _ in range(200):
        tree = formula.Node("add", (tree, formula.Node("b")))

    class Array(np.ndarray):
        pass

    def tracked(x):
        nonlocal most
        x = np.where(np.isfinite(x), x, 0.0).view(Array)
        alive.add(x)
        most = max(most, len(alive))
        return x

    monkeypatch.setattr(Array, "__hash__", object.__hash__, raising=False)
    monkeypatch.setattr(Array, "__eq__", lambda s, o: s is o, raising=False)
    monkeypatch.setattr(formula, "_finite", tracked)
    (_, signal), = formula.Graph([tree]).signals({"a": np.ones(5), "b": np.ones(5)}, 5)
    assert signal[0] == 201 and most <= 6


def test_fitness_equals_that_of_formulas_one_by_one(spark):
    rng, rows = np.random.default_rng(5), []
    for s in ("P", "Q", "R", "S"):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 160)))
        rows += [(s, "train" if i < 110 else "val", i, float(c), float(c), 1, *map(float, rng.normal(size=3))) for i, c in enumerate(close)]
    df = spark.createDataFrame(rows, "symbol string, split string, date int, open double, close double, regime int, a double, b double, c double")
    trees = [*population(10, 4), *(formula.parse(t) for t in ("sub(a, b)", "add(a, c)", "add(c, a)", "add(c, a)"))]
    got = {r["tree"]: r["fitness"] for r in evolve.evaluate(evolve.prepare(df, NAMES), trees, NAMES, chunks=3).collect()}
    assert set(got) == {str(t) for t in trees} and got["add(a, c)"] == got["add(c, a)"]
    # Each formula for itself, through the operators of tables.
    for t in (trees[0], formula.parse("sub(a, b)"), formula.parse("add(c, a)")):
        by = ["split", "symbol"]
        one = df.select("symbol", "split", "date", "open", "close", "regime", formula.column(t).alias("signal"))
        scores = metrics.metrics(one, backtest.trades(one, by), by).selectExpr("*", f"{t.size()} AS size")
        port = {r["split"]: r for r in metrics.portfolio_fitness(scores.withColumn("fitness", metrics.single_fitness(scores["size"])), ["split"]).collect()}
        row = spark.createDataFrame([(float(port["train"]["fitness"]), float(port["val"]["fitness"]), int(port["train"]["n_trades"]))], "train double, val double, n_train int")
        assert row.select(metrics.final_fitness().alias("f")).first()["f"] == pytest.approx(got[str(t)], abs=1e-6)


def test_shares_hold_each_formula_once():
    trees = population(60)
    shares = evolve.dealt(trees, 7)
    texts = [str(t) for share in shares for t in share]
    assert sorted(texts) == sorted({str(t) for t in trees}) and max(map(len, shares)) - min(map(len, shares)) <= 1
    assert sum(len(formula.Graph(s)) for s in shares) < sum(t.size() for s in shares for t in s)
    assert evolve.dealt([]) == [[]] and len(evolve.dealt(trees[:2], 7)) <= 2


def series(spark, seed=5, lengths=(160, 160, 160, 160, 1)):
    rng, rows = np.random.default_rng(seed), []
    for s, n in zip("PQRST", lengths):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        rows += [(s, "train" if i < 110 else "val", i, float(c), float(c * (1 + rng.normal(0, 0.003))), int(rng.choice([1, -1, 0], p=[0.6, 0.3, 0.1])), *map(float, rng.normal(size=3))) for i, c in enumerate(close)]
    rows = [(*r[:-1], None if k % 17 == 0 else r[-1]) for k, r in enumerate(rows)]
    return spark.createDataFrame(rows, "symbol string, split string, date int, open double, close double, regime int, a double, b double, c double")


@pytest.mark.parametrize("rows, chunks, opens", [(7, 1, True), (60, 3, True), (10_000, 2, False)])
def test_trades_of_many_formulas_by_blocks_equal_those_of_each(spark, rows, chunks, opens):
    df = series(spark).withColumns({"k": F.lit(1), "form": F.lit("x"), "block": F.lit(0), "share": F.lit(9)})  # names of our own
    df = df if opens else df.drop("open")
    rules = backtest.Rules(min_hold=3, max_hold=25, stop_loss=0.04, trailing_stop=0.05)
    shares, by = evolve.dealt(population(12, 4), chunks), ["symbol", "split"]
    trees = [t for share in shares for t in share]
    found = blocks.trades_of(blocks.laid(df, NAMES, by, rows=rows), shares, NAMES, rules).collect()
    for i, t in enumerate(trees):
        one = df.select(*by, "date", "close", *(["open"] if opens else []), "regime", formula.column(t).alias("signal"))
        want = sorted(tuple(r) for r in backtest.trades(one, by, rules=rules).collect())
        got = sorted(tuple(v for c, v in r.asDict().items() if c != "form") for r in found if r["form"] == i)
        assert [x[:5] for x in got] == [x[:5] for x in want] and [x[-1] for x in got] == [x[-1] for x in want], t
        assert all(x[5:-1] == pytest.approx(y[5:-1], abs=1e-9) for x, y in zip(got, want)), t
    assert len(found) > 100


def test_fitness_by_blocks_equals_that_of_whole_series(spark):
    df = series(spark, 6)
    trees = [*population(14, 8), *(formula.parse(t) for t in ("add(a, c)", "add(c, a)", "sub(a, b)", "sub(a, b)"))]
    want = {r["tree"]: r["fitness"] for r in evolve.evaluate(evolve.prepare(df, NAMES), trees, NAMES, chunks=2).collect()}
    odd = df.union(df.limit(1).selectExpr("NULL", "split", "date", "open", "close", "regime", "a", "b", "c")).union(df.limit(1).selectExpr("symbol", "'test'", "date", "open", "close", "regime", "a", "b", "c"))
    got = {r["tree"]: r["fitness"] for r in evolve.evaluate_blocks(evolve.prepare_blocks(odd, NAMES, 50), trees, NAMES, chunks=2).collect()}
    assert got == pytest.approx(want, abs=1e-6) and set(got) == {str(t) for t in trees} and len(set(got.values())) > 3
    none = evolve.prepare_blocks(df.where("date < 0"), NAMES)
    assert evolve.evaluate_blocks(none, [], NAMES).count() == 0 and evolve.evaluate_blocks(none, trees, NAMES).count() == 0


def test_a_search_over_blocks_ends_as_one_over_whole_series(spark):
    df, config = series(spark, 7), Config(population=8, elite=2, generations=2, max_depth=3, seed=3)
    whole, cut = evolve.evolve(df, NAMES, config, hall=4), evolve.evolve(df, NAMES, config, hall=4, rows=60)
    assert [str(t) for t, _ in whole.best] == [str(t) for t, _ in cut.best] and [f for _, f in whole.best] == pytest.approx([f for _, f in cut.best], abs=1e-6)


def test_metrics_out_of_trades_equal_those_of_curves(spark):
    rng = np.random.default_rng(9)
    lengths = {"A": 300, "B": 40, "C": 2, "D": 1, "E": 30}
    bars = spark.createDataFrame([(s, i) for s, n in lengths.items() for i in range(n)], "symbol string, date int")
    trades = [("A", int(d), 3, float(r)) for d, r in zip(rng.integers(1, 300, 90), rng.normal(0.001, 0.05, 90))]
    trades += [("B", 4, 2, 0.1), ("B", 4, 2, -0.2), ("B", 0, 1, 0.5), ("C", 1, 1, -0.3), ("E", 3, 1, 0.2), ("E", 9, 1, -1.5), ("E", 12, 1, 0.4)]
    trades = spark.createDataFrame(trades, "symbol string, exit_day int, hold_days int, net_return double")
    want = {r["symbol"]: r.asDict() for r in metrics.metrics(bars, trades).collect()}
    got = {r["symbol"]: r.asDict() for r in metrics.of_trades(bars.groupBy("symbol").agg(F.count("*").alias("n_days")), trades).collect()}
    assert set(got) == set(want) == set(lengths)
    for s in want:
        assert got[s].keys() == want[s].keys() and {k: v for k, v in got[s].items() if k != "symbol"} == pytest.approx({k: v for k, v in want[s].items() if k != "symbol"}, abs=1e-8), s
