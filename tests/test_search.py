"""Formulas, evolution, regimes and selection."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barweave.config import Config
from barweave.operators import evolve, formula, hmm, regimes, selection
from barweave.sources import sinks

NAMES = ["a", "b", "c"]
SMALL = Config(population=12, generations=2, elite=2, max_depth=3)


def test_config_checks():
    assert Config().validate()
    for bad in ({"population": 0}, {"generations": 0}, {"crossover": 1.0}, {"mutation": 0.0}, {"crossover": 0.9, "mutation": 0.2}, {"min_hold": 60}, {"min_depth": 5}, {"stop_loss": 0.07}):
        with pytest.raises(ValueError):
            Config(**bad).validate()


def test_parse_and_print():
    t = formula.parse("sub(mul(a, half), max(b, -0.25))")
    assert str(t) == "sub(mul(a, half), max(b, -0.25))" and t.size() == 7 and t.height() == 2
    assert formula.infix(t) == "((a * half) - (b max -0.25))"
    assert t.features() == {"a", "b"}
    for bad in ("", "sub(a)", "nope(a, b)", "sub(a, b", "a b", "sub", "neg(a))"):
        with pytest.raises(ValueError):
            formula.parse(bad)
    with pytest.raises(ValueError):
        formula.parse("add(a, zzz)", {"a"})


def test_column_equals_array(spark):
    rng, gen = random.Random(1), np.random.default_rng(1)
    values = gen.normal(0, 3, (60, 3))
    values[0], values[1], values[2] = 0, [np.nan, np.inf, -np.inf], [1e300, -1e300, 1e-12]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(values)], "i int, a double, b double, c double")
    trees = [evolve.ramped(rng, NAMES, Config()) for _ in range(25)]
    rows = df.select("i", *(formula.column(t).alias(f"t{k}") for k, t in enumerate(trees))).orderBy("i").collect()
    arrays = {n: values[:, k] for k, n in enumerate(NAMES)}
    for k, t in enumerate(trees):
        np.testing.assert_allclose([r[f"t{k}"] for r in rows], formula.evaluate(t, arrays, 60), rtol=1e-9, atol=1e-9, err_msg=str(t))


def test_breeding_respects_limits():
    rng, config = random.Random(2), Config(population=200)
    trees = [evolve.ramped(rng, NAMES, config) for _ in range(200)]
    assert all(config.min_depth <= t.height() <= config.max_depth for t in trees)
    trees = [t for t in trees if t.size() <= config.max_nodes]
    ranked = [(t, float(-t.size())) for t in trees]
    children = evolve.breed(rng, ranked, trees[:3], NAMES, config)
    assert len(children) == 200 and children[:3] == trees[:3]
    assert all(c.size() <= config.max_nodes and c.height() <= config.max_depth for c in children)
    assert len(evolve.seeded(rng, trees[0], 10, NAMES, config)) == 10


def test_early_stop():
    stop = evolve.EarlyStop(2, 0.01)
    assert [stop.update(x) for x in (1.0, 1.005, 1.02, 1.02, 1.02)] == [False, False, False, False, True]


@pytest.fixture(scope="module")
def market(spark):
    rng = np.random.default_rng(5)
    rows = []
    for s in "VWXYZ":
        x = rng.normal(0, 1, 260)
        close = 100 * np.exp(np.cumsum(np.roll(x, 1) * 0.01))  # the signal leads the price
        for i in range(260):
            rows.append((s, "train" if i < 180 else "val", i, float(close[i]), float(close[i]), 1, float(x[i]), float(rng.normal()), 0.5))
    return spark.createDataFrame(rows, "symbol string, split string, date int, open double, close double, regime int, a double, b double, c double").cache()


def test_evolution_repeats_itself_and_keeps_the_best(spark, market, tmp_path):
    one = evolve.evolve(market, NAMES, SMALL, seeds=["a"], hall=3, checkpoint=str(tmp_path / "gens"))
    two = evolve.evolve(market, NAMES, SMALL, seeds=["a"], hall=3)
    assert [(str(t), f) for t, f in one.best] == [(str(t), f) for t, f in two.best]
    assert len(one.stats) == 2 and one.stats[1]["best"] >= one.stats[0]["best"] - 1e-12
    assert evolve.load(spark, str(tmp_path / "none")) is None
    with pytest.raises(ValueError):
        evolve.evolve(market, NAMES, SMALL, seeds=["zzz"])


def test_a_search_that_resumes_ends_as_one_that_did_not_stop(spark, market, tmp_path, monkeypatch):
    monkeypatch.setattr(evolve, "SAVED", 1)
    long = Config(population=12, generations=3, elite=2, max_depth=3)
    whole = evolve.evolve(market, NAMES, long, seeds=["a"], hall=3)
    path = str(tmp_path / "gens")
    evolve.evolve(market, NAMES, Config(population=12, generations=2, elite=2, max_depth=3), seeds=["a"], hall=3, checkpoint=path)
    rest = evolve.evolve(market, NAMES, long, seeds=["a"], hall=3, checkpoint=path, resume=True)
    assert [str(t) for t, _ in rest.best] == [str(t) for t, _ in whole.best]
    assert [f for _, f in rest.best] == pytest.approx([f for _, f in whole.best])
    assert [s["gen"] for s in rest.stats] == [0, 1, 2] and rest.stats[2]["best"] == pytest.approx(whole.stats[2]["best"])


def test_a_search_starts_with_a_saved_model(market, monkeypatch):
    seen = []
    monkeypatch.setattr(evolve, "evaluate", lambda series, trees, features: seen.append([str(t) for t in trees]) or market.sparkSession.createDataFrame([(str(t), 1.0) for t in trees], "tree string, fitness double"))
    evolve.evolve(market, NAMES, Config(population=15, generations=1, elite=2), model="sub(a, b)")
    assert seen[0][0] == "sub(a, b)" and evolve.CLONES == 10 and len(seen[0]) == 15


def test_planted_signal_beats_noise(market):
    got = {r["tree"]: r["fitness"] for r in evolve.evaluate(evolve.prepare(market, NAMES), [formula.parse("a"), formula.parse("b"), formula.parse("zero")], NAMES).collect()}
    assert got["a"] > got["b"] and got["zero"] == -50


def test_hmm_finds_planted_states():
    rng = np.random.default_rng(0)
    states = np.repeat([0, 1, 2, 3, 1, 0], 150)
    x = np.column_stack([rng.normal(states * 4, 0.5), rng.normal((states == 2) * 5, 0.5)])
    model = hmm.fit(x, 4, 200)
    assert all(b >= a - 1e-6 for a, b in zip(model.history, model.history[1:]))
    p = model.posterior(x)
    np.testing.assert_allclose(p.sum(axis=1), 1, atol=1e-9)
    path = model.path(x)
    assert sum(len(set(path[states == s])) == 1 for s in range(4)) >= 3
    with pytest.raises(ValueError):
        hmm.fit(x[:3], 4)


def test_pruning_order():
    pairs = [("a", "b", 0.9), ("a", "c", 0.95), ("b", "c", 0.99), ("a", "d", 0.5)]
    assert selection.pruned(pairs, ["a", "b", "c", "d"]) == ["a", "d"]
    ranked = [("x", 0.5), ("rsi_14", 0.3), ("ret_1d", 0.1), ("vol_ratio", 0.05), ("body", 0.04), ("upper_wick", 0.03), ("pct_from_low52w", 0.02)]
    assert selection.covered(ranked, 2) == ["x", "rsi_14", "vol_ratio", "pct_from_low52w", "body"]
    assert len(selection.CANDIDATES) == 40 and {f for m in selection.CATEGORIES.values() for f in m} <= set(selection.CANDIDATES)


def test_forest_ranks_planted_feature_first(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (1500, 3))
    df = spark.createDataFrame([(*map(float, r), float(3 * r[1] + 0.1 * rng.normal())) for r in x], "a double, b double, c double, target double")
    assert selection.importance(df, NAMES, trees=10).where("rank = 1").first()["feature"] == "b"


def test_smoothing_ties_go_to_the_first_state(spark):
    df = spark.createDataFrame([("I", 1, 0.25, 0.25, 0.25, 0.25), ("I", 2, 0.0, 0.5, 0.5, 0.0)], "symbol string, date int, prob_bull_quiet double, prob_crisis double, prob_sideways_bear double, prob_volatile double")
    assert [r["regime_smooth"] for r in regimes.smoothed(df).orderBy("date").collect()] == ["BULL_QUIET", "CRISIS"]


def test_labels_without_a_trend_are_flat(spark):
    assert regimes.labelled(spark.createDataFrame([(1,)], "x int")).first()["regime"] == "FLAT"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.125), (2, "b", 0.375)], "x int, symbol string, v double")
    path = str(tmp_path / "t")
    df.write.parquet(path)
    sinks.replace_table(spark.read.parquet(path).withColumn("x", F.col("x") + 1), path)
    assert sorted(r["x"] for r in spark.read.parquet(path).collect()) == [2, 3]
    assert [r["v"] for r in sinks.display_rounded(df, {"v": 2}).orderBy("x").collect()] == [0.12, 0.38]
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2
    sinks.write_list(spark, ["p", "q"], str(tmp_path / "l"))
    assert sinks.read_list(spark, str(tmp_path / "l")) == ["p", "q"]
    sinks.save_model(spark, {"tree": "a"}, str(tmp_path / "m"))
    assert sinks.load_model(spark, str(tmp_path / "m")) == {"tree": "a"} and sinks.load_model(spark, str(tmp_path / "no")) is None
    sinks.write_bars(df, str(tmp_path / "b"), "x")
    assert "PartitionFilters: [isnotnull(symbol" in spark.read.parquet(str(tmp_path / "b")).where("symbol = 'a'")._jdf.queryExecution().toString()


def test_views(spark):
    from tests.oracle import DATA

    names = sinks.attach(spark, DATA, ["region", "nation"], "src_")
    assert set(names) <= set(sinks.tables(spark))
    sinks.detach(spark, names)
    assert not set(names) & set(sinks.tables(spark))
