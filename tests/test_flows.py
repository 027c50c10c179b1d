"""Queries without SQL against the same work done otherwise, and sinks that are broken off."""

from __future__ import annotations

import struct

import numpy as np
import pytest
import xxhash

from barweave.functions import safe
from barweave.operators import formula
from barweave.plans import catalog
from barweave.sources import sinks
from tests.oracle import DATA


def test_resumed_search_ends_as_one_that_does_not_stop(spark):
    got = [tuple(r) for r in catalog.evolve_resumed(spark, DATA).orderBy("rank").collect()]
    want = [tuple(r) for r in catalog._hall(spark, catalog._search(spark, DATA)).orderBy("rank").collect()]
    assert [r[:3] for r in got] == [r[:3] for r in want] and [r[3] for r in got] == pytest.approx([r[3] for r in want])
    assert len(got) == 5


def test_seeded_search_is_as_good_as_its_model(spark):
    best = catalog.evolve_seeded(spark, DATA).orderBy("rank").first()
    model = {r["tree"]: r["fitness"] for r in catalog.population_fitness(spark, DATA).collect()}["sub(f3, f6)"]
    assert best["fitness"] >= model - 1e-4


def test_sample_of_signals_is_that_of_the_least_hashes(spark):
    df = catalog._features(spark, DATA, True).select("symbol", "date", *(formula.column(t).alias(n) for n, t in catalog.FORMULAS.items())).toPandas()
    days = (np.array(df["date"], dtype="datetime64[D]")).astype("int64")

    def hashed(symbol, day):
        h = xxhash.xxh64(struct.pack("<i", day), seed=xxhash.xxh64(symbol.encode(), seed=42).intdigest()).intdigest()
        return h - (1 << 64) if h >> 63 else h

    df["hash"] = [hashed(s, int(d)) for s, d in zip(df["symbol"], days)]
    sample = df.sort_values(["hash", "symbol", "date"]).head(500)
    got = {r["tree"]: r for r in catalog.signal_sample(spark, DATA).collect()}
    assert len(df) > 500 and set(got) == set(catalog.FORMULAS)
    for n in catalog.FORMULAS:
        spread = float(np.std(np.tanh(sample[n].to_numpy(float))))
        assert got[n]["n"] == 500 and got[n]["spread"] == pytest.approx(spread, abs=2e-6) and got[n]["diverse"] == (spread >= 0.01)


def test_a_save_that_breaks_off_leaves_a_model(spark, tmp_path):
    path = str(tmp_path / "model")
    sinks.save_model(spark, {"tree": "a"}, path)
    sinks.save_model(spark, {"tree": "b"}, path)
    assert sinks.load_model(spark, path) == {"tree": "b"} and not (tmp_path / "model.old").exists()
    (tmp_path / "model").rename(tmp_path / "model.old")  # as after the first of the two moves
    assert sinks.load_model(spark, path) == {"tree": "b"}
    sinks.save_model(spark, {"tree": "c"}, path)
    assert sinks.load_model(spark, path) == {"tree": "c"}
    for part in (tmp_path / "model").glob("part-*"):
        part.write_text("{")
        (tmp_path / "model" / f".{part.name}.crc").unlink(missing_ok=True)
    assert sinks.load_model(spark, path) is None


def test_seconds_as_text():
    assert [safe.fmt_seconds(x) for x in (0, 45, 65, 3600 * 2 + 184)] == ["0.0s", "45.0s", "1m 05s", "2h 03m 04s"]
