"""Windows over blocks of rows against windows over whole series."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barweave.operators import features, halo


def walk(n, symbols=("A",), seed=1):
    rng, frames = np.random.default_rng(seed), []
    for s in symbols:
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        spread = rng.uniform(0, 2, (3, n))
        frames.append(pd.DataFrame({"symbol": s, "date": pd.date_range("1990-01-01", periods=n).date, "open": close + spread[0] - 1, "high": close + 1 + spread[1], "low": close - 1 - spread[2], "close": close, "volume": rng.integers(0, 50, n)}))
    return pd.concat(frames)


@pytest.fixture(scope="module")
def bars(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("halo") / "bars")
    spark.createDataFrame(pd.concat([walk(2600, ("A", "B")), walk(130, ("C",), 2), walk(1, ("D",), 3)])).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("rows", [64, 700, 100_000])
def test_all_features_equal_those_of_whole_series(spark, bars, rows):
    index = bars.where("symbol = 'B' AND day(date) > 3").select("date", "close")
    make = lambda df: features.daily_features(df, index)
    want = make(bars).orderBy("symbol", "date").toPandas()
    got = halo.over_blocks(bars, make, rows=rows).select(*want.columns).orderBy("symbol", "date").toPandas()
    assert len(want.columns) == 7 + 54 and len(got) == len(want) == 5331
    for c in want.columns:
        a, b = got[c], want[c]
        assert a.isna().equals(b.isna()), c
        if c in ("symbol", "date"):
            assert a.equals(b)
        else:
            np.testing.assert_allclose(a.astype(float), b.astype(float), rtol=1e-9, atol=1e-12, err_msg=c)


def test_a_task_holds_a_bounded_share_of_a_symbol(spark, bars):
    sizes = halo.apart(bars, rows=300, before=100).groupBy("symbol").agg(F.count("*").alias("n"), F.count_if("own_row").alias("own")).collect()
    assert max(r["n"] for r in sizes) == 400 and max(r["own"] for r in sizes) == 300
    assert sum(r["own"] for r in sizes) == bars.count()


def test_numbers_run_through_ranges(spark, bars):
    got = halo.numbered(bars, ["symbol"], "date", 500).orderBy("symbol", "date").toPandas()
    for _, one in got.groupby("symbol"):
        assert one["__position"].tolist() == list(range(len(one))) and (one["__length"] == len(one)).all()


def test_null_symbols_and_empty_tables(spark, bars):
    odd = bars.where("symbol = 'C'").withColumn("symbol", F.lit(None).cast("string"))
    assert halo.over_blocks(odd, features.daily_features, rows=50).where("symbol IS NULL AND sma_20 IS NOT NULL").count() == 130 - 19
    assert halo.over_blocks(bars.limit(0), features.daily_features).count() == 0
    with pytest.raises(ValueError):
        halo.apart(bars.withColumn("own_row", F.lit(1)))
