"""Rolling columns against pandas, and the rules for nulls."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barweave.functions import rolling
from barweave.operators import align, bars as B, features
from barweave.sources import bars as S


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"symbol": np.repeat(["A", "B"], 700), "date": np.tile(np.arange(700), 2), "close": 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 1400)))})
    return pdf, spark.createDataFrame(pdf).cache()


@pytest.mark.parametrize("span", [9, 12, 26])
@pytest.mark.parametrize("adjust", [True, False])
def test_ema_equals_pandas(series, span, adjust):
    pdf, df = series
    got = rolling.with_ema(df, "close", {"e": span}, adjust).orderBy("symbol", "date").toPandas()
    want = pdf.groupby("symbol").close.transform(lambda s: s.ewm(span=span, adjust=adjust).mean())
    assert np.abs(got.e.to_numpy() - want.to_numpy()).max() < 1e-9


def test_rolling_needs_full_frames(series):
    pdf, df = series
    got = df.withColumn("m", rolling.mean("close", 20)).withColumn("s", rolling.std("close", 20)).orderBy("symbol", "date").toPandas()
    by = pdf.groupby("symbol").close
    for c, want in (("m", by.transform(lambda s: s.rolling(20).mean())), ("s", by.transform(lambda s: s.rolling(20).std()))):
        assert got[c].isna().equals(want.isna())
        assert np.nanmax(np.abs(got[c].to_numpy(float) - want.to_numpy())) < 1e-9


def test_null_in_a_frame_makes_it_null(spark):
    df = spark.createDataFrame([("A", i, None if i == 3 else float(i)) for i in range(8)], "symbol string, date int, x double")
    got = [r["m"] for r in df.withColumn("m", rolling.mean("x", 3)).orderBy("date").collect()]
    assert got == [None, None, 1.0, None, None, None, 5.0, 6.0]


def bars_of(spark, rows):
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume long")


def test_flat_prices_and_zero_volume(spark):
    days = pd.date_range("2020-01-01", periods=30).date
    df = bars_of(spark, [("A", d, 5.0, 5.0, 5.0, 5.0, 0 if i == 2 else 7) for i, d in enumerate(days)])
    rows = features.daily_features(df).orderBy("date").collect()
    assert rows[3]["vol_ret"] == 5.0 and rows[2]["vol_ret"] == -1.0
    assert rows[25]["bb_width_20"] == 0 and rows[25]["rsi_14"] == 0 and rows[25]["index_rsi14"] == 0.5
    assert len(rows[0]) == 7 + 54


def test_one_row_symbol(spark):
    import datetime

    (row,) = features.daily_features(bars_of(spark, [("A", datetime.date(2020, 1, 1), 1.0, 2.0, 0.5, 1.5, 3)])).collect()
    assert row["ret_1d"] is None and row["ema_12"] == pytest.approx(1.5) and row["body"] == pytest.approx(0.5)


def test_index_that_starts_late(spark):
    left = spark.createDataFrame([("A", i) for i in range(5)], "symbol string, date int")
    right = spark.createDataFrame([(2, 20.0), (3, None), (9, 90.0)], "date int, close double")
    got = [r["v"] for r in align.asof(left, right, "date", "close", "v").orderBy("date").collect()]
    assert got == [None, None, 20.0, 20.0, 20.0]
    got = [r["v"] for r in align.exact_filled(left, right, "date", "close", "v").orderBy("date").collect()]
    assert got == [20.0] * 5


@pytest.mark.parametrize("forward", [False, True])
def test_asof_over_many_months(spark, forward):
    rng = np.random.default_rng(3)
    day = np.datetime64("2020-01-01")
    asked = sorted(set(rng.integers(0, 900, 80).tolist()))
    known = sorted(set(rng.integers(150, 700, 30).tolist()) - {400, 401})
    left = spark.createDataFrame([("A", (day + i).item()) for i in asked] + [("B", (day + i).item()) for i in asked[::2]], "symbol string, date date")
    right = spark.createDataFrame([((day + i).item(), float(i)) for i in known], "date date, close double")
    want = {(day + i).item(): next((float(k) for k in (known if forward else known[::-1]) if (k >= i if forward else k <= i)), None) for i in asked}
    got = align.asof(left, right, "date", "close", "v", forward).collect()
    assert len(got) == len(asked) + len(asked[::2]) and all(r["v"] == want[r["date"]] for r in got)


def test_nearest_takes_the_earlier_on_ties(spark):
    import datetime

    day = lambda i: datetime.date(2021, 1, 1) + datetime.timedelta(i)
    notes = spark.createDataFrame([(day(5), "tie"), (day(0), "before all"), (day(400), "after all"), (day(9), "later")], "date date, note string")
    bars = spark.createDataFrame([(day(3), 1.0), (day(7), 2.0), (day(10), 3.0)], "date date, close double")
    assert {(r["note"], r["close"]) for r in align.nearest(notes, bars, "date", ["close"]).collect()} == {("tie", 1.0), ("before all", 1.0), ("after all", 3.0), ("later", 3.0)}
    assert align.nearest(notes, bars.limit(0), "date", ["close"]).count() == 0


def test_streams_read_files_and_folders(spark, tmp_path):
    from barweave.streaming import ticks

    events = spark.createDataFrame([(i, "click", f"2024-01-01 0{i % 3}:00:00", float(i)) for i in range(9)], "event_id long, event_type string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    events = events.union(spark.createDataFrame([(99, "end", "2024-01-02 00:00:00", None)], "event_id long, event_type string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp")))
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    (tmp_path / "one").mkdir()
    events.toPandas().to_parquet(tmp_path / "one" / "events.parquet", coerce_timestamps="us", index=False)
    for k, path in enumerate((tmp_path / "events.parquet", tmp_path / "one" / "events.parquet")):
        bars = ticks.appended(ticks.stream_bars(ticks.tick_stream(spark, str(path))), str(tmp_path / f"b{k}"), str(tmp_path / f"c{k}"))
        assert bars.agg(F.count("*"), F.sum("n")).first() == (3, 9)


def test_stream_counts_late_ticks_within_the_watermark_once(spark, tmp_path):
    from barweave.streaming import ticks

    def arrive(*rows):
        df = spark.createDataFrame([(i, "click", f"2024-01-01 {at}", float(i)) for i, at in rows], "event_id long, event_type string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = ticks.appended(ticks.stream_bars(ticks.tick_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "c"))
        return sorted((str(r["bar"])[11:16], r["open"], r["close"], r["n"]) for r in out.collect())

    assert arrive((1, "00:10:00"), (2, "01:05:00")) == []  # ten minutes before the latest tick the first hour is not over
    assert arrive((3, "00:57:00")) == []  # late, but within the watermark
    assert arrive((4, "01:20:00")) == [("00:00", 1.0, 3.0, 2)]
    assert arrive((5, "00:59:00"), (6, "02:30:00")) == [("00:00", 1.0, 3.0, 2), ("01:00", 2.0, 4.0, 2)]  # the first is too late
    # A batch that is run again replaces what it has written.
    again = spark.read.parquet(str(tmp_path / "out"))
    batch = again.agg(F.max("batch")).first()[0]
    spark.read.parquet(str(tmp_path / "out" / f"batch={batch}")).write.mode("overwrite").parquet(str(tmp_path / "copy"))
    spark.read.parquet(str(tmp_path / "copy")).write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={batch}"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_fill_stays_within_symbols_unless_asked(spark):
    df = spark.createDataFrame([("A", 1, 1.0), ("B", 1, None), ("B", 2, 3.0)], "symbol string, date int, x double")
    assert [r["x"] for r in align.filled(df, "x", "date", ["symbol"]).orderBy("symbol", "date").collect()] == [1.0, 3.0, 3.0]
    assert [r["x"] for r in align.filled(df, "x", "date", None).orderBy("symbol", "date").collect()] == [1.0, 1.0, 3.0]


def test_sanitised(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "x double")
    assert [r["x"] for r in align.sanitised(df, ["x"]).collect()] == [1.0, 0, 0, 0, 0]


def test_first_of_each_and_runs(spark):
    df = spark.createDataFrame([("A", 1, "x", 2), ("A", 1, "y", 1), ("A", 2, "x", 1), ("A", 3, "x", 1), ("A", 4, "y", 1)], "symbol string, date int, l string, k int")
    one = S.first_of_each(df, ["symbol", "date"], ["k"])
    assert one.count() == 4
    assert sorted((r["l"], r["start"], r["end"], r["n"]) for r in B.runs(one, "l", "date", ["symbol"]).collect()) == [("x", 2, 3, 2), ("y", 1, 1, 1), ("y", 4, 4, 1)]


def test_rsi_lies_between_zero_and_one(series):
    _, df = series
    f = df.withColumns({c: F.col("close") for c in ("open", "high", "low")}).withColumn("volume", F.lit(1))
    low, high = features.daily_features(f).agg(F.min("rsi_14"), F.max("rsi_14")).first()
    assert 0 <= low <= high <= 1
