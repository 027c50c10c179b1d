"""Feature selection: pruning by correlation, ranking by a forest, coverage of categories."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .align import sanitised

THRESHOLD = 0.85

# The features that may be selected, and the categories of which each should be represented.
CANDIDATES = (
    "ret_1d", "ret_3d", "ret_5d", "ret_10d", "ret_20d", "close_vs_sma5", "close_vs_sma10", "close_vs_sma20", "close_vs_sma50", "close_vs_sma200",
    "macd", "rsi_7", "rsi_14", "rsi_21", "bb_upper_20", "bb_lower_20", "bb_width_20", "bb_pos_20", "atr_pct_7", "atr_pct_14", "vol_ratio", "vol_ret",
    "mom_5", "mom_10", "mom_20", "pct_from_high20", "pct_from_low20", "pct_from_high52w", "pct_from_low52w", "body", "upper_wick", "lower_wick",
    "vol_20d", "vol_60d", "index_ret_1d", "index_ret_5d", "index_ret_20d", "index_vs_sma20", "index_rsi14", "rel_strength",
)
CATEGORIES = {
    "trend": ("close_vs_sma20", "close_vs_sma50", "close_vs_sma200", "macd", "mom_20"),
    "momentum": ("ret_1d", "ret_5d", "ret_20d", "rsi_14"),
    "mean_reversion": ("bb_pos_20", "bb_width_20", "pct_from_high20", "pct_from_low20"),
    "volatility": ("atr_pct_14", "vol_ratio", "vol_20d"),
    "range_52w": ("pct_from_high52w", "pct_from_low52w"),
    "candle": ("body", "upper_wick", "lower_wick"),
    "index": ("index_ret_1d", "index_ret_5d", "rel_strength"),
}


def available(df: DataFrame, names: list[str]) -> list[str]:
    return [n for n in names if n in df.columns]


#: Groups in which partitions' moments are merged before the driver sees them.
MERGED = 64


def merged(parts) -> tuple[int, np.ndarray, np.ndarray]:
    """Counts, means and co-moments of several sets of rows as those of all, by Chan's formula: means enter by differences only."""
    n, mean, moments = 0, None, None
    for k, m, c in parts:
        if mean is None:
            n, mean, moments = k, m, c
            continue
        apart = m - mean
        moments = moments + c + np.outer(apart, apart) * (n * k / (n + k))
        mean = mean + apart * (k / (n + k))
        n += k
    return n, mean, moments


def comoments(df: DataFrame, features: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, means and centred sums of products of the columns over all rows, in one pass.

    A task keeps one matrix, groups of tasks merge theirs, and the driver the groups'. Each batch is centred by itself, so
    digits stay whatever the means are; a column that is constant has exact zeros. Without rows the means are zero.
    """
    d = len(features)

    def run(batches):
        def blocks():
            for batch in batches:
                if batch.num_rows:
                    x = np.stack([np.asarray(batch.column(k), float) for k in range(d)], axis=1)
                    low = x[0]
                    mean = (x - low).mean(axis=0)
                    x = x - low - mean
                    yield len(x), low + mean, x.T @ x

        n, mean, moments = merged(blocks())
        if n:
            values = [n], [TaskContext.get().partitionId()], [mean.tolist()], [moments.ravel().tolist()]
            kinds = pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["n", "part", "mean", "moments"])

    def merge(pdf):
        pdf = pdf.sort_values("part")
        n, mean, moments = merged((int(n), np.array(m), np.array(c).reshape(d, d)) for n, m, c in zip(pdf["n"], pdf["mean"], pdf["moments"], strict=True))
        return pd.DataFrame({"n": [n], "part": [int(pdf["part"].iloc[0])], "mean": [mean], "moments": [moments.ravel()]})

    schema = "n long, part int, mean array<double>, moments array<double>"
    parts = df.select(*(F.col(f).cast("double") for f in features)).mapInArrow(run, schema)
    rows = parts.groupBy(F.pmod("part", F.lit(MERGED))).applyInPandas(merge, schema).collect()
    n, mean, moments = merged((r["n"], np.array(r["mean"]), np.array(r["moments"]).reshape(d, d)) for r in sorted(rows, key=lambda r: r["part"]))
    return (n, mean, moments) if n else (0, np.zeros(d), np.zeros((d, d)))


def correlations(df: DataFrame, features: list[str]) -> DataFrame:
    """(first, second, corr) of every pair, absolute, features as given before each other; null where one is constant.

    One pass over the rows (see ``comoments``); the driver holds the matrix of the features alone.
    """
    _, _, c = comoments(sanitised(df, features).select(features), features)
    size = np.sqrt(np.diag(c))
    pairs = [(a, b, abs(float(c[i, j] / size[i] / size[j])) if size[i] and size[j] else None) for j, b in enumerate(features) for i, a in enumerate(features[:j])]
    return df.sparkSession.createDataFrame(pairs, "first string, second string, corr double")


def pruned(pairs: list[tuple[str, str, float]], features: list[str], threshold: float = THRESHOLD) -> list[str]:
    """Features left when of each pair above the threshold, the closest first, the second goes if both are still there."""
    at = {f: i for i, f in enumerate(features)}
    close = sorted((p for p in pairs if p[2] is not None and p[2] > threshold), key=lambda p: (-p[2], at[p[1]], at[p[0]]))
    gone: set[str] = set()
    for a, b, _ in close:
        if a not in gone and b not in gone:
            gone.add(b)
    return [f for f in features if f not in gone]


def importance(df: DataFrame, features: list[str], target: str = "target", trees: int = 300, depth: int = 6, least: int = 100, seed: int = 42) -> DataFrame:
    """(feature, importance, rank) by a forest of regression trees."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    data = VectorAssembler(inputCols=features, outputCol="x").transform(sanitised(df, [*features, target])).select("x", target)
    model = RandomForestRegressor(featuresCol="x", labelCol=target, numTrees=trees, maxDepth=depth, minInstancesPerNode=least, seed=seed).fit(data)
    ranked = sorted(zip(features, model.featureImportances.toArray().tolist(), strict=True), key=lambda p: (-p[1], features.index(p[0])))
    return df.sparkSession.createDataFrame([(f, v, i + 1) for i, (f, v) in enumerate(ranked)], "feature string, importance double, rank int")


def covered(ranked: list[tuple[str, float]], top: int, categories: dict[str, tuple[str, ...]] = CATEGORIES) -> list[str]:
    """The top features, and the best of each category that has none among them."""
    chosen = [f for f, _ in ranked[:top]]
    for members in categories.values():
        if not any(f in chosen for f in members):
            best = next((f for f, _ in ranked if f in members), None)
            if best:
                chosen.append(best)
    return list(dict.fromkeys(chosen))


def select(df: DataFrame, features: list[str] = list(CANDIDATES), top: int = 15, trees: int = 300, threshold: float = THRESHOLD) -> list[str]:
    """The whole selection over rows with the features and ``target``: available, pruned, ranked, covered."""
    names = available(df, features)
    left = pruned([tuple(r) for r in correlations(df, names).collect()], names, threshold)
    ranked = [(r["feature"], r["importance"]) for r in importance(df, left, trees=trees).orderBy("rank").collect()]
    return covered(ranked, top)
