"""A hidden Markov model with Gaussian states, by Baum and Welch, over blocks of time.

A row is a matrix of moves times densities, and a stretch of rows the product of theirs: with sums of products for
probabilities, with largest sums for the likeliest path. Tasks multiply up their blocks; the driver runs along the blocks'
products, a few numbers each, and so knows what every block is entered with from both sides; then tasks go over their
rows. So no task holds a series. ``fit`` is the same for one that fits in memory.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, replace
from operator import mul

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, functions as F

from ..session import written
from .blocks import blocked
from .regimes import STATES


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    means: np.ndarray
    covs: np.ndarray
    history: list[float]

    def _density(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.means)))
        for k, (m, c) in enumerate(zip(self.means, self.covs, strict=True)):
            root = np.linalg.cholesky(c)
            z = np.linalg.solve(root, (x - m).T)
            out[:, k] = -0.5 * ((z**2).sum(axis=0) + x.shape[1] * np.log(2 * np.pi)) - np.log(np.diag(root)).sum()
        return out

    def _passes(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Log probabilities up to and after each row, and of all: each row is scaled to one, and the scales are kept."""
        top = b.max(axis=1)
        e = np.exp(b - top[:, None]).tolist()
        into, out_of = self.move.T.tolist(), self.move.tolist()  # plain numbers: states are few, rows many
        now, f, scale = [p * x for p, x in zip(self.start.tolist(), e[0], strict=True)], [], []
        for t, row in enumerate(e):
            if t:
                now = [sum(map(mul, f[-1], ways)) * x for ways, x in zip(into, row, strict=True)]
            scale.append(sum(now) or 1e-300)
            f.append([x / scale[-1] for x in now])
        g = [[1.0] * len(self.means)]
        for t in range(len(e) - 2, -1, -1):
            ahead = [x * y / scale[t + 1] for x, y in zip(e[t + 1], g[-1], strict=True)]
            g.append([sum(map(mul, ways, ahead)) for ways in out_of])
        f, g, scale = np.array(f), np.array(g[::-1]), np.array(scale)
        upto = np.cumsum(np.log(scale) + top)
        total = float(upto[-1])
        with np.errstate(divide="ignore"):
            return np.log(f) + upto[:, None], np.log(g) + (total - upto)[:, None], total

    def posterior(self, x: np.ndarray) -> np.ndarray:
        f, g, total = self._passes(self._density(x))
        p = np.exp(f + g - total)
        return p / p.sum(axis=1, keepdims=True)

    def path(self, x: np.ndarray) -> np.ndarray:
        """The likeliest sequence of states (Viterbi)."""
        b, log_move = self._density(x), np.log(self.move + 1e-300)
        best, back = np.log(self.start + 1e-300) + b[0], np.zeros(b.shape, dtype=int)
        for t in range(1, len(b)):
            ways = best[:, None] + log_move
            back[t] = ways.argmax(axis=0)
            best = ways.max(axis=0) + b[t]
        out = [int(best.argmax())]
        for t in range(len(b) - 1, 0, -1):
            out.append(int(back[t, out[-1]]))
        return np.array(out[::-1])

    def as_dict(self) -> dict:
        return {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in asdict(self).items()}


def begin(centres: np.ndarray, wide: np.ndarray, floor: float) -> Hmm:
    """The model before the first step: states that stay, of the width of all rows."""
    states, d = centres.shape
    h = Hmm(np.full(states, 1 / states), np.full((states, states), 0.1 / max(1, states - 1)), centres, np.stack([wide + floor * np.eye(d)] * states), [])
    np.fill_diagonal(h.move, 0.9)
    h.move /= h.move.sum(axis=1, keepdims=True)
    return h


def fit(x: np.ndarray, states: int = 4, steps: int = 2000, tol: float = 1e-4, floor: float = 1e-3, seed: int = 42) -> Hmm:
    """EM from means spread out by distance; covariances are full, with a floor on their diagonal."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    if n < states:
        raise ValueError(f"{n} rows for {states} states")
    centres = [x[rng.integers(n)]]
    while len(centres) < states:
        far = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(x[rng.choice(n, p=far / far.sum())] if far.sum() > 0 else x[rng.integers(n)])
    for _ in range(20):
        near = np.argmin([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres = [x[near == k].mean(axis=0) if (near == k).any() else centres[k] for k in range(states)]
    h = begin(np.array(centres), np.atleast_2d(np.cov(x.T, bias=True)), floor)
    for _ in range(steps):
        b = h._density(x)
        f, g, total = h._passes(b)
        h.history.append(total)
        if len(h.history) > 1 and total - h.history[-2] < tol:
            break
        p = np.exp(f + g - total)
        p /= p.sum(axis=1, keepdims=True)
        pair = np.exp(f[:-1, :, None] + np.log(h.move + 1e-300)[None] + (b[1:] + g[1:])[:, None, :] - total).sum(axis=0)
        h.start, h.move = p[0], pair / np.maximum(pair.sum(axis=1, keepdims=True), 1e-300)
        weight = np.maximum(p.sum(axis=0), 1e-12)
        h.means = (p.T @ x) / weight[:, None]
        h.covs = np.stack([((x - m) * p[:, [k]]).T @ (x - m) / weight[k] + floor * np.eye(d) for k, m in enumerate(h.means)])
    return h


def names(mean: np.ndarray, vol: int, drawdown: int) -> list[str]:
    """States by their means: the deepest drawdown is the crisis, then by volatility."""
    order = list(range(len(mean)))
    out = [""] * len(mean)
    worst = min(order, key=lambda k: mean[k, drawdown])
    order.remove(worst)
    out[worst] = "crisis"
    order.sort(key=lambda k: mean[k, vol])
    for k, name in zip(order, ("bull_quiet", "sideways_bear", "volatile"), strict=True):
        out[k] = name
    return out


FEATURES = ("ret_1d", "ret_5d", "vol_5d", "vol_20d", "trend", "drawdown")


#: Rows below which a history is too short for a model: its rows get no state.
SHORT = 60
#: Rows of a block, about, and the most blocks of a series: the driver holds a few numbers for each.
ROWS, MOST = 256, 4096
#: Rows that are worth a task of their own: a step's jobs are short.
TASK_ROWS = 1024


# -- one block: products of its rows, then the rows themselves


def product(h: Hmm, b: np.ndarray, first: bool) -> tuple[np.ndarray, float]:
    """The product of a block's rows, scaled, and the logarithm of its scale; the series' first row has no move into it."""
    top = b.max(axis=1)
    m = h.move[None] * np.exp(b - top[:, None])[:, None, :]
    if first:
        m[0] = np.diag(np.exp(b[0] - top[0]))
    scale = float(top.sum())
    while len(m) > 1:  # pairs, pairs of pairs, ...: rows in order, all of a level at once
        pairs = m[: len(m) // 2 * 2 : 2] @ m[1::2]
        m = np.concatenate([pairs, m[len(m) // 2 * 2 :]])
        size = np.maximum(m.max(axis=(1, 2)), 1e-300)
        m /= size[:, None, None]
        scale += float(np.log(size).sum())
    return m[0], scale


def widest(h: Hmm, b: np.ndarray, first: bool) -> np.ndarray:
    """The weights of the likeliest ways through a block, from each state before it to each at its end."""
    m = np.log(h.move + 1e-300)[None] + b[:, None, :]
    if first:
        m[0] = np.where(np.eye(len(h.start), dtype=bool), b[0], -np.inf)
    while len(m) > 1:
        pairs = (m[: len(m) // 2 * 2 : 2][:, :, :, None] + m[1::2][:, None, :, :]).max(axis=2)
        m = np.concatenate([pairs, m[len(m) // 2 * 2 :]])
    return m[0]


def along(h: Hmm, b: np.ndarray, before: np.ndarray, after: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Each row's probabilities of states, and the expected moves, of a block between what is known before and after it."""
    e = np.exp(b - b.max(axis=1, keepdims=True))
    f, g, now = np.empty_like(e), np.empty_like(e), before
    for t, row in enumerate(e):
        now = (now if first and not t else now @ h.move) * row
        now = now / max(now.sum(), 1e-300)
        f[t] = now
    g[-1] = after
    for t in range(len(e) - 1, 0, -1):
        back = h.move @ (e[t] * g[t])
        g[t - 1] = back / max(back.max(), 1e-300)
    p = f * g
    p /= np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
    into = np.concatenate([before[None], f[:-1]])[int(first) :]
    pair = into[:, :, None] * h.move[None] * (e * g)[int(first) :, None, :]
    return p, (pair / np.maximum(pair.sum(axis=(1, 2), keepdims=True), 1e-300)).sum(axis=0)


def likeliest(h: Hmm, b: np.ndarray, before: np.ndarray, end: int, first: bool) -> np.ndarray:
    """The likeliest states of a block's rows, from the weights before it to a known state at its end."""
    log_move, back = np.log(h.move + 1e-300), np.zeros(b.shape, dtype=int)
    best = before
    for t, row in enumerate(b):
        if first and not t:
            best = before + row
            continue
        ways = best[:, None] + log_move
        back[t], best = ways.argmax(axis=0), ways.max(axis=0) + row
    out = [end]
    for t in range(len(b) - 1, 0, -1):
        out.append(int(back[t, out[-1]]))
    return np.array(out[::-1])


# -- all blocks


@dataclass
class Series:
    """One series in blocks: (place, rows scaled) by task, their table, and what the features were scaled by."""

    table: DataFrame
    blocks: RDD
    n: int
    mean: np.ndarray
    sd: np.ndarray

    def sums(self, f) -> np.ndarray | None:
        """The sum over all blocks of an array that ``f(place, rows)`` makes: tasks add up theirs first."""
        part = lambda rows: [s for s in [sum(f(k, x) for k, x in rows)] if not isinstance(s, int)]
        return sum(self.blocks.mapPartitions(part).collect())

    def each(self, f) -> list:
        """What ``f(place, rows)`` makes of each block, in their order."""
        return [v for _, v in sorted(self.blocks.map(lambda r: (r[0], f(*r))).collect(), key=lambda r: r[0])]


def series(df: DataFrame, on: str, rows: int = ROWS, most: int = MOST) -> Series | None:
    """A table of one series cut into blocks, or nothing if it is too short."""
    stats = [s(c).alias(f"{k}_{c}") for c in FEATURES for k, s in (("m", F.avg), ("s", F.stddev_pop))]
    one = df.agg(F.count("*").alias("n"), *stats).first()
    if one["n"] < SHORT:
        return None
    mean, sd = (np.array([one[f"{k}_{c}"] for c in FEATURES]) for k in "ms")
    sd = np.where(sd == 0, 1, sd)
    table = blocked(df, [], on, rows, most)
    x = F.array(*((F.col(c) - float(m)) / float(d) for c, m, d in zip(FEATURES, mean, sd, strict=True)))
    packed = table.groupBy("block").agg(F.array_sort(F.collect_list(F.struct(F.col(on).alias("on"), x.alias("x")))).alias("rows")).select("block", F.col("rows.x").alias("x"))
    packed = written(packed, "blocks")
    order = {k: i for i, k in enumerate(sorted(r[0] for r in packed.select("block").collect()))}
    tasks = max(1, min(len(order), df.sparkSession.sparkContext.defaultParallelism, -(-one["n"] // TASK_ROWS)))
    blocks = packed.repartitionByRange(tasks, "block").rdd.map(lambda r: (order[r[0]], np.array(r[1], float))).persist(StorageLevel.MEMORY_AND_DISK)
    return Series(table, blocks, one["n"], mean, sd)


def spread(s: Series, states: int, seed: int) -> np.ndarray:
    """Means spread out by distance, then moved to their nearest rows' means twenty times."""
    rng = np.random.default_rng(seed)
    sizes = np.array(s.each(lambda k, x: len(x)))

    def row(i: int) -> np.ndarray:
        k = int(np.searchsorted(np.cumsum(sizes), i, side="right"))
        at = i - int(sizes[:k].sum())
        return s.blocks.filter(lambda r: r[0] == k).map(lambda r: r[1][at]).first()

    centres = [row(int(rng.integers(s.n)))]
    while len(centres) < states:
        far = lambda x: np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
        parts = np.array(s.each(lambda k, x: far(x).sum()))
        if parts.sum() <= 0:
            centres.append(row(int(rng.integers(s.n))))
            continue
        u = rng.random() * parts.sum()
        k = min(int(np.searchsorted(np.cumsum(parts), u, side="right")), len(parts) - 1)
        left = u - parts[:k].sum()
        pick = lambda x: x[min(int(np.searchsorted(np.cumsum(far(x)), left, side="right")), len(x) - 1)]
        centres.append(s.blocks.filter(lambda r: r[0] == k).map(lambda r: pick(r[1])).first())
    centres = np.array(centres)
    for _ in range(20):
        def near(k, x, c=centres):
            hit = np.eye(len(c))[np.argmin([((x - y) ** 2).sum(axis=1) for y in c], axis=0)]
            return np.concatenate([hit.sum(axis=0)[:, None], hit.T @ x], axis=1)

        total = s.sums(near)
        new = np.where(total[:, :1] > 0, total[:, 1:] / np.maximum(total[:, :1], 1), centres)
        if (new == centres).all():
            break
        centres = new
    return centres


@dataclass
class Expected:
    """What one pass over the rows finds under a model."""

    total: float
    start: np.ndarray
    weight: np.ndarray
    first: np.ndarray
    second: np.ndarray
    moves: np.ndarray


def borders(s: Series, h: Hmm) -> tuple[list[np.ndarray], list[np.ndarray], float]:
    """What each block is entered with from before and from after, scaled, and the likelihood of all rows: by prefix products."""
    found = s.each(lambda k, x: product(h, h._density(x), k == 0))
    before, total, now = [], 0.0, h.start
    for m, scale in found:
        before.append(now)
        now = now @ m
        size = max(now.sum(), 1e-300)
        now, total = now / size, total + scale + math.log(size)
    after, now = [], np.ones(len(h.start))
    for m, _ in reversed(found):
        after.append(now)
        now = m @ now
        now = now / max(now.max(), 1e-300)
    return before, after[::-1], total


def expected(s: Series, h: Hmm) -> Expected:
    before, after, total = borders(s, h)
    states, d = h.means.shape

    def part(k, x):
        p, pair = along(h, h._density(x), before[k], after[k], k == 0)
        start = p[0] if k == 0 else np.zeros(states)
        second = np.stack([(x * p[:, [i]]).T @ x for i in range(states)])
        return np.concatenate([start, p.sum(axis=0), (p.T @ x).ravel(), second.ravel(), pair.ravel()])

    got = s.sums(part)
    ends = np.cumsum([states, states, states * d, states * d * d])
    start, weight, first, second, moves = np.split(got, ends)
    return Expected(total, start, weight, first.reshape(states, d), second.reshape(states, d, d), moves.reshape(states, states))


def fit_blocks(s: Series, h: Hmm, steps: int = 2000, tol: float = 1e-4, floor: float = 1e-3) -> tuple[Hmm, Expected]:
    """The steps of ``fit`` from a given model, two jobs each; and what the last pass found."""
    d = h.means.shape[1]
    h, e = replace(h, history=[]), None
    for _ in range(steps):
        e = expected(s, h)
        h.history.append(e.total)
        if len(h.history) > 1 and e.total - h.history[-2] < tol:
            return h, e
        weight = np.maximum(e.weight, 1e-12)
        means = e.first / weight[:, None]
        covs = np.stack([e.second[k] / weight[k] - np.outer(m, m) * (e.weight[k] / weight[k]) + floor * np.eye(d) for k, m in enumerate(means)])
        h = Hmm(e.start, e.moves / np.maximum(e.moves.sum(axis=1, keepdims=True), 1e-300), means, covs, h.history)
    return h, expected(s, h)


@dataclass
class Fitted:
    """A model of one series: its places in STATES, and the sums it was read from."""

    symbol: str
    series: Series
    model: Hmm
    sums: Expected
    column: list[int]


def fitted(df: DataFrame, on: str = "date", steps: int = 2000, seed: int = 42, rows: int = ROWS) -> list[Fitted]:
    """Models of one or more indices with the columns of ``state_features``, each by itself; short histories have none."""
    out = []
    for (symbol,) in sorted(df.select("symbol").distinct().collect()):
        own = series(df.where(F.col("symbol") == symbol), on, rows)
        if own is None:
            continue
        d = len(FEATURES)
        centres = spread(own, len(STATES), seed)
        second = own.sums(lambda k, x: x.T @ x) / own.n
        middle = own.sums(lambda k, x: x.sum(axis=0)) / own.n
        model, sums = fit_blocks(own, begin(centres, second - np.outer(middle, middle), 1e-3), steps)
        mean = sums.first / np.maximum(sums.weight, 1e-12)[:, None] * own.sd + own.mean
        name = names(mean, FEATURES.index("vol_20d"), FEATURES.index("drawdown"))
        out.append(Fitted(symbol, own, model, sums, [STATES.index(x) for x in name]))
    return out


def _states(f: Fitted, on: str, keep: list[str]) -> DataFrame:
    """The rows of a series with the likeliest path and the probabilities of states, block by block."""
    s, h = f.series, f.model
    before, after, _ = borders(s, h)
    ways = s.each(lambda k, x: widest(h, h._density(x), k == 0))
    best = [np.log(h.start + 1e-300)]
    for m in ways:
        best.append((best[-1][:, None] + m).max(axis=0))
    ends = [int(best[-1].argmax())]
    for k in range(len(ways) - 1, 0, -1):
        ends.append(int((best[k] + ways[k][:, ends[-1]]).argmax()))
    ends = ends[::-1]
    spark = s.table.sparkSession
    order = sorted(r[0] for r in s.table.select("block").distinct().collect())
    sides = [(block, k, before[k].tolist(), after[k].tolist(), best[k].tolist(), ends[k]) for k, block in enumerate(order)]
    sides = spark.createDataFrame(sides, "block int, place int, before array<double>, after array<double>, best array<double>, last int")
    schema = ", ".join(f"{c.name} {c.dataType.simpleString()}" for c in s.table.select(keep).schema) + ", state int, regime string, " + ", ".join(f"prob_{x} double" for x in STATES)
    mean, sd, column = s.mean, s.sd, f.column

    def rows(pdf):
        pdf = pdf.sort_values(on, kind="stable")
        one = pdf.iloc[0]
        b, first = h._density((pdf[list(FEATURES)].to_numpy(float) - mean) / sd), one["place"] == 0
        p, _ = along(h, b, np.array(one["before"]), np.array(one["after"]), first)
        path = likeliest(h, b, np.array(one["best"]), int(one["last"]), first)
        out = pdf[keep].copy()
        out["state"] = np.array(column)[path]
        out["regime"] = [STATES[k].upper() for k in out["state"]]
        for c, x in enumerate(STATES):
            out[f"prob_{x}"] = p[:, column.index(c)]
        return out

    return s.table.join(sides, "block").groupBy("block").applyInPandas(rows, schema)


def detect(df: DataFrame, on: str = "date", models: list[Fitted] | None = None) -> DataFrame:
    """Of one or more indices with the columns of ``state_features``: state, regime, probabilities.

    ``models`` are those of ``fitted``, if there are already. Histories of less than ``SHORT`` rows have null in all of them.
    """
    models = fitted(df, on) if models is None else models
    keep = ["symbol", on, "close", "ret_1d", "ret_20d", "vol_20d", "drawdown"]
    short = df.where(~F.col("symbol").isin([f.symbol for f in models])) if models else df
    out = short.select(*keep, F.lit(None).cast("int").alias("state"), F.lit(None).cast("string").alias("regime"), *(F.lit(None).cast("double").alias(f"prob_{x}") for x in STATES))
    for f in models:
        out = out.unionByName(_states(f, on, keep))
    return out


def transitions(df: DataFrame, on: str = "date", models: list[Fitted] | None = None) -> DataFrame:
    """The models of ``detect``: (symbol, state, next_state, probability, share, and the state's mean of each feature).

    ``share`` is the state's part of all days, by their probabilities. Histories that are too short have no rows.
    """
    rows = []
    for f in fitted(df, on) if models is None else models:
        mean = f.sums.first / np.maximum(f.sums.weight, 1e-12)[:, None] * f.series.sd + f.series.mean
        for i, a in enumerate(f.column):
            rows += [(f.symbol, STATES[a], STATES[b], float(f.model.move[i, j]), float(f.sums.weight[i] / f.series.n), *map(float, mean[i])) for j, b in enumerate(f.column)]
    schema = "symbol string, state string, next_state string, probability double, share double, " + ", ".join(f"mean_{f} double" for f in FEATURES)
    return df.sparkSession.createDataFrame(rows, schema)
