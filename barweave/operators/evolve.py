"""Evolution of formulas: the population lives on the driver, its evaluation is one Spark job a generation.

The data are prepared once: one row for each (symbol, split) with its series as arrays. A generation's job sends the
population, which is bounded by its size times the nodes of a tree, to these rows, and each evaluates its share of the
formulas as one graph, so that what formulas have in common is computed once. Known formulas, or such as differ from
them only in the order of commutative arguments, are not evaluated again. A checkpoint holds all that the search knows,
so that it goes on from there as if it had not stopped.
"""

from __future__ import annotations

import json
import random
import time
import uuid
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..config import Config
from ..session import shared_folder
from . import backtest, blocks, formula, metrics
from .formula import CONSTANTS, OPS, Node


#: Shares of a population, each of them a task on each series.
CHUNKS = 8


def constant(rng: random.Random) -> Node:
    return Node(f"{rng.uniform(-1, 1):.4f}")


def grow(rng: random.Random, features: list[str], low: int, high: int, full: bool) -> Node:
    """A random tree whose leaves lie between two depths, or all at one."""
    depth = rng.randint(low, high)

    def make(d: int) -> Node:
        leaves = len(features) + len(CONSTANTS) + 1
        if d == depth or (not full and d >= low and rng.random() < leaves / (leaves + len(OPS))):
            k = rng.randrange(leaves)
            return Node(features[k]) if k < len(features) else Node(list(CONSTANTS)[k - len(features)]) if k < leaves - 1 else constant(rng)
        name = rng.choice(list(OPS))
        return Node(name, tuple(make(d + 1) for _ in range(OPS[name].arity)))

    return make(0)


def ramped(rng: random.Random, features: list[str], config: Config) -> Node:
    return grow(rng, features, config.min_depth, config.max_depth, rng.random() < 0.5)


def _fits(tree: Node, config: Config) -> bool:
    return tree.size() <= config.max_nodes and tree.height() <= config.max_depth


def crossover(rng: random.Random, a: Node, b: Node, config: Config) -> tuple[Node, Node]:
    """Two trees with a subtree exchanged; a child that is too large gives way to its parent."""
    if a.size() < 2 or b.size() < 2:
        return a, b
    i, j = rng.randrange(1, a.size()), rng.randrange(1, b.size())
    x, y = list(a.nodes())[i], list(b.nodes())[j]
    c, d = a.replaced(i, y), b.replaced(j, x)
    return c if _fits(c, config) else a, d if _fits(d, config) else b


def mutate(rng: random.Random, a: Node, features: list[str], config: Config) -> Node:
    """A tree with a random subtree in place of one of its own."""
    c = a.replaced(rng.randrange(a.size()), grow(rng, features, 0, 2, True))
    return c if _fits(c, config) else a


def tournament(rng: random.Random, ranked: list[tuple[Node, float]], size: int) -> Node:
    return max((rng.choice(ranked) for _ in range(size)), key=lambda p: p[1])[0]


def breed(rng: random.Random, ranked: list[tuple[Node, float]], best: list[Node], features: list[str], config: Config) -> list[Node]:
    """The next generation: the elite as it is, then children."""
    out = list(best[: config.elite])
    while len(out) < config.population:
        u = rng.random()
        a = tournament(rng, ranked, config.tournament)
        if u < config.crossover:
            out += crossover(rng, a, tournament(rng, ranked, config.tournament), config)
        else:
            out.append(mutate(rng, a, features, config) if u < config.crossover + config.mutation else a)
    return out[: config.population]


@dataclass
class EarlyStop:
    patience: int
    min_delta: float
    best: float = float("-inf")
    since: int = 0

    def update(self, fitness: float) -> bool:
        """True when the best has not risen by more than min_delta for ``patience`` generations."""
        if fitness > self.best + self.min_delta:
            self.best, self.since = fitness, 0
        else:
            self.since += 1
        return self.since >= self.patience


def prepare(data: DataFrame, features: list[str]) -> DataFrame:
    """One row for each (symbol, split) of rows (symbol, split, date, open, close, regime, features), written once."""
    columns = ["open", "close", *features]
    row = F.struct("date", *(F.col(c).cast("double").alias(c) for c in columns), F.col("regime").cast("int").alias("regime"))
    series = data.where(F.col("split").isin("train", "val")).groupBy("symbol", "split").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    series = series.select("symbol", "split", *(F.col(f"rows.{c}").alias(c) for c in (*columns, "regime")))
    path = f"{shared_folder(data.sparkSession)}/series-{uuid.uuid4().hex}"
    series.write.parquet(path)
    return data.sparkSession.read.parquet(path)


def dealt(trees: list[Node], chunks: int = CHUNKS) -> list[list[Node]]:
    """Distinct formulas in about equal shares; neighbours in order of their normal form are together, as they have more in common."""
    distinct = sorted({str(t): t for t in trees}.values(), key=lambda t: (str(formula.normal(t)), str(t)))
    chunks = min(chunks, len(distinct)) or 1
    at = [len(distinct) * k // chunks for k in range(chunks + 1)]
    return [distinct[a:b] for a, b in zip(at, at[1:])]


def evaluate(series: DataFrame, trees: list[Node], features: list[str], chunks: int = CHUNKS, rules: backtest.Rules = backtest.Rules()) -> DataFrame:
    """(tree, fitness) of formulas over the series of ``prepare``; errors surface."""
    spark = series.sparkSession
    shares = dealt(trees, chunks)
    shared = spark.sparkContext.broadcast([[str(t) for t in share] for share in shares])  # population x nodes at most
    names = [x.split()[0] for x in backtest.TRADE.split(", ")]
    chunks = len(shares)

    def run(frames):
        for frame in frames:
            for x in frame.to_dict("records"):
                arrays = {f: np.asarray(x[f], float) for f in features}
                close, opens, regime = (np.asarray(x[c]) for c in ("close", "open", "regime"))
                out, texts = [], shared.value[x["chunk"]]
                trees = [formula.parse(t) for t in texts]
                for which, signal in formula.Graph(trees).signals(arrays, len(close)):
                    found = summary(backtest.run(signal, close, regime, opens, rules), len(close), names)
                    out += [(x["symbol"], x["split"], texts[i], trees[i].size(), *found) for i in which]
                yield pd.DataFrame(out, columns=["symbol", "split", "tree", "size", *METRICS])

    work = series.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).repartition("symbol", "split", "chunk")
    scored = work.mapInPandas(run, "symbol string, split string, tree string, size int, " + ", ".join(f"{m} {'int' if m == 'n_trades' else 'double'}" for m in METRICS))
    return _fitness(scored, "tree")


def _fitness(scored: DataFrame, key: str) -> DataFrame:
    """(key, fitness) out of metrics by symbol and split, with the ``size`` of each formula."""
    scored = scored.withColumn("fitness", metrics.single_fitness(F.col("size")))
    by_split = metrics.portfolio_fitness(scored, [key, "split"])
    both = by_split.groupBy(key).pivot("split", ["train", "val"]).agg(F.first("fitness").alias("f"), F.first("n_trades").alias("n"))
    both = both.select(key, F.coalesce("train_f", F.lit(metrics.FAILED)).alias("train"), F.coalesce("val_f", F.lit(metrics.FAILED)).alias("val"), F.coalesce("train_n", F.lit(0)).alias("n_train"))
    return both.select(key, metrics.final_fitness().alias("fitness"))


def prepare_blocks(data: DataFrame, features: list[str], rows: int = blocks.ROWS) -> blocks.Laid:
    """The same rows in blocks of time of about ``rows``, written once, for series longer than a task; none without a symbol."""
    return blocks.laid(data.where("symbol IS NOT NULL AND split IN ('train', 'val')"), features, ["symbol", "split"], rows=rows)


def evaluate_blocks(series: blocks.Laid, trees: list[Node], features: list[str], chunks: int = 1, rules: backtest.Rules = backtest.Rules()) -> DataFrame:
    """(tree, fitness) as ``evaluate`` has it, over the blocks of ``prepare_blocks``.

    No task holds more than a block of a series with a share of the formulas, nor a window more than a series' trades
    under one formula. Formulas equal up to order are evaluated once. Blocks are shares of the work by themselves, so one
    of the population is enough unless there are fewer blocks than tasks.
    """
    spark = series.rows.sparkSession
    if not trees:
        return spark.createDataFrame([], "tree string, fitness double")
    shares = dealt([formula.normal(t) for t in trees], chunks)
    forms = [t for share in shares for t in share]
    number = {str(t): i for i, t in enumerate(forms)}
    named = F.broadcast(spark.createDataFrame([(t, number[str(formula.normal(tree))]) for t, tree in {str(t): t for t in trees}.items()], "tree string, form int"))  # a population
    sized = F.broadcast(spark.createDataFrame([(i, t.size()) for i, t in enumerate(forms)], "form int, size int"))
    found = blocks.trades_of(series, shares, features, rules)
    lengths = series.ends.groupBy(*series.by).agg(F.sum("n").alias("n_days")).withColumn("form", F.explode(F.sequence(F.lit(0), F.lit(len(forms) - 1))))
    scored = metrics.of_trades(lengths, found, [*series.by, "form"]).join(sized, "form")
    return _fitness(scored, "form").join(named, "form").select("tree", "fitness")


METRICS = ("annual_return_pct", "sharpe_ratio", "sortino_ratio", "max_drawdown_pct", "win_rate", "trades_per_year", "n_trades")


def summary(found: list[tuple], n: int, names: list[str]) -> tuple:
    """The metrics of one series' trades, as ``metrics.metrics`` has them."""
    if not found:
        return 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0
    eps, years = metrics.EPS, max(n / metrics.YEAR, metrics.EPS)
    gain = np.array([t[names.index("net_return")] for t in found])
    pnl = np.zeros(n)
    np.add.at(pnl, [t[names.index("exit_day")] for t in found], gain)
    pnl[0] = 0
    equity = np.cumprod(1 + pnl)
    ret = np.diff(equity) / (equity[:-1] + eps)
    down = ret[ret < 0]
    ratio = lambda r, of: float(ret.mean() / r.std() * np.sqrt(metrics.YEAR)) if len(r) > 1 and r.std() > eps else 0.0
    peak = np.maximum.accumulate(equity)
    return float((equity[-1] ** (1 / years) - 1) * 100), ratio(ret, ret), ratio(down, ret), float(((equity - peak) / (peak + eps)).min() * 100), float((gain > 0).mean() * 100), len(found) / years, len(found)


@dataclass
class Result:
    best: list[tuple[Node, float]]
    stats: list[dict] = field(default_factory=list)


#: Generations from one checkpoint to the next, and clones of a saved model that a population starts with.
SAVED, CLONES = 5, 10


def evolve(data: DataFrame, features: list[str], config: Config, seeds: list[str] = (), hall: int = 10, checkpoint: str | None = None, resume: bool = False, model: str | None = None, every: int | None = None, rows: int | None = None) -> Result:
    """Search over rows (symbol, split, date, open, close, regime, features); statistics of each generation come along.

    Among them are the ``nodes`` of the formulas evaluated, and how many of them the graphs leave to be ``evaluated``.

    A population starts with the ``seeds``, then a saved ``model`` and ``CLONES`` mutated clones of it; seeds that name
    unknown features raise. A ``checkpoint`` folder gets all of the search ``every`` so many generations (``SAVED``); with ``resume`` it
    goes on from the last of them, if there is one, with the same result as without a stop. With ``rows`` series are
    evaluated in blocks of about so many, for such as are longer than a task.
    """
    config.validate()
    rng = random.Random(config.seed)
    spark, known, stop, result, begin = data.sparkSession, {}, EarlyStop(config.patience, config.min_delta), Result([]), 0
    saved = load(spark, checkpoint) if resume and checkpoint else None
    if saved:
        begin, ranked, known, stop, result = saved["gen"] + 1, saved["ranked"], saved["known"], saved["stop"], saved["result"]
        rng.setstate(saved["rng"])
        if stop.since >= stop.patience or begin >= config.generations:
            return Result(result.best[:hall], result.stats)
        population = breed(rng, ranked, [t for t, _ in result.best], features, config)
    else:
        first = [formula.parse(s, set(features)) for s in seeds]
        if model is not None:
            tree = formula.parse(model, set(features))
            first += [tree, *seeded(rng, tree, CLONES, features, config)]
        population = first[: config.population]
        population += [ramped(rng, features, config) for _ in range(config.population - len(population))]
    series = prepare_blocks(data, features, rows) if rows else prepare(data, features)
    score = evaluate_blocks if rows else evaluate
    for gen in range(begin, config.generations):
        began = time.time()
        forms = {t: str(formula.normal(t)) for t in population}
        new = [t for t in population if forms[t] not in known]
        shares = dealt(new, 1 if rows else CHUNKS)
        if new:
            found = {r["tree"]: r["fitness"] for r in score(series, new, features).collect()}
            known |= {forms[t]: found[str(t)] for t in new}
        ranked = [(t, known[forms[t]]) for t in population]
        best = {str(t): (t, f) for t, f in [*result.best, *ranked]}
        result.best = sorted(best.values(), key=lambda p: (-p[1], str(p[0])))[: max(hall, config.elite)]
        values = np.array([f for _, f in ranked if f > -99])
        result.stats.append({"gen": gen, "best": float(values.max()), "avg": float(values.mean()), "std": float(values.std()), "min": float(values.min()), "n_valid": len(values), "n_total": len(ranked), "nodes": sum(t.size() for share in shares for t in share), "evaluated": sum(len(formula.Graph(share)) for share in shares), "elapsed_s": time.time() - began})
        ends = stop.update(result.best[0][1])
        if checkpoint and (gen + 1) % (every or SAVED) == 0:
            save(spark, checkpoint, gen, ranked, known, stop, result, rng)
        if ends:
            break
        if gen + 1 < config.generations:
            population = breed(rng, ranked, [t for t, _ in result.best], features, config)
    result.best = result.best[:hall]
    return result


def save(spark, path: str, gen: int, ranked: list[tuple[Node, float]], known: dict[str, float], stop: EarlyStop, result: Result, rng: random.Random) -> None:
    """All of a search after a generation; the state comes last, so a folder with one is whole."""
    place = f"{path}/gen={gen:06d}"
    order = [(i, str(t), float(f)) for i, (t, f) in enumerate(ranked)]
    spark.createDataFrame(order, "at int, tree string, fitness double").coalesce(1).write.mode("overwrite").parquet(f"{place}/population")
    spark.createDataFrame(list(known.items()), "tree string, fitness double").coalesce(1).write.mode("overwrite").parquet(f"{place}/known")
    state = {"gen": gen, "stop": asdict(stop), "stats": result.stats, "best": [(str(t), f) for t, f in result.best], "rng": rng.getstate()}
    spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").text(f"{place}/state")


def load(spark, path: str) -> dict | None:
    """What ``save`` wrote last, or None."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/gen=*/state/_SUCCESS"))
    if not done:
        return None
    place = max(f.getPath().getParent().getParent().toString() for f in done)
    state = json.loads(spark.read.text(f"{place}/state").first()[0])
    version, numbers, gauss = state["rng"]
    ranked = [(formula.parse(r["tree"]), r["fitness"]) for r in spark.read.parquet(f"{place}/population").orderBy("at").collect()]
    known = {r["tree"]: r["fitness"] for r in spark.read.parquet(f"{place}/known").collect()}
    result = Result([(formula.parse(t), f) for t, f in state["best"]], state["stats"])
    return {"gen": state["gen"], "ranked": ranked, "known": known, "stop": EarlyStop(**state["stop"]), "result": result, "rng": (version, tuple(numbers), gauss)}


def seeded(rng: random.Random, model: Node, n: int, features: list[str], config: Config) -> list[Node]:
    """A saved formula's clones, mutated, to start a population with."""
    return [mutate(rng, model, features, config) for _ in range(n)]
