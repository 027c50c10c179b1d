"""Equity, risk and fitness out of trades, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

EPS = 1e-8
YEAR = 252.0


def _by_day(trades: DataFrame, by: list[str]) -> DataFrame:
    """What the trades that end on a day amount to."""
    r = F.col("net_return")
    won, lost = F.when(r > 0, r), F.when(r <= 0, r)
    return trades.groupBy(*by, F.col("exit_day").alias("day")).agg(F.sum(r).alias("pnl"), F.count("*").alias("n"), F.count(won).alias("wins"), F.sum("hold_days").alias("hold"), F.sum(won).alias("won"), F.sum(lost).alias("lost"))


def _curve(bars: DataFrame, ended: DataFrame, by: list[str], on: str) -> DataFrame:
    """``equity`` with the columns of ``ended``: (by, day, pnl) of days on which trades end, and others."""
    w = Window.partitionBy(*by).orderBy(on)
    days = bars.select(*by, on, (F.row_number().over(w) - 1).alias("day"))
    out = days.join(ended, [*by, "day"], "left").withColumn("pnl", F.coalesce("pnl", F.lit(0.0)))
    w = Window.partitionBy(*by).orderBy("day")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    # Nothing is left after a total loss, whose logarithm doesn't exist.
    lost = F.max(F.when((F.col("day") > 0) & (F.col("pnl") <= -1), 1).otherwise(0)).over(upto)
    grown = F.exp(F.sum(F.when((F.col("day") > 0) & (F.col("pnl") > -1), F.log1p("pnl")).otherwise(0.0)).over(upto))
    out = out.withColumn("equity", F.when(lost == 1, 0.0).otherwise(grown))
    out = out.withColumn("peak", F.max("equity").over(upto))
    before = F.lag("equity").over(w)
    return out.withColumns({"drawdown": (F.col("equity") - F.col("peak")) / (F.col("peak") + EPS), "ret": (F.col("equity") - before) / (before + EPS)})


def equity(bars: DataFrame, trades: DataFrame, by: list[str] = ["symbol"], on: str = "date") -> DataFrame:
    """(by, on, day, pnl, equity, peak, drawdown, ret) of every row: returns of trades compound on their exit day."""
    ended = trades.groupBy(*by, F.col("exit_day").alias("day")).agg(F.sum("net_return").alias("pnl"))
    return _curve(bars, ended, by, on).select(*by, "day", on, "pnl", "equity", "peak", "drawdown", "ret")


def metrics(bars: DataFrame, trades: DataFrame, by: list[str] = ["symbol"], on: str = "date") -> DataFrame:
    """One row for each group of bars, of one pass over its trades; all zero where there are none."""
    down, n = F.when(F.col("ret") < 0, F.col("ret")), F.sum("n")
    x = _curve(bars, _by_day(trades, by), by, on).groupBy(*by).agg(
        F.count("*").alias("n_days"), F.max_by("equity", "day").alias("last"), F.avg("ret").alias("m"), F.stddev_pop("ret").alias("sd"), F.count("ret").alias("n_ret"), F.stddev_pop(down).alias("dsd"), F.count(down).alias("n_down"), F.min("drawdown").alias("dd"),
        n.cast("int").alias("n_trades"), (F.sum("wins") / n).alias("wins"), (F.sum("hold") / n).alias("hold"), F.coalesce(F.sum("won"), F.lit(0.0)).alias("won"), F.coalesce(-F.sum("lost"), F.lit(EPS)).alias("lost"),
    )
    return _report(x, by)


def of_trades(lengths: DataFrame, trades: DataFrame, by: list[str] = ["symbol"]) -> DataFrame:
    """As ``metrics``, out of the trades and the number of rows of each group, (by, n_days): no row of a series is read.

    Equity moves on the days alone on which trades end; between them returns are zero and drawdowns stay what they were.
    So a group's window holds its trades, which are fewer than its rows. Groups without a length have no row.
    """
    w = Window.partitionBy(*by).orderBy("day")
    upto, later = w.rowsBetween(Window.unboundedPreceding, 0), F.col("day") > 0
    lost = F.max(F.when(later & (F.col("pnl") <= -1), 1).otherwise(0)).over(upto)
    grown = F.exp(F.sum(F.when(later & (F.col("pnl") > -1), F.log1p("pnl")).otherwise(0.0)).over(upto))
    out = _by_day(trades, by).withColumn("equity", F.when(lost == 1, 0.0).otherwise(grown))
    before, peak = F.coalesce(F.lag("equity").over(w), F.lit(1.0)), F.greatest(F.lit(1.0), F.max("equity").over(upto))
    out = out.withColumns({"drawdown": (F.col("equity") - peak) / (peak + EPS), "ret": F.when(later, (F.col("equity") - before) / (before + EPS))})
    down, n = F.when(F.col("ret") < 0, F.col("ret")), F.sum("n")
    out = out.groupBy(*by).agg(
        F.max_by("equity", "day").alias("last"), F.sum("ret").alias("s"), F.avg("ret").alias("mean"), F.var_pop("ret").alias("var"), F.count("ret").alias("moved"), F.stddev_pop(down).alias("dsd"), F.count(down).alias("n_down"), F.least(F.lit(0.0), F.min("drawdown")).alias("dd"),
        n.cast("int").alias("n_trades"), (F.sum("wins") / n).alias("wins"), (F.sum("hold") / n).alias("hold"), F.coalesce(F.sum("won"), F.lit(0.0)).alias("won"), F.coalesce(-F.sum("lost"), F.lit(EPS)).alias("lost"),
    )
    # The spread of days with and without a return, merged: the latter are all zero.
    n_ret, c = F.col("n_days") - 1, F.col
    spread = c("moved") * c("var") + c("mean") * c("mean") * c("moved") * F.try_divide(n_ret - c("moved"), n_ret)
    return _report(lengths.join(out, by, "left").withColumns({"n_ret": n_ret, "m": F.try_divide("s", n_ret), "sd": F.sqrt(F.try_divide(spread, n_ret))}), by)


def _report(x: DataFrame, by: list[str]) -> DataFrame:
    years, c = F.greatest(F.col("n_days") / YEAR, F.lit(EPS)), F.col
    ratio = lambda sd, n: F.when((c(n) > 1) & (c(sd) > EPS), c("m") / c(sd) * F.sqrt(F.lit(YEAR))).otherwise(0.0)
    traded = lambda v: F.when(c("n_trades") > 0, v).otherwise(0.0)
    return x.select(
        *by,
        traded((c("last") - 1) * 100).alias("total_return_pct"),
        traded((F.pow(c("last"), 1 / years) - 1) * 100).alias("annual_return_pct"),
        traded(F.when(c("n_ret") > 1, ratio("sd", "n_ret")).otherwise(0.0)).alias("sharpe_ratio"),
        traded(ratio("dsd", "n_down")).alias("sortino_ratio"),
        traded(c("dd") * 100).alias("max_drawdown_pct"),
        traded(c("wins") * 100).alias("win_rate"),
        traded(c("hold")).alias("avg_hold_days"),
        traded(c("n_trades") / years).alias("trades_per_year"),
        F.coalesce("n_trades", F.lit(0)).alias("n_trades"),
        traded(c("won") / F.greatest(c("lost"), F.lit(EPS))).alias("profit_factor"),
    )


# -- fitness

FAILED = -50.0


def single_fitness(size: Column | int) -> Column:
    """Fitness of one symbol's metrics; the weights are fixed values."""
    c = F.col
    bonus = F.when(c("trades_per_year") < 4, -1.0).when(c("trades_per_year") <= 50, 0.5).otherwise(-0.5)
    value = 3.0 * c("annual_return_pct") / 100 + 2.0 * c("sharpe_ratio") + 1.0 * c("sortino_ratio") + 1.0 * c("win_rate") / 100 - 2.0 * F.abs("max_drawdown_pct") / 100 + 0.5 * bonus - 0.02 * (F.lit(size) if isinstance(size, int) else size)
    return F.when(c("n_trades") < 2, FAILED).otherwise(value)


def portfolio_fitness(scores: DataFrame, by: list[str], score: str = "fitness") -> DataFrame:
    """Mean less 1.5 deviations of the symbols that did not fail; fewer than three of those count five each above failure."""
    valid = F.when(F.col(score) > FAILED, F.col(score))
    n = F.count(valid)
    value = F.when(n < 3, FAILED + 5.0 * n).otherwise(F.avg(valid) - 1.5 * F.stddev_pop(valid))
    return scores.groupBy(*by).agg(value.alias("fitness"), F.sum("n_trades").alias("n_trades"))


def final_fitness(train: str = "train", val: str = "val", n_train: str = "n_train") -> Column:
    """Train and validation together, less where validation falls behind."""
    t, v = F.col(train), F.col(val)
    ratio = v / (t + EPS)
    factor = F.when(t > EPS, F.when(v <= 0, 0.1).when(ratio < 0.3, 0.2).when(ratio < 0.6, 0.6).otherwise(1.0)).otherwise(0.5)
    return F.when((F.col(n_train) < 10) | (t <= -40.0), FAILED).otherwise((0.4 * t + 0.6 * v) * factor)


def generation_stats(population: DataFrame, fitness: str = "fitness") -> DataFrame:
    """Best, mean, spread and least of the fitness above -99, with counts."""
    valid = F.when(F.col(fitness) > -99, F.col(fitness))
    return population.groupBy("gen").agg(F.max(valid).alias("best"), F.avg(valid).alias("avg"), F.stddev_pop(valid).alias("std"), F.min(valid).alias("min"), F.count(valid).cast("int").alias("n_valid"), F.count("*").cast("int").alias("n_total"))


# -- reports

def trade_summary(log: DataFrame, by: list[str] = []) -> DataFrame:
    """Counts of trades, and of the closed ones win rate, mean, best, worst and total result and mean hold."""
    closed = F.col("exit_date") != "OPEN"
    pnl, hold = F.when(closed, F.col("pnl_pct")), F.when(closed, F.col("hold_days"))
    return log.groupBy(*by).agg(F.count("*").alias("n_trades"), F.count_if(~closed).alias("n_open"), F.count_if(closed).alias("n_closed"), (100 * F.avg(F.when(closed, F.when(F.col("pnl_pct") > 0, 1.0).otherwise(0.0)))).alias("win_rate"), F.avg(pnl).alias("avg_pnl"), F.max(pnl).alias("best_pnl"), F.min(pnl).alias("worst_pnl"), F.sum(pnl).alias("total_pnl"), F.avg(hold).alias("avg_hold"))


def per_symbol_summary(log: DataFrame) -> DataFrame:
    """Of closed trades only; symbols without any are left out."""
    return trade_summary(log.where(F.col("exit_date") != "OPEN"), ["symbol"]).select("symbol", "n_closed", "win_rate", "avg_pnl", "total_pnl")


def open_trades(log: DataFrame) -> DataFrame:
    return log.where(F.col("exit_date") == "OPEN").select("symbol", "direction", "entry_date", "entry_price", "exit_price", "pnl_pct", "hold_days")


def return_histogram(log: DataFrame, column: str, bins: int, low: float, high: float) -> DataFrame:
    """Counts of wins and losses in equal bins of a column; what lies beyond is in bins 0 and bins + 1."""
    return log.groupBy(F.width_bucket(column, F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col("pnl_pct") > 0).alias("wins"), F.count_if(F.col("pnl_pct") <= 0).alias("losses"))


def across_symbols(table: DataFrame, by: str) -> DataFrame:
    """Mean and deviation over symbols of the main metrics."""
    return table.groupBy(by).agg(F.count("*").alias("n_symbols"), F.sum("n_trades").alias("n_trades"), *(f(c).alias(f"{name}_{c}") for c in ("total_return_pct", "annual_return_pct", "sharpe_ratio", "max_drawdown_pct", "win_rate") for name, f in (("avg", F.avg), ("std", F.stddev_pop))))
