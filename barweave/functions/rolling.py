"""Rolling columns over the rows of a symbol: null until a frame has as many non-null values as it has rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

EPS = 1e-9
BY, ON = "symbol", "date"


def rows(n: int, on: str = ON) -> WindowSpec:
    """The last n rows."""
    return Window.partitionBy(BY).orderBy(on).rowsBetween(1 - n, 0)


def along(on: str = ON) -> WindowSpec:
    return Window.partitionBy(BY).orderBy(on)


def roll(agg, x: str, n: int, on: str = ON) -> Column:
    w = rows(n, on)
    return F.when(F.count(x).over(w) == n, agg(F.col(x)).over(w))


def with_extremes(df: DataFrame, wanted: dict[str, tuple[str, str, int]], on: str = ON) -> DataFrame:
    """Columns ``{name: ("max" or "min", column, rows)}`` of the last rows, as by ``roll``; each row is looked at a fixed
    number of times, however long the frame.

    A frame of n rows reaches over one border of blocks of n rows at most: its extreme is that of the end of the block
    before and of the start of its own. Best for long frames: each length costs two sorts within symbols.
    """
    w, temporary = along(on), []

    def add(name: str, column: Column) -> str:
        nonlocal df
        df = df.withColumn(name, column)
        temporary.append(name)
        return name

    row = add("__row", F.row_number().over(w))
    upto = {x: add(f"__n_{x}", F.count(x).over(w.rowsBetween(Window.unboundedPreceding, 0))) for x in dict.fromkeys(x for _, x, _ in wanted.values())}
    for n in dict.fromkeys(n for _, _, n in wanted.values()):
        block = add(f"__block_{n}", F.floor((F.col(row) - 1) / n))
        for way, order in (("start", F.asc(row)), ("end", F.desc(row))):
            frame = Window.partitionBy(BY, block).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
            for name, (kind, x, m) in wanted.items():
                if m == n:
                    add(f"__{way}_{name}", (F.max if kind == "max" else F.min)(x).over(frame))
    out = {}
    for name, (kind, x, n) in wanted.items():
        full = F.col(upto[x]) - F.coalesce(F.lag(upto[x], n).over(w), F.lit(0)) == n
        ends = F.lag(f"__end_{name}", n - 1).over(w), F.col(f"__start_{name}")
        out[name] = F.when(full, (F.greatest if kind == "max" else F.least)(*ends))
    return df.withColumns(out).drop(*temporary)


def mean(x: str, n: int, on: str = ON) -> Column:
    return roll(F.avg, x, n, on)


def std(x: str, n: int, on: str = ON) -> Column:
    return roll(F.stddev_samp, x, n, on)


def change(x: str, k: int, on: str = ON) -> Column:
    """x against x of k rows before, less one; null where that is zero."""
    return F.try_divide(F.col(x), F.lag(x, k).over(along(on))) - 1


def rsi(gain: str, loss: str, n: int, on: str = ON) -> Column:
    """Relative strength by simple means of gains and losses, between 0 and 1."""
    ratio = mean(gain, n, on) / (mean(loss, n, on) + EPS)
    return (100 - 100 / (1 + ratio)) / 100


def smooth(x: str, n: int, on: str = ON) -> Column:
    """Mean of the last n rows, or of as many as there are."""
    return F.avg(x).over(rows(n, on))


def with_ema(df: DataFrame, x: str, spans: dict[str, int], adjust: bool = True, on: str = ON) -> DataFrame:
    """Exponential means of a column without nulls, in time linear in the rows.

    Rows come in blocks so long that a block's weight in the one after next is below double precision. Within a block a
    running sum of values over falling weights gives the mean's numerator; the block before adds one number.
    """
    n = F.row_number().over(along(on)) - 1
    df = df.withColumn("__n", n)
    if not adjust:
        df = df.withColumn("__x0", F.first(x).over(along(on).rowsBetween(Window.unboundedPreceding, 0)))
    for name, span in spans.items():
        alpha = 2.0 / (span + 1)
        q = 1 - alpha
        block = math.ceil(38 / -math.log(q))
        k = F.pmod(F.col("__n"), F.lit(block))
        df = df.withColumn("__b", F.floor(F.col("__n") / block)).withColumn("__k", k).withColumn("__w", F.col(x) * F.pow(F.lit(q), -F.col("__k")))
        own = F.sum("__w").over(Window.partitionBy(BY, "__b").orderBy("__n").rowsBetween(Window.unboundedPreceding, 0))
        before = F.coalesce(F.sum("__w").over(Window.partitionBy(BY).orderBy("__b").rangeBetween(-1, -1)), F.lit(0.0))
        top = F.pow(F.lit(q), F.col("__k")) * own + F.pow(F.lit(q), F.col("__k") + block) * before
        if adjust:
            df = df.withColumn(name, top * alpha / (1 - F.pow(F.lit(q), F.col("__n") + 1)))
        else:
            df = df.withColumn(name, alpha * top + (1 - alpha) * F.pow(F.lit(q), F.col("__n")) * F.col("__x0"))
    return df.drop("__n", "__x0", "__b", "__k", "__w")
