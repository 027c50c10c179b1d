"""Mixing sources to target weights by entropy balancing.

Of all rates between 0 and 2 copies that give every source its target of words, entropy balancing takes those nearest to
one copy each. Its dual is convex with one multiplier for each source, and a document's rate is its exponential tilt
2 / (1 + exp(-multiplier x size)): exponential odds of the rate against the bound. Newton steps run as one aggregate
over all sources at a time; rates depend on source and size alone, so the aggregate reads the counts of those.

Rates become copies by systematic rounding along documents ordered by size, and a few documents of a source then change
by a copy where that brings its words nearer to the target.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD_JAVA, Scratch, small, tell_apart

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, CAP = 1.5, 2.0
STEPS, REPAIRS, CELL_ROWS = 60, 6, 1000
#: Bits of a size that its band leaves out.
BAND = 8


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> dict[str | None, float]:
    """Share out ``share`` x all words by weight; a target stops at ``cap`` x its source, the excess goes to the others."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-8", "surrogatepass")))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, open_ = {}, set(order)
    left = share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in sorted(open_, key=order.index))
        full = [s for s in order if s in open_ and weight[s] * level > cap * sizes[s]]
        if not full:
            out |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            out[s] = cap * float(sizes[s])
            left -= out[s]
        open_ -= set(full)
    return out


def _rate(size: Column, theta: Column, scale: Column) -> Column:
    return F.when(theta >= 1e6, F.lit(CAP)).otherwise(F.lit(CAP) / (1 + F.exp(-F.least(F.lit(500.0), F.greatest(F.lit(-500.0), theta * size / scale)))))


def number_rows(docs: DataFrame, name: str, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents with a hash of their own in the column ``name``, of id, text and source; repeats of all three are numbered."""
    key = F.xxhash64(F.col(id_col), F.col(text_col).cast("string"), F.col(source_col).cast("string"), F.lit(8))
    return tell_apart(docs.withColumn(name, key), name, lambda h, k: F.xxhash64(h, k), scratch)


def _running(cells: DataFrame, keys: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """The cells with the sum of ``value`` over those before them among equal ``keys``."""
    by = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn(name, F.coalesce(F.sum(value).over(by), F.lit(0.0)))


def _same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys that may be null, with one column of each key."""
    named = b.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [a[k].eqNullSafe(named[f"_{k}"]) for k in keys]
    return a.join(named, on, how).drop(*(f"_{k}" for k in keys))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, row_col: str | None = None) -> DataFrame:
    """A row for each document: id, row, source, size, source_size, target, copies, taken.

    A null or empty text has size 0 and one copy of nothing; null sources are one source, the last; repeated rows count
    each for itself, equal ones in any order; null ids take part like others. Ties go to the smaller hash of the row, so
    reruns agree. ``row`` is that hash, or the column ``row_col`` of ``number_rows``, and tells all rows apart. The driver
    holds one line for each source; an empty table has no rows; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    if row_col is None:
        row_col = "mix_row"
        docs = number_rows(docs.select(id_col, text_col, source_col), row_col, scratch, id_col, text_col, source_col)
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD_JAVA)), F.lit(0)).cast("long")
    rows = scratch.save(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.col(row_col).alias("order")), "sizes")
    cells = scratch.save(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    per = {r["source"]: r for r in cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("size"), F.sum(F.col("n") * F.col("size").cast("double") * F.col("size")).alias("square")).collect()}
    sizes = {s: int(r["size"]) for s, r in per.items()}
    goal = targets(sizes, weights, share)
    theta, low, high = {}, {}, {}
    scale = {s: max(1.0, r["square"] / r["size"]) if r["size"] else 1.0 for s, r in per.items()}
    for s in sizes:
        theta[s], low[s], high[s] = 0.0, -1e5, 1e5
        if goal[s] >= CAP * sizes[s] * (1 - 1e-12):
            theta[s] = 1e6  # the bound itself: two copies of all
    schema = "source string, theta double, scale double, goal double, source_size long"

    def state() -> DataFrame:
        return small(spark.createDataFrame([(s, theta[s], scale[s], goal[s], sizes[s]) for s in theta], schema), len(theta))

    def with_state(df: DataFrame) -> DataFrame:
        s = state().withColumnRenamed("source", "__s")
        return df.join(s, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")

    open_ = {s for s in sizes if theta[s] < 1e6}
    for _ in range(STEPS):
        if not open_:
            break
        rate, x = _rate(F.col("size"), F.col("theta"), F.col("scale")), F.col("size") / F.col("scale")
        words = F.sum(F.col("n") * rate * F.col("size")).alias("words")
        slope = F.sum(F.col("n") * rate * (1 - rate / CAP) * x * F.col("size")).alias("slope")
        for r in with_state(cells).groupBy("source").agg(words, slope).collect():
            s = r["source"]
            if s not in open_:
                continue
            off = r["words"] - goal[s]
            if abs(off) <= 1e-9 * max(1.0, goal[s]):
                open_.discard(s)
                continue
            low[s], high[s] = (low[s], theta[s]) if off > 0 else (theta[s], high[s])
            step = theta[s] - off / r["slope"] if r["slope"] > 0 else math.inf
            # Outside the bracket: halve it, on a scale of its size while an end is far.
            theta[s] = step if low[s] < step < high[s] else (low[s] + high[s]) / 2
            if high[s] - low[s] < 1e-13 * max(1.0, abs(theta[s])):
                open_.discard(s)
    # Sums of doubles differ in their last digits from run to run; the multipliers that count don't.
    theta = {s: round(t, 10) for s, t in theta.items()}

    # Systematic rounding: the running sum of rates along a source, long documents first; documents of equal size follow
    # their hash. A cell of one size is cut by hash into parts of about CELL_ROWS, so that no task orders a large one.
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / CELL_ROWS)).cast("int").alias("parts")
    ready = with_state(cells).select("source", "size", parts, _rate(F.col("size"), F.col("theta"), F.col("scale")).alias("rate"), "goal", "source_size")
    rated = rows.alias("r").join(ready.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.size") == F.col("c.size"))).select("r.id", "r.source", "r.size", "r.order", "c.parts", "c.rate", "c.goal", "c.source_size")
    rated = scratch.save(rated.withColumn("part", F.pmod(F.shiftright("order", 20), F.col("parts"))).drop("parts"), "rates")
    # Sums before a block, in three steps: bands of sizes in a source, sizes in a band, blocks of a size.
    sized = ready.join(cells.select(F.col("source").alias("cs"), F.col("size").alias("cz"), "n"), F.col("source").eqNullSafe(F.col("cs")) & (F.col("size") == F.col("cz")))
    sized = sized.select("source", "size", (F.col("n") * F.col("rate")).alias("sum"), F.shiftright("size", BAND).alias("band"))
    bands = _running(sized.groupBy("source", "band").agg(F.sum("sum").alias("sum")), ["source"], [F.desc("band")], F.col("sum"), "before_band").drop("sum")
    sized = _running(_same(sized, bands, ["source", "band"]), ["source", "band"], [F.desc("size")], F.col("sum"), "before_size").select("source", "size", (F.col("before_band") + F.col("before_size")).alias("before_size"))
    blocks = rated.groupBy("source", "size", "part").agg((F.count("*") * F.first("rate")).alias("sum"))
    blocks = _same(_running(blocks, ["source", "size"], [F.col("part")], F.col("sum"), "before_part"), sized, ["source", "size"])
    blocks = blocks.select(F.col("source").alias("bs"), F.col("size").alias("bz"), F.col("part").alias("bp"), (F.col("before_size") + F.col("before_part")).alias("before"))
    number = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("order", "id"))
    placed = rated.withColumn("k", number)
    placed = placed.join(blocks, F.col("source").eqNullSafe(F.col("bs")) & (F.col("size") == F.col("bz")) & (F.col("part") == F.col("bp"))).drop("bs", "bz", "bp")
    # Rounded to millionths, so that a sum of whole rates is whole.
    upto = lambda k: F.floor(F.round(F.col("before") + k * F.col("rate"), 6) + 0.5)
    placed = placed.withColumn("copies", F.least(F.lit(int(CAP)), F.greatest(F.lit(0), upto(F.col("k")) - upto(F.col("k") - 1))).cast("int"))
    placed = scratch.save(placed.select("id", "source", "size", "order", "k", "part", "copies", "goal", "source_size"), "copies")

    # Repairs: of each source, the document whose copy more or less brings its words nearest to the target.
    fixes: dict[tuple, int] = {}
    taken = {r["source"]: r["taken"] for r in placed.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken")).collect()}
    for _ in range(REPAIRS):
        gaps = [(s, float(goal[s] - taken[s])) for s in taken if abs(goal[s] - taken[s]) >= 1]
        if not gaps:
            break
        gap = small(spark.createDataFrame(gaps, "gs string, gap double"), len(gaps))
        near = placed.join(gap, F.col("source").eqNullSafe(F.col("gs"))).where((F.col("size") > 0) & F.when(F.col("gap") > 0, F.col("copies") < CAP).otherwise(F.col("copies") > 0))
        if fixes:
            done = small(spark.createDataFrame([(*k, v) for k, v in fixes.items()], "fs string, fz long, fp long, fk int, fix int"), len(fixes))
            near = near.join(done, F.col("source").eqNullSafe(F.col("fs")) & (F.col("size") == F.col("fz")) & (F.col("part") == F.col("fp")) & (F.col("k") == F.col("fk")), "left_anti")
        left = F.abs(F.abs(F.col("gap")) - F.col("size"))
        best = near.groupBy("source").agg(F.min(F.struct(left.alias("left"), "size", "part", "k")).alias("b"), F.first("gap").alias("gap"))
        changed = False
        for r in best.collect():
            b = r["b"]
            if b["left"] < abs(r["gap"]):
                step = 1 if r["gap"] > 0 else -1
                fixes[(r["source"], b["size"], b["part"], b["k"])] = step
                taken[r["source"]] += step * b["size"]
                changed = True
        if not changed:
            break
    if fixes:
        done = small(spark.createDataFrame([(*k, v) for k, v in fixes.items()], "fs string, fz long, fp long, fk int, fix int"), len(fixes))
        placed = placed.join(done, F.col("source").eqNullSafe(F.col("fs")) & (F.col("size") == F.col("fz")) & (F.col("part") == F.col("fp")) & (F.col("k") == F.col("fk")), "left")
        placed = placed.withColumn("copies", F.col("copies") + F.coalesce("fix", F.lit(0)))
    return placed.select(F.col("id").alias(id_col), F.col("order").alias("row"), "source", "size", "source_size", F.col("goal").alias("target"), "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
