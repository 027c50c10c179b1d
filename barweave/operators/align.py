"""Alignment in time: as-of, exact with fills, nearest; splits and sanitising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


#: Width of a stretch of times that are plain numbers.
NUMBERS = 4096


def asof(left: DataFrame, right: DataFrame, on: str, value: str, out: str, forward: bool = False) -> DataFrame:
    """Left rows with the value of the latest right row that is not later; right (an index) has one row for each time.

    With ``forward`` of the earliest that is not earlier. The times of both sides become one stream along which the last
    value is carried, one row for each distinct time: within each month first (or ``NUMBERS`` numbers, if times are
    those), then over the ends of months, of which there are a few hundred. An equality join brings the values back, so neither side is joined by range or copied to each
    symbol. Where the right value is null, an older one counts.
    """
    times = left.select(on).distinct().withColumn("__v", F.lit(None).cast(right.schema[value].dataType))
    stream = times.unionByName(right.select(F.col(on), F.col(value).alias("__v"))).groupBy(on).agg(F.first("__v", ignorenulls=True).alias("__v"))
    dated = stream.schema[on].dataType.typeName() in ("date", "timestamp", "timestamp_ntz")
    stream = stream.withColumn("__month", F.date_trunc("month", on) if dated else F.floor(F.col(on) / NUMBERS))
    order = lambda c: F.desc(c) if forward else F.asc(c)
    within = Window.partitionBy("__month").orderBy(order(on)).rowsBetween(Window.unboundedPreceding, 0)
    last = F.min_by("__v", on) if forward else F.max_by("__v", on)
    ends = stream.where(F.col("__v").isNotNull()).groupBy("__month").agg(last.alias("__end"))
    ends = stream.select("__month").distinct().join(ends, "__month", "left")
    before = Window.orderBy(order("__month")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("__month", F.last("__end", ignorenulls=True).over(before).alias("__end"))
    values = stream.withColumn("__v", F.last("__v", ignorenulls=True).over(within)).join(ends, "__month")
    values = values.select(F.col(on).alias("__on"), F.coalesce("__v", "__end").alias(out))
    return left.join(values, left[on] == F.col("__on"), "left").drop("__on")


def exact_filled(left: DataFrame, right: DataFrame, on: str, value: str, out: str, by: list[str] = ["symbol"]) -> DataFrame:
    """Left rows with the right value of the same time, carried forward, then backward where there is none before."""
    keyed = right.select(F.col(on).alias("__on"), F.col(value).alias(out))
    joined = left.join(keyed, left[on] == F.col("__on"), "left").drop("__on")
    return filled(joined, out, on, by)


def filled(df: DataFrame, column: str, on: str, by: list[str] | None) -> DataFrame:
    """Nulls take the value before, else the one after; ``by`` None fills across groups in one order.

    Both ways each row is looked at once: the value after is the last one in the order backwards.
    """
    def carried(way) -> Column:
        order = [way(c) for c in ((on,) if by else ("symbol", on))]
        w = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return F.last(column, ignorenulls=True).over(w)

    return df.withColumn(column, F.coalesce(carried(F.asc), carried(F.desc)))


def gated(df: DataFrame, column: str, least: float = 0.8, by: str = "symbol") -> DataFrame:
    """The column where at least this share of a group's rows has it, else zero throughout."""
    share = F.count(column).over(Window.partitionBy(by)) / F.count("*").over(Window.partitionBy(by))
    return df.withColumn(column, F.when(share >= least, F.col(column)).otherwise(0.0))


def nearest(left: DataFrame, right: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """Each left row with the right row nearest in time, the earlier one on ties; of several of one time, the least."""
    others = [c for c in left.columns if c != on]
    found = right.groupBy(on).agg(F.min(F.struct(on, *columns)).alias("__r"))
    both = asof(asof(left, found, on, "__r", "__before"), found, on, "__r", "__after", forward=True)
    apart = lambda r: F.abs(F.unix_seconds(F.col(f"{r}.{on}").cast("timestamp")) - F.unix_seconds(F.col(on).cast("timestamp")))
    nearer = F.when(F.col("__after").isNull() | (apart("__before") <= apart("__after")), F.col("__before")).otherwise(F.col("__after"))
    return both.withColumn("__r", nearer).where(F.col("__r").isNotNull()).select(F.col(on).alias("asked"), *others, "__r.*")


def split(on: Column, train_end: str, val_start: str, val_end: str, test_start: str, val_end_included: bool = False) -> Column:
    """train, val, test or null by date; the validation's end is excluded unless asked for."""
    day = lambda s: F.lit(s).cast("date")
    before_end = on <= day(val_end) if val_end_included else on < day(val_end)
    return F.when(on <= day(train_end), "train").when((on >= day(val_start)) & before_end, "val").when(on >= day(test_start), "test")


def between(df: DataFrame, on: str, start: str, end: str) -> DataFrame:
    """Rows from start on, before end."""
    return df.where((F.col(on) >= F.lit(start).cast("date")) & (F.col(on) < F.lit(end).cast("date")))


def sanitised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null, NaN and infinite values become zero."""
    return df.withColumns({c: F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(F.col(c)) for c in columns})
