"""Series cut into blocks of time, so that one series is the work of many tasks.

The state machine remembers, so a block's trades depend on what it is entered with. Blocks run ahead as if they were
entered flat. Where a position comes in after all, it is run on next to the flat run until both are flat at one row: from
there they are one, and the trades of the flat run stand. A block whose end changes by that hands it to the next one.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written
from . import formula
from .backtest import TRADE, Machine, Rules

#: Rows of a block, about, and the most blocks that a table is cut into.
ROWS, MOST = 100_000, 1 << 14


def blocked(df: DataFrame, by: list[str], on: str, rows: int = ROWS, most: int = MOST) -> DataFrame:
    """The rows with the number of their block, in ``block``: stretches of about ``rows`` rows in the order (by, on).

    Written once, as ranges are drawn from a sample. A block of several series is one block for each of them.
    """
    n = max(1, min(most, -(-df.count() // rows)))
    return written(df.repartitionByRange(n, *by, on).withColumn("block", F.spark_partition_id()), "blocks")


_NAMES = [x.split()[0] for x in TRADE.split(", ")]
_STATE = [x.split()[0] for x in Machine.FIELDS.split(", ")]
_KINDS = [{"long": int, "int": int, "double": float, "boolean": bool}[x.split()[1]] for x in Machine.FIELDS.split(", ")]
_AT = ", ".join("at_" + x for x in Machine.FIELDS.split(", "))


def _along(machine: Machine, shadow: Machine | None, signal: list, close: list, regime: list, opens: list, final: bool) -> tuple[list[tuple], int]:
    """A block's trades, and the row at which the run and its ``shadow`` are both flat, where it ends, or -1."""
    found = []
    for now, price, side, open_ in zip(signal, close, regime, opens, strict=True):
        trade = machine.step(now, price, side, open_)
        if trade:
            found.append(trade)
        if shadow:
            shadow.step(now, price, side, open_)
            if not machine.side and not shadow.side:
                return found, machine.i - 1
    last = machine.end() if final else None
    return [*found, last] if last else found, -1



def trades(bars: DataFrame, by: list[str] = ["symbol"], on: str = "date", rules: Rules = Rules(), rows: int = ROWS) -> DataFrame:
    """As ``backtest.trades``, but no task holds more than a block of a series: equal trades for any length of block.

    Times of a series must differ. The driver sees a count of blocks whose entry has changed, nothing else.
    """
    columns = [*by, on, "signal", "close", "regime", *(["open"] if "open" in bars.columns else [])]
    table = blocked(bars.select(*columns), by, on, rows)
    key = [*by, "block"]
    ordered = Window.partitionBy(*by).orderBy("block")
    ends = table.groupBy(*key).agg(F.count("*").alias("n"), F.max_by("signal", on).alias("last"), F.max_by("close", on).alias("shut"))
    # Where a block begins, and the row before it: one row a block, so this is small.
    ends = ends.select(*key, (F.sum("n").over(ordered) - F.col("n")).alias("first"), F.lag("last").over(ordered).alias("before"), F.lag("shut").over(ordered).alias("shut"), F.lead("n").over(ordered).isNull().alias("final"), F.row_number().over(ordered).alias("k"))
    ends = written(ends, "ends")
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.select(*by).schema)
    schema = f"{keys}, k int, until long, {_AT}, {TRADE}"

    def run(key, pdf):
        """The block's trades from its entry, up to the row where its flat run is the same; a last row without a trade has the end."""
        pdf = pdf.sort_values(on, kind="stable")
        head = pdf.iloc[0]
        flat = (int(head["first"]), 0.0 if pd.isna(head["before"]) else float(head["before"]), 0, 0, 0.0, 0.0, 0.0, False, 0.0 if pd.isna(head["shut"]) else float(head["shut"]))
        entered = "at_i" in pdf and not pd.isna(head["at_i"])
        machine = Machine(rules, tuple(head[f"at_{c}"].item() if hasattr(head[f"at_{c}"], "item") else head[f"at_{c}"] for c in _STATE) if entered else flat)
        shadow = Machine(rules, flat) if entered else None
        if entered:
            machine.i, machine.side, machine.day = int(machine.i), int(machine.side), int(machine.day)
        opens = pdf["open"].tolist() if "open" in pdf else [None] * len(pdf)
        found, until = _along(machine, shadow, pdf["signal"].tolist(), pdf["close"].tolist(), pdf["regime"].tolist(), opens, bool(head["final"]))
        merged = until >= 0
        out = pd.DataFrame([*found, (None,) * len(_NAMES)], columns=_NAMES)
        for c, v in reversed(list(zip(_STATE, (None,) * len(_STATE) if merged else machine.state, strict=True))):
            out.insert(0, f"at_{c}", v)
        out.insert(0, "until", until if merged else None)
        out.insert(0, "k", int(head["k"]))
        for name, v in reversed(list(zip(by, key, strict=False))):
            out.insert(0, name, v)
        return out

    flat = written(table.join(ends, key).groupBy(*by, "k").applyInPandas(run, schema), "flat")
    again = lambda new: table.join(ends, key).join(new, [*by, "k"]).groupBy(*by, "k").applyInPandas(run, schema)
    return _stitched(flat, again, ends.select(*by, "k"), by)


def _stitched(flat: DataFrame, again: Callable[[DataFrame], DataFrame], places: DataFrame, by: list[str]) -> DataFrame:
    """The trades of blocks run ``flat``, mended: ``again`` runs those that are entered otherwise, given (by, k, state).

    ``places`` are all blocks there are, (keys among ``by``, k).
    """
    state = [f"at_{c}" for c in _STATE]
    is_end = F.col("direction").isNull()
    outcome = flat.where(is_end).select(*by, "k", *state)
    fixes, seen = None, None
    while True:
        # What each block is entered with: flat or not, by the latest runs.
        entry = outcome.where("at_side != 0").withColumn("k", F.col("k") + 1)
        mark = F.xxhash64(*state).alias("mark")
        new = entry if seen is None else entry.join(seen, [*by, "k"], "left").where(F.col("seen").isNull() | (F.col("seen") != F.xxhash64(*state))).drop("seen")
        gone = None if seen is None else seen.join(entry, [*by, "k"], "left_anti")
        new = written(new.join(places, places.columns, "left_semi"), "entered")
        if new.isEmpty() and (gone is None or gone.isEmpty()):
            break
        fixed = written(again(new), "fixed")
        if fixes is not None:
            fixed = written(fixes.join(new, [*by, "k"], "left_anti").join(gone.select(*by, "k"), [*by, "k"], "left_anti").unionByName(fixed), "fixes")
        fixes = fixed
        seen = written(entry.select(*by, "k", mark.alias("seen")), "seen")
        # A run that met the flat one ends as that does.
        last = fixes.where(is_end & F.col("until").isNull()).select(*by, "k", *state)
        outcome = written(last.unionByName(outcome_of(flat, is_end, by, state).join(last.select(*by, "k"), [*by, "k"], "left_anti")), "outcome")
    stands = flat.where(~is_end)
    if fixes is None:
        return stands.select(*by, *_NAMES)
    # Of a block that was entered, the flat run's trades stand that began after the row where both were flat.
    until = fixes.where(is_end).select(*by, "k", F.coalesce("until", F.lit((1 << 63) - 1)).alias("met"))
    stands = stands.join(until, [*by, "k"], "left").where(F.col("met").isNull() | (F.col("entry_day") > F.col("met")))
    return stands.select(*by, *_NAMES).unionByName(fixes.where(~is_end).select(*by, *_NAMES))


def outcome_of(flat: DataFrame, is_end, by: list[str], state: list[str]) -> DataFrame:
    return flat.where(is_end).select(*by, "k", *state)


class Laid(NamedTuple):
    """Series in blocks, written once: their rows, and a row a block with the row before it."""

    rows: DataFrame
    ends: DataFrame
    by: list[str]
    on: str
    opens: list[str]


def laid(bars: DataFrame, features: list[str], by: list[str] = ["symbol"], on: str = "date", rows: int = ROWS) -> Laid:
    """Rows (by, on, close, open, regime, features) in blocks of about ``rows``, for ``trades_of``.

    Times of a series must differ; ``open`` may be missing; rows with a null among ``by`` take no part. Other columns are not
    read; features are not called block, k, share or as the columns before them.
    """
    opens = ["open"] if "open" in bars.columns else []
    number = [F.col(c).cast("double").alias(c) for c in ("close", *opens, *features)]
    table = blocked(bars.select(*by, on, F.col("regime").cast("int").alias("regime"), *number), by, on, rows)
    key, ordered = [*by, "block"], Window.partitionBy(*by).orderBy("block")
    ends = table.groupBy(*key).agg(F.count("*").alias("n"), F.max_by(F.struct("close", *features), on).alias("last"))
    first = (F.sum("n").over(ordered) - F.col("n")).alias("first")
    before = F.lag("last").over(ordered)
    ends = ends.select(*key, "n", first, F.lead("n").over(ordered).isNull().alias("final"), F.row_number().over(ordered).alias("k"), *(before[c].alias(f"before_{c}") for c in ("close", *features)))
    ends = written(ends, "ends")
    return Laid(table.join(ends.select(*key, "k"), key), ends, by, on, opens)


def trades_of(series: Laid, shares: list[list[formula.Node]], features: list[str], rules: Rules = Rules()) -> DataFrame:
    """Trades of many formulas on the same rows: (by, form, trade) for any length of block.

    ``form`` numbers the formulas of all shares in order. Rows are sent once a share, not once a formula: a task takes a
    block of a series and evaluates a share as one graph over it and the row before it; what is mended later is a block
    with those of its formulas that hold a position as it begins.
    """
    by, on, opens = series.by, series.on, series.opens
    first = [0, *np.cumsum([len(s) for s in shares]).tolist()]
    shared = series.rows.sparkSession.sparkContext.broadcast([{a + i: str(t) for i, t in enumerate(share)} for a, share in zip(first, shares)])  # population x nodes at most
    share = F.explode(F.sequence(F.lit(0), F.lit(len(shares) - 1)))
    table = series.rows.withColumn("share", share)
    heads = written(series.ends.drop("block", "n").withColumn("share", share), "heads")
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.select(*by).schema)
    columns = [*by, "form", "k", "until", *(f"at_{c}" for c in _STATE), *_NAMES]

    def run(key, pdf, entries):
        """Each formula's trades in the block, or of those alone that ``entries`` bring in; a last row without a trade has the end."""
        out = []
        if len(pdf) and len(entries):
            pdf, head = pdf.sort_values(on, kind="stable"), entries.iloc[0]
            entered = {int(e["form"]): e for e in entries.to_dict("records") if not pd.isna(e["form"])}
            texts = {i: t for i, t in shared.value[int(key[-1])].items() if not entered or i in entered}
            numbers, before, final = list(texts), int(head["first"] > 0), bool(head["final"])
            arrays = {f: np.concatenate([[head[f"before_{f}"]] * before, pdf[f]]).astype(float) for f in features}
            close, regime = pdf["close"].tolist(), pdf["regime"].tolist()
            fills = [None if x != x else x for x in pdf["open"].tolist()] if opens else [None] * len(pdf)
            for which, signal in formula.Graph([formula.parse(t) for t in texts.values()]).signals(arrays, len(pdf) + before):
                signal = signal.tolist()
                flat = (int(head["first"]), signal[0] if before else 0.0, 0, 0, 0.0, 0.0, 0.0, False, float(head["before_close"]) if before else 0.0)
                for form in (numbers[i] for i in which):
                    state = tuple(kind(entered[form][f"at_{c}"]) for c, kind in zip(_STATE, _KINDS, strict=True)) if entered else flat
                    machine, shadow = Machine(rules, state), Machine(rules, flat) if entered else None
                    found, until = _along(machine, shadow, signal[before:], close, regime, fills, final)
                    merged = until >= 0
                    end = (*key[:-2], form, key[-2], until if merged else None, *((None,) * len(_STATE) if merged else machine.state))
                    out += [(*end, *t) for t in (*found, (None,) * len(_NAMES))]
        return pd.DataFrame(out, columns=columns)

    def work(rows: DataFrame, entries: DataFrame) -> DataFrame:
        # By number, as blocks are small in bytes but not in work: adaptive execution would put them into few tasks.
        at, n = [*by, "k", "share"], int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows, entries = rows.repartition(n, *at), entries.repartition(n, *at)
        return rows.groupBy(*at).cogroup(entries.groupBy(*at)).applyInPandas(run, f"{keys}, form int, k int, until long, {_AT}, {TRADE}")

    def again(new: DataFrame) -> DataFrame:
        at = [*by, "k", "share"]
        new = new.withColumn("share", _share_of(F.col("form"), first))
        entries = written(heads.join(new, at), "entries")
        return work(table.join(new.select(*at).distinct(), at, "left_semi"), entries)

    none = heads.select("*", F.lit(None).cast("int").alias("form"))
    return _stitched(written(work(table, none), "flat"), again, series.ends.select(*by, "k"), [*by, "form"])


def _share_of(form: Column, first: list[int]) -> Column:
    """The number of the share that a formula is in."""
    return F.size(F.filter(F.array(*map(F.lit, first[1:])), lambda x: x <= form))
