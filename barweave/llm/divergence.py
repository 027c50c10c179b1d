"""How a source's words differ from the other sources of its language: joint histograms of counts, in whole numbers.

Two sources of a language are compared term by term, but terms of equal counts contribute alike. So each pair gets a
histogram: how many terms have which two counts. The term-wise measure is then computed once for each combination.
Combinations with a zero need no rows of their own: they follow from the histograms of each source by subtraction.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import Scratch, releasing

#: Documents of a language that a kept term occurs in, at least.
MIN_DOCS = 3
#: Parts per UNIT that frequencies are expressed in, and what is added to each count.
UNIT, ALPHA = 1_000_000_000, 1
#: Terms listed for a group.
TOP = 200
#: Parts in which the terms of a group are ranked first.
PARTS = 16
#: Different terms that a task counts before it hands them on.
HELD = 1 << 19
#: Bytes of a text taken at a time.
PIECE = 1 << 20

#: Letters A-Z become lower-case; all other bytes of ASCII but a-z become blanks. Bytes of other characters stay.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BETWEEN = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")


def pieces(text: bytes):
    """The text in pieces of about ``PIECE`` bytes that end between terms."""
    at = 0
    while at < len(text):
        cut = _BETWEEN.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def _count(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of terms, counted in tasks: a group of a task may have several rows of a term."""

    def run(batches):
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def flush():
            for (lang, source), (n, d) in counts.items():
                terms = list(n)
                for a in range(0, len(terms), 1 << 15):
                    part = terms[a : a + (1 << 15)]
                    same = lambda x: pa.array([x] * len(part), pa.string())
                    yield pa.RecordBatch.from_arrays([same(lang), same(source), pa.array(part, pa.binary()), pa.array([n[t] for t in part], pa.int64()), pa.array([d[t] for t in part], pa.int64())], names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, text in zip(*(batch.column(k) for k in range(3)), strict=True):
                n, d = counts.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                before, own = len(n), set()
                for piece in pieces(text.as_py()):
                    terms = piece.translate(_TERMS).split()
                    n.update(terms)
                    own.update(terms)
                d.update(own)
                held += len(n) - before
                if held >= HELD:
                    yield from flush()
                    counts, held = {}, 0
        yield from flush()

    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    texts = docs.select(blank("lang").alias("lang"), blank("source").alias("source"), blank("text").cast("binary").alias("text"))
    found = texts.mapInArrow(releasing(run), "lang string, source string, term binary, n long, docs long")
    return found.withColumn("term", F.col("term").cast("string"))


def frequency(count: Column | str, total: Column | str, terms: Column | str) -> Column:
    """1 + floor(UNIT * (count + ALPHA) / (total + ALPHA * terms)), exact for any count that a long holds."""
    n, t, v = (F.col(x) if isinstance(x, str) else x for x in (count, total, terms))
    exact = lambda c: c.cast("decimal(20,0)")
    return 1 + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (exact(n) + exact(F.lit(ALPHA))), exact(t) + exact(ALPHA * v))


def measure(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q): at most about UNIT squared, which a long holds."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, top: int = TOP) -> DataFrame:
    """How each (lang, source) differs from each other source of its lang, and in which terms from its whole lang.

    (lang, source, part, item, value, rank). Part ``pair``: item is another source, value the sum of ``measure`` over all
    terms kept in the language, the group's frequency as p, the other's as q. Part ``term``: item is a kept term that the
    group has more often than its language, value its measure against it, ranks up to ``top``. Ranks count from 1 by value
    descending, then by item in the order of its bytes.

    Null text, lang and source are read as empty; the empty name is a language and a source like others. A group without
    terms counts nothing, and differs from others by that; in a language that keeps no terms all values are 0, and a group
    that is alone in its language has no pairs. Repeated rows count each. An empty table has no rows; doc_id and other
    columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    counts = _count(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    counts = counts.select("lang", "source", "term", "n", F.sum("docs").over(of_term).alias("docs"), F.sum("n").over(of_term).alias("lang_n"))
    kept = scratch.save(counts.where(F.col("docs") >= MIN_DOCS).select("lang", "source", "term", "n", "lang_n"), "kept")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    every = docs.select(blank("lang").alias("lang"), blank("source").alias("source")).distinct()
    langs = kept.groupBy("lang", "term").agg(F.max("lang_n").alias("n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = every.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "v", "lang_total"])
    groups = scratch.save(groups, "groups")
    pairs, terms = _pairs(kept, groups, scratch), _terms(kept, groups, top)
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def _pairs(kept: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    two = lambda df, k, *names: df.select(*names, *(F.col(c).alias(f"{c}{k}") for c in df.columns if c not in names))
    cells = kept.select("lang", "source", "term", "n")
    # Terms that both have: counted before the shuffle, so what moves are combinations of counts, not terms.
    both = two(cells, 1, "lang", "term").join(two(cells, 2, "lang", "term"), ["lang", "term"]).where("source1 < source2")
    both = scratch.save(both.groupBy("lang", "source1", "source2", "n1", "n2").agg(F.count("*").alias("m")), "both")
    own = scratch.save(kept.groupBy("lang", "source", "n").agg(F.count("*").alias("m")), "own")
    pair = scratch.save(two(groups.drop("lang_total", "v"), 1, "lang").join(two(groups.drop("lang_total"), 2, "lang"), "lang").where("source1 < source2").withColumnRenamed("v2", "v"), "pairs")
    # Zeros by inclusion and exclusion: all terms, less those that one has, plus those that both have.
    m, n1, n2, none = F.col("m"), F.col("n1"), F.col("n2"), F.lit(0).cast("long")
    cell = lambda a, b, c: F.struct(a.alias("n1"), b.alias("n2"), c.alias("m"))
    names = ["lang", "source1", "source2"]
    spread = lambda df, *cs: df.select(*names, F.inline(F.array(*cs)))
    found = spread(both, cell(n1, n2, m), cell(n1, none, -m), cell(none, n2, -m), cell(none, none, m))
    n = F.col("n")
    for k, ends in ((1, (cell(n, none, m), cell(none, none, -m))), (2, (cell(none, n, m), cell(none, none, -m)))):
        found = found.union(spread(pair.join(own.withColumnRenamed("source", f"source{k}"), ["lang", f"source{k}"]), *ends))
    found = found.union(pair.select(*names, none, none, F.col("v")))
    found = found.groupBy(*names, "n1", "n2").agg(F.sum("m").alias("m")).where("m > 0").join(pair, names)
    p, q = frequency("n1", "total1", "v"), frequency("n2", "total2", "v")
    found = found.select(*names, "m", p.alias("p"), q.alias("q"))
    sums = [F.sum(measure(F.col(a), F.col(b)).cast("decimal(38,0)") * F.col("m")).cast("long").alias(x) for a, b, x in (("p", "q", "there"), ("q", "p", "back"))]
    sums = pair.select(names).join(found.groupBy(*names).agg(*sums), names, "left").na.fill(0, ["there", "back"])
    one = lambda a, b, value: F.struct(F.col(a).alias("source"), F.col(b).alias("item"), F.col(value).alias("value"))
    out = sums.select("lang", F.inline(F.array(one("source1", "source2", "there"), one("source2", "source1", "back"))))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return out.select("*", F.lit("pair").alias("part"), F.row_number().over(order).alias("rank"))


def _terms(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    found = kept.join(groups, ["lang", "source"])
    found = found.select("lang", "source", F.col("term").alias("item"), frequency("n", "total", "v").alias("p"), frequency("lang_n", "lang_total", "v").alias("q"))
    found = found.where("p > q").select("lang", "source", "item", measure(F.col("p"), F.col("q")).alias("value"))
    # A group may have any number of terms: the best of each of its parts first.
    order = lambda *by: F.row_number().over(Window.partitionBy("lang", "source", *by).orderBy(F.desc("value"), "item"))
    found = found.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(PARTS))).withColumn("rank", order("part")).where(F.col("rank") <= top)
    found = found.drop("part", "rank").withColumn("rank", order()).where(F.col("rank") <= top)
    return found.withColumn("part", F.lit("term"))
