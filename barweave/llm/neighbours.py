"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are turned, projected and shifted in several ways, and each way orders them along a Hilbert curve: a range
partitioning in Spark. A query meets the rows within a window on both sides of its place on every curve; the windows are
merged and ranked by the exact cosine. Equal vectors are one class, so copies neither fill a window nor are lost.

The window is fitted: a sample of queries is answered exactly, and the window is the least that would have held the
wanted share of their neighbours. Vectors with structure get small windows; for vectors without any, no index helps, and
the window becomes a share of the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import Scratch, partitions

#: Curves, dimensions and bits of each, and the share of the range by which a curve may be shifted.
CURVES, DIMS, BITS, SHIFT = 16, 6, 5, 0.3
#: Vectors that ranges are fitted on, queries that windows are fitted on, about, and the recall that these should have.
FIT_ROWS, FIT_QUERIES, FIT_RECALL = 4000, 100, 0.96
LEAST_WINDOW = 64
#: Rows of a block of a curve, and queries that meet a block together.
BLOCK, ASKED = 4096, 1024


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows), by the transposition of Skilling's method."""
    x = x.astype(np.int64).copy()
    d = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            on = (x[:, i] & q) > 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(on, p, swap)
            if i:
                x[:, i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[:, d - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


class Curves:
    """Projections, ranges and shifts; fitted on a bounded sample, used on every vector."""

    def __init__(self, sample: np.ndarray, curves: int = CURVES):
        rng = np.random.default_rng(29)
        n = sample.shape[1]
        d = min(DIMS, n)
        unit = _unit(sample)
        self.ways = []
        for _ in range(curves):
            turn = np.linalg.qr(rng.standard_normal((n, n)))[0][:, :d]
            low, high = np.quantile(unit @ turn, [0.001, 0.999], axis=0)
            self.ways.append((turn, low, np.maximum(high - low, 1e-12) / (1 - SHIFT), rng.random(d) * SHIFT))

    def keys(self, x: np.ndarray) -> list[np.ndarray]:
        unit, top = _unit(x), (1 << BITS) - 1
        return [hilbert(np.clip(((unit @ turn - low) / span + shift) * (top + 1), 0, top).astype(np.int64), BITS) for turn, low, span, shift in self.ways]


def _unit(x: np.ndarray) -> np.ndarray:
    # Scaled by the largest component first, so that squares neither overflow nor vanish.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, with the same result wherever a pair is met."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float64).reshape(len(column), -1)


def _top(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int):
    """For each query the places of its k best rows: all within rounding of the k best by one product, then by the pair's own cosine."""
    rough = _unit(queries) @ _unit(rows).T
    n, size = rough.shape[1], rows.shape[1]
    m = min(k, n)
    least = np.partition(rough, n - m, axis=1)[:, n - m] - (1e-12 + size * 1e-15)
    at, best = np.nonzero(rough >= least[:, None])
    step = max(1, (1 << 22) // size)  # many rows may tie
    exact = np.concatenate([cosines(queries[at[i : i + step]], rows[best[i : i + step]]) for i in range(0, len(at), step)])
    order = np.lexsort((ids[best], -exact, at))
    at, best, exact = at[order], best[order], exact[order]
    keep = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[keep], best[keep], exact[keep]


def _classes(vectors: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """(rep, ids, vec): equal vectors with their least id and their k + 1 least ids."""
    usable = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable)

    def least(batches):
        """Each batch's classes with their least ids: what is grouped after has a line for a class and batch."""
        for batch in batches:
            seen: dict[bytes, list[int]] = {}
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.setdefault((np.array(v) + 0.0).tobytes(), []).append(i)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([sorted(set(ids))[: k + 1] for ids in seen.values()], pa.list_(pa.int64()))], names=["vec", "ids"])

    part = rows.mapInArrow(least, "vec binary, ids array<long>")
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1)
    return part.groupBy("vec").agg(ids.alias("ids")).select(F.element_at("ids", 1).alias("rep"), "ids", "vec")


def search(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", fit_recall: float = FIT_RECALL) -> DataFrame:
    """The k nearest other rows of each query found: (query_id, rank, vec_id, score), ties to the smaller id.

    ``is_query`` is a condition on ``id_col``. Vectors that are null, zero, or hold null or non-finite components take
    no part, nor do rows without an id. Vectors of different lengths are searched apart, each length for itself. Rows that
    repeat an id with the same vector count once; with another vector, each for itself. Copies of a query are found, itself
    not. With fewer than k candidates all are returned; an empty table has no result. Other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    classes = scratch.save(_classes(vectors, id_col, vector_col, k), "classes")
    # A class has an index of its own: with repeated ids, several classes can share their least id.
    classes = classes.withColumn("cls", F.xxhash64("vec"))
    # Queries are classes too: all ids of a class have the same neighbours.
    asked = vectors.select(F.col(id_col).cast("long").alias(id_col), F.col(vector_col).cast("array<double>").alias("v")).where(is_query & F.col("v").isNotNull()).distinct()

    def keyed(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            vecs = [(np.array(v, dtype=np.float64) + 0.0).tobytes() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vecs, pa.binary())], names=["query_id", "qvec"])

    asked = asked.where(F.forall("v", lambda x: x.isNotNull())).mapInArrow(keyed, "query_id long, qvec binary").withColumn("cls", F.xxhash64("qvec"))
    asked = scratch.save(asked.join(classes.select("cls", "vec"), "cls").where(F.col("qvec") == F.col("vec")).select("query_id", "cls", F.length("vec").alias("length")), "asked")
    out = none
    for r in asked.select("length").distinct().orderBy("length").collect():  # the lengths that vectors have: one, as a rule
        mine = asked.where(F.col("length") == r["length"]).select("query_id", "cls")
        found = _search(classes.where(F.length("vec") == r["length"]), mine, k, fit_recall, scratch)
        out = found if out is none else out.unionByName(found)
    return out


def _search(classes: DataFrame, asked: DataFrame, k: int, fit_recall: float, scratch: Scratch) -> DataFrame:
    """``search`` among vectors of one length: classes (cls, rep, ids, vec) and queries (query_id, cls)."""
    spark = classes.sparkSession
    n = classes.count()
    share = lambda salt, want, of: F.pmod(F.xxhash64("vec", F.lit(salt)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, want / max(1, of)))
    sample = sorted(bytes(r["vec"]) for r in classes.where(share("fit", FIT_ROWS, n)).select("vec").collect()) or [bytes(classes.first()["vec"])]
    curves = Curves(_matrix(sample))
    queries = asked.select("cls").distinct().withColumn("query", F.lit(True))

    def lines(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                m = part.num_rows
                keys = curves.keys(_matrix(part.column("vec").to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(keys), dtype=np.int32), m)), pa.array(np.concatenate(keys)), *(pa.concat_arrays([part.column(c)] * len(keys)) for c in ("cls", "rep", "query", "vec"))], names=["curve", "key", "cls", "rep", "query", "vec"])

    schema = "curve int, key long, cls long, rep long, query boolean, vec binary"
    line = classes.join(queries, "cls", "left").select("cls", "rep", F.coalesce("query", F.lit(False)).alias("query"), "vec").mapInArrow(lines, schema)

    def placed(batches):
        from pyspark import TaskContext

        pid, at = TaskContext.get().partitionId(), {}
        for batch in batches:
            curve = np.asarray(batch.column(0))
            place = np.empty(len(curve), dtype=np.int64)
            for c in np.unique(curve):
                mine = curve == c
                place[mine] = at.get(c, 0) + np.arange(mine.sum())
                at[c] = at.get(c, 0) + int(mine.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(curve), pid, np.int32)), pa.array(place)], names=[*batch.schema.names, "pid", "place"])

    ordered = line.repartitionByRange(partitions(spark), "curve", "key", "cls").sortWithinPartitions("curve", "key", "cls").mapInArrow(placed, f"{schema}, pid int, place long")
    ordered = scratch.save(ordered, "curves")
    # The driver holds one number for each curve and partition.
    sizes = sorted((r["curve"], r["pid"], r["n"]) for r in ordered.groupBy("curve", "pid").agg(F.count("*").alias("n")).collect())
    before, last, at = [], None, 0
    for curve, pid, m in sizes:
        at = at if curve == last else 0
        before.append((curve, pid, at))
        last, at = curve, at + m
    start = F.broadcast(spark.createDataFrame(before, "curve int, pid int, start long"))
    ranked = ordered.join(start, ["curve", "pid"]).withColumn("place", F.col("start") + F.col("place")).drop("start", "pid")

    window = _fit_window(classes.join(queries, "cls"), classes, ranked, n, k, fit_recall)
    # Every query visits the blocks that its window touches. A block's queries come in parts, each with its copy of the rows.
    low, high = F.floor(F.greatest(F.lit(0), F.col("place") - window) / BLOCK), F.floor(F.least(F.lit(n - 1), F.col("place") + window) / BLOCK)
    visits = ranked.where("query").select("curve", F.explode(F.sequence(low, high)).alias("block"), "cls", "vec")
    parts = visits.groupBy("curve", "block").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("parts"))
    visits = visits.join(parts, ["curve", "block"]).withColumn("part", F.pmod(F.xxhash64("cls"), "parts").cast("int")).drop("parts")
    blocks = ranked.withColumn("block", F.floor(F.col("place") / BLOCK)).join(parts, ["curve", "block"])
    blocks = blocks.select(F.col("curve").alias("on_curve"), F.col("block").alias("in_block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("in_part"), F.col("cls").alias("cls_"), F.col("rep").alias("rep_"), F.col("vec").alias("vec_"))

    def meet(q, rows):
        import pandas as pd

        empty = pd.DataFrame({"cls": np.zeros(0, np.int64), "found": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(q) or not len(rows):
            return empty
        x, ids, classes_ = _matrix(rows["vec_"].tolist()), rows["rep_"].to_numpy(), rows["cls_"].to_numpy()
        out = []
        for a in range(0, len(q), 256):
            part = q.iloc[a : a + 256]
            of, place, score = _top(_matrix(part["vec"].tolist()), x, ids, k + 1)
            out.append(pd.DataFrame({"cls": part["cls"].to_numpy()[of], "found": classes_[place], "score": score}))
        return pd.concat(out)

    met = visits.groupBy("curve", "block", "part").cogroup(blocks.groupBy("on_curve", "in_block", "in_part")).applyInPandas(meet, "cls long, found long, score double")
    best = met.groupBy("cls", "found").agg(F.max("score").alias("score"))
    best = best.join(classes.select(F.col("cls").alias("found"), "rep", "ids"), "found")
    # A class's members tie, so its k + 1 least ids are enough.
    order = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("score"), "rep", "found"))
    best = best.withColumn("order", order).where(F.col("order") <= k + 1).select("cls", "score", F.explode("ids").alias("vec_id"))
    pairs = asked.join(best, "cls").where(F.col("query_id") != F.col("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query_id", "cls").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _fit_window(queries: DataFrame, classes: DataFrame, ranked: DataFrame, n: int, k: int, recall: float) -> int:
    """Rows on each side of a query that hold the wanted share of the true neighbours of a sample of queries."""
    total = queries.count()
    draw = F.pmod(F.xxhash64("vec", F.lit("queries")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, FIT_QUERIES / max(1, total)))
    sample = sorted((r["cls"], bytes(r["vec"])) for r in queries.where(draw).select("cls", "vec").collect())
    if not sample:
        return LEAST_WINDOW
    own, asked = np.array([c for c, _ in sample]), _matrix([v for _, v in sample])

    def nearest(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                cls = np.asarray(part.column(0))
                of, place, score = _top(asked, _matrix(part.column(1).to_pylist()), cls, k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(own[of]), pa.array(cls[place]), pa.array(score)], names=["cls", "found", "score"])

    true = classes.select("cls", "vec").mapInArrow(nearest, "cls long, found long, score double").where("cls != found")
    true = true.withColumn("order", F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("score"), "found"))).where(F.col("order") <= k)
    pairs = [(r["cls"], r["found"]) for r in true.collect()]
    if not pairs:
        return LEAST_WINDOW
    spark = classes.sparkSession
    # At most FIT_QUERIES x (k + 1) classes.
    names = F.broadcast(spark.createDataFrame([(int(c),) for c in sorted({x for p in pairs for x in p})], "cls long"))
    places: dict[int, dict[int, int]] = {}
    for r in ranked.join(names, "cls").select("cls", "curve", "place").collect():
        places.setdefault(r["cls"], {})[r["curve"]] = r["place"]
    apart = sorted(min(abs(places[a][c] - places[b][c]) for c in places[a]) for a, b in pairs)
    return min(n, max(LEAST_WINDOW, apart[min(len(apart) - 1, int(np.ceil(recall * len(apart))))]))
