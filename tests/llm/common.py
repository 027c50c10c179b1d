from __future__ import annotations

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or return: none of them may be touched by columns of that name.
CLASHING = ["id", "n", "size", "score", "label", "rep", "token", "digest", "copies", "depth", "bucket", "hash", "order", "n_tokens", "held_out", "component_id", "spans", "rank", "vec", "cls", "key", "__n", "node", "__shard", "row", "rest", "media", "order"]


def docs(spark, rows, clash=False):
    """Documents of (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    return df.withColumns({c: F.lit("x") for c in CLASHING}) if clash else df


def words(rng, n, stock=4000):
    return " ".join(f"w{rng.randrange(stock)}" for _ in range(n))
