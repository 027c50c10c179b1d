"""Sharding by extendible hashing: only buckets over the byte limit split on another bit of the hash.

Only DataFrame operations. A round looks at ``STEP`` more bits of all rows that have no shard yet: one small
aggregate of bytes by prefix, from which the shortest prefix that fits follows for every longer one. Balanced data
need one round; rows beside a very large document need a few more, each over what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, free_name, tell_apart

#: Bits of the hash, bits looked at beyond what evenly filled shards need, and further bits a round.
BITS, SPARE, STEP = 60, 3, 6


def _bits(text: Column) -> Column:
    """The first 60 bits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def hash60(doc_id: Column, text: Column) -> Column:
    """A hash of an id and a text, null as the empty text."""
    return _bits(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text.cast("string"), F.lit(""))))


def again60(h: Column, k: Column) -> Column:
    """The hash of the k-th of rows that share one."""
    return _bits(F.concat(h.cast("string"), F.lit("|"), k.cast("string")))


def assign(docs: DataFrame, byte_limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A shard for every row: id, n_bytes, shard (the prefix as a string of bits), depth, shard_bytes, over_limit.

    A shard is the shortest prefix of hashes whose rows hold ``byte_limit`` bytes of text at most. Rows are hashed by id
    and text, and repeats of both by their number too, so repeated and null ids are split like others; only a single
    document over the limit is left over it and marked over_limit. A null or empty text holds no bytes; other columns are
    not read; an empty table has no shards.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    rows = docs.select(F.col(id_col).alias("id"), hash60(F.col(id_col), F.col(text_col)).alias("hash"), _size(text_col).alias("n_bytes"))
    return _assign(tell_apart(rows, "hash", again60, scratch), byte_limit, scratch).drop("hash").withColumnRenamed("id", id_col)


def _size(text_col: str) -> Column:
    return F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long")


def _assign(rows: DataFrame, byte_limit: int, scratch: Scratch) -> DataFrame:
    """The rows (id, hash, n_bytes) with shard, depth, shard_bytes, over_limit."""
    rows = scratch.save(rows, "rows")
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n")).first()["n"]
    seen, depth = -1, min(BITS, max(0, (total // byte_limit).bit_length()) + SPARE)
    rest, done = rows, []
    while True:
        cells = scratch.save(rest.groupBy(F.shiftright("hash", BITS - depth).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.min("hash").alias("low"), F.max("hash").alias("high")), "cells")
        levels = cells.withColumn("level", F.explode(F.sequence(F.lit(seen + 1), F.lit(depth)))).withColumn("prefix", F.expr(f"shiftright(cell, {depth} - level)"))
        fits = levels.groupBy("level", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.min("low").alias("low"), F.max("high").alias("high"))
        fits = fits.where((F.col("shard_bytes") <= byte_limit) | (F.col("low") == F.col("high")) | (F.col("level") == BITS)).drop("low", "high")
        leaf = levels.select("cell", "level", "prefix").join(fits, ["level", "prefix"]).groupBy("cell").agg(F.min(F.struct("level", "prefix", "shard_bytes")).alias("leaf"))
        leaf = scratch.save(leaf.select("cell", "leaf.*"), "leaves")
        found = rest.withColumn("cell", F.shiftright("hash", BITS - depth)).join(leaf, "cell", "left")
        done.append(found.where(F.col("level").isNotNull()).select("id", "hash", "n_bytes", F.expr("right(lpad(bin(prefix), 64, '0'), level)").alias("shard"), F.col("level").alias("depth"), "shard_bytes"))
        if depth == BITS or leaf.count() == cells.count():
            break
        rest = scratch.save(found.where(F.col("level").isNull()).select("id", "hash", "n_bytes"), "rest")
        seen, depth = depth, min(BITS, depth + STEP)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.withColumn("over_limit", F.col("shard_bytes") > byte_limit)


def write_shards(docs: DataFrame, path: str, byte_limit: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the documents in a folder for each shard, one file of at most ``byte_limit`` bytes of text (or one document).

    Folders are named by a column ``__shard``, with more underscores where the documents have that already.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    key, shard = free_name(docs, "__hash"), free_name(docs, "__shard")
    rows = tell_apart(docs.withColumn(key, hash60(F.col(id_col), F.col(text_col))), key, again60, scratch)
    shards = _assign(rows.select(F.col(id_col).alias("id"), F.col(key).alias("hash"), _size(text_col).alias("n_bytes")), byte_limit, scratch)
    shards = shards.select(F.col("hash").alias(free_name(rows, "__of")), F.concat(F.lit("b"), "shard").alias(shard)).distinct()
    joined = rows.join(shards, rows[key] == shards[shards.columns[0]]).select(*docs.columns, shard)
    joined.repartition(shard).write.partitionBy(shard).parquet(path)
