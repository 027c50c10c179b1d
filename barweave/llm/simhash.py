"""Near-duplicates by SimHash: fingerprints of 64 bits, compared exactly tile by tile.

A tile holds the fingerprints whose parts have equal population counts. Two fingerprints that differ in r bits have
counts that differ by r at most, summed over the parts, so only tiles that near each other meet: by exclusive-or and
bit counts of whole blocks in numpy. What a meeting returns is a forest of its links, never all of its pairs.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, releasing
from .graph import components

SEED, SHINGLE, RADIUS = 42, 3, 2
#: Fingerprints in a block of a tile, about; rows of a block compared at a time.
BLOCK, STRIP = 4096, 256
#: Parts whose population counts make a tile: 4 of 16 bits, for more fingerprints than ``MANY`` 8 of 8 bits.
PARTS, MANY = (4, 8), 1 << 26
#: Bytes of a text and shingles of it at a time.
PIECE, HASHES = 1 << 20, 1 << 16

_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _words(text: bytes):
    """Lists of the text's words, of about ``PIECE`` bytes each."""
    at = 0
    while at < len(text):
        cut = _BLANK.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        yield text[at:end].lower().split()  # of bytes: A-Z only, and the blanks of ASCII
        at = end


def fingerprint(text: bytes | None) -> int:
    """Each bit set in over half of the hashes of all shingles of words; 0 without words. As a signed number."""
    ones, total, carry = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest

    def add(hashes):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return bits.sum(axis=0, dtype=np.int64)

    for words in _words(text or b""):
        words = carry + words
        if len(words) >= SHINGLE:
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            n = len(words) - SHINGLE + 1
            for a in range(0, n, HASHES):
                b = min(n, a + HASHES)
                spans = zip(starts[a:b].tolist(), ends[a + SHINGLE - 1 : b + SHINGLE - 1].tolist(), strict=True)
                ones += add(np.fromiter((digest(line[i:j], SEED) for i, j in spans), np.uint64, b - a))
            total += n
        carry = words[-(SHINGLE - 1) :]
    if not total:
        if not carry:
            return 0
        ones, total = add(np.array([digest(b" ".join(carry), SEED)], np.uint64)), 1
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of each row, fp a long of 64 bits."""

    def run(batches):
        for batch in batches:
            found = [fingerprint(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(releasing(run), "doc_id long, fp long")


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) between nodes under n, replaced by one from each node to the least that it can reach."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def near(x: np.ndarray, y: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links between two blocks, or within one: places in x and y one after the other, as a forest."""
    n = len(x) + (0 if same else len(y))
    kept = np.empty(0, np.int64), np.empty(0, np.int64)
    for k in range(0, len(x), STRIP):
        from_ = k + 1 if same else 0
        i, j = np.nonzero(np.bitwise_count(x[k : k + STRIP, None] ^ y[None, from_:]) <= radius)
        i, j = i + k, j + from_
        if same:
            later = j > i
            i, j = i[later], j[later]
        else:
            j = j + len(x)
        if len(i):
            kept = np.concatenate((kept[0], i)), np.concatenate((kept[1], j))
            if len(kept[0]) > 4 * n:
                kept = forest(*kept, n)
    return forest(*kept, n) if len(kept[0]) > n else kept


def _steps(parts: int, radius: int) -> list[int]:
    """Differences between the codes of tiles that may hold links, each once for a pair of tiles; 0 first."""
    found = [(0, ())]
    for _ in range(parts):
        found = [(used + abs(d), (*v, d)) for used, v in found for d in range(used - radius, radius - used + 1)]
    ahead = [v for _, v in found if next((d for d in v if d), 0) > 0]
    return [0, *sorted(sum(d << 7 * k for k, d in enumerate(v)) for v in ahead)]


def _tile(fp: Column, parts: int) -> Column:
    """The population counts of the parts, 7 bits for each: a step that leaves a count's range meets no tile."""
    width = 64 // parts
    count = lambda k: F.bit_count(F.shiftrightunsigned(fp, k * width).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))).cast("long")
    out = F.lit(0).cast("long")
    for k in range(parts):
        out = out + F.shiftleft(count(k), 7 * k)
    return out


def links(fps: DataFrame, radius: int = RADIUS, parts: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Links (a, b) between the distinct values ``fp`` of a table that differ in ``radius`` bits or fewer, directly or by way
    of others: what they join is what all pairs join."""
    scratch = scratch or Scratch(fps.sparkSession, "simhash")
    parts = parts or PARTS[fps.count() > MANY]
    tiles = fps.select("fp", _tile(F.col("fp"), parts).alias("tile"))
    size = tiles.groupBy("tile").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    tiles = tiles.join(size, "tile").select("tile", F.pmod(F.xxhash64("fp"), "blocks").cast("int").alias("block"), "fp")
    packed = scratch.save(tiles.groupBy("tile", "block").agg(F.collect_list("fp").alias("fps")), "tiles")
    names = packed.select("tile", "block")
    a = names.select(F.col("tile").alias("tile_a"), F.col("block").alias("block_a"), F.explode(F.array(*(F.lit(s).cast("long") for s in _steps(parts, radius)))).alias("step"))
    b = names.select(F.col("tile").alias("tile_b"), F.col("block").alias("block_b"))
    pairs = a.join(b, F.col("tile_a") + F.col("step") == F.col("tile_b")).where("step != 0 OR block_a <= block_b").drop("step")
    for k in "ab":
        pairs = pairs.join(packed.select(F.col("tile").alias(f"tile_{k}"), F.col("block").alias(f"block_{k}"), F.col("fps").alias(f"fps_{k}")), [f"tile_{k}", f"block_{k}"])
    same = ((F.col("tile_a") == F.col("tile_b")) & (F.col("block_a") == F.col("block_b"))).alias("same")

    def run(batches):
        for batch in batches:
            out = []
            for x, y, alone in zip(*(batch.column(k) for k in range(3)), strict=True):
                x, y = (np.asarray(v.values).view(np.uint64) for v in (x, y))
                i, j = near(x, y, radius, alone.as_py())
                if len(i):
                    both = x if alone.as_py() else np.concatenate((x, y))
                    out.append((both[i].view(np.int64), both[j].view(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in zip(*out, strict=True)], names=["a", "b"])

    return pairs.select("fps_a", "fps_b", same).mapInArrow(releasing(run), "a long, b long")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Every row's fingerprint and component: (doc_id, fingerprint, component_id).

    Documents link whose fingerprints differ in ``radius`` bits or fewer; the component is the least id that links reach,
    the document included. A text of fewer than three words is one shingle; texts without words, empty or null, have
    fingerprint zero and link like any other. Rows of one id share a component, whichever of their texts links. Rows
    without an id name no component, but link others; alone, they have a null one. Repeated rows are returned each. Other
    columns are not read; an empty table has no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.save(fingerprints(docs, id_col, text_col), "rows")
    reps = scratch.save(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprints")
    ids = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("first"), F.max("fp").alias("other")).where("first < other")
    same_id = rows.join(ids, "doc_id").select(F.col("first").alias("a"), F.col("fp").alias("b")).where("a < b")
    labels = components(links(reps, radius, scratch=scratch).union(same_id), scratch)
    named = reps.join(labels, reps["fp"] == labels["node"], "left").select("fp", "rep", F.coalesce("label", "fp").alias("label"))
    found = named.join(named.groupBy("label").agg(F.min("rep").alias("component_id")), "label").select("fp", "component_id")
    return rows.join(found, "fp").select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
