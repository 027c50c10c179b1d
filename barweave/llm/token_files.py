"""Token ids in files of 64-bit words, packed by Simple-8b selectors.

A word is a selector in the low four bits and sixty bits of ids. Selectors 1 to 14 hold a count of ids of one width
(``SELECTORS``), 0 is the escape: the whole next word is one id, for ids of over sixty bits. Blocks of ``BLOCK`` ids are
packed each for itself, and the first word of each is listed, so that a reader can start at any block; packing runs over
all blocks side by side, and unpacking handles all words of one selector in one numpy operation.

A token file is one segment: a magic number, the numbers of ids, words and blocks, the block offsets and the words. A
table of segments in Parquet carries the files, so any store that Spark reaches will do.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import byte_letters, slices
from .common import Scratch, partitions

MAGIC = b"S8B1"
#: (ids a word, bits an id) by selector; the first is the escape.
SELECTORS = ((0, 64), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
BLOCK = 240
#: Ids in a segment before the next document starts another.
SEGMENT_IDS = 1 << 18


def pack(ids: np.ndarray) -> bytes:
    """A token file of the ids (any unsigned 64-bit values)."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    blocks = -(-n // BLOCK)
    grid = np.zeros(blocks * BLOCK + 64, dtype=np.uint64)
    grid[:n] = ids
    # An id's smallest width among the selectors' widths, as an index of SELECTORS; 15 needs the escape.
    level = np.ones(len(grid), dtype=np.uint8)
    for s in range(1, 15):
        level += grid >= np.uint64(1 << SELECTORS[s][1])
    level[n:] = 1
    # The widest of the count ids from each position on, for each selector's count, by doubling.
    fits = {}
    runs = {1: level}
    for width in (2, 4, 8, 16, 32):
        half = runs[width // 2]
        runs[width] = np.maximum(half, np.append(half[width // 2 :], np.ones(width // 2, np.uint8)))
    for s in range(1, 15):
        count = SELECTORS[s][0]
        base = 1 << (count.bit_length() - 1)
        run, shift = runs[base], count - base
        fits[s] = (np.maximum(run, np.append(run[shift:], np.ones(shift, np.uint8))) if shift else run) <= s
    best = np.zeros(len(grid), dtype=np.uint8)
    for s in range(14, 0, -1):  # lower selectors hold more ids
        best[fits[s]] = s
    counts = np.array([max(1, c) for c, _ in SELECTORS], dtype=np.int64)
    # All blocks advance together, a word at a time; a word may run over its block's end, where it holds fewer ids.
    at = np.arange(blocks, dtype=np.int64) * BLOCK
    ends = np.minimum(at + BLOCK, n)
    starts, owners = [], []
    alive = np.arange(blocks)
    while len(alive):
        starts.append(at[alive])
        owners.append(alive)
        at[alive] += counts[best[at[alive]]]
        alive = alive[at[alive] < ends[alive]]
    if blocks:
        starts, owners = np.concatenate(starts), np.concatenate(owners)
        order = np.argsort(starts, kind="stable")
        starts, owners = starts[order], owners[order]
    else:
        starts = owners = np.zeros(0, np.int64)
    chosen = best[starts]
    place = np.cumsum(1 + (chosen == 0)) - (1 + (chosen == 0))
    words = np.zeros(len(starts) + int((chosen == 0).sum()), dtype=np.uint64)
    words[place] = chosen
    words[place[chosen == 0] + 1] = grid[starts[chosen == 0]]
    for s in range(1, 15):
        mine = chosen == s
        if mine.any():
            count, bits = SELECTORS[s]
            first, limit, word = starts[mine], ends[owners[mine]], words[place[mine]]
            for k in range(count):
                value = np.where(first + k < limit, grid[np.minimum(first + k, len(grid) - 1)], np.uint64(0))
                word = word | (value << np.uint64(4 + k * bits))
            words[place[mine]] = word
    first_word = place[np.searchsorted(owners, np.arange(blocks))] if blocks else np.zeros(0, np.int64)
    head = np.array([n, len(words), blocks], dtype="<u8").tobytes()
    return MAGIC + head + first_word.astype("<u8").tobytes() + words.astype("<u8").tobytes()


def _open(file: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    if file[:4] != MAGIC:
        raise ValueError("not a token file")
    n, words, blocks = np.frombuffer(file, dtype="<u8", count=3, offset=4).tolist()
    if len(file) != 28 + 8 * (blocks + words):
        raise ValueError("token file is cut short")
    offsets = np.frombuffer(file, dtype="<u8", count=blocks, offset=28).astype(np.int64)
    return n, offsets, np.frombuffer(file, dtype="<u8", count=words, offset=28 + 8 * blocks)


def unpack(file: bytes, first_block: int = 0, last_block: int | None = None) -> np.ndarray:
    """The ids of a token file, or of some of its blocks."""
    n, offsets, words = _open(file)
    blocks = len(offsets)
    last_block = blocks if last_block is None else min(last_block, blocks)
    if first_block >= last_block:
        return np.zeros(0, dtype=np.uint64)
    a = offsets[first_block]
    b = offsets[last_block] if last_block < blocks else len(words)
    words = words[a:b]
    start = offsets[first_block:last_block] - a
    total = min(n, last_block * BLOCK) - first_block * BLOCK
    chosen = (words & np.uint64(15)).astype(np.int64)
    # Words after an escape are raw ids: whether a word is one alternates along a run of words that look like escapes.
    raw = np.zeros(len(words), dtype=bool)
    if (chosen == 0).any():
        at = 0
        for at in np.flatnonzero(chosen == 0).tolist():
            if not raw[at] and at + 1 < len(words):
                raw[at + 1] = True
    counts = np.array([1 if s == 0 else SELECTORS[s][0] for s in range(15)] + [0])[chosen]
    counts[raw] = 0
    # Positions: within each block from the block's first id.
    block_of = np.searchsorted(start, np.arange(len(words)), side="right") - 1
    run = np.cumsum(counts) - counts
    position = block_of * BLOCK + run - run[start][block_of]
    ends = np.minimum((block_of + 1) * BLOCK, total)
    out = np.zeros(total, dtype=np.uint64)
    escaped = np.flatnonzero((chosen == 0) & ~raw)
    out[position[escaped]] = words[escaped + 1] if len(escaped) else 0
    for s in range(1, 15):
        mine = np.flatnonzero((chosen == s) & ~raw)
        if len(mine):
            count, bits = SELECTORS[s]
            to = position[mine][:, None] + np.arange(count)
            values = (words[mine][:, None] >> (np.uint64(4) + np.arange(count, dtype=np.uint64) * np.uint64(bits))) & np.uint64((1 << bits) - 1)
            inside = to < ends[mine][:, None]
            out[to[inside]] = values[inside]
    return out


class Library:
    """Any tokenizer file, read by the ``tokenizers`` library itself."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def text(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def texts(self, texts: list[str | None], end: int | None = None) -> list[np.ndarray]:
        tail = np.array([] if end is None else [end], dtype="<u4")
        return [np.concatenate([self.text(t) if t else tail[:0], tail]) for t in texts]


class ByteBpe(Library):
    """A byte-level tokenizer file whose ids are those of the ``tokenizers`` library at a third of its time.

    The file's vocabulary is read as merge ranks by ``tiktoken``. ``reads`` tells for which files that is the same; the
    tests hold both engines against each other on every code point, every token and long runs of one character.
    """

    #: How files of the ``ByteLevel`` kind split a text: a fixed value of that pre-tokenizer.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    #: White space of so many characters is split off before the pattern runs, whose engine gives up at about a million.
    LONG = 1 << 17
    #: What the pattern takes for white space.
    BLANK = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

    @staticmethod
    def reads(spec: dict) -> bool:
        """Whether a file does nothing but what this class does: the plain byte-level split, and merges in the order of their ids."""
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            return False
        if any(t.get(flag) for t in spec["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            return False
        if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")):
            return False
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = [model["vocab"][a + b] for a, b in merges]
        return all(a < b for a, b in zip(ids, ids[1:])) and len(ids) + 256 == len(model["vocab"].keys() - {t["content"] for t in spec["added_tokens"]})

    def __init__(self, path: str, spec: dict):
        import tiktoken

        byte = {c: b for b, c in enumerate(byte_letters())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.encoding = tiktoken.Encoding(path, pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = tuple(special)
        # Only a run's start may match: else each place in a run that is too short would look to its end.
        self.long = re.compile(f"(?<!{self.BLANK}){self.BLANK}{{{self.LONG},}}")

    def _ids(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4")

    def text(self, text: str) -> np.ndarray:
        """The ids of a text. Long white space is one piece for the pattern, but for its last character if a word follows."""
        if len(text) < self.LONG:
            return self._ids(text)
        out, at = [], 0
        for found in self.long.finditer(text):
            a, b = found.span()
            # A special token parts the text, so white space before one is whole, as at the text's end.
            if b < len(text) and not text.startswith(self.special, b):
                b -= 1
            out += [self._ids(text[at:a]), np.array(self.encoding._encode_single_piece(text[a:b]), dtype="<u4")]
            at = b
        return np.concatenate([*out, self._ids(text[at:])])


@lru_cache(maxsize=2)
def encoder(path: str) -> Library:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return ByteBpe(path, spec) if ByteBpe.reads(spec) else Library(path)


SEGMENTS = "shard int, segment int, first_id long, n_ids long, doc_ids array<{id}>, n_tokens array<int>, file binary"


def write(docs: DataFrame, out_path: str, tokenizer_path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write token files of every whole text, in ascending id order: shards are ranges of ids, segments follow within.

    A null or empty text holds just the end id. Null ids come first; repeated ids follow each other by text. A document
    longer than a segment makes that segment longer. An empty table writes a table without segments.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    arrow_id = pa.int64() if id_type == "bigint" else pa.int32() if id_type == "int" else pa.string()

    def run(batches):
        from pyspark import TaskContext

        shard, segment, first = TaskContext.get().partitionId(), 0, 0
        ids, docs_in, n = [], [], 0

        def flush():
            nonlocal segment, first, ids, docs_in, n
            row = [[shard], [segment], [first], [n], [docs_in], [[len(x) for x in ids]], [pack(np.concatenate(ids))]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(arrow_id), pa.list_(pa.int32()), pa.binary()]
            segment, first, ids, docs_in, n = segment + 1, first + n, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(row, types, strict=True)], names=["shard", "segment", "first_id", "n_ids", "doc_ids", "n_tokens", "file"])

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                for key, got in zip(keys[a:b], encoder(tokenizer_path).texts(texts[a:b], end_id), strict=True):
                    ids.append(got)
                    docs_in.append(key)
                    n += len(got)
                    if n >= SEGMENT_IDS:
                        yield flush()
        if ids:
            yield flush()

    ordered = source.repartitionByRange(partitions(docs.sparkSession), "id", F.xxhash64("text")).sortWithinPartitions("id", "text")
    ordered.mapInArrow(run, SEGMENTS.format(id=id_type)).write.parquet(out_path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of token files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Each id is unpacked from its file. Only the shards' totals reach the driver, one number for each written partition.
    """
    files = spark.read.parquet(path)
    id_type = files.schema["doc_ids"].dataType.elementType.simpleString()
    arrow_id = files.schema["doc_ids"].dataType.elementType
    arrow_id = pa.int64() if id_type == "bigint" else pa.int32() if id_type == "int" else pa.string()
    base, total = {}, 0
    for shard, n in sorted((r["shard"], r["n"]) for r in files.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()):
        base[shard] = total
        total += n

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                part = batch.slice(row, 1).to_pydict()
                ids = unpack(part["file"][0]).astype("<u4")
                lengths = np.array(part["n_tokens"][0], dtype=np.int64)
                if len(ids) != part["n_ids"][0] or lengths.sum() != len(ids):
                    raise ValueError("a token file and its list of documents differ")
                ends = np.cumsum(lengths)
                begins = ends - lengths
                raw = memoryview(ids.tobytes())
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                first = base[part["shard"][0]] + part["first_id"][0]
                yield pa.RecordBatch.from_arrays([pa.array(part["doc_ids"][0], type=arrow_id), pa.array(begins + first), pa.array(lengths), pa.array(sums, type=pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("shard", "first_id", "n_ids", "doc_ids", "n_tokens", "file").mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2) -> DataFrame:
    """Write token files to the shared folder and read them back."""
    spark = docs.sparkSession
    path = Scratch(spark, "tokens").path("files")
    write(docs, path, tokenizer_path, end_id)
    return read(spark, path)
