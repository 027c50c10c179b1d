"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

Every leaf of a word's tree holds the merge rank of the pair that starts at that symbol. The root is the lowest rank,
and going down to the left on ties finds its leftmost place; a merge changes three leaves, each a path of
logarithmic length. Words are merged many at a time, one tree a row of a numpy array; long words get a tree of their own.

Results equal those of the public ``tokenizers`` library for a word-level file: NFC, lower case, special tokens cut
from the raw text first, a word-end suffix, and tokens joined by blanks on decoding (such files have no decoder).
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import releasing

INF = np.int32(2**31 - 1)
#: Words of more symbols than this get a tree of their own.
LONG_WORD = 128
#: Words a Python worker remembers; beyond that it starts anew.
CACHE_WORDS = 120_000
#: Symbols merged at a time in one array of trees.
FOREST = 1 << 17
#: Characters of text taken apart at a time.
SLICE_CHARS = 1_000_000

# White space as the regular expressions of tokenizer files see it.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")


def byte_letters() -> list[str]:
    """The visible letter that stands for each byte: itself if printable Latin-1, else the next free one from 256."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(free)) for b in range(256)]


class SegmentTree:
    """Minimum over ranks, for one word."""

    def __init__(self, ranks: list[int]):
        self.size = 1
        while self.size < len(ranks):
            self.size *= 2
        self.t = [INF] * self.size + ranks + [INF] * (self.size - len(ranks))
        for i in range(self.size - 1, 0, -1):
            self.t[i] = min(self.t[2 * i], self.t[2 * i + 1])

    def put(self, i: int, rank: int) -> None:
        t, i = self.t, i + self.size
        t[i] = rank
        while i > 1:
            i //= 2
            low = t[2 * i] if t[2 * i] <= t[2 * i + 1] else t[2 * i + 1]
            if t[i] == low:
                break
            t[i] = low

    def leftmost(self) -> int:
        t, i = self.t, 1
        while i < self.size:
            i = 2 * i if t[2 * i] <= t[2 * i + 1] else 2 * i + 1
        return i - self.size


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        letters = byte_letters()
        self.path, self.bytes_of = path, {c: b for b, c in enumerate(letters)}
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in letters], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], dtype=np.int64)
        self.rank_of = {int(k): r for r, k in reversed(list(enumerate(keys)))}
        keys, first = np.unique(keys, return_index=True)
        self.keys, self.ranks = np.append(keys, np.int64(2**62)), np.append(first, INF).astype(np.int32)
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], INF)

    def _symbols(self, word: str | bytes) -> np.ndarray:
        raw = np.frombuffer(word.encode("utf-8", "surrogatepass") if isinstance(word, str) else word, dtype=np.uint8)
        out = self.inner[raw]
        out[-1] = self.last[raw[-1]]
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word; empty words have none."""
        out: list[list[int]] = [[] for _ in words]
        groups: dict[int, list[int]] = {}
        symbols = []
        for k, word in enumerate(words):
            symbols.append(s := self._symbols(word) if word else np.zeros(0, np.int64))
            if len(s) > LONG_WORD:
                out[k] = self._merge_long(s.tolist())
            elif len(s) > 1:
                groups.setdefault(1 << (len(s) - 2).bit_length() if len(s) > 2 else 1, []).append(k)
            else:
                out[k] = s.tolist()
        for size, members in groups.items():
            step = max(1, FOREST // (size + 1))
            for i in range(0, len(members), step):
                part = members[i : i + step]
                for k, ids in zip(part, self._merge_forest([symbols[k] for k in part], size), strict=True):
                    out[k] = ids
        return out

    def _merge_long(self, sym: list[int]) -> list[int]:
        n, rank_of, merged = len(sym), self.rank_of, self.merged
        following, before = [*range(1, n), -1], [-1, *range(n - 1)]
        rank = lambda a, b: rank_of.get((sym[a] << 32) | sym[b], INF)
        tree = SegmentTree([int(rank(i, i + 1)) for i in range(n - 1)])
        while (low := tree.t[1]) != INF:
            i = tree.leftmost()
            j = following[i]
            k = following[j]
            sym[i], sym[j] = int(merged[low]), -1
            following[i] = k
            if j < n - 1:
                tree.put(j, INF)
            if k >= 0:
                before[k] = i
            if i < n - 1:
                tree.put(i, rank(i, k) if k >= 0 else INF)
            if (p := before[i]) >= 0:
                tree.put(p, rank(p, i))
        return [x for x in sym if x >= 0]

    def _merge_forest(self, symbols: list[np.ndarray], size: int) -> list[list[int]]:
        """Words of 2 to size + 1 symbols; one row and one tree of ``size`` leaves for each."""
        n, width = len(symbols), size + 2  # position size + 1 stands for the end
        sym = np.full((n, width), -1, dtype=np.int64)
        lengths = np.array([len(s) for s in symbols])
        inside = np.arange(width)[None, :] < lengths[:, None]
        sym[inside] = np.concatenate(symbols)
        end = size + 1
        following = np.where(np.arange(1, width + 1)[None, :] < lengths[:, None], np.arange(1, width + 1)[None, :], end)
        before = np.broadcast_to(np.arange(-1, width - 1), (n, width)).copy()  # -1, the last column, is before the first
        tree = np.full((n, 2 * size), INF, dtype=np.int32)
        leaves = self._rank(np.maximum(sym[:, :size], 0), np.maximum(sym[:, 1 : size + 1], 0))
        tree[:, size:] = np.where(inside[:, 1 : size + 1], leaves, INF)
        for level in range(size.bit_length() - 2, -1, -1):
            a = 1 << level
            tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])
        rows = np.arange(n)

        def put(r: np.ndarray, leaf: np.ndarray, rank: np.ndarray) -> None:
            node = leaf + size
            tree[r, node] = rank
            while size > 1 and (node := node >> 1)[0]:
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

        while True:
            rows = rows[tree[rows, 1] != INF]
            if not len(rows):
                break
            low = tree[rows, 1]
            node = np.ones(len(rows), dtype=np.int64)
            for _ in range(size.bit_length() - 1):
                node = 2 * node + (tree[rows, 2 * node] > tree[rows, 2 * node + 1])
            i = node - size
            j = following[rows, i]
            k = following[rows, j]
            sym[rows, i], sym[rows, j] = self.merged[low], -1
            following[rows, i] = k
            before[rows, k] = i
            has = j < size
            if has.any():
                put(rows[has], j[has], np.full(int(has.sum()), INF, dtype=np.int32))
            new = np.where(k < end, self._rank(sym[rows, i], np.maximum(sym[rows, k], 0)), INF)
            put(rows, i, new.astype(np.int32))
            p = before[rows, i]
            has = p >= 0
            if has.any():
                r, q = rows[has], p[has]
                put(r, q, self._rank(sym[r, q], sym[r, i[has]]).astype(np.int32))
        kept = sym >= 0
        flat, ends = sym[kept].tolist(), np.cumsum(kept.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    # -- whole texts

    def words(self, text: str) -> list:
        """The pre-tokens of a text as strings, or their bytes; a special token is the one-element tuple of its string."""
        if self.split is None or "<" not in text:
            return self._plain(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append((m[0],))
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list:
        if text.isascii():
            return _ASCII_WORDS.findall(text.lower())
        if _unknown(text):
            rules = _library(self.path)
            return [bytes(map(self.bytes_of.__getitem__, word)) for word, _ in rules.pre_tokenizer.pre_tokenize_str(rules.normalizer.normalize_str(text))]
        # Each letter by itself: no rule for a final sigma.
        return _WORDS.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def decode(self, ids) -> str:
        return " ".join(self.tokens[i] for i in ids)


#: Characters of a text that are looked up at a time.
LOOKUP = 1 << 18


@lru_cache(maxsize=1)
def _unassigned() -> np.ndarray:
    """For each code point whether Python's tables don't assign it or keep it for private use: the library's may be newer."""
    return np.array([unicodedata.category(chr(c)) in ("Cn", "Co") for c in range(0x110000)])


def _unknown(text: str) -> bool:
    flags = _unassigned()
    parts = (text[a : a + LOOKUP].encode("utf-32-le", "surrogatepass") for a in range(0, len(text), LOOKUP))
    return any(flags[np.frombuffer(part, "<u4")].any() for part in parts)


@lru_cache(maxsize=4)
def _library(path: str):
    """The file's own rules to normalise and split a text."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    return Bpe(path)


@lru_cache(maxsize=4)
def _memory(path: str) -> dict:
    return {}


def encode_texts(path: str, texts: list[str | None]) -> list[tuple[bytes, str]]:
    """For each text: its ids as little-endian unsigned 32-bit integers, and the decoded text."""
    bpe, seen = load(path), _memory(path)
    if len(seen) > CACHE_WORDS:
        seen.clear()
    split = [bpe.words(t) if t else [] for t in texts]
    new = {w for words in split for w in words if w not in seen}
    plain = [w for w in new if not isinstance(w, tuple)]
    for w, ids in zip(plain, bpe.encode_words(plain), strict=True):
        seen[w] = np.array(ids, dtype="<u4").tobytes(), bpe.decode(ids)
    for w in new:
        if isinstance(w, tuple):
            seen[w] = np.array([bpe.special[w[0]]], dtype="<u4").tobytes(), w[0]
    out = []
    for words in split:
        got = [seen[w] for w in words]
        out.append((b"".join([g[0] for g in got]), " ".join([g[1] for g in got])))
    return out


def slices(texts: list, limit: int = SLICE_CHARS):
    """(from, to) of runs of texts that hold about ``limit`` characters."""
    a = n = 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n >= limit:
            yield a, i + 1
            a, n = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


_OUTPUTS = {
    "n_tokens": ("long", pa.int64()),
    "ids": ("array<int>", pa.list_(pa.int32())),
    "decoded": ("string", pa.string()),
    "ids_sha256": ("string", pa.string()),
    "decoded_sha256": ("string", pa.string()),
}


def encode_decode(docs: DataFrame, path: str, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text, row by row: no shuffle, a row out for each row in.

    A null or empty text has no ids and decodes to the empty text; a null id stays null; repeated rows give repeated
    results; other columns, whatever their names, are not read. ``outputs`` picks from n_tokens, ids, decoded and the
    SHA-256 digests of the last two.
    """
    import hashlib

    sha = lambda b: hashlib.sha256(b).hexdigest()
    make = {
        "n_tokens": lambda b, t: len(b) // 4,
        "ids": lambda b, t: np.frombuffer(b, dtype="<u4").astype(np.int32),
        "decoded": lambda b, t: t,
        "ids_sha256": lambda b, t: sha(b),
        "decoded_sha256": lambda b, t: sha(t.encode("utf-8", "surrogatepass")),
    }
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = source.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                got = encode_texts(path, texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array([make[o](*g) for g in got], type=_OUTPUTS[o][1]) for o in outputs)], names=["id", *outputs])

    out = source.mapInArrow(releasing(run), f"id {id_type}, " + ", ".join(f"{o} {_OUTPUTS[o][0]}" for o in outputs))
    return out.withColumnRenamed("id", id_col)
