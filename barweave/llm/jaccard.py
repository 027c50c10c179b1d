"""N-gram Jaccard join by prefix filters under several global orders.

Two sets that are similar enough share a token among the first few of each, under any order of all tokens. The first
order puts tokens of many documents late, and those of frequent words after those with rare ones, then follows a hash;
documents that share a prefix token under it meet in the token's bucket. Two more hash orders must agree before a pair's
whole sets are compared.

Texts with equal sets are one class. Buckets with many classes (groups of near copies) are not expanded into pairs: one
class leads, and the others are compared to it. A pair that is similar without both being similar to the leader also
shares some of its differences to the leader, more than a known number, so the differences are joined next, by their own
prefixes: a smaller join of the same kind, in which copies of one text no longer meet in what they are copies of. What
has become one component is never compared again. What is left of a bucket after that is compared in blocks inside tasks,
which emit nothing but links, or led once more if it is still large. So every link between different components is found.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, partitions, releasing
from .graph import components

N = 5
#: Similarity of at least NUM / DEN.
NUM, DEN = 4, 5
#: Tokens of more documents than these come later in the first order, level by level.
LEVELS = (32, 1024, 32768)
#: Bits of the map of each level: a fixed megabyte; where one fills up, more tokens come late, which stays an order.
MAP_BITS = 23
#: Bits of the map of the documents whose sets are gathered, at most: sixteen megabytes.
MARK_BITS = 27
#: Classes to which one copy of their leader's set is sent.
LED = 512
#: Rows and tokens of a block of a bucket, and blocks up to which a bucket of differences is compared in blocks.
BLOCK, BLOCK_TOKENS, BLOCKS = 256, 1 << 20, 16
#: Rounds of leaders before larger ones are, too.
LEADS = 4
#: Of each document's tokens, the hundredths that count for that map.
COUNTED = 45
#: Classes in the bucket of a token up to which all its pairs are made at once.
MANY = 4 * LEVELS[0]
#: Share of all words from which a word is frequent.
FREQUENT = 2e-5
#: Tokens gathered by a task between two packs.
PACK = 1 << 19

_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_TRUE = np.ones(1, dtype=bool)
_ORDERS = np.array([0x0, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


class Shingles:
    """Sets of shingles as 64-bit tokens. The low three bits of a token tell how many of its words are frequent ones.

    A shingle with a rare word is itself rare: that orders tokens by how many documents have them, whatever the size of
    the corpus, by a list of words of bounded length.
    """

    def __init__(self, frequent: np.ndarray | None = None):
        self.frequent = set() if frequent is None else set(frequent.tolist())
        self.words = _Words(self.frequent)

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """The distinct shingles of each text, sorted: lower-case A-Z, words between ASCII white space."""
        h, lengths = self.hashes(texts)
        rare = (h & np.uint64(1)) ^ np.uint64(1)
        h = h >> np.uint64(1)
        # Runs over the end of a text are made too, and left out below.
        n = max(0, len(h) - N + 1)
        total, common = h[:n] * _MUL[0], np.full(n, N, dtype=np.uint64) - rare[:n]
        for k in range(1, N):
            total += h[k : k + n] * _MUL[k]
            common -= rare[k : k + n]
        total = (mix(total) & ~np.uint64(7)) | common
        out, at = [], 0
        for m in lengths:
            if m >= N:
                got = np.sort(total[at : at + m - N + 1])
                out.append(got[np.concatenate([_TRUE, got[1:] != got[:-1]])])
            else:  # the whole sequence, apart from any run of N words
                got = np.full(min(m, 1), m, dtype=np.uint64)
                for x in h[at : at + m]:
                    got = mix(got ^ x)
                out.append(got & ~np.uint64(7))
            at += m
        return out

    def hashes(self, texts: list[str | None]) -> tuple[np.ndarray, list[int]]:
        """Hashes of all words, the low bit set for frequent ones, and the texts' numbers of words."""
        if len(self.words) > 300_000:
            self.words.clear()
        split = [_split(t) for t in texts]
        lengths = [len(w) for w in split]
        return np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), dtype=np.uint64, count=sum(lengths)), lengths


def _split(text: str | None) -> list[bytes]:
    """Words; bytes change and split at ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _word(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) & ~1


class _Words(dict):
    def __init__(self, frequent: set[int]):
        self.frequent = frequent

    def __missing__(self, word: bytes) -> int:
        h = _word(word)
        self[word] = h = h | (h in self.frequent)
        return h


def _key(tokens: np.ndarray, maps: list[np.ndarray] = ()) -> np.ndarray:
    """Places in the first order: fewer documents first, by the maps, then fewer frequent words, then a hash."""
    key = ((tokens & np.uint64(7)) << np.uint64(59)) | (mix(tokens) >> np.uint64(5))
    at = tokens >> np.uint64(64 - MAP_BITS)
    for marks in maps:
        key += _marked(marks, at).astype(np.uint64) << np.uint64(62)
    return key


def _heads_of(sets: list[np.ndarray], key: np.ndarray, length) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each set the first tokens under the order of ``key`` (of all sets, one after the other), and their keys."""
    out, at = [], 0
    for s in sets:
        k, n = key[at : at + len(s)], length(len(s))
        at += len(s)
        first = np.argpartition(k, n - 1)[:n] if 0 < n < len(s) else np.arange(n)
        first = first[np.argsort(k[first])]
        out.append((s[first], k[first]))
    return out


def _class(tokens: np.ndarray) -> int:
    """The digest of a set, as a signed number."""
    return int.from_bytes(xxhash.xxh3_64_digest(tokens.tobytes()), "big", signed=True)


def _together(sets: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64)


def prefix_length(n: int) -> int:
    return n - (NUM * n + DEN - 1) // DEN + 1 if n else 0


def _batches(batches, size: int = 512):
    for batch in batches:
        for a in range(0, batch.num_rows, size):
            yield batch.slice(a, size)


def _first(s: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """The n tokens with the least keys."""
    return s[np.argpartition(key, n - 1)[:n]] if 0 < n < len(s) else s[:n]


def _pack_bits(spark) -> int:
    """Packs: twice the shuffle partitions or more, so their share of the tokens falls as those grow."""
    return min(MAP_BITS - 3, max(4, (2 * partitions(spark) - 1).bit_length()))


def _cuts(tokens: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(pack, from, to) of sorted tokens by their leading bits."""
    edges = np.searchsorted(tokens, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    edges = [0, *edges.tolist(), len(tokens)]
    return [(k, a, b) for k, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]


def _marked(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (marks[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1


def _frequent(docs: DataFrame) -> np.ndarray:
    """Hashes of the words that make up FREQUENT of all words or more: at most 2 / FREQUENT, whatever the corpus.

    Tasks leave out words below a quarter of that share of what they have read at a time.
    """

    def counted(batches):
        held, n = Counter(), 0

        def flush():
            keep = [(w, c) for w, c in held.items() if c >= n * FREQUENT / 4]
            words = [_word(w) for w, _ in keep]
            return pa.RecordBatch.from_arrays([pa.array(np.array([*words, 0], np.uint64).view(np.int64)), pa.array([*(c for _, c in keep), n], pa.int64()), pa.array([False] * len(keep) + [True])], names=["word", "n", "total"])

        for part in _batches(batches):
            for text in part.column(0).to_pylist():
                words = _split(text)
                held.update(words)
                n += len(words)
            if n >= PACK:
                yield flush()
                held, n = Counter(), 0
        if n:
            yield flush()

    found = docs.select("text").mapInArrow(releasing(counted), "word long, n long, total boolean").groupBy("word", "total").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("total"), F.desc("n"), "word").limit(int(2 / FREQUENT) + 1).collect()
    total = top[0]["n"] if top else 0
    return np.array([r["word"] for r in top[1:] if r["n"] >= FREQUENT * total / 2], dtype=np.int64).view(np.uint64)


def _hot_maps(docs: DataFrame, frequent) -> list[bytes]:
    """Maps of fixed size that mark the tokens of over LEVELS documents, counted over all of them.

    Of each document the part COUNTED of its tokens that come first counts: its prefix lies there, even if most of what
    is there is hot. Tasks send sorted packs of 32-bit rests of the tokens by their leading bits, repeats counted.
    """
    bits = _pack_bits(docs.sparkSession)

    def packs(batches):
        shingles, held, n = Shingles(frequent.value), [], 0

        def flush():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            rests = ((tokens << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
            rows = _cuts(tokens, bits)
            many = [np.flatnonzero(counts[a:b] > 1) + a for _, a, b in rows]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in rows], pa.int32()), pa.array([rests[a:b].tobytes() for _, a, b in rows], pa.binary()), pa.array([rests[m].tobytes() for m in many], pa.binary()), pa.array([(counts[m] - 1).astype(np.uint32).tobytes() for m in many], pa.binary())], names=["pack", "rests", "many", "counts"])

        for part in _batches(batches):
            sets = shingles.sets(part.column(0).to_pylist())
            key, at = _key(_together(sets)), 0
            for s in sets:
                k = key[at : at + len(s)]
                at += len(s)
                held.append(s := _first(s, k, -(-len(s) * COUNTED // 100)))
                n += len(s)
            if n >= PACK:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    def count(key, pdf):
        import pandas as pd

        rests = np.concatenate([np.frombuffer(x, np.uint32) for col in ("rests", "many") for x in pdf[col]])
        weight = np.concatenate([np.ones(sum(len(x) for x in pdf["rests"]) // 4, np.int64), *(np.frombuffer(x, np.uint32).astype(np.int64) for x in pdf["counts"])])
        tokens, at = np.unique(rests, return_inverse=True)
        counts, out = np.bincount(at, weights=weight), {"pack": [key[0]]}
        for k, level in enumerate(LEVELS):
            marks = np.zeros(1 << (MAP_BITS - bits), dtype=bool)
            marks[tokens[counts > level] >> np.uint32(32 - (MAP_BITS - bits))] = True
            out[f"m{k}"] = [np.packbits(marks, bitorder="little").tobytes()]
        return pd.DataFrame(out)

    got = docs.select("text").mapInArrow(releasing(packs), "pack int, rests binary, many binary, counts binary").groupBy("pack").applyInPandas(count, "pack int, " + ", ".join(f"m{k} binary" for k in range(len(LEVELS))))
    size = 1 << (MAP_BITS - bits - 3)
    maps = [bytearray(1 << (MAP_BITS - 3)) for _ in LEVELS]
    for r in got.toLocalIterator():  # a fixed megabyte for each level
        for k, whole in enumerate(maps):
            whole[r["pack"] * size : (r["pack"] + 1) * size] = r[f"m{k}"]
    return [bytes(m) for m in maps]


def _heads(docs: DataFrame, frequent, maps: list[bytes]) -> DataFrame:
    """(doc_id, n, class, and the prefix under the first order in two parts: its tokens that no map marks, and the others).

    The class is a digest of the set; a token's position is its place in both parts, one after the other.
    """
    shared = docs.sparkSession.sparkContext.broadcast(maps)

    def run(batches):
        shingles, marks = Shingles(frequent.value), [np.frombuffer(m, dtype=np.uint8) for m in shared.value]
        for part in _batches(batches):
            sets = shingles.sets(part.column(1).to_pylist())
            head, late = [], []
            for tokens, key in _heads_of(sets, _key(_together(sets), marks), prefix_length):
                cold = int(np.searchsorted(key, np.uint64(1 << 62)))
                head.append(tokens[:cold].view(np.int64))
                late.append(tokens[cold:].view(np.int64))
            classes = np.array([_class(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(classes), pa.array(head, pa.list_(pa.int64())), pa.array(late, pa.list_(pa.int64()))], names=["doc_id", "n", "cls", "head", "late"])

    return docs.select("doc_id", "text").mapInArrow(releasing(run), "doc_id long, n long, cls long, head array<long>, late array<long>")


def _near(n, d, i, m, e, j):
    """Whether two sets of n and m tokens can be similar, if the i-th of d (and the j-th of e) is the first token that they share.

    The d and e tokens are those in which the sets differ from one leader, or all of them without one. Similar sets
    share at least (9 (d + e) - n - m) / 18 of those. For numbers, arrays or columns.
    """
    least = (NUM + DEN) * (d + e) - n - m
    return (DEN * n >= NUM * m) & (DEN * m >= NUM * n) & (2 * (NUM + DEN) * (d - i) >= least) & (2 * (NUM + DEN) * (e - j) >= least)


def _met(named: DataFrame) -> DataFrame:
    """Classes that meet in tokens that are not late: as pairs (a, b), or where they are many, as rows (token, a, n, pos)."""
    bits = _pack_bits(named.sparkSession)
    kinds = (np.int64, np.int64, np.int32, np.int32)

    def packs(batches):
        held, n, seen = [], 0, set()

        def flush():
            columns = [np.concatenate(x) for x in zip(*held)]
            order = np.argsort(columns[0].view(np.uint64))
            columns = [x[order] for x in columns]
            rows = _cuts(columns[0].view(np.uint64), bits)
            return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in rows], pa.int32()), *(pa.array([x[a:b].tobytes() for _, a, b in rows], pa.binary()) for x in columns)], names=["pack", "tokens", "classes", "sizes", "places"])

        for part in _batches(batches):
            for cls, size, tokens in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                if cls in seen:
                    continue
                seen.add(cls)
                tokens = np.asarray(tokens.values)
                m = len(tokens)
                held.append((tokens, np.full(m, cls, np.int64), np.full(m, size, np.int32), np.arange(m, dtype=np.int32)))
                n += m
            if n >= PACK:
                yield flush()
                held, n, seen = [], 0, set()
        if n:
            yield flush()

    def pairs(tokens, classes, sizes, places):
        order = np.lexsort((classes, tokens))
        tokens, classes, sizes, places = (x[order] for x in (tokens, classes, sizes, places))
        new = np.ones(len(tokens), dtype=bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (classes[1:] != classes[:-1])
        tokens, classes, sizes, places = tokens[new], classes[new], sizes[new].astype(np.int64), places[new].astype(np.int64)
        starts = np.flatnonzero(np.concatenate([_TRUE, tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
        many = np.diff(np.append(starts, len(tokens)))
        many = np.repeat(many, many)
        large = many > MANY
        found, d = [], 1
        while (at := np.flatnonzero(~large & (many > d))).size:
            at = at[at + d < len(tokens)]
            at = at[tokens[at] == tokens[at + d]]
            at = at[_near(sizes[at], sizes[at], places[at], sizes[at + d], sizes[at + d], places[at + d])]
            found.append(np.stack([classes[at], classes[at + d]], axis=1))
            d += 1
        found = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        none, m, k = np.zeros(len(found), np.int64), len(found), int(large.sum())
        lost = pa.nulls(m, pa.int64())
        return pa.RecordBatch.from_arrays([pa.concat_arrays([lost, pa.array(tokens[large])]), pa.array(np.concatenate([found[:, 0], classes[large]])), pa.concat_arrays([pa.array(found[:, 1]), pa.nulls(k, pa.int64())]), pa.array(np.concatenate([none, sizes[large]])), pa.array(np.concatenate([none, places[large]]))], names=["token", "a", "b", "n", "pos"])

    def meet(batches):
        # A partition's packs one after the other: rows come sorted by pack.
        last, held = None, []
        columns = lambda: [np.concatenate([np.frombuffer(x[c], t) for x in held]) for c, t in enumerate(kinds)]
        for batch in batches:
            for pack, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if pack != last and held:
                    yield pairs(*columns())
                    held = []
                last = pack
                held.append(row)
        if held:
            yield pairs(*columns())

    packed = named.select("cls", "n", "head").mapInArrow(releasing(packs), "pack int, tokens binary, classes binary, sizes binary, places binary")
    return packed.repartition(partitions(named.sparkSession), "pack").sortWithinPartitions("pack").mapInArrow(releasing(meet), "token long, a long, b long, n long, pos long")


def _mark(ids: DataFrame, bits: int) -> bytes:
    """A map of 2 ** bits bits that marks the hashes of all ids of a column."""
    at = F.pmod(F.xxhash64("id"), F.lit(1 << bits))
    got = ids.select(at.alias("at")).groupBy(F.expr("bitmap_bucket_number(at)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("marks"))
    whole = bytearray((1 << (bits - 3)) + 4096)
    for r in got.toLocalIterator():  # the position 0 is the last of its bucket's neighbour
        whole[r["k"] * 4096 : (r["k"] + 1) * 4096] = r["marks"]
    return bytes(whole)


def _sets(docs: DataFrame, frequent, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """(cls, n, second, third, text): a text of each of the classes (cls, rep), with the other orders' prefixes.

    Prefixes are sorted places in the order, 31 bits of each: tokens that share one only make a pair look more alike.
    A map of the documents' ids, eight bits for each up to ``MARK_BITS``, spares most other texts; more than these do no harm.
    """
    bits = min(MARK_BITS, max(16, (8 * wanted.count()).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(_mark(wanted.select(F.col("rep").alias("id")), bits))
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))
    rows = docs.where(F.col("doc_id").isNotNull()).select("text", at.alias("at")).select("text", F.expr("bitmap_bucket_number(at) * 32768 + bitmap_bit_position(at)").alias("bit"))

    def run(batches):
        shingles, marks = Shingles(frequent.value), np.frombuffer(shared.value, dtype=np.uint8)
        for part in _batches(batches):
            part = part.filter(pa.array(_marked(marks, np.asarray(part.column(1)).astype(np.uint64)).astype(bool)))
            sets = shingles.sets(part.column(0).to_pylist())
            cols = [pa.array(np.array([_class(s) for s in sets], np.int64)), pa.array([len(s) for s in sets], pa.int64())]
            for seed in _ORDERS[1:]:
                places = [mix(s ^ seed) >> np.uint64(33) for s in sets]
                cols.append(pa.array([np.sort(_first(x, x, prefix_length(len(x)))).astype(np.int32) for x in places], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*cols, part.column(0)], names=["cls", "n", "second", "third", "text"])

    return scratch.save(rows.mapInArrow(releasing(run), "cls long, n long, second array<int>, third array<int>, text string").dropDuplicates(["cls"]), "sets")


class _Recent:
    """The sets of texts; those of the last batch are at hand for the next one, as rows of one text follow each other."""

    def __init__(self, frequent: np.ndarray):
        self.shingles, self.known = Shingles(frequent), {}

    def pairs(self, a: pa.Array, b: pa.Array):
        a, b = a.to_pylist(), b.to_pylist()
        texts = dict.fromkeys(a + b)
        known = {t: s for t, s in self.known.items() if t in texts}
        new = [t for t in texts if t not in known]
        self.known = known | dict(zip(new, self.shingles.sets(new), strict=True))
        return ((self.known[x], self.known[y]) for x, y in zip(a, b, strict=True))


def _both(pairs: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """The pairs with columns of each class."""
    for side in ("a", "b"):
        pairs = pairs.join(rows.select(F.col("cls").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns)), side)
    return pairs


def _may_agree(x: Column, y: Column, n: Column, m: Column) -> Column:
    """Whether prefixes under one order share a token and leave room for the asked similarity.

    Up to the place where the shorter-reaching prefix ends both are whole, so what one of them has alone there is missing
    from the overlap for good.
    """
    end = F.least(F.element_at(x, -1), F.element_at(y, -1))
    least = F.ceil(NUM * (n + m) / (NUM + DEN))
    alone = lambda a, b: F.size(F.array_except(F.filter(a, lambda v: v < end), b))
    return F.arrays_overlap(x, y) & (alone(x, y) <= n - least) & (alone(y, x) <= m - least)


def _places(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of two sorted sets, y not empty: which tokens of x are in y, and where."""
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return y[at] == x, at


def verify(pairs: DataFrame, sets: DataFrame, frequent, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose sets are similar: first the other orders' prefixes must agree, then whole sets count."""
    left = _both(pairs.select("a", "b"), sets, ["n", "second", "third"])
    for c in ("second", "third"):
        left = left.where(_may_agree(F.col(f"{c}_a"), F.col(f"{c}_b"), F.col("n_a"), F.col("n_b")))
    left = scratch.save(left.select("a", "b"), "left")

    def run(batches):
        recent = _Recent(frequent.value)
        for part in _batches(batches, 128):
            keep = []
            for x, y in recent.pairs(part.column(2), part.column(3)):
                both = int(_places(x, y)[0].sum())
                keep.append(DEN * both >= NUM * (len(x) + len(y) - both))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _both(left, sets, ["text"]).select("a", "b", "text_a", "text_b").mapInArrow(releasing(run), "a long, b long")


def _levels(m: int, top: int) -> list[int]:
    """Where the kinds of excess begin for a leader of m tokens: kind 0 is similar to it, the others double."""
    out = [0, m + 1]
    while out[-1] <= top:
        out.append(2 * out[-1])
    return out


def _prefixes(n: int, d: int, m: int) -> list[tuple[int, bool, int]]:
    """(kind, whether to probe, length) of the prefixes of d differences between n tokens and a leader's m.

    Two sets x and y are similar if they share (e(x) + e(y)) / 18 of their differences or more, where e = 9 d - n is the
    excess; a set is similar to the leader if its excess is m or less. Of a pair without one component, one set at least
    is not. So a set is met by those of its own kind or a higher one, with an excess of that kind's level at least, and it
    probes the lower kinds. Sets similar to the leader share (e(x) - m) / 10 with x at least: their excess is no less than
    8 times what is shared, less m. All bounds are above zero, so similar pairs share a token of these prefixes.
    """
    both = 2 * (NUM + DEN)
    excess = (NUM + DEN) * d - n
    levels = _levels(m, excess)
    kind = max(k for k, level in enumerate(levels) if k == 0 or level <= excess) if excess > m else 0
    out = [(kind, False, -(-(excess + levels[max(1, kind)]) // both))]
    # Similar sets differ by a ninth of both sizes at most, and the larger is five quarters of the smaller at most.
    lowest = (NUM + DEN) * d - 4 * n
    for k in range(kind):
        if k + 1 == len(levels) or levels[k + 1] > lowest:
            out.append((k, True, -(-(excess + levels[k]) // both) if k else -(-(excess - m) // (both - 8))))
    return [(k, probe, d - least + 1) for k, probe, least in out if least <= d]


def _differences(led: DataFrame, sets: DataFrame, frequent, maps: list[bytes], scratch: Scratch) -> DataFrame:
    """(lead, cls, paths, n, d, linked, tokens, places): each class of (lead, cls, paths) against its leader.

    The d ``tokens`` are in one of both sets alone, and ``places`` are those of its prefixes among them.
    """
    shared = sets.sparkSession.sparkContext.broadcast(maps)
    # A leader's set goes to its classes in parts of about LED rows.
    parts = led.groupBy("lead").agg(F.ceil(F.count("*") / LED).cast("int").alias("parts"))
    own = led.join(parts, "lead").select("lead", "cls", "paths", F.pmod(F.xxhash64("cls"), "parts").cast("int").alias("part")).join(sets.select("cls", "text"), "cls")
    leads = parts.join(sets.select(F.col("cls").alias("lead"), F.col("text").alias("lead_text")), "lead")
    leads = leads.select("lead", "lead_text", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def compare(x: np.ndarray, y: np.ndarray, marks: list[np.ndarray]):
        same, at = _places(x, y)
        gone = np.ones(len(y), dtype=bool)
        gone[at[same]] = False
        new, gone = x[~same], y[gone]
        # What the leader lacks is rarer than what it has.
        tokens = np.concatenate([new[np.argsort(_key(new, marks))], gone[np.argsort(mix(gone))]])
        d = len(tokens)
        prefixes = _prefixes(len(x), d, len(y))
        long = [m for _, _, m in prefixes]
        kinds, probes = np.repeat([k for k, _, _ in prefixes], long), np.repeat([p for _, p, _ in prefixes], long)
        pos = np.concatenate([np.arange(m) for m in long]) if long else np.zeros(0, np.int64)
        return len(x), d, (NUM + DEN) * d <= len(x) + len(y), tokens.tobytes(), kinds, probes, pos, tokens[pos]

    place = pa.struct([("kind", pa.int32()), ("probe", pa.bool_()), ("pos", pa.int64()), ("token", pa.int64())])

    def run(batches):
        recent, marks = _Recent(frequent.value), [np.frombuffer(m, dtype=np.uint8) for m in shared.value]
        for part in _batches(batches, 128):
            rows = [compare(x, y, marks) for x, y in recent.pairs(part.column(3), part.column(4))]
            n, d, linked, whole, *lists = zip(*rows, strict=True) if rows else ((),) * 8
            ends = np.cumsum([0, *(len(x) for x in lists[0])]).astype(np.int32)
            kinds, probes, pos, tokens = (np.concatenate([np.zeros(0, t), *x]).astype(t) for x, t in zip(lists, (np.int32, bool, np.int64, np.uint64), strict=True))
            places = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(kinds), pa.array(probes), pa.array(pos), pa.array(tokens.view(np.int64))], fields=list(place)))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(linked, pa.bool_()), pa.array(whole, pa.binary()), places], names=["lead", "cls", "paths", "n", "d", "linked", "tokens", "places"])

    schema = "lead long, cls long, paths array<long>, n long, d long, linked boolean, tokens binary, places array<struct<kind:int,probe:boolean,pos:long,token:long>>"
    return scratch.save(own.join(leads, ["lead", "part"]).select("lead", "cls", "paths", "text", "lead_text").mapInArrow(releasing(run), schema), "differences")


def _blocks(rows: DataFrame, differ: DataFrame, bucket: list[str]) -> DataFrame:
    """The links (a, b) in buckets of many classes: tasks take two blocks of a bucket at a time and make nothing but links."""
    size = rows.groupBy(*bucket).agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("d") / BLOCK_TOKENS)).cast("int").alias("blocks"))
    rows = rows.join(size, bucket).withColumn("own", F.pmod(F.xxhash64("cls"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.join(differ.select("lead", "cls", "tokens"), ["lead", "cls"])

    def meet(pdf):
        import pandas as pd

        sets = [np.frombuffer(x, np.uint64) for x in pdf["tokens"]]
        tokens, column = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        n, d, label, cls, own = (pdf[c].to_numpy() for c in ("n", "d", "label", "cls", "own"))
        met = np.flatnonzero(~pdf["probe"].to_numpy())
        shared = np.zeros((len(met), len(sets)), dtype=np.float32)
        for a in range(0, len(tokens), 4096):
            i, j = np.searchsorted(column, [a, a + 4096])
            part = np.zeros((len(sets), 4096), dtype=np.float32)
            part[row[i:j], column[i:j] - a] = 1
            shared += part[met] @ part.T
        near = 2 * (NUM + DEN) * shared.astype(np.int64) >= ((NUM + DEN) * d - n)[met][:, None] + ((NUM + DEN) * d - n)
        near &= label[met][:, None] != label
        if len(set(own)) > 1:
            near &= own[met][:, None] != own
        i, j = np.nonzero(near)
        return pd.DataFrame({"a": cls[met[i]], "b": cls[j]})

    cells = [*bucket, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")]
    return rows.select(*cells, "own", "cls", "n", "d", "label", "probe", "tokens").groupBy(*bucket, "low", "high").applyInPandas(meet, "a long, b long")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's number of distinct 5-word shingles and component: (id, n_shingles, component_id).

    Documents link at a Jaccard similarity of 0.8 or more; the component is the least id that links reach, the document
    included. A text of fewer words is one shingle; one without words, empty or null, has none and links with nothing.
    Rows of one id share a component, whichever of their texts links. Rows without an id are returned with a null
    component and link with nothing. Other columns are not read; an empty table has no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    frequent = spark.sparkContext.broadcast(_frequent(docs))
    maps = _hot_maps(docs, frequent)
    heads = scratch.save(_heads(docs, frequent, maps), "heads")
    named = heads.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    of_id = scratch.save(named.groupBy("doc_id").agg(F.min("cls").alias("cls"), F.max("cls").alias("other")), "classes")
    reps = scratch.save(named.groupBy("cls").agg(F.min("doc_id").alias("rep")), "reps")
    labels = _labels(docs, frequent, maps, named, of_id.where("cls < other"), reps, scratch)
    # A component's label is a class; its name is the least id of all its classes.
    labelled = reps.join(labels, reps["cls"] == labels["node"], "left").select("cls", "rep", F.coalesce("label", "cls").alias("label"))
    names = labelled.groupBy("label").agg(F.min("rep").alias("component_id"))
    found = of_id.join(labelled.join(names, "label").select("cls", "component_id"), "cls").select(F.col("doc_id").alias("named"), "component_id")
    out = heads.select("doc_id", "n").join(found, F.col("doc_id") == F.col("named"), "left")
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _labels(docs: DataFrame, frequent, maps: list[bytes], named: DataFrame, repeated: DataFrame, reps: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) of all classes that links join to another; ``repeated`` are ids (doc_id, cls) with more classes."""
    met = scratch.save(_met(named), "met")
    pairs = scratch.save(met.where("token IS NULL").select("a", "b").distinct(), "pairs")
    # Late tokens, and those of many classes after all: the buckets (path, token), where the path of leaders is empty as yet.
    late = named.select("cls", "n", F.size("head").alias("first"), F.posexplode("late").alias("k", "token")).select("token", "cls", "n", (F.col("first") + F.col("k")).alias("pos"))
    late = late.union(met.where("token IS NOT NULL").select("token", F.col("a").alias("cls"), "n", "pos"))
    late = scratch.save(late.groupBy("token", "cls").agg(F.first("n").alias("n"), F.min("pos").alias("pos")), "late")
    several = late.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    postings = late.join(several, "token").select(F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("lead"), "token", F.lit(0).alias("kind"), F.lit(False).alias("probe"), "cls", "n", F.col("n").alias("d"), "pos")
    postings = scratch.save(postings, "postings")
    ends = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).union(postings.select("cls")).distinct()
    sets = _sets(docs, frequent, reps.join(ends, "cls"), scratch)
    same_id = named.select("doc_id", F.col("cls").alias("b")).join(repeated.select("doc_id", F.col("cls").alias("a")), "doc_id").select("a", "b")
    labels = components(verify(pairs, sets, frequent, scratch).union(same_id), scratch)
    tested, bucket, differ = pairs, ["path", "lead", "token", "kind"], None
    for round_ in range(LEADS + 1):
        blocks = F.lit(False) if not round_ else F.lit(True) if round_ == LEADS else F.col("c") <= BLOCKS * BLOCK
        # Buckets that one component fills, or that hold nothing but probes, are done.
        rows = postings.join(labels, postings["cls"] == labels["node"], "left").select(*bucket, "probe", "cls", "n", "d", "pos", F.coalesce("label", "cls").alias("label"))
        count = F.count("*").alias("c"), F.count_if(~F.col("probe")).alias("met"), F.min("label").alias("low"), F.max("label").alias("high")
        rows = scratch.save(rows.join(rows.groupBy(*bucket).agg(*count).where("met > 0 AND low < high").select(*bucket, "c", "met"), bucket), "open")
        if rows.isEmpty():
            break
        few, many = rows.where(F.col("met") <= MANY).drop("c", "met"), rows.where((F.col("met") > MANY) & ~blocks)
        found = few.where("NOT probe").join(few.withColumnsRenamed({c: f"{c}_" for c in ("probe", "cls", "n", "d", "pos", "label")}), bucket).where("(probe_ OR cls < cls_) AND label != label_")
        found = found.where(_near(*(F.col(c) for c in ("n", "d", "pos", "n_", "d_", "pos_"))))
        found = scratch.save(found.select(F.least("cls", "cls_").alias("a"), F.greatest("cls", "cls_").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        links, tested = verify(found, sets, frequent, scratch), tested.union(found)
        if round_:
            links = links.union(_blocks(rows.where((F.col("met") > MANY) & blocks), differ, bucket))
        if round_ < LEADS:
            # The class in whose order the token comes first has the fewest rare tokens: what others are copies of.
            # Of such classes the one of most buckets leads all that it is in, so that a class has few leaders.
            first = many.groupBy(*bucket).agg(F.min(F.struct("pos", F.xxhash64("label").alias("h"), "cls")).alias("first"))
            often = first.groupBy(F.col("first.cls").alias("cls")).agg(F.count("*").alias("often"))
            lead = many.join(often, "cls").groupBy(*bucket).agg(F.max(F.struct("often", "cls")).alias("first"))
            led = many.join(lead, bucket).select("path", F.col("first.cls").alias("lead"), "cls").where("lead != cls")
            led = led.groupBy("lead", "cls").agg(F.collect_set(F.xxhash64("path", "lead")).alias("paths"))
            differ = _differences(scratch.save(led, "led"), sets, frequent, maps, scratch)
            links = links.union(differ.where("linked").select("lead", "cls"))
            postings = differ.select(F.explode("paths").alias("path"), "lead", "cls", "n", "d", "places").select("path", "lead", "cls", "n", "d", F.inline("places"))
        labels = components(links.union(labels), scratch)
    return labels
