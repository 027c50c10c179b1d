"""Language identification in two steps: the family of languages, then the language within it.

Texts are counts of hashed byte n-grams. One linear support vector machine for each family against the rest picks the
family; one for each pair of its languages votes for the language. Both are trained on a bounded sample of labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import held_out

#: Dimensions of the hashed counts, lengths of the n-grams.
DIM_BITS, LENGTHS = 12, (1, 2, 3, 4)
#: Learning rows for each language and in all, about: rows whose hash is below the share that gives so many.
PER_LANGUAGE, IN_ALL = 600, 4000
#: Bytes of text counted at a time.
PIECE = 1 << 20
STEPS, RIDGE = 250, 1e-4

# Families of languages by ISO 639-1 code; any other value is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "uz"),
    "uralic": ("et", "fi", "hu"),
    "semitic": ("am", "ar", "he", "mt"),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
_MUL = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)


def family(lang: str) -> str:
    return _FAMILY.get(lang.split("-")[0].split("_")[0].lower(), f"own:{lang}")


def _folded() -> np.ndarray:
    """Bytes to what counts: lower case, letters beyond ASCII as they are, all else blank."""
    table = np.full(256, 32, dtype=np.uint8)
    for b in range(256):
        if chr(b).isascii() and chr(b).isalpha():
            table[b] = ord(chr(b).lower())
        elif b >= 128 or b == 39:
            table[b] = b
    return table


_TABLE = _folded()


def features(texts: list[bytes]) -> np.ndarray:
    """Square roots of n-gram counts, each row of length one (or zero, for a text without letters)."""
    dim = 1 << DIM_BITS
    counts = np.zeros((len(texts), dim), dtype=np.float64)
    for first, piece, lengths in _pieces(texts):
        raw = _TABLE[np.frombuffer(piece, dtype=np.uint8)]
        # Upper-case letters of the Latin-1 supplement: their second byte after 0xC3.
        upper = (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[:-1] == 0xC3)
        raw[1:][upper] += 0x20
        row = np.repeat(np.arange(len(lengths)), lengths).astype(np.int64) << DIM_BITS
        raw = raw.astype(np.uint32) + np.uint32(1)
        total = np.zeros(len(lengths) << DIM_BITS, dtype=np.int64)
        h = np.zeros(len(raw), dtype=np.uint32)
        for k in range(max(LENGTHS)):
            n = len(raw) - k
            if n <= 0:
                break
            h = (h[:n] ^ (raw[k:] * _MUL[k])) * np.uint32(0x9E3779B1)
            if k + 1 in LENGTHS:
                inside = row[:n] == row[k:]
                total += np.bincount((row[:n] + (h >> np.uint32(32 - DIM_BITS)))[inside], minlength=len(total))
        counts[first : first + len(lengths)] += total.reshape(len(lengths), dim)
    out = np.sqrt(counts)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def _pieces(texts: list[bytes]):
    """(first text, bytes, lengths) of about PIECE bytes each; a longer text comes in pieces that overlap by an n-gram."""
    held, first, size = [], 0, 0
    for i, t in enumerate(texts):
        if len(t) > PIECE:
            if held:
                yield first, b"".join(held), [len(x) for x in held]
            for a in range(0, len(t), PIECE):
                part = t[max(0, a - max(LENGTHS) + 1) : a + PIECE]
                yield i, part, [len(part)]
            held, first, size = [], i + 1, 0
            continue
        if size + len(t) > PIECE:
            yield first, b"".join(held), [len(x) for x in held]
            held, first, size = [], i, 0
        held.append(t)
        size += len(t)
    if held:
        yield first, b"".join(held), [len(x) for x in held]


def fit_svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights, bias last, of a linear machine with squared hinge loss, by accelerated gradient steps; y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = v = np.zeros(x.shape[1], dtype=np.float32)
    rate = np.float32(1 / (2 * 2 * 1.05 + RIDGE))  # rows are at most sqrt(2) long
    for t in range(STEPS):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - rate * (x.T @ (-2 * weight * y * slack) + RIDGE * v)
        v = new + np.float32(t / (t + 3)) * (new - w)
        w = new
    return w


@dataclass
class Model:
    langs: list[str]
    families: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray  # (dimensions + 1) x (families + pairs)

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        x = features(texts)
        margins = x @ self.weights[:-1] + self.weights[-1]
        of = [self.families.index(family(lang)) for lang in self.langs]
        k = len(self.families)
        best = margins[:, :k].argmax(axis=1)
        certain = 1 / (1 + np.exp(-4 * margins[np.arange(len(texts)), best])) if k > 1 else np.ones(len(texts))
        votes = np.zeros((len(texts), len(self.langs)))
        sums = np.zeros_like(votes)
        for j, (a, b) in enumerate(self.pairs):
            m = margins[:, k + j]
            votes[:, a] += m >= 0
            votes[:, b] += m < 0
            sums[:, a] += np.tanh(m)
            sums[:, b] -= np.tanh(m)
        rank = votes + 1e-3 * sums
        rank[np.array(of)[None, :] != best[:, None]] = -np.inf
        lang = rank.argmax(axis=1)
        rivals = np.bincount(of, minlength=k)[best] - 1
        within = np.where(rivals > 0, 1 / (1 + np.exp(-4 * sums[np.arange(len(texts)), lang] / np.maximum(1, rivals))), 1.0)
        return [self.langs[i] for i in lang], certain * within


def train(x: np.ndarray, y: list[str]) -> Model | None:
    langs = sorted(set(y))
    if not langs:
        return None
    y = np.array(y)
    families = sorted({family(lang) for lang in langs})
    of = np.array([family(lang) for lang in y])
    columns = [fit_svm(x, np.where(of == f, 1, -1).astype(np.float32)) if len(families) > 1 else np.zeros(x.shape[1] + 1) for f in families]
    pairs = [(a, b) for a, b in combinations(range(len(langs)), 2) if family(langs[a]) == family(langs[b])]
    for a, b in pairs:
        rows = (y == langs[a]) | (y == langs[b])
        columns.append(fit_svm(x[rows], np.where(y[rows] == langs[a], 1, -1).astype(np.float32)))
    return Model(langs, families, pairs, np.stack(columns, axis=1).astype(np.float32))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, in_all: int = IN_ALL) -> Model | None:
    """A model from a sample of the rows (id, text, lang) with a language; the driver gets about ``in_all`` rows of counts."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not n:
        return None
    share = min(per_language, in_all // len(n) or 1)
    draw = F.pmod(F.xxhash64("id", "text", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)  # by row: ids may repeat, or be null
    keep = F.lit(False)
    for lang, count in n.items():
        keep = keep | ((F.col("lang") == lang) & (draw < share / count))

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                x = features([t.encode("utf-8", "surrogatepass") for t in part.column(0).to_pylist()]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])

    # Equal rows count once, and however the draw falls, no more than twice the rows asked for come.
    drawn = labelled.where(keep).select("text", "lang", draw.alias("draw")).dropDuplicates(["draw", "lang"]).orderBy("draw", "lang").limit(2 * in_all)
    rows = drawn.select("text", "lang").mapInArrow(run, "lang string, x binary").collect()
    rows = sorted(rows, key=lambda r: (r["lang"], bytes(r["x"])))  # whatever the order of the partitions
    if not rows:
        return None
    return train(np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32), [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every whole text, a row for each row.

    ``und`` with score 0 if the text is null or has no letter, or if there was nothing to learn from; null ids stay and
    repeated rows repeat. Other columns are not read.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights for each pair of languages

    def run(batches):
        model = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                texts = part.column(1).to_pylist()
                lettered = [bool(t) and any(map(str.isalpha, t)) for t in texts]
                langs, scores = ["und"] * len(texts), np.zeros(len(texts))
                if model and any(lettered):
                    at = np.flatnonzero(lettered)
                    got, scores[at] = model.predict([texts[i].encode("utf-8", "surrogatepass") for i in at])
                    for i, lang in zip(at, got, strict=True):
                        langs[i] = lang
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs), pa.array(scores)], names=["id", "lang_pred", "score"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col)


def learn_and_identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, and identify all: (doc_id, held_out, lang_pred, score)."""
    rows = docs.select("doc_id", F.col("doc_id").alias("id"), "text", "lang")
    model = fit(rows.where(~held_out(F.col("id"))))
    return identify(rows, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
