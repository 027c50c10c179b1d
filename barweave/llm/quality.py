"""A quality classifier by attention over passages.

A document is a bag of passages and only the document has a label. Each passage is encoded by its words and runs of bytes,
hashed, by what kinds of characters follow each other and how its words repeat, through a learned layer; gated attention weighs the passages, and their
weighted mean is scored. Training runs on a bounded sample of labelled rows, scoring over all passages of every text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import held_out, releasing

#: Bytes of a passage, kinds of characters, cells that words and runs of three bytes are hashed to, further features.
PASSAGE, KINDS, WORDS, GRAMS, EXTRA = 400, 16, 128, 128, 6
DIM = KINDS * KINDS + WORDS + GRAMS + EXTRA
#: Learning documents of either label, about, and passages that those of one label may have together.
PER_LABEL, LABEL_PASSAGES = 1200, 1 << 14
HIDDEN, GATE, STEPS, RATE, DECAY = 32, 16, 220, 0.02, 1e-3
THRESHOLD = 0.7


def _kinds() -> np.ndarray:
    table = np.full(256, 14, dtype=np.uint8)
    for kind, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r\t\v\f", ".", ",", "!?", "'\"-()", "*#%&$@^~+=", "|/\\_<>{}[]`", ":;")):
        for c in chars:
            table[ord(c)] = kind
    table[0x80:0xA0], table[0xA0:0xC0], table[0xC0:] = 13, 0, 12
    return table


_KIND = _kinds()
#: Where the hashed words and byte runs begin among the features.
_WORD, _GRAM = KINDS * KINDS, KINDS * KINDS + WORDS
_PLACE = np.random.default_rng(11).integers(1, 2**32, 64, dtype=np.uint32) | np.uint32(1)


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of some texts, and each text's number of passages; an empty text has one."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    n = np.maximum(1, lengths // PASSAGE)
    first = np.cumsum(n) - n
    total = int(n.sum())
    out = np.zeros((total, DIM), dtype=np.float32)
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if not len(raw):
        return out, n
    text = np.repeat(np.arange(len(texts)), lengths)
    offset = np.arange(len(raw)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    passage = first[text] + np.minimum(offset // PASSAGE, n[text] - 1)
    size = np.bincount(passage, minlength=total)
    kind = _KIND[raw].astype(np.int64)
    both = passage[1:] == passage[:-1]
    pair = (passage[:-1] * (KINDS * KINDS) + kind[:-1] * KINDS + kind[1:])[both]
    counts = np.bincount(pair, minlength=total * KINDS * KINDS).reshape(total, -1)
    out[:, : KINDS * KINDS] = np.sqrt(counts / np.maximum(1, size)[:, None])
    if len(raw) > 2:
        gram = raw[:-2].astype(np.uint32) * _PLACE[0] + raw[1:-1].astype(np.uint32) * _PLACE[1] + raw[2:].astype(np.uint32) * _PLACE[2]
        inside = passage[2:] == passage[:-2]
        cell = (passage[2:] * GRAMS + (gram >> np.uint32(25)).astype(np.int64))[inside]
        counts = np.bincount(cell, minlength=total * GRAMS).reshape(total, -1)
        out[:, _GRAM : _GRAM + GRAMS] = np.sqrt(counts / np.maximum(1, size)[:, None])
    # Words, and whether they repeat the last or the one before it.
    blank = (kind == 3) | (kind == 4)
    begins = ~blank
    begins[1:] &= blank[:-1] | (text[1:] != text[:-1])
    starts = np.flatnonzero(begins)
    if len(starts):
        word = np.cumsum(begins) - 1
        letters = (raw.astype(np.uint32) + np.uint32(1)) * _PLACE[(np.arange(len(raw)) - starts[np.maximum(word, 0)]) & 63]
        letters[blank] = 0
        hashes = np.add.reduceat(letters, starts)
        of, doc = passage[starts], text[starts]
        words = np.maximum(1, np.bincount(of, minlength=total))
        cell = of * WORDS + (hashes.astype(np.uint32) * _PLACE[3] >> np.uint32(25)).astype(np.int64)
        out[:, _WORD : _WORD + WORDS] = np.sqrt(np.bincount(cell, minlength=total * WORDS).reshape(total, -1) / words[:, None])
        for k, column in ((1, 0), (2, 1)):
            again = np.zeros(len(starts))
            again[k:] = (hashes[k:] == hashes[:-k]) & (doc[k:] == doc[:-k])
            out[:, DIM - EXTRA + column] = np.bincount(of, weights=again, minlength=total) / words
        upper = np.bincount(of, weights=(kind[starts] == 1), minlength=total)
        out[:, -4] = upper / words
        out[:, -3] = np.log1p(np.bincount(of, minlength=total)) / 5
        out[:, -2] = np.bincount(passage, weights=~blank, minlength=total) / words / 10
    out[:, -1] = np.log1p(size) / 8
    return out, n


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def _forward(self, x: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        p, first = self.p, np.cumsum(n) - n
        h = np.tanh(x @ p["w"] + p["wb"])
        t, g = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = (t * g) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), n))
        a = e / np.repeat(np.add.reduceat(e, first), n)
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "s": _sigmoid(z @ p["c"] + p["cb"])}

    def _slopes(self, x: np.ndarray, n: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted log loss to each parameter."""
        p, f, first = self.p, self._forward(x, n), np.cumsum(n) - n
        d = ((f["s"] - y) * weight).astype(x.dtype)  # to the score before its sigmoid
        grad = {"c": f["z"].T @ d, "cb": d.sum(keepdims=True)}
        dz = np.repeat(d[:, None] * p["c"], n, axis=0)
        da = (dz * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, first), n))
        grad["a"] = (f["t"] * f["g"]).T @ de
        dt = de[:, None] * p["a"] * f["g"] * (1 - f["t"] ** 2)
        dg = de[:, None] * p["a"] * f["t"] * f["g"] * (1 - f["g"])
        grad["v"], grad["u"] = f["h"].T @ dt, f["h"].T @ dg
        dh = (f["a"][:, None] * dz + dt @ p["v"].T + dg @ p["u"].T) * (1 - f["h"] ** 2)
        grad["w"], grad["wb"] = x.T @ dh, dh.sum(axis=0)
        return grad

    def _inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6).astype(np.float32)

    def score(self, texts: list[bytes]) -> np.ndarray:
        x, n = passages(texts)
        return self._forward(self._inputs(x), n)["s"].astype(np.float64)


def train(x: np.ndarray, n: np.ndarray, y: np.ndarray) -> Model:
    """Full-batch Adam on the log loss, both labels of equal weight."""
    rng = np.random.default_rng(3)
    shapes = {"w": (DIM, HIDDEN), "wb": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,), "cb": (1,)}
    p = {k: (rng.standard_normal(s) / np.sqrt(s[0]) if k not in ("wb", "cb") else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
    model = Model(x.mean(axis=0), np.maximum(x.std(axis=0), 0.02), p)
    x = model._inputs(x)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum())).astype(np.float32)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        grad = model._slopes(x, n, y, weight)
        for k in p:
            g = grad[k] + (DECAY * p[k] if k not in ("wb", "cb") else 0)
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            p[k] -= (RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model | float:
    """A model from a sample of the rows (id, text) with a quality label; a constant score if one label is missing.

    About ``per_label`` documents of either label come, with features of all their passages, to the driver: whole ones in
    the order of the draw, without those that would exceed ``LABEL_PASSAGES`` passages of their label. Equal rows count
    once, texts of a repeated id each. Several labels of an id count as the least, null ones and those of no document not
    at all. With one label only the score is 1 if that is good, else 0; without any it is 1.
    """
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg((F.min("quality") > 0).alias("good"))
    labels = labels.where(~held_out(F.col("label_id")))
    draw = F.pmod(F.xxhash64("id", "text", F.lit("quality")), F.lit(1 << 30)) / float(1 << 30)
    size = F.greatest(F.lit(1), F.floor(F.coalesce(F.octet_length("text"), F.lit(0)) / PASSAGE))
    # Texts stay where they are until it is known which are learned from: ids, draws and sizes move alone.
    labelled = docs.select("id", draw.alias("draw"), size.alias("n")).join(labels, F.col("id") == F.col("label_id")).select("id", "draw", "n", "good")
    n = {r["good"]: r["count"] for r in labelled.groupBy("good").count().collect()}
    if len(n) < 2:
        return 0.0 if n and not next(iter(n)) else 1.0
    sample = labelled.where(F.col("draw") < F.when(F.col("good"), per_label / n[True]).otherwise(per_label / n[False]))
    # However the draw falls, no more than four times the rows asked for come.
    drawn = sample.groupBy("good", "draw").agg(F.max("n").alias("n"), F.collect_set("id").alias("ids")).orderBy("draw", "good").limit(4 * per_label).collect()
    room, learned = {True: LABEL_PASSAGES, False: LABEL_PASSAGES}, []
    for r in drawn:
        if r["n"] <= room[r["good"]]:
            room[r["good"]] -= r["n"]
            learned += [(i, r["draw"], r["good"]) for i in r["ids"]]
    chosen = docs.sparkSession.createDataFrame(learned, labelled.select("id", "draw", "good").schema)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                x, n = passages([(t or "").encode("utf-8", "surrogatepass") for t in part.column(0).to_pylist()])
                rows = [bag.astype(np.float16).tobytes() for bag in np.split(x, np.cumsum(n)[:-1])]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(rows, pa.binary())], names=["good", "x"])

    texts = docs.select("id", "text", draw.alias("draw")).join(F.broadcast(chosen), ["id", "draw"])
    rows = texts.groupBy("good", "draw").agg(F.max("text").alias("text")).select("text", "good")
    rows = rows.mapInArrow(releasing(run), "good boolean, x binary").collect()
    rows = sorted(rows, key=lambda r: (r["good"], bytes(r["x"])))
    if len({r["good"] for r in rows}) < 2:
        return 1.0 if not rows or rows[0]["good"] else 0.0
    bags = [np.frombuffer(r["x"], np.float16).reshape(-1, DIM).astype(np.float32) for r in rows]
    return train(np.concatenate(bags), np.array([len(b) for b in bags]), np.array([r["good"] for r in rows], dtype=np.float32))


def score_column(docs: DataFrame, model: Model | float, text_col: str, name: str) -> DataFrame:
    """The table with a column ``name`` of scores of its texts; rows and columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights
    schema = docs.select("*", F.lit(0.0).alias(name)).schema
    at = docs.columns.index(text_col)

    def run(batches):
        model = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(at).to_pylist()]
                scores = np.full(len(texts), model) if isinstance(model, float) else model.score(texts)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], names=[*part.schema.names, name])

    return docs.mapInArrow(releasing(run), schema)


def learn_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labelled rows that are not held out, and score all: (doc_id, held_out, score, predicted).

    Null and empty texts are scored as one passage without characters; without rows of both labels to learn from, all
    scores are 1 (or 0 if only the label 0 is known); null ids and repeated rows stay.
    """
    rows = docs.select("doc_id", "text")
    model = fit(rows.withColumnRenamed("doc_id", "id"), labels.select("doc_id", "quality"))
    scored = score_column(rows, model, "text", "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
