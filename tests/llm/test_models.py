"""Held-out accuracy of the classifiers, recall of the neighbour search, images."""

from __future__ import annotations

import hashlib
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barweave.llm import language, media, neighbours, quality
from barweave.llm.common import documents, held_out
from tests.llm.common import docs

SF = os.environ.get("TEST_LLM_SF_DIR", "/root/testdata/sf0.01")


def test_held_out_rows(spark):
    rows = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)


def test_quality_of_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.learn_and_score(documents(spark, SF), labels)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(labels, "doc_id").where("held_out").select("quality", "score", "predicted").collect()
    assert len(rows) > 50
    assert np.mean([r["quality"] == r["predicted"] for r in rows]) > 0.93
    bounds = got.agg(F.min("score"), F.max("score"), F.count("*")).first()
    assert 0 <= bounds[0] <= bounds[1] <= 1 and bounds[2] == documents(spark, SF).count()


def test_quality_edges(spark):
    rows = [(1, None), (2, ""), (3, "word"), (None, "x y"), (3, "word"), (4, "a" * 100_000)]
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.learn_and_score(docs(spark, rows, clash=True), none).collect()
    assert len(got) == 6 and {r["score"] for r in got} == {1.0} and {r["predicted"] for r in got} == {1}
    bad = spark.createDataFrame([(3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    assert {r["score"] for r in quality.learn_and_score(docs(spark, rows), bad).collect()} == {0.0}
    some = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    more = [(i, "clean words in a row here " * 20 if i % 2 else "BAD!! BAD!! BAD!! " * 20) for i in range(40)]
    got = quality.learn_and_score(docs(spark, more + rows[:2]), some)
    assert got.count() == 42 and quality.learn_and_score(docs(spark, []), some).count() == 0


def test_quality_learns_from_whole_texts(spark, monkeypatch):
    sizes = {i: 1 + i % 60 for i in range(200)}
    rows = [(i, "some words. " * (k * quality.PASSAGE // 12 + 1)) for i, k in sizes.items()]
    labels = spark.createDataFrame([(i, i % 2) for i in sizes], "doc_id long, quality int")
    texts = docs(spark, rows).select(F.col("doc_id").alias("id"), "text")
    learned = [r["i"] for r in spark.range(200).select(F.col("id").alias("i"), held_out(F.col("id")).alias("h")).collect() if not r["h"]]
    monkeypatch.setattr(quality, "train", lambda x, n, y: (len(x), n.tolist(), y.tolist()))
    total, n, y = quality.fit(texts, labels, 10**6)
    want = sorted(len(quality.passages([rows[i][1].encode()])[0]) for i in learned)
    assert sorted(n) == want and total == sum(want) and max(n) == 60
    # Where all don't fit, whole texts are left out, and either label stays.
    monkeypatch.setattr(quality, "LABEL_PASSAGES", 300)
    _, n, y = quality.fit(texts, labels, 10**6)
    assert all(240 < sum(k for k, v in zip(n, y, strict=True) if v == good) <= 300 for good in (0, 1)) and not set(n) - set(want)


def test_quality_moves_drawn_texts_only(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, rng.bytes(10_000).hex()) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    texts = docs(spark, rows).select(F.col("doc_id").alias("id"), "text")
    seen = []
    monkeypatch.setattr(quality, "train", lambda x, n, y: seen.append((n.tolist(), y.tolist())))
    context = spark.sparkContext._jsc.sc()

    def shuffled():
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorList(False).apply(0).totalShuffleWrite()

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where either table is large
    try:
        before = shuffled()
        quality.fit(texts, labels, 8)
        moved = shuffled() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    (sizes, good) = seen[0]
    assert set(sizes) == {50} and set(good) == {0, 1}
    # Hexadecimal digits hold half their bytes. Drawn texts move once, to their equals.
    assert 10_000 * len(sizes) < moved < 1.5 * 20_000 * len(sizes) + 100_000 < 10_000 * len(rows)


def test_quality_gradients():
    rng = np.random.default_rng(0)
    n = np.array([3, 1, 4, 2] * 5)
    y = np.array([1, 0, 1, 0] * 5, dtype=np.float32)
    x = rng.normal(0, 0.3, (n.sum(), quality.DIM)).astype(np.float32) + np.repeat(y, n)[:, None] * 0.2
    model = quality.train(x, n, y)
    x = model._inputs(x)
    score = model._forward(x, n)
    assert ((score["s"] > 0.5) == (y > 0)).all()

    def plain(p, bag):  # one document, by the formulas
        h = [np.tanh(row @ p["w"] + p["wb"]) for row in bag]
        e = np.array([(np.tanh(k @ p["v"]) / (1 + np.exp(-(k @ p["u"])))) @ p["a"] for k in h])
        a = np.exp(e) / np.exp(e).sum()
        return 1 / (1 + np.exp(-(sum(w * k for w, k in zip(a, h, strict=True)) @ p["c"] + p["cb"][0])))

    bags = np.split(x, np.cumsum(n)[:-1])
    np.testing.assert_allclose(score["s"], [plain(model.p, b) for b in bags], atol=1e-5)
    # Numeric slopes of the loss at a place where training has not ended.
    p = {k: v.astype(np.float64) + rng.normal(0, 0.05, v.shape) for k, v in model.p.items()}
    wide, weight = quality.Model(model.mean, model.scale, p), rng.random(len(n))
    x, bags = x.astype(np.float64), [b.astype(np.float64) for b in bags]
    slopes = wide._slopes(x, n, y.astype(np.float64), weight)

    def loss():
        s = np.array([plain(p, b) for b in bags])
        return -(weight * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum()

    for name, values in p.items():
        for at in {tuple(rng.integers(0, k) for k in values.shape) for _ in range(4)}:
            old, step = values[at], 1e-5
            values[at] = old + step
            up = loss()
            values[at] = old - step
            numeric = (up - loss()) / (2 * step)
            values[at] = old
            assert abs(numeric - slopes[name][at]) <= 1e-6 + 1e-4 * abs(numeric), (name, at)


def test_quality_with_one_label_left(spark):
    table = docs(spark, [(i, f"text {i}") for i in range(20)])
    gone = [(1000 + i, 1) for i in range(40)]
    for quality_, others in ((0, gone), (1, [(i, 0) for i, _ in gone])):
        labels = spark.createDataFrame([(i, quality_) for i in range(20)] + others, "doc_id long, quality int")
        assert {(r["score"], r["predicted"]) for r in quality.learn_and_score(table, labels).collect()} == {(float(quality_), quality_)}


def test_equal_rows_are_learned_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda x, n, y: seen.append(len(n)) or 0.5)
    rows = [(3, "good text here")] * 500 + [(4, "bad"), (7, "more of it"), (None, "no id")]
    labels = spark.createDataFrame([(3, 1), (4, 0), (7, 0)], "doc_id long, quality int")
    kept = [i for i in (3, 4, 7) if zlib.crc32(str(i).encode()) % 4 != 2]
    quality.fit(docs(spark, rows).select(F.col("doc_id").alias("id"), "text"), labels)
    assert seen == [len(kept)]


def test_languages_of_held_out_rows(spark):
    d = documents(spark, SF)
    got = language.learn_and_identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark):
    base = [(i, ["the thing and the word", "der die und das wort", "que el de la cosa"][i % 3] * 5, ["en", "de", "es"][i % 3]) for i in range(60)]
    odd = [(100, None, "en"), (101, "", "en"), (102, "12 !?", "en"), (103, "ß", None), (None, "the word", None), (100, None, "en"), (104, "日本", None)]
    got = language.learn_and_identify(docs(spark, base + odd, clash=True)).collect()
    assert len(got) == 67
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert und == {100, 101, 102} and all(r["score"] == 0 for r in got if r["doc_id"] in und)
    assert {r["lang_pred"] for r in got} == {"en", "de", "es", "und"}
    assert {r["lang_pred"] for r in language.learn_and_identify(docs(spark, [(1, "abc", None)])).collect()} == {"und"}
    assert {r["lang_pred"] for r in language.learn_and_identify(docs(spark, [(i, "abc", "xx") for i in range(9)])).collect()} == {"xx"}
    assert language.learn_and_identify(docs(spark, [])).count() == 0


def test_long_texts_count_as_whole():
    raw = ("the thing, " * 300_000).encode()
    one = language.features([raw, b"short"])
    assert np.abs(np.linalg.norm(one, axis=1) - 1).max() < 1e-4
    small = language.features([b"the thing, " * 3000])
    assert (one[0] * small[0]).sum() > 0.999


# -- neighbours


def exact(ids, x, k=5):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in np.flatnonzero(ids % 50 == 0):
        s = u @ u[q]
        order = [i for i in np.lexsort((ids, -s)) if i != q][:k]
        out[int(ids[q])] = [int(ids[i]) for i in order]
    return out


def search(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("cls", "rep", "vec", "rank", "score", "query")})
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in got.items()}


def test_recall(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in table]), np.array([r["embedding"] for r in table], dtype=np.float64)
    got, want = search(spark, [(int(i), v.tolist()) for i, v in zip(ids, x)]), exact(ids, x)
    assert set(got) == set(want)
    assert np.mean([len({v for _, v, _ in got[q]} & set(want[q])) / 5 for q in want]) >= 0.9
    for q, rows in got.items():
        assert [r for r, _, _ in rows] == [1, 2, 3, 4, 5]
        a = x[ids == q][0]
        for _, v, s in rows:
            b = x[ids == v][0]
            assert s == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)


def test_copies_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1, 50)]
    rows += [(i, [1.0] * 8) for i in range(50, 160)]  # a large group of copies, with queries 50, 100, 150
    rows += [(200, None), (250, [0.0] * 8), (300, [float("nan")] * 8), (350, [None] * 8), (400, [float("inf")] * 8), (450, [1.0, 2.0]), (None, [1.0] * 8), (500, [])]
    rows += [(7, rows[6][1])]  # a repeated row
    got = search(spark, rows)
    assert set(got) == {50, 100, 150}
    assert [v for _, v, _ in got[50]] == [51, 52, 53, 54, 55] and [v for _, v, _ in got[100]] == [50, 51, 52, 53, 54]
    assert all(s == pytest.approx(1) for _, _, s in got[150])


def test_many_scaled_copies_tie_to_the_smaller_id(spark):
    v = np.random.default_rng(31).standard_normal(16)
    rows = np.array([v * 2.0**i for i in range(40)])
    ids = np.arange(40)[::-1].copy()
    at, place, score = neighbours._top(np.array([v, -v]), rows, ids, 6)
    assert at.tolist() == [0] * 6 + [1] * 6 and ids[place].tolist() == [0, 1, 2, 3, 4, 5] * 2 and len(set(score.tolist())) == 2
    table = spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(ids, rows, strict=True)], "vec_id long, embedding array<double>")
    got = neighbours.search(table, F.col("vec_id") == 20, k=5).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [0, 1, 2, 3, 4]


def test_lengths_are_searched_apart(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=(8, 8, 3)[i % 3]).tolist()) for i in range(300)]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, k=5).collect()
    vecs = {i: np.array(v) for i, v in rows}
    for q in range(0, 300, 50):
        cos = sorted((-float(v @ vecs[q] / np.linalg.norm(v) / np.linalg.norm(vecs[q])), i) for i, v in vecs.items() if i != q and len(v) == len(vecs[q]))
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [i for _, i in cos[:5]]


def test_few_and_no_candidates(spark):
    assert {q: [v for _, v, _ in r] for q, r in search(spark, [(0, [1.0, 0.0]), (3, [0.0, 1.0]), (2, [1.0, 1.0])]).items()} == {0: [2, 3]}
    assert search(spark, [(0, [1.0])]) == {} and search(spark, []) == {}


def test_hilbert_curve_is_one():
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    keys = neighbours.hilbert(grid, 3)
    assert sorted(keys.tolist()) == list(range(512))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


# -- images


def test_text_images(spark):
    rows = [(1, None), (2, ""), (3, "a" * 64), (4, "a" * 65), (5, "é" * 7000), (6, "é" * 7000), (None, "x"), (3, "a" * 64)]
    images = media.text_images(docs(spark, rows, clash=True))
    stored = {(r["doc_id"], bytes(r["media"])) for r in images.collect()}
    assert {(r["doc_id"], r["media_sha256"]) for r in media.round_trip(docs(spark, rows)).collect()} == {(i, hashlib.sha256(m).hexdigest()) for i, m in stored}
    got = [{**r.asDict(), "media": m} for r in media.payload_features(images).collect() for i, m in stored if i == r["doc_id"]]
    assert len(got) == 8
    for r in got:
        raw = next(((t or "") for i, t in rows if i == r["doc_id"])).encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert r["n_bytes"] == len(raw) and r["payload_bytes"] == len(payload) and r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-64:]) and r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
        assert media.read_png(bytes(r["media"])).tobytes() == payload
        assert r["feature"] == plain_hash(np.frombuffer(payload, np.uint8).reshape(-1, 64))
    assert len({(r["feature"], r["media_sha256"]) for r in got if r["doc_id"] in (5, 6)}) == 1
    assert media.round_trip(docs(spark, [])).count() == 0


def plain_hash(image):
    """The cosine hash by its definition: an image averaged to 32 x 32, sums of cosines, bits above the median."""
    h, w = image.shape
    share = lambda n: [[max(0.0, min((k + 1) * n / 32, i + 1) - max(k * n / 32, i)) * 32 / n for i in range(n)] for k in range(32)]
    small = np.array(share(h)) @ image.astype(float) @ np.array(share(w)).T
    k = np.arange(32)
    low = np.array([[(small * np.outer(np.cos(np.pi * (2 * k + 1) * u / 64), np.cos(np.pi * (2 * k + 1) * v / 64))).sum() for v in range(8)] for u in range(8)])
    low = np.round(low, 6).ravel()
    return f"{int(''.join('01'[b] for b in (low > np.median(low[1:])).tolist()), 2):016x}"


def test_image_features_of_empty_and_clashing_tables(spark):
    good, _ = media.store_bytes(b"hello")
    rows = spark.createDataFrame([(None, bytearray(good)), (1, bytearray(good)), (1, bytearray(good))], "media_id int, media binary")
    got = media.image_features(rows.withColumns({c: F.lit("x") for c in ("id", "width", "feature", "error")})).collect()
    assert len(got) == 3 and {r["error"] for r in got} == {None}
    assert media.image_features(rows.limit(0)).count() == 0


def png(rows, width, cut=None):
    body = zlib.compress(b"".join(bytes([f]) + bytes(r) for f, r in rows))
    parts = [body] if cut is None else [body[:cut], body[cut:]]
    return media.SIGNATURE + media.chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + b"".join(media.chunk(b"IDAT", p) for p in parts) + media.chunk(b"tEXt", b"k\0v") + media.chunk(b"IEND", b"")


def test_all_filters():
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (40, 23), dtype=np.uint8)
    rows, prev = [], np.zeros(23, int)
    for y in range(40):
        f, line, out = y * 7 % 5 if y % 3 else (y // 3) % 5, image[y].astype(int), []
        for x in range(23):
            a, b, c = (line[x - 1] if x else 0), prev[x], (prev[x - 1] if x else 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((line[x] - (0, a, b, (a + b) // 2, paeth)[f]) % 256)
        rows.append((f, out))
        prev = line
    assert (media.read_png(png(rows, 23, cut=50)) == image).all()


def test_damaged_images(spark):
    good, _ = media.store_bytes(b"hello")
    flipped = bytearray(good)
    flipped[45] ^= 1
    rows = [(1, bytearray(good)), (2, flipped), (3, None), (4, bytearray(b"junk")), (5, bytearray(good[:-5])), (6, bytearray())]
    got = {r["media_id"]: r for r in media.image_features(spark.createDataFrame(rows, "media_id int, media binary")).collect()}
    assert got[1]["error"] is None and got[1]["width"] == 64 and len(got[1]["feature"]) == 16
    assert all(got[i]["error"] and got[i]["feature"] is None for i in (2, 3, 4, 5, 6))


def test_hash_is_near_for_near_images():
    rng = np.random.default_rng(3)
    across, down = ((np.arange(n) + 0.5) * np.pi / n for n in (64, 100))
    waves = [np.outer(np.cos(u * down), np.cos(v * across)) * rng.normal(0, 12) for u in range(8) for v in range(8)]
    image = np.clip(128 + sum(waves[1:]), 0, 255)
    near = np.clip(image + rng.normal(0, 3, image.shape), 0, 255)
    bits = lambda x: int(media.cosine_hash(x.astype(np.uint8)), 16)
    assert (bits(image) ^ bits(near)).bit_count() <= 8 < (bits(image) ^ bits(rng.integers(0, 256, image.shape))).bit_count()
