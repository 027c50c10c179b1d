"""Language identification against plain formulas, one text and one n-gram at a time."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barweave.llm import language
from barweave.llm.common import documents, held_out
from tests.llm.common import docs

SF = "/root/testdata/sf0.001"
ODD = ["École ÀÉÎ, don't!", "ß ÿ × ÷", "日本 語", "a", "ab" * 700, "İstanbul Ğ", "x" * 40 + "\n\n" + "Y" * 40]


def plain_features(text):
    """Square roots of the counts of hashed n-grams of 1 to 4 folded bytes, of length one."""
    raw = []
    for b in text.encode():
        c = chr(b).lower() if b < 128 else ""
        raw.append(ord(c) if c.isalpha() else b if b >= 128 or b == 39 else 32)
    raw = [b + 32 if k and raw[k - 1] == 0xC3 and 0x80 <= b <= 0x9E else b for k, b in enumerate(raw)]
    counts = Counter()
    for k in range(len(raw)):
        h = 0
        for n, b in enumerate(raw[k : k + 4]):
            h = ((h ^ ((b + 1) * int(language._MUL[n]) % 2**32)) * 0x9E3779B1) % 2**32
            counts[h >> (32 - language.DIM_BITS)] += 1
    norm = math.sqrt(sum(counts.values()))
    return {k: math.sqrt(c) / norm for k, c in counts.items()}


def plain_prediction(model, text):
    """The family of the largest margin, and in it the language of the most votes of its pairs."""
    x = plain_features(text)
    margin = lambda j: sum(v * float(model.weights[k, j]) for k, v in x.items()) + float(model.weights[-1, j])
    squash = lambda m: 1 / (1 + math.exp(-4 * m))
    families = {f: margin(j) for j, f in enumerate(model.families)}
    best = max(families, key=families.get)
    inside = [a for a, lang in enumerate(model.langs) if language.family(lang) == best]
    votes, sums = Counter(), Counter()
    for j, (a, b) in enumerate(model.pairs):
        if a in inside:
            m = margin(len(families) + j)
            votes[a if m >= 0 else b] += 1
            sums[a] += math.tanh(m)
            sums[b] -= math.tanh(m)
    chosen = max(inside, key=lambda a: (votes[a] + 1e-3 * sums[a], -a))
    score = (squash(families[best]) if len(families) > 1 else 1.0) * (squash(sums[chosen] / (len(inside) - 1)) if len(inside) > 1 else 1.0)
    close = sorted(families.values())[-2:]
    return model.langs[chosen], score, len(close) > 1 and close[1] - close[0] < 1e-5


def test_counts_equal_plain_ones():
    got = language.features([t.encode() for t in ODD])
    for text, row in zip(ODD, got, strict=True):
        want = plain_features(text)
        assert set(np.flatnonzero(row)) == set(want)
        assert all(row[k] == pytest.approx(v, abs=1e-6) for k, v in want.items()), text


def test_predictions_of_whole_tables_equal_plain_ones(spark):
    d = documents(spark, SF).select("doc_id", "text", "lang")
    table = d.union(docs(spark, [(10**6 + k, t) for k, t in enumerate(ODD)]).select("doc_id", "text", F.lit(None).cast("string").alias("lang")))
    model = language.fit(table.where(~held_out(F.col("doc_id"))).withColumnRenamed("doc_id", "id"))
    got = {r["doc_id"]: r for r in language.learn_and_identify(table).collect()}
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    assert set(got) == set(texts) and len(model.pairs) > 0 and len(model.families) > 1
    for i, text in texts.items():
        if not text or not any(map(str.isalpha, text)):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        lang, score, close = plain_prediction(model, text)
        assert close or (got[i]["lang_pred"] == lang and got[i]["score"] == pytest.approx(score, abs=1e-4)), (i, lang, got[i])


def test_machines_reach_the_least_loss():
    """Squared hinge loss with a ridge is convex: many small plain steps end where the fast ones do."""
    rng = np.random.default_rng(1)
    x = np.abs(rng.normal(size=(90, 12)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=90) > 0.3, 1.0, -1.0)
    weight, z = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum()), np.hstack([x, np.ones((90, 1))])
    loss = lambda w: (weight * np.maximum(0, 1 - y * (z @ w)) ** 2).sum() + language.RIDGE / 2 * (w @ w)
    w = np.zeros(13)
    for _ in range(40_000):
        w -= 0.2 * (z.T @ (-2 * weight * y * np.maximum(0, 1 - y * (z @ w))) + language.RIDGE * w)
    fast = language.fit_svm(x.astype(np.float32), y.astype(np.float32)).astype(float)
    assert loss(w) <= loss(fast) + 1e-9 and loss(fast) - loss(w) < 2e-3 * (loss(np.zeros(13)) - loss(w))
