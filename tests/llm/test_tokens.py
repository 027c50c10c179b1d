"""BPE and token files against the tokenizers library, and exact round trips."""

from __future__ import annotations

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from barweave.llm import bpe, token_files
from barweave.llm.queries import tokenizer_file
from tests.llm.common import docs

WORD, BYTE = tokenizer_file("word_bpe_49k.json"), tokenizer_file("byte_bpe_50k.json")
ODD = ["", None, " ", "a", "Hello, it's 12½ o'clock", "<|endoftext|>", "x<|endoftext|>y <|startoftext|>", "<|endoftext", "ΣΑΣ ΟΔΟΣ", "İstanbul ẞ ǅ", "é é café", "a" * 3000, "ab" * 333 + "'s 'tis", "日本語 テスト", "a\x1cb\x85c\xa0d​e", "\U0001f600 ﬁ Ⅷ", "__ _a_ $$$***", "\n\n  \t x  y\r\n"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}


def test_word_bpe_equals_library(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (0, "again"), (0, "again")]
    got = bpe.encode_decode(docs(spark, rows, clash=True), WORD, ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    assert len(got) == len(rows)
    by = {}
    for (i, t), r in zip(sorted(rows, key=repr), sorted(got, key=lambda r: repr((r["doc_id"], None))), strict=False):
        by.setdefault(i, []).append(t)
    texts = dict(rows)
    for r in got:
        if r["doc_id"] is None or r["doc_id"] == 0:
            continue
        want = library[WORD].encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["n_tokens"] == len(want), texts[r["doc_id"]]
        decoded = library[WORD].decode(want, skip_special_tokens=False)
        assert r["decoded"] == decoded
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encode_decode(docs(spark, []), WORD).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aeinrst 's\n")), max_size=60))
def test_word_bpe_on_any_text(text):
    from tokenizers import Tokenizer

    global _TOKENIZER
    _TOKENIZER = globals().get("_TOKENIZER") or Tokenizer.from_file(WORD)
    ids, _ = bpe.encode_texts(WORD, [text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == _TOKENIZER.encode(text, add_special_tokens=False).ids


def test_forest_equals_single_trees():
    model, rng = bpe.load(WORD), random.Random(1)
    some = ["".join(rng.choice("thernaio") for _ in range(rng.randrange(1, 120))) for _ in range(300)]
    for w, ids in zip(some, model.encode_words(some), strict=True):
        assert ids == model._merge_long(model._symbols(w).tolist()), w


def test_segment_tree_finds_leftmost_least():
    rng = random.Random(3)
    ranks = [rng.randrange(5) for _ in range(37)]
    tree = bpe.SegmentTree(list(ranks))
    for _ in range(60):
        assert tree.leftmost() == ranks.index(min(ranks))
        i = rng.randrange(37)
        ranks[i] = rng.randrange(9)
        tree.put(i, ranks[i])


@pytest.mark.parametrize("n", [0, 1, 2, 239, 240, 241, 5000])
@pytest.mark.parametrize("kind", range(6))
def test_pack_round_trip(n, kind):
    rng = np.random.default_rng(n + kind)
    ids = [rng.integers(0, 50257, n), rng.integers(0, 2, n), np.zeros(n), rng.integers(0, 2**62, n), 2 ** rng.integers(0, 63, n), rng.integers(0, 2**63, n) * (rng.random(n) < 0.1)][kind].astype(np.uint64)
    file = token_files.pack(ids)
    assert (token_files.unpack(file) == ids).all() and len(token_files.unpack(file)) == n
    if n > 480:
        assert (token_files.unpack(file, 1, 3) == ids[240:720]).all()
        assert len(token_files.unpack(file, 3, 3)) == 0


def test_damaged_files_are_refused():
    file = token_files.pack(np.arange(100, dtype=np.uint64))
    for bad in (b"", b"nope" + file[4:], file[:-1]):
        with pytest.raises(ValueError):
            token_files.unpack(bad)


def test_files_of_documents(spark, library, monkeypatch):
    rng = random.Random(2)
    rows = [(i * 3, t) for i, t in enumerate(ODD)] + [(1000 - i, " ".join(rng.choice(["alpha", "beta,", "Γ", "12"]) for _ in range(rng.randrange(60)))) for i in range(200)]
    rng.shuffle(rows)
    got = sorted(token_files.round_trip(docs(spark, rows, clash=True), BYTE, 2).collect())
    start = 0
    for (i, t), r in zip(sorted(rows), got, strict=True):
        ids = library[BYTE].encode(t or "", add_special_tokens=False).ids + [2]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (i, start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert token_files.round_trip(docs(spark, []), BYTE, 2).count() == 0


def test_long_white_space_in_files(spark, library):
    n = 2_000_000
    texts = ["x" + " " * n + "y", "\n" * n, "a" + " \n" * (n // 2) + "\u3000", " " * n + "<|endoftext|>" + "\t" * n + "'s"]
    got = {r["doc_id"]: r for r in token_files.round_trip(docs(spark, list(enumerate([*texts, "short"]))), BYTE, 2).collect()}
    for i, t in enumerate([*texts, "short"]):
        ids = library[BYTE].encode(t, add_special_tokens=False).ids + [2]
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_white_space_just_under_the_limit_in_a_long_text(library):
    engine = token_files.encoder(BYTE)
    n = token_files.ByteBpe.LONG
    for text in [("x" + " " * (n - 1)) * 8 + "y", (" " * (n - 1) + "x") * 4 + " " * n + "y", "\n" * n + "a" + "\t" * (n - 1)]:
        began = time.perf_counter()
        got = engine.text(text).tolist()
        assert time.perf_counter() - began < 5
        assert got == library[BYTE].encode(text, add_special_tokens=False).ids


def test_split_white_space_keeps_ids(library, monkeypatch):
    monkeypatch.setattr(token_files.ByteBpe, "LONG", 3)
    split, rng = token_files.encoder.__wrapped__(BYTE), random.Random(12)
    stock = [" ", " ", "\n", "\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "a", "é", "1", "!", "'s", "<|endoftext|>", "<|endof"]
    for _ in range(1500):
        text = "".join(rng.choice(stock) * rng.choice([1, 1, 2, 5]) for _ in range(rng.randrange(1, 14)))
        assert split.text(text).tolist() == library[BYTE].encode(text, add_special_tokens=False).ids, repr(text)


def test_null_and_repeated_ids_in_files(spark):
    got = sorted(token_files.round_trip(docs(spark, [(None, "a b"), (7, "b"), (7, "a"), (7, "a")]), BYTE, 2).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 7, 7, 7] and [r["start"] for r in got] == [0, 3, 5, 7]


def every_code_point():
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for a in range(0, len(points), 20_000):
        yield points[a : a + 20_000]


def test_byte_bpe_equals_library_on_every_code_point(library):
    fast = token_files.encoder(BYTE)
    assert type(fast) is token_files.ByteBpe
    for points in every_code_point():
        texts = [f"a{c}1{c}b {c} {c}  {c}!{c}'{c}" for c in map(chr, points)]
        got = library[BYTE].encode_batch_fast(texts, add_special_tokens=False)
        assert [hex(c) for c, t, e in zip(points, texts, got, strict=True) if fast.text(t).tolist() != e.ids] == []


def test_byte_bpe_equals_library_on_every_token_and_long_runs(library):
    fast, letters = token_files.encoder(BYTE), {c: b for b, c in enumerate(bpe.byte_letters())}
    raws = [bytes(letters[c] for c in t) for t in library[BYTE].get_vocab() if t != "<|endoftext|>"]
    texts = [r.decode() for r in raws if r.decode("utf-8", "ignore").encode() == r]
    texts += [f"x{c * 1_000_000}y" for c in (" ", "a", "1", "!", "\n", "é")] + ["ab " * 200_000, "'s" * 200_000, "<|endoftext|>" * 20_000]
    got = library[BYTE].encode_batch_fast(texts, add_special_tokens=False)
    assert [t[:9] for t, e in zip(texts, got, strict=True) if fast.text(t).tolist() != e.ids] == []


@pytest.mark.parametrize("change", ["prefix", "normalizer", "order", "flag", None])
def test_files_of_other_kinds_go_to_the_library(tmp_path, change):
    import json

    spec = json.load(open(BYTE, encoding="utf-8"))
    if change == "prefix":
        spec["pre_tokenizer"]["add_prefix_space"] = True
    elif change == "normalizer":
        spec["normalizer"] = {"type": "Lowercase"}
    elif change == "order":
        spec["model"]["merges"][10:12] = spec["model"]["merges"][11:9:-1]
    elif change == "flag":
        spec["added_tokens"][0]["rstrip"] = True
    path = str(tmp_path / "t.json")
    json.dump(spec, open(path, "w", encoding="utf-8"))
    from tokenizers import Tokenizer

    got = token_files.encoder(path)
    assert (type(got) is token_files.ByteBpe) == (change is None)
    want = Tokenizer.from_file(path)
    for t in ("Hello There<|endoftext|>  friend", "a b"):
        assert got.texts([t, None], 2)[0].tolist() == [*want.encode(t, add_special_tokens=False).ids, 2]


def test_word_bpe_equals_library_on_every_code_point(library):
    for points in every_code_point():
        texts = [f"a{c}1{c}b {c}" for c in map(chr, points)]
        want = library[WORD].encode_batch_fast(texts, add_special_tokens=False)
        got = bpe.encode_texts(WORD, texts)
        assert [hex(c) for c, g, e in zip(points, got, want, strict=True) if np.frombuffer(g[0], "<u4").tolist() != e.ids] == []
