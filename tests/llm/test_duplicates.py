"""N-gram Jaccard join and substring dedup against brute force."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest

from barweave.llm import graph, jaccard, substrings
from barweave.llm.common import Scratch
from tests.llm.common import docs, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def check(spark, rows, clash=False):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs(spark, rows, clash)).collect()}
    want = brute(rows)
    assert got == want, [(i, got.get(i), want[i]) for i in want if got.get(i) != want[i]][:5]
    return got


def test_edges_of_documents(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  B"), (6, "a b c d e"), (7, "a\x0bb C d E"), (8, "é b c d e"), (9, "É b c d e"), (10, "a b"), (11, "x " * 9)]
    check(spark, rows, clash=True)


def test_similarity_of_just_eight_tenths(spark):
    base = [f"w{i}" for i in range(44)]  # 40 shingles
    rows = [(1, " ".join(base))]
    for i, cut in enumerate((36, 35), start=2):  # 32 of 40, then 31
        rows.append((i * 10, " ".join(base[:cut])))
    got = check(spark, rows)
    assert got[20][1] == 1


def test_chains_hot_groups_and_shared_passages(spark):
    rng = random.Random(5)
    base, rows = [f"b{rng.randrange(3000)}" for _ in range(110)], []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(110)] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, rows[3][1]) for i in range(60)]  # exact copies
    line = words(rng, 40)
    rows += [(300 + i, words(rng, rng.randrange(20, 60)) + " " + line) for i in range(120)]
    step = [f"c{i}" for i in range(200)]
    for i in range(12):  # neighbours link, ends don't
        rows.append((600 + i, " ".join(step[i * 6 : i * 6 + 100])))
    rng.shuffle(rows)
    check(spark, rows)


def edited(rng, base, edits, stock=10**6):
    w = list(base)
    for k in rng.sample(range(len(w)), edits):
        w[k] = f"z{rng.randrange(stock)}"
    return " ".join(w)


@pytest.mark.parametrize("seed", [1])
def test_groups_of_many_classes_with_texts_just_below_the_threshold(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "MANY", 12)  # leaders, and leaders among their differences
    rng = random.Random(seed)
    rows = []
    for base in ([f"a{rng.randrange(3000)}" for _ in range(64)], [f"b{rng.randrange(3000)}" for _ in range(49)]):
        rows += [edited(rng, base, rng.choice([0, 1, 1, 1, 2, 2, 3, 4])) for _ in range(110)]
        # Few words to choose from: many copies share their edits, and link over them without being similar to the base.
        rows += [edited(rng, base, rng.choice([2, 3]), 3) for _ in range(60)]
        rows += [" ".join(base[: rng.randrange(40, len(base))]) for _ in range(20)]
        rows += [" ".join(base[k:] + [f"n{seed}{j}" for j in range(k)]) for k in range(1, 14)]
    rng.shuffle(rows)
    check(spark, list(enumerate(rows)))


def test_many_texts_of_one_passage_and_little_else(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MANY", 8)
    rng = random.Random(4)
    lines = [words(rng, 45), words(rng, 30), words(rng, 30)]
    rows = [" ".join([lines[0], *(f"u{rng.randrange(50)}" for _ in range(rng.randrange(16)))]) for _ in range(120)]
    rows += [" ".join([*rng.sample(lines[1:], 2), *(f"u{rng.randrange(50)}" for _ in range(rng.randrange(16)))]) for _ in range(120)]
    check(spark, list(enumerate(rows)))


def test_all_texts_of_a_repeated_id_link(spark):
    rng = random.Random(12)
    for _ in range(3):
        t, u, v = words(rng, 60), words(rng, 60), words(rng, 60)
        got = {(r["doc_id"], r["component_id"]) for r in jaccard.join(docs(spark, [(1, t), (2, u), (2, t), (3, v), (4, v), (4, u), (5, words(rng, 60)), (None, v)])).collect()}
        assert {c for i, c in got if i in (1, 2, 3, 4)} == {1} and (5, 5) in got and (None, None) in got


def test_long_sets_of_just_eight_tenths(spark):
    rows = []
    for k in range(3):  # 80,000 of 100,000 shingles
        w = [f"{k}v{i}" for i in range(100_004)]
        rows += [(10 * k, " ".join(w)), (10 * k + 1, " ".join(w[:80_004])), (10 * k + 2, " ".join(w[20_001:]))]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(docs(spark, rows)).collect()}
    assert got == {i: i // 10 * 10 if i % 10 < 2 else i for i, _ in rows}


def test_repeated_rows_null_ids_and_empty_table(spark):
    long = " ".join(f"w{i}" for i in range(50))
    got = jaccard.join(docs(spark, [(5, long), (5, long), (9, long), (None, long), (7, "other text of five words")])).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in got) == [(0, 46, 0), (5, 46, 5), (5, 46, 5), (7, 1, 7), (9, 46, 5)]
    assert jaccard.join(docs(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(500, x) for x in range(501, 560)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "t")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {x: find(x) for x in parent}


# -- substrings


def shared_windows(rows, n=50):
    seen = {}
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - n + 1):
            seen.setdefault(tuple(w[k : k + n]), set()).add(i)
    return {i for s in seen.values() if len(s) > 1 for i in s if i != min(s)}


def cut(spark, rows, clash=False):
    return {r["doc_id"]: r for r in substrings.dedup(docs(spark, rows, clash)).collect()}


def test_planted_passages_go_and_clean_texts_stay(spark):
    rng = random.Random(8)
    passages = [words(rng, n, 10**6) for n in (51, 60, 80, 200)]
    short = words(rng, 30, 10**6)
    rows = []
    for i in range(80):
        parts = [words(rng, rng.randrange(30, 200), 10**6)]
        if i % 2:
            parts += [passages[i % 4], words(rng, rng.randrange(0, 90), 10**6)]
        if i % 5 == 0:
            parts.insert(0, short)
        rows.append((i, " ".join(parts)))
    got = cut(spark, rows, clash=True)
    want = shared_windows(rows)
    assert {i for i, r in got.items() if r["n_removed"]} == want
    assert not shared_windows([(i, r["text"]) for i, r in got.items()])
    for i, t in rows:
        if i not in want:
            assert got[i]["text"] == t and not got[i]["spans"]
        else:
            raw, gone = t.encode(), got[i]["spans"]
            assert "".join(raw[a:b].decode() for a, b in zip([0, *(s["stop"] for s in gone)], [*(s["start"] for s in gone), len(raw)])) == got[i]["text"]
            assert any(p.split()[10:-10] == raw[s["start"] : s["stop"]].decode().split()[10 : len(p.split()) - 10] for s in gone for p in passages)


def test_exact_copies_and_repeats_within(spark):
    rng = random.Random(9)
    long, line = words(rng, 120, 10**6), words(rng, 55, 10**6)
    got = cut(spark, [(4, long), (2, long), (9, line + "\n" + line + "\n" + line), (11, None), (12, ""), (None, long), (13, "é" * 5000), (14, "é" * 5000), (15, "x " * 3000), (16, "x " * 3000)])
    assert got[2]["text"] == long and got[4]["text"] == "" and got[4]["n_removed"] == 120
    assert got[9]["n_removed"] == 0 and got[11]["text"] is None and got[12]["text"] == "" and got[None]["text"] == long
    assert got[14]["n_removed"] == 0  # one word
    assert got[15]["n_removed"] == 0 and got[16]["n_removed"] == 3000
    assert substrings.dedup(docs(spark, [])).count() == 0


def test_repeated_rows_of_an_id(spark):
    rng = random.Random(10)
    long = words(rng, 90, 10**6)
    rows = substrings.dedup(docs(spark, [(1, long), (1, long), (3, long), (3, long)])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in rows) == [(1, 0), (1, 0), (3, 90), (3, 90)]


def brute_cut(rows, n=50):
    """By id: each text without the windows of n words, white space between them included, that an earlier id has."""
    first, places = {}, []
    for i, t in rows:
        raw = (t or "").encode()
        at = [m.span() for m in re.finditer(rb"[^ \t-\r]+", raw)]
        keys = [raw[at[k][0] : at[k + n - 1][1]] for k in range(len(at) - n + 1)]
        places.append((i, raw, at, keys))
        for key in keys:
            first[key] = min(i, first.get(key, i))
    out = {}
    for i, raw, at, keys in places:
        gone = bytearray(len(raw))
        words_gone = set()
        for k, key in enumerate(keys):
            if first[key] < i:
                gone[at[k][0] : at[k + n - 1][1]] = b"\1" * len(key)
                words_gone.update(range(k, k + n))
        out[i] = (bytes(b for b, g in zip(raw, gone, strict=True) if not g).decode(), len(words_gone))
    return out


def check_cut(spark, rows):
    got = {i: (r["text"] or "", r["n_removed"]) for i, r in cut(spark, rows).items()}
    want = brute_cut(rows)
    assert got == want, [(i, got[i], want[i]) for i in want if got[i] != want[i]][:3]
    return got


def test_shifted_periodic_passages(spark):
    rng = random.Random(21)
    rows = []
    for line in ("x", "la la", "all rights reserved by us", "2 4 6", words(rng, 12)):
        for _ in range(6):
            n = rng.randrange(50, 300)
            repeat = (f"{line} " * n).split()[:n]
            rows.append((len(rows), " ".join([words(rng, rng.randrange(1, 40), 10**6), *repeat, words(rng, rng.randrange(1, 40), 10**6)])))
    got = check_cut(spark, rows)
    assert sum(n > 0 for _, n in got.values()) >= 20


def test_short_repeats_of_several_documents_are_no_passage(spark):
    rng = random.Random(22)
    lines = [words(rng, 8 + i % 8, 10**6) for i in range(40)]
    rows = [(i, f"{words(rng, 30, 10**6)} {line} {words(rng, 30, 10**6)}") for i, line in enumerate(lines)]
    rows += [(100 + i, " ".join(rng.sample(lines, 12))) for i in range(10)]
    long = [words(rng, 60, 10**6) for _ in range(3)]
    rows += [(50 + i, t) for i, t in enumerate(long)] + [(200, " ".join([*long, lines[0], lines[1]])), (201, "q " + long[0] + " " + long[2])]
    got = check_cut(spark, rows)
    assert not any(got[i][1] for i in range(100, 110)) and got[200][1] == 180 and got[201][1] == 120


@pytest.mark.parametrize("letters", [1, 2, 4])
def test_passages_of_short_words(spark, letters):
    rng = random.Random(23 + letters)
    some = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(letters)) for _ in range(n))
    passages = [some(50) for _ in range(150)]
    rows = [(i, f"{some(20)} {p}\n{some(9)}") for i, p in enumerate(passages)] + [(1000 + i, f"{some(7)}\t{p} {some(30)}") for i, p in enumerate(passages)]
    got = check_cut(spark, rows)
    assert all(got[1000 + i][1] >= 50 for i in range(150))


def test_windows_of_any_texts_equal_brute_force(spark):
    rng = random.Random(24)
    stock = ["a", "b", "é", "日本", "long-word" * 9, " ", "\t", "\r\n", "\x0b", " \x0c "]
    rows = [(i, "".join(rng.choice(stock[:5]) + rng.choice([" ", " ", " ", *stock[5:]]) for _ in range(rng.randrange(130)))) for i in range(40)]
    rows += [(100 + i, rows[i][1][rng.randrange(9) :] + rng.choice(["", " ", " c"]) + rows[i + 1][1]) for i in range(30)]
    check_cut(spark, rows)
    raws = [t.encode() for _, t in rows]
    whole, each = substrings.windows(raws), [substrings.windows([r]) for r in raws]
    assert all((np.concatenate([e[k] for e in each]) == whole[k]).all() for k in (1, 2, 4, 5))


def test_copies_are_settled_by_stretches(spark, monkeypatch):
    rng = random.Random(14)
    texts = [words(rng, 300, 10**6) for _ in range(6)]
    rows = [(k, texts[k % 6]) for k in range(120)]
    rows += [(120 + k, f"{words(rng, 20, 10**6)} {texts[k]} {words(rng, 20, 10**6)}") for k in range(6)]
    rows += [(130 + k, "tick tock " * n) for k, n in enumerate((900, 1500, 900, 20))]
    moved, inner = [], substrings._marked_windows

    def counted(*args):
        out = inner(*args)
        moved.append(out.count())
        return out

    monkeypatch.setattr(substrings, "_marked_windows", counted)
    got = check_cut(spark, rows)
    assert all(got[k] == ("", 300) for k in range(6, 120)) and got[132] == (got[132][0], 1800)
    assert 0 < moved[0] < 4000  # the 120 copies have 30,120 windows, those of least id 1,506


def test_stretches_are_runs_of_one_mark():
    rng = random.Random(15)
    raws = [words(rng, n, 10**6).encode() for n in (400, 30, 90, 400)] + [b"a " * 3000]
    raws.append(b" ".join([raws[0], raws[2]]))
    text, _, _, at, key, mark = substrings.windows(raws)
    text = text[at]
    first, digest = substrings.stretches(text, key, mark)
    ends = [*first[1:].tolist(), len(mark)]
    seen = {}
    for a, b, d in zip(first.tolist(), ends, digest.tolist(), strict=True):
        assert len({(t, m) for t, m in zip(text[a:b].tolist(), mark[a:b].tolist(), strict=True)}) == 1 and b - a <= substrings.STRETCH
        assert seen.setdefault(d, key[a:b].tolist()) == key[a:b].tolist()
    assert len({tuple(k) for k in seen.values()}) == len(seen)
    inside = lambda k: set(digest[text[first] == k].tolist())
    assert len(inside(5) & inside(0)) >= len(inside(0)) - 1 and len(inside(5) & inside(2)) >= len(inside(2)) - 1


def test_long_words_and_white_space_in_windows(monkeypatch):
    texts = [b"a " * 60 + b"w" * n + b" " * m + b" b" * 60 for n, m in ((5000, 1), (1, 5000), (5000, 5000))]
    monkeypatch.setattr(substrings, "BLOCK", 1000)
    for t in texts:
        one, two = substrings.windows([t]), substrings.windows([b"shifted " * 3 + t])
        assert (one[4] == two[4][3:]).all() and (one[5] == two[5][3:]).all() and len(set(one[4].tolist())) > 49


def test_chunks_resist_shifts():
    rng = random.Random(11)
    width = 11
    hashes = lambda n: np.array([rng.randrange(1 << 64) for _ in range(n)], dtype=np.uint64)
    h = hashes(3000)
    parts = lambda x: {x[a + 1 : b + 1].tobytes() for ends in [substrings.chunk_ends(substrings.gear(x), width).tolist()] for a, b in zip(ends, ends[1:])}
    a, b = parts(h), parts(np.concatenate([hashes(2), h[:1000], hashes(3), h[1000:]]))
    assert len(a - b) <= 8 and len(a) > 400
    plain = [sum(int(h[k - t]) << (8 * t) for t in range(min(k + 1, 8))) % (1 << 64) for k in range(len(h))]
    assert substrings.gear(h).tolist() == plain
    want = {max(range(k, k + width), key=lambda p: (-plain[p], p)) for k in range(len(h) - width + 1)}
    assert substrings.chunk_ends(substrings.gear(h), width).tolist() == sorted(want)
    assert np.diff(sorted(want)).max() <= width


def test_marks_are_of_chunks_that_a_window_decides_alone():
    rng = random.Random(12)
    for stock in (3, 10**6):
        h = np.array([hash((stock, rng.randrange(stock))) % (1 << 64) for _ in range(400)], dtype=np.uint64)
        got = substrings._chunk_marks(h, 49)
        assert (got == np.concatenate([substrings._chunk_marks(h[k : k + 49], 49) for k in range(len(h) - 48)])).all()


def test_common_passages_of_one_task_are_known_before_the_shuffle():
    told = substrings._Told("key", False)
    told.add(np.array([3, 3, 1, 2, 2, 5]), np.array([7, 7, 7, 7, 9, 8], dtype=np.uint64))
    rows = sorted(zip(*told.batch().to_pydict().values(), strict=True))
    assert [(i, v, salt > 0) for i, v, salt in rows] == [(1, 7, False), (2, 7, True), (2, 9, False), (3, 7, True), (5, 8, False)]
    told = substrings._Told("mark", True)
    told.add(np.array([3, 1, 5]), np.array([7, 7, 8], dtype=np.uint64))
    assert [(i, salt > 0) for i, _, salt in sorted(zip(*told.batch().to_pydict().values(), strict=True))] == [(1, False), (1, True), (3, True), (5, False)]
