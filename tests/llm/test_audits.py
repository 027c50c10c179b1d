"""Source divergence, SimHash and conversation repair against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from barweave.llm import conversations, divergence, queries, simhash
from tests.llm.common import docs, words
from tests.oracle import same

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# Divergence


def plain_audit(rows, top=200):
    rows = [(lower(t), lang or "", source or "") for _, t, lang, source in rows]
    seen, counts = defaultdict(Counter), defaultdict(Counter)
    for t, lang, source in rows:
        terms = TERM.findall(t)
        seen[lang].update(set(terms))
        counts[lang, source].update(terms)
    kept = {lang: {t for t, n in c.items() if n >= 3} for lang, c in seen.items()}
    for (lang, _), c in counts.items():
        for t in [t for t in c if t not in kept[lang]]:
            del c[t]
    whole = defaultdict(Counter)
    for (lang, _), c in counts.items():
        whole[lang].update(c)
    p = lambda c, n, v: 1 + 1_000_000_000 * (c + 1) // (n + v)
    out = set()
    for (lang, source), c in counts.items():
        n, v, ln = sum(c.values()), len(kept[lang]), sum(whole[lang].values())
        parts = {"pair": {}, "term": {}}
        for other_lang, other in counts:
            if other_lang == lang and other != source:
                d = counts[lang, other]
                dn = sum(d.values())
                parts["pair"][other] = sum((p(c[t], n, v) - (q := p(d[t], dn, v))) ** 2 // q for t in kept[lang])
        for t, k in c.items():
            a, b = p(k, n, v), p(whole[lang][t], ln, v)
            if k and a > b:
                parts["term"][t] = (a - b) ** 2 // b
        for part, values in parts.items():
            ranked = sorted(values.items(), key=lambda x: (-x[1], x[0].encode()))
            out |= {(lang, source, part, item, value, k) for k, (item, value) in enumerate(ranked, 1) if part == "pair" or k <= top}
    return out


def audited(spark, rows, clash=False, **kw):
    got = [tuple(r) for r in divergence.audit(docs(spark, rows, clash), **kw).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_divergence_equals_brute_force(spark):
    rng = random.Random(3)
    stock = [f"{a}{b}" for a in "abcé" for b in ("", "x", "Yy", "ñ", "日本")]
    rows = [(k, " ".join(rng.choices(stock, weights=range(1, len(stock) + 1), k=rng.randrange(30))), rng.choice(["en", "de", None]), rng.choice(["s", "t", "u", None])) for k in range(80)]
    rows += [(100, None, "en", "empty"), (101, "", "xx", "alone"), (102, "once", "yy", "a"), (103, None, "yy", "b"), (104, "A1b2\x00C", "en", "s"), (104, "A1b2\x00C", "en", "s"), (None, "İ ı K", "en", "v")]
    assert audited(spark, rows, clash=False) == plain_audit(rows)


def test_divergence_top_terms_with_ties_and_parts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PARTS", 3)
    rows = [(k, " ".join("q" + "abcdefghij"[j // 10] + "abcdefghij"[j % 10] for j in range(60)) + f" common{'x' * (k % 3)}", "en", "s") for k in range(4)] + [(9, "common commonx", "en", "t")]
    assert audited(spark, rows, top=7) == plain_audit(rows, top=7)


def test_divergence_counts_in_pieces_and_flushes(spark, monkeypatch):
    rng = random.Random(5)
    text = " ".join("".join(rng.choices("abcdé", k=3)) for _ in range(3000))
    assert b" ".join(divergence.pieces(text.encode())) == text.encode()
    rows = [(k, text[k:], "en", f"s{k % 2}") for k in range(6)]
    want = plain_audit(rows)
    monkeypatch.setattr(divergence, "PIECE", 50)
    monkeypatch.setattr(divergence, "HELD", 10)
    assert Counter(t for x in divergence.pieces(text.encode()) for t in x.split()) == Counter(text.encode().split())
    assert audited(spark, rows) == want


def test_divergence_of_large_counts_is_exact(spark):
    df = spark.createDataFrame([(9_000_000_000_000, 9_500_000_000_001, 123_456), (0, 0, 1), (2**62, 2**62 + 5, 7)], "n long, t long, v long")
    got = df.select("n", "t", "v", divergence.frequency("n", "t", "v").alias("p")).collect()
    assert all(r["p"] == 1 + 10**9 * (r["n"] + 1) // (r["t"] + r["v"]) for r in got)


def test_divergence_of_nothing_and_clashing_names(spark):
    assert divergence.audit(docs(spark, [])).count() == 0
    rows = [(k, "a b c" if k % 2 else "a c d", "en", "st"[k % 2]) for k in range(8)]
    df = docs(spark, rows).withColumns({c: F.lit("x") for c in ("term", "n", "m", "n1", "n2", "v", "total", "part", "item", "value", "rank", "docs")})
    assert {tuple(r) for r in divergence.audit(df).collect()} == plain_audit(rows)


# SimHash


def plain_fingerprint(text):
    w = WORD.findall(lower(text))
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(values, radius=2):
    """values: (id, number) pairs; the least id that each number reaches, rows of one id being one."""
    parent = {("id", i): ("id", i) for i, _ in values if i is not None} | {("fp", f): ("fp", f) for _, f in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = sorted({f for _, f in values})
    for a, b in [(("fp", x), ("fp", y)) for x, y in itertools.combinations(fps, 2) if (x ^ y).bit_count() <= radius] + [(("id", i), ("fp", f)) for i, f in values if i is not None]:
        parent[find(a)] = find(b)
    least = {}
    for x in parent:
        if x[0] == "id":
            least[find(x)] = min(least.get(find(x), x[1]), x[1])
    return [least.get(find(("fp", f))) for _, f in values]


def test_simhash_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "A"), (6, "a B"), (7, "a b c"), (8, "É b\x0bc d"), (9, "é b c d"), (10, "x " * 40), (None, "a b c"), (None, "only here once"), (4, "a")]
    for k in range(30):
        text = words(rng, 150).split()
        rows.append((100 + 10 * k, " ".join(text)))
        for j in range(4):
            edited = list(text)
            edited[rng.randrange(len(edited))] = "new"
            rows.append((101 + 10 * k + j, " ".join(edited)))
    rows += [(100, rows[-1][1]), (7000, rows[20][1]), (7000, rows[90][1])]
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["fingerprint"], r["component_id"] if r["component_id"] is not None else -1) for r in simhash.join(docs(spark, rows, clash=True)).collect())
    values = [(i, plain_fingerprint(t)) for i, t in rows]
    want = sorted((i if i is not None else -1, f"{f:016x}", c if c is not None else -1) for (i, f), c in zip(values, plain_components(values), strict=True))
    assert got == want
    assert len({c for _, _, c in got}) < len(rows) - 30


@pytest.mark.parametrize("parts", [1, 2, 4, 8])
def test_simhash_links_of_close_numbers(spark, monkeypatch, parts):
    monkeypatch.setattr(simhash, "BLOCK", 7)
    monkeypatch.setattr(simhash, "STRIP", 3)
    rng = random.Random(parts)
    base = [rng.getrandbits(64) for _ in range(60)] + [0, 2**64 - 1, 2**63]
    values = {x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for x in base for _ in range(4)}
    signed = {v: v - (v >> 63 << 64) for v in values}
    df = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    found = simhash.links(df, parts=parts).collect()
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") for a, b in found)
    joined = plain_components([(k, v) for k, v in enumerate(values)])
    # What the links join is what all pairs join.
    parent = {s: s for s in signed.values()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        parent[find(a)] = find(b)
    groups = {}
    for v, c in zip(values, joined, strict=True):
        groups.setdefault(find(signed[v]), set()).add(c)
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(joined))


def test_simhash_of_a_large_group_returns_a_forest():
    centre = np.uint64(0x0123456789ABCDEF)
    x = np.array([centre ^ np.uint64((1 << a) | (1 << b)) for a in range(64) for b in range(a)], np.uint64)
    i, j = simhash.near(x, x, 2, True)
    assert len(i) < 2 * len(x)
    i, j = simhash.near(x, np.array([centre]), 2, False)
    assert len(i) == len(x)


def test_simhash_in_pieces(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice(["a", "B", "é", " ", "\n", "  ", "word"]) for _ in range(4000))
    want = plain_fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 16)
    monkeypatch.setattr(simhash, "HASHES", 5)
    assert simhash.fingerprint(text.encode()) % 2**64 == want
    assert simhash.fingerprint(None) == simhash.fingerprint(b" \n") == 0


def test_simhash_of_nothing(spark):
    assert simhash.join(docs(spark, [])).count() == 0


# Conversations


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        t = text.strip(" \t\n\x0b\x0c\r")
        out.append(1 if not t else 2 if (role, text) in seen else 3 if t[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def every_way(initials, kinds):
    """The least (cost, edits) over all edits with at most two inserts at a place, and the roles that they give."""
    inserts = [()] + [(a,) for a in "ua"] + [(a, b) for a in "ua" for b in "ua"]
    best = None
    rows = []
    for r, f in zip(initials, kinds, strict=True):
        stay = 5 * (f == 3)
        rows.append([("D", 2, "")] + ([] if f in (1, 2) else [("K", stay, r), ("R", 1 + stay, "u"), ("R", 1 + stay, "a")]))
    for some in itertools.product(inserts, repeat=len(rows) + 1):
        for ways in itertools.product(*rows):
            cost, edits, roles = 0, "", ""
            for k in range(len(rows) + 1):
                cost, edits, roles = cost + 5 * len(some[k]), edits + "I" * len(some[k]), roles + "".join(some[k])
                if k < len(rows):
                    cost, edits, roles = cost + ways[k][1], edits + ways[k][0], roles + ways[k][2]
            if (best is None or (cost, edits) < best) and re.fullmatch("(s?(ua)+)?", roles):
                best = cost, edits
    return best


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_search_equals_every_way(n):
    cases = list(itertools.product("suax", [0, 1, 3]))
    some = list(itertools.product(cases, repeat=n))
    for rows in random.Random(n).sample(some, min(len(some), 25 if n == 3 else 60)):
        assert conversations.cheapest([r for r, _ in rows], [f for _, f in rows]) == every_way([r for r, _ in rows], [f for _, f in rows])


def by_layers(initials, kinds):
    """The same by dynamic programming over rows, with edits as strings."""
    best = {0: (0, "")}
    step = lambda q: 3 if q == 2 else 2

    def inserts(best):
        out = dict(best)
        for _ in range(2):
            for q, (c, w) in list(out.items()):
                out[step(q)] = min(out.get(step(q), (10**9, "")), (c + 5, w + "I"))
        return out

    for r, f in zip(initials, kinds, strict=True):
        new, stay = {}, 5 * (f == 3)
        for q, (c, w) in inserts(best).items():
            to = [("D", 2, q)] + ([] if f in (1, 2) else [("R", 1 + stay, step(q))])
            if f not in (1, 2) and (r == "s" and q == 0 or r == "u" and q != 2 or r == "a" and q == 2):
                to.append(("K", stay, {"s": 1, "u": 2, "a": 3}[r]))
            for x, cost, z in to:
                new[z] = min(new.get(z, (10**9, "")), (c + cost, w + x))
        best = new
    return min(v for q, v in inserts(best).items() if q in (0, 3))


def test_search_on_longer_conversations():
    rng = random.Random(8)
    for n in [rng.randrange(4, 40) for _ in range(150)] + [700]:
        initials, kinds = rng.choices("suaax", k=n), rng.choices([0, 0, 0, 1, 2, 3], k=n)
        assert conversations.cheapest(initials, kinds) == by_layers(initials, kinds)


def test_search_of_a_very_long_conversation():
    cost, edits = conversations.cheapest(["u", "a"] * 20_000, [0, 0, 3, 0] * 10_000)
    assert len(edits) >= 40_000 and cost > 0


def test_chains_compare_as_strings():
    rng = random.Random(4)
    nodes = [(conversations.Edits(), "")]
    known = {""}
    for _ in range(300):
        node, s = rng.choice(nodes[-40:])
        letter = rng.choice("DIKR")
        if s + letter not in known:
            known.add(s + letter)
            nodes.append((conversations.Edits(node, letter), s + letter))
    assert all((a < b) == (s < t) for (a, s), (b, t) in itertools.product(nodes, nodes) if s != t)
    assert all(str(a) == s for a, s in nodes)


def plain_repair(rows):
    out, kept = {}, defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        kept[conv] += []
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        kept[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, lines in kept.items():
        lines.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).digest()))
        kinds, turns = faults([x[1:] for x in lines]), {x[0] for x in lines} - {None}
        initials = [x[1][:1] for x in lines]
        cost, edits = by_layers(initials, kinds)
        said, k, turn = [], 0, "user"
        for letter in edits:
            role, text = (turn, "") if letter == "I" else lines[k][1:] if letter == "K" else (turn, lines[k][2])
            k += letter != "I"
            if letter != "D":
                said.append(f"{role}:{text}")
                turn = "assistant" if role[:1] == "u" else "user"
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(kinds.count(f) for f in (1, 2, 3)), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, edits, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def repaired(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("key", "kind", "copy", "digest", "fault", "part", "audit", "gaps")})
    got = conversations.repair(conversations.damage(df), df).collect()
    assert len(got) == len({r["conv_id"] for r in got})
    return {r["conv_id"]: tuple(r)[1:] for r in got}


def test_conversations_equal_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for conv in [*range(120), None]:
        for turn in range(rng.randrange(1, 12)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), role, rng.choice(["Yes.", "No! ", "é?\n", "cut", "", None, " \t", "Yes.", "a\x0b", "ümlaut."])))
    rng.shuffle(rows)
    rows += rows[:10]
    assert repaired(spark, rows) == plain_repair(rows)


def test_conversations_without_rows_and_long_ones(spark):
    dropped = [(c, 0, "user", "Hi.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    long = [(1000, t, "user" if t % 2 == 0 else "assistant", "x" * 5000 + f"{t}.") for t in range(300)]
    got = repaired(spark, dropped + long)
    assert got == plain_repair(dropped + long)
    assert got[dropped[0][0]] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair(conversations.damage(empty), empty).count() == 0


@pytest.mark.parametrize("name", ["op11_divergence", "op13_conversations"])
def test_audits_equal_sql(spark, name):
    assert same(spark, queries.queries()[name], queries.oracle_sql()[name]) > 0
