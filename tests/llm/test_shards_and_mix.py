"""Sharding against SQL, mixing against its constraints, and the pipeline."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from barweave.llm import mixing, queries, sharding
from tests.llm.common import docs, words
from tests.oracle import same

SF = "/root/testdata/sf0.01"


def test_shards_equal_sql(spark):
    assert same(spark, queries.op6_sharding, queries.oracle_sql()["op6_sharding"], SF) > 0


def test_shards_fit(spark):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randrange(200)) for i in range(500)] + [(1000, "y" * 5000), (1001, None), (None, ""), (7, "again")]
    got = sharding.assign(docs(spark, rows, clash=True), 1000).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    for shard, members in by.items():
        assert len(shard) == members[0]["depth"] and sum(r["n_bytes"] for r in members) == members[0]["shard_bytes"]
        assert members[0]["shard_bytes"] <= 1000 or {r["doc_id"] for r in members} == {1000} and members[0]["over_limit"]
    names = sorted(by)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))  # no shard lies within another
    for shard in names:  # a shard's parent would not fit
        if shard:
            assert sum(r["n_bytes"] for s, m in by.items() if s.startswith(shard[:-1]) for r in m) > 1000
    assert sharding.assign(docs(spark, []), 10).count() == 0
    assert {r["shard"] for r in sharding.assign(docs(spark, [(1, "a")]), 10).collect()} == {""}


def test_repeated_and_null_ids_are_split(spark):
    rows = [(None, "x" * 100)] * 50 + [(1, "y" * 100)] * 50 + [(2, "z" * 60), (2, "u" * 60)]
    one, two = (sharding.assign(docs(spark, rows[::step]), 1000).collect() for step in (1, -1))
    by = {}
    for r in one:
        by.setdefault(r["shard"], []).append(r["n_bytes"])
        assert not r["over_limit"]
    assert len(one) == len(rows) and max(map(sum, by.values())) <= 1000
    assert sorted(map(repr, one)) == sorted(map(repr, two))


def test_sql_of_repeated_rows(spark, tmp_path):
    rows = [(i % 40, "x" * (i % 40 * 900)) for i in range(120)] + [(None, "n" * 30_000)] * 90
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    assert same(spark, queries.op6_sharding, queries.oracle_sql()["op6_sharding"], str(tmp_path)) == 210


def test_written_shards(spark, tmp_path):
    rows = [(i, "x" * 100) for i in range(50)] + [(None, "y" * 90)] * 30 + [(7, None), (7, "")]
    for k, table in enumerate((docs(spark, rows), docs(spark, rows, clash=True), docs(spark, []))):
        sharding.write_shards(table, str(tmp_path / f"{k}"), 1000)
        if table.isEmpty():
            continue
        back = spark.read.parquet(str(tmp_path / f"{k}"))
        name = back.columns[-1]
        assert name == ("___shard" if "__shard" in table.columns else "__shard")
        assert sorted(map(repr, back.select(table.columns).collect())) == sorted(map(repr, table.collect()))
        assert max(r[1] for r in back.groupBy(name).agg({"n_chars": "sum"}).collect()) <= 1000


def test_targets_by_hand():
    assert mixing.targets({"a": 100, "b": 100, "c": 100}) == pytest.approx({"a": 200, "b": 250 / 3, "c": 500 / 3})
    got = mixing.targets({"b": 10, "a": 10, None: 1000})
    assert got == pytest.approx({"a": 20, "b": 20, None: 1490})
    got = mixing.targets({"a": 0, "b": 5})
    assert got == pytest.approx({"a": 0, "b": 7.5})
    assert mixing.targets({}) == {}


@pytest.mark.parametrize("clash", [False, True])
def test_mix_meets_targets(spark, clash):
    rng = random.Random(2)
    rows = [(i, words(rng, int(rng.paretovariate(1.2) * 8) % 900), "en", rng.choice(["hot"] * 6 + ["b", "Z", "é", None])) for i in range(900)]
    rows += [(2000 + i, "same size text here", "en", "hot") for i in range(1500)] + [(5000, None, "en", "b"), (5001, "", "en", "hot"), (None, "one two", "en", "b")]
    one = mixing.mix(docs(spark, rows, clash)).collect()
    assert len(one) == len(rows)
    sizes, taken, target = {}, {}, {}
    for r in one:
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    assert all(r["source_size"] == sizes[r["source"]] for r in one)
    assert target == pytest.approx(mixing.targets(sizes)) and sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(5, 0.002 * target[s]), (s, taken[s], target[s])
    two = mixing.mix(docs(spark, rows[::-1], clash)).collect()
    assert sorted((r["doc_id"] or -1, r["taken"]) for r in one) == sorted((r["doc_id"] or -1, r["taken"]) for r in two)


def test_mix_of_little(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    (r,) = mixing.mix(docs(spark, [(1, "a b c d")])).collect()
    assert r["target"] == 6 and r["taken"] in (4, 8)
    (r,) = mixing.mix(docs(spark, [(1, None)])).collect()
    assert (r["size"], r["taken"], r["target"]) == (0, 0, 0)


def test_rates_are_exponential_tilts(spark):
    """Among documents of one source the odds of the rate against its bound grow by a constant factor with size."""
    import numpy as np

    rng = random.Random(3)
    rows = [(i, words(rng, rng.choice([20, 40, 60, 80])), "en", "a" if i % 2 else "b") for i in range(4000)]
    got = mixing.mix(docs(spark, rows), weights=(1.0,)).where("source = 'b'").groupBy("size").agg({"copies": "avg"}).orderBy("size").collect()
    rate = np.array([r[1] for r in got])
    odds = np.log(rate / (2 - rate))
    assert np.allclose(odds / odds[0], [1, 2, 3, 4], rtol=0.05), odds


def test_copies_are_those_of_the_dual_solution(spark):
    """A source's multiplier by bisection; a size's copies are its rate's, but for rounding and a few repairs."""
    import math

    rng = random.Random(6)
    rows = [(i, words(rng, rng.choice([5, 10, 300, 700])), "en", "abc"[i % 3]) for i in range(1500)] + [(None, "one two three", "en", "a")] * 200
    got = mixing.mix(docs(spark, rows))
    cells = {(r["source"], r["size"]): (r["n"], r["c"]) for r in got.groupBy("source", "size").agg(F.count("*").alias("n"), F.sum("copies").alias("c")).collect()}
    goal = mixing.targets({s: sum(n * z for (t, z), (n, _) in cells.items() if t == s) for s in "abc"})
    for s in "abc":
        rate = lambda theta, z: 2 / (1 + math.exp(min(700, -theta * z)))
        low, high = -5.0, 5.0
        for _ in range(200):
            theta = (low + high) / 2
            words_taken = sum(n * z * rate(theta, z) for (t, z), (n, _) in cells.items() if t == s)
            low, high = (theta, high) if words_taken < goal[s] else (low, theta)
        for (t, z), (n, c) in cells.items():
            if t == s:
                assert abs(c - n * (2 if goal[s] == 2 * sum(k * y for (u, y), (k, _) in cells.items() if u == s) else rate(theta, z))) <= 1 + mixing.REPAIRS, (s, z)


def test_copies_of_repeated_rows_are_carried_to_them(spark):
    import corpus_pipeline as P

    rng = random.Random(7)
    rows = [(None, words(rng, rng.randrange(1, 40)), "en", rng.choice("ab")) for _ in range(200)] + [(5, words(rng, n), "en", "b") for n in range(1, 60)] + [(6, "the same row", "en", "a")] * 100
    table = docs(spark, rows)
    want = {tuple(r) for r in mixing.mix(table).groupBy("source").agg(F.sum("taken")).collect()}
    got = P.mixed_sources(spark, table, SF)
    size = F.size(F.split("text", " "))
    assert {tuple(r) for r in got.groupBy("source").agg(F.sum(size)).collect()} == want


def test_pipeline(spark):
    import corpus_pipeline as P

    from barweave.llm.common import Scratch, documents

    scratch, table = Scratch(spark, "t"), documents(spark, SF)
    rows, columns = [table.count()], table.columns
    kept = table
    for name, stage in P.STAGES:
        kept = scratch.save(stage(spark, kept, SF), name)
        rows.append(kept.count())
        if name != P.STAGES[-1][0]:
            assert kept.columns == columns and kept.dtypes == table.dtypes
    assert rows[0] > rows[1] > rows[2] >= rows[3] > 0 and rows[4] == rows[5]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = P.good_quality(spark, table, SF)
    share = good.join(labels, "doc_id").selectExpr("avg(quality)").first()[0]
    left = good.join(labels.where("quality = 1"), "doc_id").count() / labels.where("quality = 1").count()
    assert share > 0.98 and left > 0.97


def test_pipeline_stages_on_odd_documents(spark):
    import corpus_pipeline as P

    rng = random.Random(4)
    long = words(rng, 120, 10**6)
    rows = [(1, long), (2, long + " and a bit"), (2, long + " and a bit"), (3, None), (4, ""), (None, "no id here"), (5, words(rng, 80, 10**6)), (6, "x" * 50_000)]
    table = docs(spark, rows, clash=True)
    for name, stage in P.STAGES:
        out = stage(spark, table, SF)
        assert name == "tokens" and out.count() == len(rows) or out.columns == table.columns, name
        empty = stage(spark, docs(spark, []), SF)
        assert empty.count() == 0, name
    kept = P.one_of_each_group(spark, table, SF).select("doc_id").collect()
    assert sorted(r[0] or 0 for r in kept) == [0, 1, 3, 4, 5, 6]
    unlike = [words(rng, 60, 10**6) for _ in range(5)]
    rows = [(7, unlike[0]), (7, unlike[1]), (7, unlike[2]), (8, unlike[3]), (8, unlike[4]), (8, unlike[1] + " z"), (7, unlike[0] + " z"), (None, unlike[4] + " q"), (None, long), (None, long)]
    kept = [tuple(r) for r in P.one_of_each_group(spark, docs(spark, rows), SF).select("doc_id", "text").collect()]
    assert len(kept) == 6 and {(i, t.removesuffix(" z")) for i, t in kept} == {(7, unlike[0]), (7, unlike[1]), (7, unlike[2]), (8, unlike[3]), (8, unlike[4]), (None, long)}
    cut = {r["doc_id"]: (r["text"], r["n_chars"]) for r in P.without_repeated_passages(spark, docs(spark, [(1, long), (2, long), (7, "head " + long + " tail"), (8, ""), (9, None)]), SF).collect()}
    assert cut[1] == (long, len(long)) and 2 not in cut and cut[7][0].split() == ["head", "tail"] and cut[7][1] == len(cut[7][0]) and cut[8][0] == "" and cut[9][0] is None
