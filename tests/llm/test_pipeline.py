"""The whole pipeline, stage after stage, against brute force over all its rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from barweave.llm import mixing, quality
from barweave.llm.queries import tokenizer_file
from tests.llm.test_duplicates import brute, brute_cut

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The given documents with near copies, copies and passages that others have, each under an id of its own."""
    out, rng = tmp_path_factory.mktemp("sf"), random.Random(12)
    table = pq.read_table(f"{SF}/documents.parquet")
    rows = table.to_pylist()
    top = max(r["doc_id"] for r in rows)
    long = [r for r in rows if len((r["text"] or "").split()) > 150]
    for k in range(120):
        base, other = rng.sample(long, 2)
        w, v = base["text"].split(), other["text"].split()
        at = rng.randrange(len(w) - 60)
        text = (" ".join([*w, f"end{k}"]), base["text"], " ".join([*v[:40], *w[at : at + 60], *v[40:]]))[k % 3]
        rows.append(base | {"doc_id": top + 1 + k, "text": text, "n_chars": len(text)})
    rows += [rows[0] | {"doc_id": top + 500, "text": None, "n_chars": None}, rows[0] | {"doc_id": top + 501, "text": "", "n_chars": 0}]
    pq.write_table(pa.Table.from_pylist(rows, schema=table.schema), f"{out}/documents.parquet")
    pq.write_table(pq.read_table(f"{SF}/labels.parquet"), f"{out}/labels.parquet")
    return str(out)


def test_pipeline_equals_brute_force(spark, folder):
    import corpus_pipeline as P
    from tokenizers import Tokenizer

    table = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r["doc_id"]: (r["text"], r["source"]) for r in table.collect()}
    assert len(rows) == table.count() > 1100
    # Quality: each text for itself.
    model = quality.fit(table.select(F.col("doc_id").alias("id"), "text"), spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality"))
    good = {i: t for i, (t, _) in rows.items() if model.score([(t or "").encode()])[0] >= quality.THRESHOLD}
    assert 100 < len(good) < len(rows)
    # Near duplicates: all pairs of sets.
    least = {i: c for i, (_, c) in brute(list(good.items())).items()}
    alone = {i: t for i, t in good.items() if least[i] == i}
    assert len(alone) < len(good) - 10
    # Repeated passages: all windows of all texts.
    cut = brute_cut(list(alone.items()))
    left = {i: text if n else alone[i] for i, (text, n) in cut.items() if not n or re.search(r"[^\x20\x09-\x0D]", text)}
    assert sum(n for _, n in cut.values()) > 600
    # The mix: copies as wanted by its targets, which are worked out from whole sizes.
    out = P.run(spark, folder).collect()
    copies = Counter(r["doc_id"] for r in out)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in left.items()}
    assert set(copies) <= set(left) and max(copies.values()) <= 2 and all(copies[i] == 1 for i in left if not size[i])
    of = Counter()
    for i, n in size.items():
        of[rows[i][1]] += n
    goal, taken = mixing.targets(dict(of)), Counter()
    for i, n in copies.items():
        taken[rows[i][1]] += n * size[i]
    assert all(abs(taken[s] - goal[s]) <= max(50, 0.02 * goal[s]) for s in of), (taken, goal)
    assert sum(goal.values()) == pytest.approx(1.5 * sum(of.values()))
    for s in of:  # where the target is the most there is, all are taken twice
        if goal[s] == pytest.approx(2 * of[s]):
            assert all(copies[i] == 2 for i in left if rows[i][1] == s and size[i])
    # Tokens: the library, one text at a time.
    library = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    for r in out:
        ids = library.encode(left[r["doc_id"]] or "", add_special_tokens=False).ids
        assert list(r["ids"]) == ids and r["n_tokens"] == len(ids) and r["decoded"] == library.decode(ids, skip_special_tokens=False), r["doc_id"]
