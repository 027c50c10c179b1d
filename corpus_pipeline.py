"""From raw documents to tokens: quality, near duplicates, repeated passages, source weights, token ids.

Each stage is one operator over all rows that the one before it kept; its rows are written as Parquet and are the next
one's documents. All but the last return the documents' own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barweave.llm import bpe, jaccard, mixing, quality, substrings
from barweave.llm.common import Scratch, documents, free_name
from barweave.llm.queries import tokenizer_file


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject: it learns from labelled documents that are not held out.

    Texts that are null or empty are scored like others; repeated rows stay, with or without an id; an empty table stays
    empty, and where both labels are not there to learn from, all rows have one score (see ``quality.fit``).
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs.select(F.col("doc_id").alias("id"), "text"), labels.select("doc_id", "quality"))
    score = free_name(docs, "quality_score")
    return quality.score_column(docs, model, "text", score).where(F.col(score) >= quality.THRESHOLD).drop(score)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id, without an id the one of least hash.

    Each row is a document by itself, also where ids are null or repeat: unlike texts of one id stay, and of rows that are
    repeated one does. Documents without words link with nothing and stay. An empty table stays empty.
    """
    scratch = Scratch(spark, "groups")
    row, member = free_name(docs, "group_row"), free_name(docs, "group_member")
    rows = mixing.number_rows(docs, row, scratch)
    groups = jaccard.join(rows, row).withColumnRenamed(row, member)
    ids = rows.select(F.col(row).alias("of"), F.col("doc_id").alias("named"))
    # In order: those with an id before those without, then by id; rows of one id by their hash.
    order = F.struct(F.col("named").isNull().alias("none"), "named", F.col("of").alias(member))
    keep = groups.join(ids, groups[member] == ids["of"]).groupBy("component_id").agg(F.min(order).alias("first")).select(f"first.{member}")
    return rows.join(keep, rows[row] == keep[member], "left_semi").select(docs.columns)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that an earlier one has; those with no word left go.

    A document that had no word before stays, and n_chars is counted anew where a text changed. Rows that repeat an id are
    cut each for itself; rows without an id stay as they are. An empty table stays empty.
    """
    cut = substrings.dedup(docs, rest="row").where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    columns = {c: F.col("text") if c == "text" else F.col("row").getField(c) for c in docs.columns}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(columns["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return cut.select(*(column.alias(c) for c, column in columns.items()))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: not at all, once or twice; copies keep their id.

    Rows that repeat an id, or have none, are taken each for itself; rows that are equal in id, text and source share their
    copies in any order. Documents without a word have no weight and stay once. An empty table stays empty.
    """
    row, of, n, copy = (free_name(docs, x) for x in ("mix_row", "mix_of", "mix_copies", "mix_copy"))
    rows = mixing.number_rows(docs, row, Scratch(spark, "mix"))
    times = mixing.mix(rows, row_col=row).select(F.col("row").alias(of), F.col("copies").alias(n))
    joined = rows.join(times, rows[row] == times[of]).where(F.col(n) > 0)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text that they decode to.

    A row for each row, repeats included; null and empty texts have no ids; null ids stay; an empty table stays empty.
    """
    return bpe.encode_decode(docs, tokenizer_file("word_bpe_49k.json"), ("n_tokens", "ids", "decoded"))


STAGES = [
    ("good_quality", good_quality),
    ("one_of_each_group", one_of_each_group),
    ("without_repeated_passages", without_repeated_passages),
    ("mixed_sources", mixed_sources),
    ("tokens", tokens),
]

#: Models, chunks, Newton steps and byte pairs have no SQL: the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
