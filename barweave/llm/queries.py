"""The queries of this package, each an operator over its whole table, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, conversations, divergence, jaccard, language, media, mixing, neighbours, quality, sharding, simhash, substrings, token_files
from .common import documents

#: Bytes of text in a shard of op6: sized for tables of megabytes; 1 << 30 suits larger ones.
SHARD_BYTES = 1 << 20


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.learn_and_score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), end_id=2)


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, k=5)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.learn_and_identify(documents(spark, sf_dir))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir), SHARD_BYTES)


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(documents(spark, sf_dir))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.join(documents(spark, sf_dir))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversations.repair(conversations.damage(rows), rows)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_bpe": op2_bpe,
        "op3_token_files": op3_token_files,
        "op4_neighbours": op4_neighbours,
        "op5_language": op5_language,
        "op6_sharding": op6_sharding,
        "op7_substrings": op7_substrings,
        "op8_mixing": op8_mixing,
        "op9_media": op9_media,
        "op10_jaccard": op10_jaccard,
        "op11_divergence": op11_divergence,
        "op12_simhash": op12_simhash,
        "op13_conversations": op13_conversations,
    }


#: CRC-32 of the string in column s, as DuckDB has none.
_CRC32 = """
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(s) + 1), lambda k: ascii(substr(s, k, 1))::BIGINT)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384)))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_divergence": r"""
            WITH d AS (SELECT COALESCE(lang, '') AS lang, COALESCE(source, '') AS source, row_number() OVER () AS doc, translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
            w AS (SELECT lang, source, doc, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
            k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT doc) >= 3),
            c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
            l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY ALL),
            g AS (SELECT lang, source, COALESCE(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source)),
            f AS (SELECT lang, source, term, COALESCE(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (COALESCE(c.n, 0) + 1)) // (g.total + v) AS p, 1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + v) AS lp
                  FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
            s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
            pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, COALESCE(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                     LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
            term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - lp) * (p - lp) // lp)::BIGINT AS value FROM f WHERE n > 0 AND p > lp)
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (FROM pair UNION ALL FROM term) QUALIFY part = 'pair' OR rank <= 200
        """,
        "op13_conversations": f"""
            WITH RECURSIVE named AS (SELECT *, COALESCE(conv_id::VARCHAR, ' ') || ':' || COALESCE(turn::VARCHAR, ' ') AS s FROM conversations),
            d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE COALESCE(role, ' ') END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(COALESCE(text, ' '), '.!?', '') ELSE COALESCE(text, ' ') END AS text, copy
                  FROM (SELECT *, xor({_CRC32}, 4294967295) % 20 AS kind FROM named), range(2) AS r(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
            o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM d),
            e AS (SELECT *, role[1] AS r, CASE WHEN t = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN t[-1] NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
                  r || lead(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS pair FROM o),
            a AS (SELECT conv_id, max(i) AS n, COALESCE(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
                  count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM e GROUP BY ALL),
            -- Moves that take a row, and those that insert before it: state 0 nothing, 1 system, 2 user, 3 assistant.
            move AS (SELECT conv_id, i, l, UNNEST(CASE WHEN fault IN (1, 2) THEN [{{'w': 'D', 'c': 2, 'z': l}}] ELSE [{{'w': 'D', 'c': 2, 'z': l}}, {{'w': 'R', 'c': 1 + CASE fault WHEN 3 THEN 5 ELSE 0 END, 'z': CASE l WHEN 2 THEN 3 ELSE 2 END}},
                     {{'w': 'K', 'c': CASE fault WHEN 3 THEN 5 ELSE 0 END, 'z': CASE WHEN r = 's' AND l = 0 THEN 1 WHEN r = 'u' AND l <> 2 THEN 2 WHEN r = 'a' AND l = 2 THEN 3 ELSE -1 END}}] END, recursive := true) FROM e, range(4) AS s(l)),
            ways AS (SELECT conv_id, i, l AS a, w, c, z FROM move WHERE z >= 0 UNION ALL SELECT conv_id, i, y, 'I' || w, c + 5, z FROM move, (VALUES (0, 2), (1, 2), (3, 2), (2, 3)) AS s(y, l2) WHERE l2 = l AND z >= 0
                     UNION ALL SELECT conv_id, i, y, 'II' || w, c + 10, z FROM move, (VALUES (0, 3), (1, 3), (3, 3), (2, 2)) AS s(y, l2) WHERE l2 = l AND z >= 0),
            p AS (SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS z, 0::BIGINT AS cost, '' AS audit FROM a
                  UNION ALL SELECT p.conv_id, p.i + 1, ways.z, min(p.cost + ways.c), arg_min(p.audit || ways.w, (p.cost + ways.c, p.audit || ways.w)) FROM p JOIN ways ON ways.conv_id IS NOT DISTINCT FROM p.conv_id AND ways.i = p.i + 1 AND ways.a = p.z GROUP BY ALL),
            ended AS (SELECT p.conv_id, min(cost + x) AS cost, arg_min(audit || y, (cost + x, audit || y)) AS audit FROM p JOIN a ON a.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = a.n JOIN (VALUES (0, 0, ''), (3, 0, ''), (2, 5, 'I'), (1, 10, 'II')) AS s(l, x, y) ON l = z GROUP BY ALL),
            letters AS (SELECT conv_id, k, audit[k] AS w, length(replace(audit[:k], 'I', '')) AS i FROM ended, LATERAL (SELECT UNNEST(range(1, length(audit) + 1)) AS k)),
            said AS (SELECT l.conv_id, k, w, CASE WHEN w = 'I' THEN '' ELSE text END AS text, CASE WHEN w = 'K' THEN role END AS role, row_number() OVER (PARTITION BY l.conv_id ORDER BY k) - 1 AS place FROM letters l LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM l.conv_id AND e.i = l.i WHERE w <> 'D'),
            spoken AS (SELECT *, max(place) FILTER (WHERE role[1] = 's') OVER (PARTITION BY conv_id) AS head FROM said),
            h AS (SELECT conv_id, string_agg(COALESCE(role, CASE WHEN (place - COALESCE(head + 1, 0)) % 2 = 0 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY k) AS whole FROM spoken GROUP BY ALL)
            SELECT c.conv_id, COALESCE(gaps, 0)::BIGINT AS gaps, COALESCE(blank, 0)::BIGINT AS blank, COALESCE(duplicate, 0)::BIGINT AS duplicate, COALESCE(truncated, 0)::BIGINT AS truncated, COALESCE(illegal, 0)::BIGINT AS illegal,
                   COALESCE(cost, 0)::BIGINT AS cost, COALESCE(audit, '') AS audit, sha256(COALESCE(whole, '')) AS repaired_sha256
            FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM c.conv_id
        """,
        "op6_sharding": f"""
            WITH e AS (SELECT doc_id, COALESCE(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(COALESCE(doc_id::VARCHAR, '') || '|' || COALESCE(text, '')), 1, 15))::BIGINT AS h FROM documents),
            n AS (SELECT doc_id, n_bytes, h, row_number() OVER (PARTITION BY h) AS k FROM e),
            d AS (SELECT doc_id, n_bytes, CASE WHEN k = 1 THEN h ELSE ('0x' || substr(md5(h::VARCHAR || '|' || k::VARCHAR), 1, 15))::BIGINT END AS h FROM n),
            b AS (SELECT level, h >> (60 - level) AS prefix, sum(n_bytes) AS shard_bytes, min(h) = max(h) AS one FROM d, range(0, 61) AS r(level) GROUP BY ALL),
            leaf AS (SELECT doc_id, n_bytes, h, min(level) AS depth FROM d, range(0, 61) AS r(level) JOIN b USING (level) WHERE b.prefix = d.h >> (60 - level) AND (b.shard_bytes <= {SHARD_BYTES} OR b.one OR level = 60) GROUP BY ALL)
            SELECT doc_id, n_bytes, right(lpad(bin(prefix), 64, '0'), depth::INT) AS shard, depth::INT AS depth, shard_bytes::BIGINT AS shard_bytes, shard_bytes > {SHARD_BYTES} AS over_limit
            FROM leaf JOIN b ON b.level = leaf.depth AND b.prefix = leaf.h >> (60 - leaf.depth::INT)
        """,
    }
