"""One query for each operator, at production parameters, over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, fingerprints, jaccard, licenses, lm, pii, quality, repeats, sharding
from .common import table


def tokenizer_path() -> str:
    """Where the public vocabulary file lies; ``LOGLOOM_TOKENIZER`` names another place."""
    named = os.environ.get("LOGLOOM_TOKENIZER")
    if named:
        return named
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.find_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=False)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_versions(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=False)
    names = F.array_sort(F.array_distinct(F.transform("hits", lambda x: x["license"])))
    spans = F.transform("hits", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string")))
    best = F.coalesce(F.array_max(F.transform("hits", lambda x: x["coverage"])), F.lit(0.0))
    return found.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hits"), F.array_join(names, ",").alias("licenses"), best.alias("coverage"), F.array_join(spans, ",").alias("spans"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_pii(docs, carry=False)
    counts = [f"n_{k}" for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, tokenizer_path())


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.assign_shards(docs, "doc_id", "text", [1.0] * 24).drop("text")


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = lm.fit(docs.where(lm.learned()).select("text"))
    scored = lm.score_texts(docs, model)
    return scored.select("doc_id", (~lm.learned()).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard": op1_jaccard,
    "op2_substrings": op2_substrings,
    "op3_fingerprints": op3_fingerprints,
    "op4_licenses": op4_licenses,
    "op5_pii": op5_pii,
    "op6_quality": op6_quality,
    "op7_bpe": op7_bpe,
    "op8_sharding": op8_sharding,
    "op9_language_model": op9_language_model,
    "op10_decontamination": op10_decontamination,
}

ORACLE: dict[str, str] = {
    "op1_jaccard": r"""
WITH RECURSIVE toks AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM toks WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y
), tops AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x
), counts AS (SELECT x AS doc_id, count(*) AS n_links FROM links GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM tops LEFT JOIN sizes USING (doc_id) LEFT JOIN counts USING (doc_id)
""",
    "op2_substrings": r"""
WITH toks AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), wins AS (
  SELECT r, i, array_to_string(w[i : i + 34], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM toks WHERE len(w) >= 35)
), again AS (SELECT g FROM wins GROUP BY g HAVING count(*) > 1
), gone AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM wins WHERE g IN (SELECT g FROM again))
), kept AS (
  SELECT r, string_agg(t, ' ' ORDER BY p) AS k, count(*) AS n FROM (SELECT r, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM toks) ANTI JOIN gone USING (r, p) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM toks LEFT JOIN kept USING (r)
""",
    "op8_sharding": """
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), docs AS (
  SELECT doc_id, coalesce(text, '') AS body, row_number() OVER () AS r FROM documents
), sums AS (
  SELECT r, xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS text_crc32
  FROM docs, crc
), draws AS (
  SELECT r, j, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || j), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) AS score
  FROM docs, range(25) AS s(j)
), homes AS (
  SELECT r, arg_min(j, score) FILTER (WHERE j < 24)::INTEGER AS shard, arg_min(j, score)::INTEGER AS grown_shard FROM draws GROUP BY r
)
SELECT doc_id, strlen(body) + 8 AS size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':slot'), 1, 8))::BIGINT % 1024, doc_id NULLS FIRST, text_crc32, strlen(body)) - 1 AS slot,
  grown_shard
FROM docs JOIN sums USING (r) JOIN homes USING (r)
""",
    "op10_decontamination": r"""
WITH toks AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), grams AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT m FROM grams
), hits AS (
  SELECT r, i, m, g FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i, array_to_string(w[i : i + m - 1], ' ') AS g FROM toks, sizes WHERE len(w) >= m)
  WHERE g IN (SELECT g FROM grams)
), covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM hits) GROUP BY r
), named AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hits JOIN grams USING (g, m) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM toks LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
""",
}
