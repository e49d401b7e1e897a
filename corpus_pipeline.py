"""From raw documents to token ids: filter, deduplicate, decontaminate, redact, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
``run`` writes each stage's result to the shared folder and reads it again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import bpe, decontaminate, filters, jaccard, pii, quality
from logloom.llm.common import cut, table
from logloom.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject (score of 0.3 or more)."""
    model = quality.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.score_quality(docs, model).where("predicted = 1").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8: the one of the least doc_id.

    Rows are told apart by id and text, so repeated rows leave one row, and null ids stand for themselves. Only rows that
    may be dropped, by a bit map of hashes, are shuffled to meet the list of rows that stay.
    """
    h = F.xxhash64("text", "doc_id")
    row = F.struct(F.col("doc_id"), h.alias("h"))
    keyed = docs.select(*COLUMNS, h.alias("h"))
    linked = jaccard.link_documents(docs.select(row.alias("row"), "text"), "row", size=5, percent=80, links=False)
    found = cut(linked.select("row", "component_id"), "near-copies")
    gone = found.where(F.col("row") != F.col("component_id")).select("row.h")
    twice = found.groupBy("row").count().where("count > 1").select("row.h")
    untouched, others = filters.parted(keyed, "h", filters.hash_bits(gone.unionByName(twice)))
    kept = found.where(F.col("row") == F.col("component_id")).select("row")
    left = others.withColumn("row", F.struct("doc_id", "h")).join(kept, "row", "left_semi").dropDuplicates(["row"])
    return untouched.select(*COLUMNS).unionByName(left.select(*COLUMNS))


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; single benchmark passages are cut out of the others."""
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    kept = decontaminate.remove_spans(found.where(~decontaminate.contaminated()))
    return _measured(kept)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in brackets."""
    found = pii.find_pii(docs)
    return _measured(found.withColumn("text", pii.redact(F.col("text"), F.col("spans"))))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text decoded from them."""
    return bpe.round_trip(docs.select("doc_id", "text", "lang", "source"), tokenizer_path(), with_ids=True)


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


STAGES = [
    ("quality", filter_quality),
    ("near_copies", drop_near_copies),
    ("benchmarks", remove_benchmarks),
    ("personal_data", redact_personal_data),
    ("encode", encode),
]

#: Not expressible in SQL: the classifier, the bootstrapped spans and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
