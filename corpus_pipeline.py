"""A training corpus from documents: faulty ones go, one of each group of near copies stays, what holds benchmark
passages goes, and the rest is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import byte_bpe, decontaminate, ngram_join, quality_bayes
from attestra.llm.common import discard, stored
from attestra.session import table, workers_import


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. A document without an id is judged by no other's id, and stays."""
    workers_import(spark)
    judged = quality_bayes.judge(docs, table(spark, sf_dir, "labels"))
    return docs.join(judged.where("not kept").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one of the smallest id; of rows that repeat an id, that of the first text.

    An id is one document: where one of its rows is a copy of a smaller id's, its rows go. Rows without an id stay.
    """
    workers_import(spark)
    others = ngram_join.ngram_components(docs).where("doc_id <> component_id").select("doc_id").distinct()
    rest = docs.where("doc_id is not null").join(others, "doc_id", "left_anti")
    first = F.min_by(F.struct(*docs.columns), F.coalesce("text", F.lit("")))
    return rest.groupBy("doc_id").agg(first.alias("row")).select("row.*").unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stands in benchmark passages."""
    workers_import(spark)
    found = decontaminate.flagged(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~decontaminate.contaminated(F.col("contamination.n_hit"), F.col("contamination.n_words"))).select(docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the ids of every document that is left, and whether they decode to its text."""
    workers_import(spark)
    digests = {"ids_sha256": ("string", lambda ids, _: byte_bpe.digest(ids)), "decoded_sha256": ("string", lambda _, raw: byte_bpe.digest(raw))}
    return byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests)


STAGES = [("quality", quality), ("near_copies", near_copies), ("decontamination", decontamination), ("encoding", encoding)]
#: The classifier is fitted and the encoding is a loop of merges, so SQL can't state the rows of run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        if i:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
