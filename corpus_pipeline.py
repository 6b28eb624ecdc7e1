"""A corpus pipeline over the documents table: five stages, each written and read again before the next.

Every stage takes null and empty texts, null and repeated keys, further columns and empty tables, as its operator states
it. Rows without letters go with language ID; an empty text that is left by line dedup stays, with no ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexframe.llm.common import file_system, fleeting, read, shared_folder
from plexframe.llm.decontaminate import drop_leaks
from plexframe.llm.jaccard_join import drop_near_copies
from plexframe.llm.language_id import UNKNOWN, held_out, identify, learn
from plexframe.llm.line_dedup import line_runs
from plexframe.llm.pieces import encode


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not known go; the language of the others is the one predicted."""
    model = learn(docs.filter(~held_out()))
    found = identify(docs, model, keep_text=True).filter(F.col("lang_pred") != UNKNOWN)
    return found.withColumn("lang", F.col("lang_pred")).select(docs.columns)


def line_chunks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines go from the texts; every document stays, with its new length."""
    out = line_runs(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8) the smallest doc_id stays."""
    return drop_near_copies(docs, k=5, num=4, den=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids: doc_id, lang, source, ids, n_ids, round_trip."""
    return encode(docs.select("doc_id", "lang", "source", "text"), check=True)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_chunks),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", pieces),
]

#: SQL can express neither the language model nor the piece search; tests/llm/test_brute_force.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        with fleeting():  # what a stage set down on its way goes once its result is written
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{folder}/{i}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{i}")
        if i:
            at, path = file_system(spark, f"{folder}/{i - 1}")
            at.delete(path, True)
    return docs
