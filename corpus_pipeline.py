"""A training corpus from ``documents``, in five stages.

Each stage works on all rows that its predecessor kept, which are written as Parquet
to the folder that executors share and read again. All stages but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fernglass.llm import bpe, decontam, language_id, line_dedup, ngram_join
from fernglass.llm._store import materialize
from fernglass.llm.queries import table, tokenizer_file

#: The least mean share of a text's predicted language; mixtures and noise fall below.
MIN_LANGUAGE_SCORE = 0.3


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a clear language, go."""
    return language_id.keep_identified(docs, MIN_LANGUAGE_SCORE)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across documents go, but for their first document."""
    return line_dedup.drop_recurring(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays."""
    return ngram_join.keep_one_per_group(docs, n=2, threshold=60)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words lies in benchmark windows go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), window=13, share=20)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with the number of ids and digests of the ids and of what they decode to."""
    return bpe.digest(docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("language ID", identify),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("byte-level BPE", encode),
]

#: SQL can't express language ID and BPE; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, "stage")
    return docs
