"""From raw documents to packed training sequences, stage by stage.

Each stage reads all rows that the one before kept, as Parquet; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakelens.llm import decontaminate, digest_index, ngram_join, packing, toxicity
from lakelens.llm.queries import tokenizer_path
from lakelens.llm.words import kept_table, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the ordinal model calls toxic go.  The model is fitted
    on the labelled documents of the input.  Null and empty texts stay, repeated rows
    go or stay together, whole texts are read however long; without labels, or of an
    empty table, nothing goes."""
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"), read(spark, sf_dir, "documents"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of equal texts the row with the largest id stays.  A null text equals an
    empty one, a null id is the smallest, and of rows that share id and text one stays."""
    return digest_index.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5 on five-word n-grams at a similarity of 0.8: the smallest id of each group stays.
    Texts without words link with nothing and stay; rows that share the smallest id all stay."""
    return ngram_join.without_near_copies(docs, k=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that hold a benchmark item go.  Null and empty texts hold none; an
    empty table, or an empty benchmark, changes nothing."""
    return decontaminate.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: the pieces of the packed sequences, with their token ids.  A null or empty
    text is its end token alone; long texts are cut, repeated rows each packed."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: Fitting, components and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
