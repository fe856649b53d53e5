"""From raw documents to packed training sequences.

STAGES are run in order, each on all that the one before kept; their results are
written as Parquet and read again between them. Rules and both dedups only drop
rows; mixing repeats rows; packing tells where each row's words go. Each takes an empty
table to an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftspark.llm import bloom_dedup, crf, jaccard, mixing, packing
from driftspark.llm.common import checkpoint_dir, col, delete, delete_at_exit, fresh, load

#: Tempering of the sources' and languages' shares of words. Mild, as no document is to be lost.
SOURCE_POWER, LANG_POWER = 0.9, 0.95


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents of which at least half the bytes are in lines labelled content.

    Null, empty and blank texts have no content and go; equal rows are kept or go together. Nulls and names
    of other columns do not matter. Without labels of both classes all other texts stay.
    """
    return crf.kept(docs, crf.train(docs, load(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each text, the one with the smallest id.

    Null texts all stay; empty ones are equal texts; a null id comes last; of rows with equal id and text the
    first by its other columns stays.
    """
    return bloom_dedup.exact_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each group of similar ones, the one with the smallest id.

    Rows without an id, and null or empty texts, all stay; rows that share an id stay or go together.
    """
    return jaccard.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: each document as often as its source's and language's target shares ask for, at least once.

    A null source or language is a level of its own; texts without words get their levels' copies; equal rows
    get equal numbers.
    """
    counts = mixing.word_counts(docs, ["source", "lang"])
    targets = {"source": mixing.temper(counts, "source", SOURCE_POWER), "lang": mixing.temper(counts, "lang", LANG_POWER)}
    copies, each = fresh(docs, "copies", "each")
    mixed = mixing.mix_to_targets(docs, targets, keep_all=True, counts=counts, copies=copies)
    repeated = mixed.withColumn(each, F.explode(F.array_repeat(F.lit(0), col(copies).cast("int"))))
    return repeated.select(*[col(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the place of each document's words in sequences of 2048.

    Null and empty texts have one row without a sequence; rows of one id are packed each on its own.
    """
    return packing.best_fit_pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]

#: The field's training and the Newton iterations are beyond SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents.

    Each stage's rows are written to the cluster's shared folder. They go when the
    next stage has written its own; the last ones, which the result is read from,
    when the application ends.
    """
    from uuid import uuid4

    docs = load(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid4().hex}"
    delete_at_exit(spark, folder)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            delete(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
