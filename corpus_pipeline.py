"""The corpus pipeline: five stages, each one of the operators of ``trackloom.llm``, from ``documents`` to token files.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
``documents``; the last returns the index of the token files it wrote, one row for each document of the mixture.

In every stage null texts are empty, texts are read whole however long, further columns go along whatever they are called, and an empty table stays
empty; what a stage does with null ids, repeated rows and ties is said below. Quality, decontamination and mixing decide each row where it is; only
near duplicates and token files shuffle texts or frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackloom.llm.decontaminate import drop_leaks
from trackloom.llm.mixing import mixed
from trackloom.llm.near_duplicates import keep_one
from trackloom.llm.quality import accepted, train
from trackloom.llm.tables import new_path, remove
from trackloom.llm.token_files import read_index, write_tokens


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on their labels, accepts: a score of at least 0.5.

    Rows are judged by their texts alone: repeated rows stay or go together, null ids don't matter. Without labels the score is 0.5, which accepts.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return accepted(docs, train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: that of the smallest doc_id, of a null one only if all are, then of the smallest hash of its text.

    Of repeated rows one stays. Texts without words are duplicates of equal texts only.
    """
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found. Repeated rows stay or go together; an empty benchmark keeps all."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: each document as often as its source's target says. Null sources are one source; equal rows are drawn together; of equal
    ranks the smaller doc_id, then the smaller size comes first."""
    return mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str, output: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the token files, read back from them; null ids come first, repeated rows are each written.

    The files are the pipeline's product: they stay in ``output``, a new folder; without one they are in the shared folder, which goes when the driver ends.
    """
    folder = write_tokens(docs, output or new_path(spark, "tokens"))
    return read_index(spark, folder).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_ids", token_ids),
]

#: Four of the five stages can't be expressed in SQL. tests/llm/test_pipeline.py compares the rows of run() with a plain version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, output: str | None = None) -> DataFrame:
    """The stages in turn over ``documents``. What a stage has kept is removed once its successor is written."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if held:
            remove(spark, held)
        held = path
    index = token_ids(spark, docs, sf_dir, output)
    if held:
        remove(spark, held)
    return index
