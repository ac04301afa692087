"""The corpus pipeline: five stages from raw documents to sampled token ids, each written as Parquet and read again."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontam, langmix, lattice, linedup, simhash
from weftline.llm.session import shared_dir, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some known language; those without letters and those that no language explains go."""
    return langmix.keep(docs, langmix.fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines are cut from the texts."""
    return linedup.strip(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.drop(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.drop(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document."""
    return lattice.encode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("tokenize", tokenize),
]

#: The stages fit models, follow chains of candidates and sample, which SQL can't express; their tests use brute force.
ORACLE_SQL: str | None = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, without and with rows, whatever other columns they have.

    What passes between them is in the shared checkpoint folder: a stage's result goes once the next one is written, so only the last, which is returned, stays.
    Repeated rows, nulls, empty and very long texts, ties and clashing columns are as each stage defines them; a row without letters goes in the first one, and a
    text of which nothing is left in the second. No documents: no rows, and the same columns.
    """
    docs = table(spark, sf_dir, "documents")
    folder = posixpath.join(shared_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    last = None
    for name, stage in STAGES:
        out = posixpath.join(folder, name)
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if last:
            _delete(spark, last)
        last = out
    return docs
