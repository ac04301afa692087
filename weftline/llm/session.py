"""Reading of tables, and names that clash with no column. Lineage is cut in the shared folder, as in the rest of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut, shared_dir

__all__ = ["cut", "fresh", "shared_dir", "table", "without"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for x in names:
        while x.lower() in taken:
            x = f"_{x}"
        out.append(x)
    return out


def without(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """docs less the documents (doc_id, th) of lost, which may be null or repeat; whatever other columns docs has."""
    a, b = fresh(docs, "__lost_id", "__lost_th")
    gone = lost.select(F.col("doc_id").alias(a), F.col("th").alias(b)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(F.col(a)) & (F.xxhash64(docs["text"].cast("string")) == F.col(b)), "left_anti")
