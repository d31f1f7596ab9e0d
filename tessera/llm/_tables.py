"""Reading tables, and carrying a table's own columns through a batch function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.tables import forget, keep, keep_only, release, shared_dir

__all__ = ["forget", "keep", "keep_only", "release", "rolled", "shared_dir", "table", "unrolled"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rolled(docs: DataFrame) -> DataFrame:
    """text (as string) and own, a struct of all other columns, so that a batch function can add columns of any name; unrolled() gives docs' columns back."""
    filler = "_"  # a struct needs a field
    while filler.lower() in map(str.lower, docs.columns):
        filler += "_"
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], F.lit(0).alias(filler)).alias("own"), F.col("text").cast("string").alias("text"))


def unrolled(rows: DataFrame, docs: DataFrame, **instead: Column) -> DataFrame:
    """The columns of docs from rows that rolled() made, some of them replaced."""
    return rows.select(*[(instead[c] if c in instead else F.col("text") if c == "text" else F.col("own").getField(c)).alias(c) for c in docs.columns])
