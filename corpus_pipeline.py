"""The corpus pipeline: five stages, each of which works on all that the one before has kept.

quality classifier -> quality rules -> near-duplicates -> personal data -> packing. All but the last return the columns of documents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import discriminant, nnls_packing, odd_sketch, rule_ledger, weak_pii
from tessera.llm._tables import forget, keep_only, table
from tessera.session import ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quadratic discriminant, learnt from the labelled ones, doesn't reject, with docs' columns.

    Each row is judged by its own text, also repeated rows and those without doc_id; a null text counts as empty and is scored like any other, and a text of any length is read whole. A score of
    exactly 0.5 stays. Without labels of both classes all rows stay. An empty table gives an empty one."""
    ship_package(spark)
    return discriminant.keep_good(docs, table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the current policy of the rule ledger keeps, with docs' columns.

    Each row is judged by its own whole text, also repeated rows and those without doc_id; null and empty texts have too few words and go. An empty table gives an empty one."""
    ship_package(spark)
    return rule_ledger.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by five-word shingles at a similarity of 0.8 or more, with docs' columns.

    It is the row with the smallest doc_id; rows without one come last, and of rows that tie any one stays. Rows without words (null and empty texts) are linked with nothing and all stay; a text of fewer
    than five words is one shingle. An empty table gives an empty one."""
    ship_package(spark)
    return odd_sketch.keep_one(docs, size=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data in their texts replaced by its kind and n_chars made to fit; the other columns of docs as they are.

    A null text stays null. Repeated rows and those without doc_id are treated like any other. An empty table gives an empty one."""
    ship_package(spark)
    return weak_pii.redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of at most 4096 tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is empty, and an empty one still has the end token. Repeated rows and those without doc_id are packed each on its own. An empty table gives no pieces."""
    ship_package(spark)
    return nnls_packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("rules", rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packing),
]
#: The first stage's model and the third's components can't be said in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's result is written as Parquet to the shared folder and read again as the next one's docs; what was written before it is deleted then."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, keep_only(lambda: stage(spark, docs, sf_dir), f"stage-{name}")  # noqa: B023
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
