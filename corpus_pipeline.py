"""From raw documents to a training mix: each stage's rows are written and are the next one's documents.

All stages take any columns beside doc_id, text and source through unchanged, whatever their names; repeated
rows, null ids and null texts are as each operator's docstring says. No documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm import decontaminate, lines, mixing, overlap, quality
from granary.llm._common import discard, settled, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the quality rules keep; null and short texts go."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that other documents hold too; a null text becomes empty."""
    return lines.drop_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that with the smallest id: SimHash with an exact check, then an exact search for what fingerprints miss. Rows without an id stay."""
    return overlap.keep_one(spark, docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that hold no item of `benchmark`."""
    return decontaminate.drop_contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, with how often as `copies`; a null source is a source."""
    return mixing.take(spark, docs)


STAGES = [("quality rules", good), ("line dedup", line_dedup), ("near dedup", near_dedup), ("decontamination", uncontaminated), ("mixing", mixed)]
#: Shingle sets and their components are not expressed in SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of the table `documents`. What a stage wrote on the way, and its input, are deleted once its result is there."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        done = settled(spark, lambda: stage(spark, docs, sf_dir), f"stage{k}")  # noqa: B023
        if k:
            discard(spark, docs)
        docs = done
    return docs
