"""Five corpus stages over ``documents``: quality, near-duplicates, decontamination, private data, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each one's rows are written as
Parquet to the shared folder and read again as the next one's ``docs``. All but the last keep the
columns of ``documents``. Nulls: a null text is scored, fingerprinted and searched as an empty one
and stays null; a row with a null id is never dropped as a duplicate or as contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.llm import decontam, mixing, pii, quality, simhash
from cuewright.llm.common import Scratch, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier scores 0.7 or more."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each SimHash group."""
    return simhash.keep_first(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the new text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by Poisson draws so that sources meet their target weights."""
    return mixing.mix_sources(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("PII", mask_private),
    ("mixing sources to target weights", mix),
]

#: Trained models decide in two stages, so SQL can't express run(); tests compare it with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch, before = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), None
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
