"""The corpus pipeline: language ID, line dedup, n-gram join, decontamination, byte-level BPE.

Each stage works on all rows that the one before it kept, read back from
Parquet.  All but the last return the columns of ``documents``.
"""

from pyspark.sql import DataFrame, SparkSession

from assetpulse.llm import bpe, chosenpath, decontaminate, langid, linededup
from assetpulse.llm.common import staged
from assetpulse.sources.tables import read_table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the others go."""
    return langid.accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that a later document repeats; ``n_chars`` follows the text."""
    return linededup.dedup_texts(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return chosenpath.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and of their decoded bytes."""
    return bpe.round_trip(docs)


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("tokens", tokens)]

#: Stages 1 and 3 are models and sampled searches, which SQL can't express; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
