"""A training corpus from documents, in five stages. Each stage's rows are written and read
again as the next one's docs.

All stages take null texts as empty, give no rows for an empty table, and return all columns
of docs but for packing, also those that are named like columns of the operators. Rows that
repeat an id and a text are judged alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markweave.llm import line_dedup, mixing, packing, quality, simhash
from markweave.llm.common import read_table, saved, set_aside


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars, where docs has it, follows the text; that of a null text stays."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; the others lose the lines that too many
    documents of their source hold, but for the first that holds one. A null or empty text is
    rejected, a null source is a source of its own, a null doc_id comes first."""
    return _counted(quality.keep_good(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document of a lesser id holds go (a null id is the least); documents stay,
    if need be with an empty text. Rows with one id are one document."""
    rows, back = set_aside(docs, "n_lines", "n_dropped")
    return _counted(line_dedup.dedup_lines(rows).select(*back))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the least id: groups are linked by a Jaccard
    similarity of 0.8 and more of five-word shingles. All texts without words are a group."""
    return simhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out so that sources come at their target weights; a null source
    belongs to the rest."""
    return mixing.mixed_order(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in training sequences, which follow the mixed order. An
    empty text is a piece of one token; repeated rows are packed each."""
    return packing.pack_documents(docs, in_order=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", near_dedup),
    ("source mixing", mix),
    ("best-fit packing", pack),
]
#: Packing and SimHash have no SQL form: tests/llm/test_pipeline.py has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
