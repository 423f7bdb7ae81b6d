"""The corpus pipeline: documents without toxic ones, near copies and personal data, mixed to weights and packed.

Every stage but the last returns the columns of documents, whatever further columns there are. `run` writes what each
stage returns and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import mixing, neardup, packing, pii, toxicity
from lodestone.llm.queries import vocabulary
from lodestone.llm.tables import Workspace, read_table
from lodestone.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go; clean ones, also without a label, stay."""
    ship(spark)
    return toxicity.without_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest id."""
    ship(spark)
    return neardup.deduplicate(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; spans of personal data become the names of their kinds."""
    ship(spark)
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    ship(spark)
    return mixing.repeat(docs, mixing.mix(docs, F.array("source")))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of a fixed window. A repeated document is packed as often as it occurs."""
    ship(spark)
    return packing.pack(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_documents),
]

#: A trained classifier, MinHash groups and a packing plan are not SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    space = Workspace(spark, "pipeline")
    for name, stage in STAGES:
        before, docs = docs, space.write(stage(spark, docs, sf_dir), name)
        if name != STAGES[0][0]:
            space.drop(before)
    return docs
