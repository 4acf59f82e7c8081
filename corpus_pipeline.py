"""The corpus pipeline: reject poor documents, keep one of each near-duplicate class, mask personal data, mix the sources to
their weights, and pack what is left into training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geocell.llm import mixing, neardup, packing, pii, quality
from geocell.llm.common import table, written
from geocell.llm.queries import tokenizer


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that it rejects go; source is the site's host, lang its path.

    Null and empty texts are judged by the features of an empty text; null sources and langs are sites of their own; rows
    without an id have no label; repeated rows stay or go together. Without labels all rows stay. Empty table: no row. The
    columns stay, whatever their names are.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: one document of each class of near duplicates stays, the one with the smallest id.

    Rows without an id and repeated rows are copies like others. Null and empty texts have no shingles and all stay. Nulls in
    other columns do not matter. Empty table: no row. The columns stay, whatever their names are.
    """
    return neardup.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: spans are replaced by their kind; n_chars follows where it is not null.

    Null texts stay null, empty ones empty; all rows stay, repeated ones too. Nulls in other columns do not matter. Empty
    table: no row. The columns stay.
    """
    return pii.redact(docs).withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: a document comes as often as the mix takes it, up to three times.

    Null sources are one source; null and empty texts have size 0 and may be taken; rows without an id and repeated rows are
    documents of their own. Empty table: no row. The columns stay, whatever their names are.
    """
    return mixing.sample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: a row for each piece of a document, with its place in a sequence of at most 2048 ids.

    Null and empty texts are their end id alone; null ids stay null; repeated rows are packed as often as they come. Empty
    table: no row. Other columns are ignored.
    """
    return packing.pack(docs, *tokenizer())


STAGES = [("quality", keep_good), ("near_duplicates", keep_one_of_each), ("personal_data", mask_personal_data), ("mixing", mix_sources), ("packing", pack)]
# A classifier, MinHash, a field and a tokenizer are not for SQL: the tests hold each stage, and run(), against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table, each on all that the one before kept; what a stage returns is written to the
    shared folder and read again. An empty table gives no row; nulls, empty texts and repeated rows are as in the stages."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
