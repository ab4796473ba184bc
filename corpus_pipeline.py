"""From raw documents to packed training sequences, in five stages.

Each stage is a function (spark, docs, sf_dir) that returns a DataFrame. ``run`` writes what each
returns as Parquet in the cluster's shared folder and gives it, read again, to the next one.

Every stage takes whole texts of any length, and null and empty ones; rows with a null doc_id, and rows that
repeat; a null lang or source; and no rows, of which it makes none. Columns beside those of documents
do not matter, whatever their names, and all stages but the last leave them out. What a stage does with a
row of these kinds its own words say, and those of the operator that it calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm import line_dedup, mixing, packing, simhash, toxicity
from braidwork.llm.common import discard_since, materialize, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _as_documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars as the text is now."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled rows outside the held-out fold.

    A null or empty text has no toxic word and stays; rows that repeat share a fate.
    """
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of later occurrences of a three-line window go; every document stays.

    A null text stays null. Rows equal in doc_id and text are one document, and each keeps its lines.
    """
    return _as_documents(line_dedup.line_dedup(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: candidates by SimHash and by prefixes, verified at 0.8 on five-word shingles.

    All null and empty texts are one group; rows equal in doc_id and text share a fate; a null doc_id stays.
    """
    return simhash.keep_one(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights ask for.

    A null lang or source is a node of its own; texts without words weigh nothing and come along in their order;
    rows equal in doc_id and text share a fate.
    """
    return mixing.mix(docs).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens.

    A null or empty text is its end token; each row is packed, those that repeat too.
    """
    return packing.digest(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_repeated_lines),
    ("near-duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL can fit the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage has written beside its outcome, and its input, go when it is done."""
    docs, mark = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        discard_since(mark, docs)
    return docs
