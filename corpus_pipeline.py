"""From documents to packed training windows: five stages, each on all that the one before it kept.

run() writes every stage's rows as Parquet to the shared folder and reads them again as the next
one's docs. All stages but the last return the columns of documents. No SQL expresses the trained
first stage, so ORACLE_SQL is None and the tests hold run() against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm.common import materialize, table
from loomstone.llm.copies import without_copies
from loomstone.llm.mixing import mixed_rows
from loomstone.llm.packing import pack
from loomstone.llm.simhash import one_of_each
from loomstone.llm.suffixes import LENGTH, dedup
from loomstone.llm.toxicity import fit, held_out, without_toxic

#: Bytes of a repeated passage that goes: 51 words have as many in all but a few of the given texts (README).
PASSAGE = 200


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the subword model rejects go; it learns from the labels that op10 learns from.

    Null and empty texts get what the bias alone says and stay unless most labelled rows are toxic; long
    texts are read whole; rows that are equal are judged alike; an empty table stays empty; a table whose rows
    have no labels teaches nothing, and nothing goes.
    """
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return without_toxic(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: of null, empty and wordless texts one, of rows that repeat one, of ties the least doc_id."""
    return one_of_each(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, and of these none with an earlier one of 0.8 of its five-word shingles (Jaccard).

    Earlier is the one of lesser doc_id, a null one last. Texts without words have no copies but each other.
    """
    return without_copies(near_duplicates(spark, docs, sf_dir))


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str, length: int = LENGTH) -> DataFrame:
    """Bytes of strings of `length` bytes that stand twice or more are cut out of the texts; n_chars follows.

    Every row stays: null texts null, shorter ones as they are, those that repeat as a whole without text.
    """
    return dedup(docs, rewrite=True, length=length, counts=False)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """repeated_spans() at a length below that of passages of 51 words."""
    return repeated_spans(spark, docs, sf_dir, PASSAGE)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights: each document stays as often as the mix takes it, three times at most.

    Rows without words (null and empty texts among them) have nothing to take and go; a null source is one of its own.
    """
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents, each in its place in a window; null and empty texts are an end id alone."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_copies),
    ("repeated_spans", repeated_passages),
    ("mixture", mixture),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that pass the stages."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
