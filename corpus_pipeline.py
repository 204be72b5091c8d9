"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents; every stage works on all its predecessor
kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import Workspace, released, table
from quire.llm.mixing import mixed_documents
from quire.llm.packing import pack
from quire.llm.simhash import one_of_each
from quire.llm.substring import ADDED, remove_repeats
from quire.llm.toxicity import without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go.

    Null and empty texts are judged as texts without words; each row with a null or repeated doc_id is judged by its
    own text; an empty table stays empty.
    """
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest doc_id stays.

    Null and empty texts are one group; of equal rows one stays; rows with a null doc_id stay; an empty table stays
    empty.
    """
    return one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside repeated 35-word windows go; a document that loses all its words goes with them.

    Null texts become empty and stay, as they lose nothing; n_chars follows the new text; rows with a null or repeated
    doc_id are cut by their own texts; columns of any other names are kept; an empty table stays empty.
    """
    own = {c: f"__{c}" for c in docs.columns if c in ADDED}  # names that the operator uses for its counts
    cut = remove_repeats(docs.withColumnsRenamed(own)).where("n_removed = 0 or n_removed < n_words")
    cut = cut.drop(*own).withColumnsRenamed({v: k for k, v in own.items()})
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix has copies of them, so a document may be gone or come twice.

    A null source is a source of its own; documents without words come once; rows with one doc_id (or none) share its
    copies; an empty table stays empty.
    """
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in sequences.

    Null and empty texts are a piece of the end id alone; every row is packed, repeated ones and those without a doc_id
    too; an empty table gives no pieces.
    """
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("substring", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table. What a stage leaves in the shared folder goes when its successor is written."""
    ws = Workspace(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with released():
            docs = ws.save(stage(spark, docs, sf_dir), name)
        if before:
            ws.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)


#: Fitting, fingerprints, Newton steps and packing are beyond SQL; tests/llm hold them against brute force.
ORACLE_SQL = None
