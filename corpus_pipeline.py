"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, mixing to target weights, packing.

Every stage takes null ids, texts and sources, empty and very long texts, repeated rows, empty tables and further columns under any name, which
pass through all stages but the last.  The stages say what becomes of such rows.
"""

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.llm import lines, mixing, packing, simhash, toxicity
from sonoframe.llm.shared import shared_folder
from sonoframe.session import bounded_batches


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the trained scorer calls toxic go; learning follows the rule of its query.

    Null and empty texts get the score of a text without words, equal texts the same score, whatever their ids.
    """
    model = toxicity.fit_on_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score, taken = "_toxicity", {c.lower() for c in docs.columns}
    while score in taken:
        score += "_"
    return toxicity.score_toxicity(docs, model, to=score).filter(F.col(score) < 0.5).drop(score)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines leave the texts; every document stays, with its new length.

    Null texts stay null, and a document may end empty; rows without an id keep all lines.  Rows of several texts under one id lose a
    position together.
    """
    return lines.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-copies the document with the smallest id stays, and one of its repeated rows; so does each row without an id.

    Null and blank texts are copies of each other.
    """
    return simhash.keep_one_per_component(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources uses it; a null source is a source, and texts without words come as often as their whole source."""
    return mixing.mixed_documents(docs).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents in sequences; a null or empty text is its closing token alone."""
    return packing.pack(docs)


def _bounded(stage):
    """The stage with Arrow batches of whole texts limited in bytes, in the JVM and in Python, however long the texts are."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [(name, _bounded(stage)) for name, stage in (
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
)]

ORACLE_SQL = None  # a trained scorer, sketches and a byte-pair encoder are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents, each written and reread before the next; an empty table gives an empty result."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, rows, sf_dir).write.parquet(f"{folder}/{name}")
        rows = spark.read.parquet(f"{folder}/{name}")
    return rows
