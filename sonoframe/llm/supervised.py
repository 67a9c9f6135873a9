"""Labelled samples and calibration shared by the trained document scorers."""

from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoframe.llm.shared import attach, share, stored


def id_remainder(id_column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null ids give null."""
    return F.crc32(F.col(f"`{id_column}`").cast("string").cast("binary")) % divisor


def labelled_sample(docs: DataFrame, labels: DataFrame, label_column: str, may_learn: Column, max_rows: int,
                    id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, text, label, calibrates``: about ``max_rows`` labelled documents at most, drawn by a hash of the id; stored.

    ``may_learn`` is a condition on the label table's ``doc_id``.  Null labels and ids give nothing; an id with several labels counts
    as 1 if one of them is.  A fifth of the rows is set aside to calibrate.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col(label_column).cast("int").alias("label"), may_learn.alias("may")).filter(
        "may and label_id is not null and label is not null").groupBy("label_id").agg(F.max("label").alias("label"))
    known = stored(known)
    part = min(1.0, max_rows / max(1, known.count()))
    chosen = stored(known.filter(share("label_id", "sample", part)))
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    return stored(attach(rows, chosen, F.col("doc_id") == F.col("label_id"), "inner").select(
        "doc_id", "text", "label", share("doc_id", "calibrate", 0.2).alias("calibrates")))


def fit_isotonic(scored: DataFrame, raw: str, label: str = "label"):
    """Isotonic regression of the label on a raw score; ties in the score share their mean."""
    return IsotonicRegression(featuresCol=raw, labelCol="_label", predictionCol="_calibrated").fit(scored.withColumn("_label", F.col(label).cast("double")))


def calibrated(scored: DataFrame, model) -> DataFrame:
    return model.transform(scored).withColumn("_calibrated", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_calibrated"))))
