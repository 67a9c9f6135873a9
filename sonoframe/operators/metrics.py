"""Selective classification metrics over prediction tables.

Input rows: ``label``, ``scores ARRAY<DOUBLE>`` in class order, ``eligible`` and any
grouping columns.  The big table is read once into counted cells; every metric
is then a small computation over cells.
"""

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoframe import settings
from sonoframe.functions import scores as P
from sonoframe.operators.ordering import exact_quantiles, running_totals


def judged(df: DataFrame, classes: Sequence[str], threshold: float) -> DataFrame:
    """Add ``confidence``, ``predicted``, ``accepted`` and ``correct``."""
    return (
        df.withColumn("confidence", P.confidence("scores"))
        .withColumn("predicted", P.pick_class("scores", classes))
        .withColumn("accepted", F.coalesce(F.col("eligible"), F.lit(False)) & (F.col("confidence") >= threshold))
        .withColumn("correct", F.col("predicted").eqNullSafe(F.col("label")) & F.col("label").isNotNull())  # an unknown truth is not met
    )


def selective_metrics(df: DataFrame, classes: Sequence[str], threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """Coverage, rejection and accepted-error counts and rates."""
    accepted = F.count_if("accepted")
    errors = F.count_if(F.col("accepted") & ~F.col("correct"))
    return judged(df, classes, threshold).groupBy(*by).agg(
        F.count("*").alias("sample_count"), accepted.alias("accepted_count"),
        (accepted / F.count("*")).alias("coverage"), (1.0 - accepted / F.count("*")).alias("rejection_rate"),
        errors.alias("accepted_error_count"),
        F.when(accepted > 0, errors / accepted).alias("accepted_error_rate"),
        F.count_if(F.coalesce(~F.col("label").isin(*classes), F.lit(True))).alias("unsupported_truth_count"),
    )


def unsupported(df: DataFrame, classes: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows whose truth is outside the model's classes."""
    return df.groupBy(*by).agg(F.count_if(F.coalesce(~F.col("label").isin(*classes), F.lit(True))).alias("unsupported_truth_count"))


def cells(df: DataFrame, classes: Sequence[str], threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """Counts by (truth, predicted, accepted): at most labels x classes x 2 rows per group."""
    return judged(df, classes, threshold).groupBy(*by, "label", "predicted", "accepted").agg(F.count("*").alias("n"))


def confusion(df: DataFrame, classes: Sequence[str], threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """Zero-filled confusion counts over the classes and every unseen truth label."""
    counted = cells(df, classes, threshold, by)
    known = F.array(*[F.lit(c) for c in classes])
    seen = counted.groupBy(*by).agg(F.array_sort(F.collect_set("label")).alias("_seen"))
    axis = seen.select(*by, F.concat(known, F.array_except("_seen", known)).alias("_axis"))
    grid = axis.select(*by, "_axis", F.explode("_axis").alias("label")).select(
        *by, "label", F.explode("_axis").alias("predicted"))
    hits = counted.filter("accepted").groupBy(*by, "label", "predicted").agg(F.sum("n").alias("n"))
    return grid.join(hits, [*by, "label", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def per_class(df: DataFrame, classes: Sequence[str], threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class on accepted rows; 0 where undefined.

    ``observed`` marks labels present in the truth of *all* rows of the group.
    """
    counted = cells(df, classes, threshold, by)
    hit = F.col("accepted") & (F.col("label") == F.col("predicted"))
    truth = counted.groupBy(*by, "label").agg(
        F.sum(F.when(F.col("accepted"), F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp"), F.lit(True).alias("observed"))
    guessed = counted.filter("accepted").groupBy(*by, F.col("predicted").alias("label")).agg(F.sum("n").alias("guesses"))
    domain = counted.groupBy(*by).agg(F.lit(1).alias("_one")).select(
        *by, F.explode(F.array(*[F.lit(c) for c in classes])).alias("label"))
    names = domain.unionByName(truth.select(*by, "label")).distinct()
    keys = [*by, "label"]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return (
        names.join(truth, keys, "left").join(guessed, keys, "left")
        .select(*keys, zero("support").alias("support"), zero("tp").alias("tp"), zero("guesses").alias("guesses"),
                F.coalesce("observed", F.lit(False)).alias("observed"))
        .select(*keys, "observed", "support", ratio(F.col("tp"), F.col("guesses")).alias("precision"),
                ratio(F.col("tp"), F.col("support")).alias("recall"),
                ratio(2 * F.col("tp"), F.col("support") + F.col("guesses")).alias("f1"))
    )


def macro_scores(df: DataFrame, classes: Sequence[str], threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """Macro F1 and mean recall over the observed labels; NULL when nothing is accepted."""
    table = per_class(df, classes, threshold, by)
    observed = lambda c: F.avg(F.when(F.col("observed"), F.col(c)))
    any_accepted = F.sum("support") > 0
    return table.groupBy(*by).agg(
        F.when(any_accepted, observed("f1")).alias("macro_f1"), F.when(any_accepted, observed("recall")).alias("uar"))


def _calibratable(df: DataFrame, classes: Sequence[str]) -> DataFrame:
    return df.filter(F.col("eligible") & F.col("label").isin(*classes))


def brier(df: DataFrame, classes: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean multiclass Brier score of eligible rows with a supported truth."""
    return _calibratable(df, classes).groupBy(*by).agg(
        F.count("*").alias("calibration_count"), F.avg(P.brier_row("scores", "label", classes)).alias("brier_score"))


def ece_bin(conf: Column) -> Column:
    """Bin number 0-9 on the fixed edges; the last bin includes 1."""
    number = F.lit(0)
    for i, edge in enumerate(settings.ECE_EDGES[1:-1], start=1):
        number = F.when(conf >= edge, F.lit(i)).otherwise(number)
    return number


def ece(df: DataFrame, classes: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Expected calibration error over ten equal confidence bins."""
    bins = (
        judged(_calibratable(df, classes), classes, 0.0)
        .groupBy(*by, ece_bin(F.col("confidence")).alias("bin"))
        .agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("hit"), F.avg("confidence").alias("conf"))
    )
    return bins.groupBy(*by).agg(
        (F.sum(F.col("n") * F.abs(F.col("hit") - F.col("conf"))) / F.sum("n")).alias("expected_calibration_error"))


def classification_metrics(
    df: DataFrame, classes: Sequence[str], threshold: float, by: Sequence[str] = ("condition",)
) -> DataFrame:
    """All scalar metrics, one row per group, from a single pass over the predictions.

    The pass leaves counted cells (truth, predicted, accepted, calibration bin); a
    group's cells are bounded by labels x classes x 40, so the metrics are folds over
    one short array per group.
    """
    by = list(by)
    usable = F.col("eligible") & F.col("label").isin(*classes)
    table = (
        judged(df, classes, threshold).withColumn("_usable", F.coalesce(usable, F.lit(False)))
        .groupBy(*by, "label", "predicted", "accepted", "_usable", ece_bin(F.col("confidence")).alias("_bin"))
        .agg(F.count("*").alias("n"), F.sum("confidence").alias("conf"),
             F.sum(F.when(F.col("_usable"), P.brier_row("scores", "label", classes))).alias("brier"))
        .groupBy(*by)
        .agg(F.collect_list(F.struct("label", "predicted", "accepted", "_usable", "_bin", "n", "conf", "brier")).alias("_cells"))
    )

    def total(condition, value=lambda c: c["n"].cast("double")):
        return F.aggregate(F.filter("_cells", condition), F.lit(0.0), lambda acc, c: acc + value(c))

    accepted, right = lambda c: c["accepted"], lambda c: c["label"] == c["predicted"]
    everything = lambda c: F.lit(True)
    ratio = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
    support = lambda name: total(lambda c: accepted(c) & (c["label"] == name))
    guesses = lambda name: total(lambda c: accepted(c) & (c["predicted"] == name))
    hits = lambda name: total(lambda c: accepted(c) & right(c) & (c["label"] == name))
    per_label = F.transform("_observed", lambda name: F.struct(
        ratio(hits(name), support(name)).alias("recall"), ratio(2.0 * hits(name), support(name) + guesses(name)).alias("f1")))
    mean_of = lambda field: F.when(F.col("_accepted") > 0, F.aggregate(
        "_per_label", F.lit(0.0), lambda acc, x: acc + x[field]) / F.size("_per_label"))
    in_bin = lambda i: lambda c: c["_usable"] & (c["_bin"] == i)
    hits_in = lambda i: lambda c: in_bin(i)(c) & right(c)
    gap_sum = F.lit(0.0)
    for i in range(10):
        gap_sum = gap_sum + F.abs(total(hits_in(i)) - total(in_bin(i), lambda c: c["conf"]))
    calibrated, count = F.col("_calibrated"), F.col("_rows")
    return (
        table.withColumn("_observed", F.array_distinct(F.transform("_cells", lambda c: c["label"])))
        .withColumn("_rows", total(everything)).withColumn("_accepted", total(accepted))
        .withColumn("_errors", total(lambda c: accepted(c) & ~right(c)))
        .withColumn("_calibrated", total(lambda c: c["_usable"])).withColumn("_per_label", per_label)
        .select(
            *by, count.cast("long").alias("sample_count"), F.col("_accepted").cast("long").alias("accepted_count"),
            (F.col("_accepted") / count).alias("coverage"), (1.0 - F.col("_accepted") / count).alias("rejection_rate"),
            F.col("_errors").cast("long").alias("accepted_error_count"),
            F.when(F.col("_accepted") > 0, F.col("_errors") / F.col("_accepted")).alias("accepted_error_rate"),
            total(lambda c: ~c["label"].isin(*classes)).cast("long").alias("unsupported_truth_count"),
            mean_of("f1").alias("macro_f1"), mean_of("recall").alias("uar"), calibrated.cast("long").alias("calibration_count"),
            F.when(calibrated > 0, total(lambda c: c["_usable"], lambda c: c["brier"]) / calibrated).alias("brier_score"),
            F.when(calibrated > 0, gap_sum / calibrated).alias("expected_calibration_error"))
    )


def reason_counts(df: DataFrame, reason: str = "reason", by: Sequence[str] = ()) -> DataFrame:
    return df.filter(F.col(reason).isNotNull()).groupBy(*by, reason).agg(F.count("*").alias("rows"))


def aggregate_recordings(
    df: DataFrame, classes: Sequence[str], keys: Sequence[str] = ("dataset_id", "recording_id"), *, strict: bool = True
) -> DataFrame:
    """Mean scores of a recording's eligible windows; uniform and ineligible if none.

    ``strict`` fails the job when a recording carries two labels or two speakers.
    """
    means = [F.avg(F.when(F.col("eligible"), F.col("scores")[i])) for i in range(len(classes))]
    grouped = df.groupBy(*keys).agg(
        F.min("label").alias("label"), F.max("label").alias("_label2"),
        F.min("speaker_id").alias("speaker_id"), F.max("speaker_id").alias("_speaker2"),
        F.bool_or("eligible").alias("eligible"), F.count("*").alias("windows"),
        *[m.alias(f"_p{i}") for i, m in enumerate(means)])
    single = F.col("label").eqNullSafe(F.col("_label2")) & F.col("speaker_id").eqNullSafe(F.col("_speaker2"))
    scores = F.array(*[F.coalesce(f"_p{i}", F.lit(1.0 / len(classes))) for i in range(len(classes))])
    out = grouped.withColumn("scores", scores)
    if strict:
        # a filter, which no projection can prune
        out = out.filter(F.when(single, F.lit(True)).otherwise(F.raise_error(F.lit("one source recording must have one label and one speaker")).cast("boolean")))
    else:
        out = out.withColumn("consistent", single)
    return out.drop("_label2", "_speaker2", *[f"_p{i}" for i in range(len(classes))])


def bootstrap_ci(
    df: DataFrame, classes: Sequence[str], threshold: float, *, seed: int = 42, resamples: int = 1000
) -> DataFrame:
    """Percentile intervals of the metrics from a bootstrap stratified by true label.

    Every reported metric depends only on how many rows of a label fall in each
    (accepted, predicted) cell, and resampling a label's rows with replacement is a
    multinomial draw over its cells.  So the table is reduced to cells once and
    the resamples are ``resamples`` independent rows of work.  Runs a job for the
    cells (labels x classes x 2 rows).
    """
    rows = cells(df, classes, threshold).collect()
    labels = sorted({r["label"] for r in rows})
    names = list(classes)
    table = np.zeros((len(labels), len(names) + 1), dtype=np.int64)  # last column: rejected
    for r in rows:
        table[labels.index(r["label"]), names.index(r["predicted"]) if r["accepted"] else -1] += r["n"]
    target = np.array([names.index(x) if x in names else -1 for x in labels])
    columns = ["macro_f1", "uar", "coverage", "accepted_error_rate", *[f"recall_{c}" for c in names]]

    def draw(batches):
        for batch in batches:
            out = []
            for b in batch["id"]:
                rng = np.random.default_rng([seed, int(b)])
                n = np.stack([rng.multinomial(row.sum(), row / row.sum()) for row in table])
                hits = np.array([n[i, t] if t >= 0 else 0 for i, t in enumerate(target)])
                support, accepted = n[:, :-1].sum(axis=1), n[:, :-1].sum()
                guesses = np.array([n[:, t].sum() if t >= 0 else 0 for t in target])
                recall = hits / np.maximum(support, 1)
                f1 = 2 * hits / np.maximum(support + guesses, 1)
                by_name = dict(zip(labels, recall))
                values = [f1.mean(), recall.mean(), accepted / n.sum(), 1 - hits.sum() / max(accepted, 1)]
                if accepted == 0:
                    values = [None, None, 0.0, None]
                out.append([*values, *[float(by_name.get(c, 0.0)) for c in names]])
            yield pd.DataFrame(out, columns=columns)

    draws = df.sparkSession.range(resamples).mapInPandas(draw, ", ".join(f"{c} double" for c in columns))
    stacked = draws.unpivot([], columns, "metric", "value").filter(F.col("value").isNotNull())
    return stacked.groupBy("metric").agg(
        F.count("*").alias("draws"), F.percentile("value", F.lit(0.025)).alias("low"), F.percentile("value", F.lit(0.975)).alias("high"))


def anonymous_ranges(
    df: DataFrame, classes: Sequence[str], threshold: float, entity: str = "speaker_id", focus: str = "happy"
) -> DataFrame:
    """Minimum and maximum of each metric across entities, with the entity key dropped."""
    table = selective_metrics(df, classes, threshold, [entity]).join(
        macro_scores(df, classes, threshold, [entity]), entity)
    focused = per_class(df, classes, threshold, [entity]).filter(F.col("label") == focus)
    table = table.join(focused.select(entity, F.col("recall").alias("focus_recall")), entity, "left")
    fields = ["macro_f1", "uar", "focus_recall", "coverage", "accepted_error_rate"]
    return table.agg(
        F.count("*").alias("entity_count"),
        F.min("sample_count").alias("min_rows"), F.max("sample_count").alias("max_rows"),
        *[f(F.col(c)).alias(f"{n}_{c}") for c in fields for n, f in (("min", F.min), ("max", F.max))])


def latency_summary(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, median and 95th percentile of a measured value (exact, distributed)."""
    return exact_quantiles(df, column, {"median": 0.5, "p95": 0.95}, by).withColumnRenamed("n", "sample_count")


def compare_runs(
    left: DataFrame, right: DataFrame, on: Sequence[str] = ("condition",),
    metrics: Sequence[str] = ("macro_f1", "uar", "coverage", "rejection_rate", "accepted_error_rate"),
) -> DataFrame:
    """Right minus left per shared condition; a delta is NULL when either side is."""
    a = left.select(*on, *[F.col(m).alias(f"left_{m}") for m in metrics])
    b = right.select(*on, *[F.col(m).alias(f"right_{m}") for m in metrics])
    return a.join(b, list(on)).select("*", *[(F.col(f"right_{m}") - F.col(f"left_{m}")).alias(f"delta_{m}") for m in metrics])


def threshold_sweep(df: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Correctness F1 of every candidate threshold: 0, each confidence and 1.

    Rows collapse to one per distinct confidence before the running sums, which
    are range-partitioned, so the sweep sorts counts and not rows.
    """
    counted = judged(df.withColumn("eligible", F.lit(True)), classes, 0.0).groupBy("confidence").agg(
        F.count("*").alias("n"), F.count_if("correct").alias("good"))
    spark = df.sparkSession
    ends = spark.createDataFrame([(0.0, 0, 0), (1.0, 0, 0)], "confidence double, n long, good long")
    points = counted.unionByName(ends).groupBy("confidence").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    down = points.withColumn("_desc", -F.col("confidence"))
    swept = running_totals(down, "_desc", {"accepted": "n", "tp": "good"})
    totals = counted.agg(F.sum("n").alias("rows"), F.sum("good").alias("all_good")).first()
    rows, good = totals["rows"] or 0, totals["all_good"] or 0
    fp, fn = F.col("accepted") - F.col("tp"), F.lit(good) - F.col("tp")
    bottom = 2 * F.col("tp") + fp + fn
    return swept.select(
        F.col("confidence").alias("threshold"), F.when(bottom > 0, 2.0 * F.col("tp") / bottom).otherwise(F.lit(0.0)).alias("f1"),
        F.col("accepted").alias("accepted_count"), fp.alias("accepted_error_count"),
        (F.col("accepted") / F.lit(max(rows, 1))).alias("coverage"))


def select_threshold(df: DataFrame, classes: Sequence[str]) -> DataFrame:
    """The threshold with the best correctness F1; the higher one on a tie.  Runs jobs."""
    best = threshold_sweep(df, classes).agg(
        F.max_by(F.struct("threshold", "f1", "accepted_count", "accepted_error_count", "coverage"),
                 F.struct("f1", "threshold")).alias("b"))
    return best.select(
        F.col("b.threshold").alias("threshold"), F.col("b.f1").alias("correctness_f1"),
        F.col("b.accepted_count").alias("accepted_count"), F.col("b.coverage").alias("coverage"),
        (1.0 - F.col("b.coverage")).alias("rejection_rate"), F.col("b.accepted_error_count").alias("accepted_error_count"),
        F.when(F.col("b.accepted_count") > 0, F.col("b.accepted_error_count") / F.col("b.accepted_count")).alias("accepted_error_rate"))
