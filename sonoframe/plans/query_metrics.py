"""Queries over prediction tables made from the embeddings table."""

from pyspark.sql import functions as F

from sonoframe import settings
from sonoframe.functions import scores as P
from sonoframe.operators import metrics as MT
from sonoframe.plans.registry import block_total, block_total_sql, load, query, r6, rounded, s6

CLASSES = settings.EMOTIONS
TRUTHS = (*CLASSES, "fear")
SLOPES, INTERCEPTS = (6.0, 7.0, 8.0, 9.0), (-0.5, 0.1, 0.0, -0.2)
THRESHOLD = 0.3


def margins(spark, sf_dir):
    """Scaled means of four blocks of each row's values as raw margins, plus a truth label per four rows."""
    block = F.expr("vec_id div 4")
    names = F.array(*[F.lit(t) for t in TRUTHS])
    return load(spark, sf_dir, "embeddings").select(
        "vec_id", F.array(*[block_total("embedding", b, 16) / 4 for b in range(4)]).alias("margins"),
        F.element_at(names, (F.pmod(block, F.lit(5)) + 1).cast("int")).alias("label"),
        F.concat(F.lit("s"), F.pmod(block, F.lit(11)).cast("string")).alias("speaker_id"),
        block.alias("recording_id"), F.lit("d").alias("dataset_id"),
        F.concat(F.lit("c"), F.pmod("vec_id", F.lit(3)).cast("string")).alias("condition"),
        (F.pmod("vec_id", F.lit(7)) != 0).alias("eligible"))


def predictions(spark, sf_dir):
    return margins(spark, sf_dir).withColumn("scores", P.calibrated_scores("margins", SLOPES, INTERCEPTS)).drop("margins")


BLOCKS = "[" + ", ".join(f"{block_total_sql('embedding', b, 16)} / 4" for b in range(4)) + "]"
SCORED = f"""e AS (SELECT vec_id, ['neutral','happy','angry','sad','fear'][(vec_id // 4) % 5 + 1] AS label, 's' || (vec_id // 4) % 11 AS speaker_id,
  vec_id // 4 AS recording_id, 'c' || vec_id % 3 AS condition, vec_id % 7 <> 0 AS eligible,
  list_transform({BLOCKS}, lambda x, i: 1 / (1 + exp(-(x * ({list(SLOPES)}::DOUBLE[])[i] + ({list(INTERCEPTS)}::DOUBLE[])[i])))) AS raw FROM embeddings),
s AS (SELECT *, list_transform(raw, lambda x: x / list_sum(raw)) AS p FROM e)"""
JUDGED = "['neutral','happy','angry','sad'][list_position(p, list_max(p))]"
PRED = f"""{SCORED}, j AS (SELECT *, list_max(p) AS confidence, {JUDGED} AS predicted, eligible AND list_max(p) >= {THRESHOLD} AS accepted FROM s)"""


@query("calibrated_scores", f"""WITH {SCORED}
SELECT vec_id, {s6('p[1]')} AS p0, {s6('p[2]')} AS p1, {s6('p[3]')} AS p2, {s6('p[4]')} AS p3, {JUDGED} AS predicted, {s6('list_max(p)')} AS confidence,
  {s6("list_sum(list_transform(p, lambda x, i: (x - (label = ['neutral','happy','angry','sad'][i])::INT) * (x - (label = ['neutral','happy','angry','sad'][i])::INT)))")} AS brier_row FROM s""")
def calibrated_scores(spark, sf_dir):
    df = predictions(spark, sf_dir)
    return df.select(
        "vec_id", *[r6(F.col("scores")[i]).alias(f"p{i}") for i in range(4)], P.pick_class("scores", CLASSES).alias("predicted"),
        r6(P.confidence("scores")).alias("confidence"), r6(P.brier_row("scores", "label", CLASSES)).alias("brier_row"))


@query("selective_metrics", f"""WITH {PRED}
SELECT condition, count(*) AS sample_count, count(*) FILTER (accepted) AS accepted_count, {s6('avg(accepted::INT)')} AS coverage, {s6('1 - avg(accepted::INT)')} AS rejection_rate,
 count(*) FILTER (accepted AND predicted <> label) AS accepted_error_count, {s6('count(*) FILTER (accepted AND predicted <> label) / nullif(count(*) FILTER (accepted), 0)')} AS accepted_error_rate,
 count(*) FILTER (label = 'fear') AS unsupported_truth_count FROM j GROUP BY condition""")
def selective_metrics(spark, sf_dir):
    return rounded(MT.selective_metrics(predictions(spark, sf_dir), CLASSES, THRESHOLD, ["condition"]),
                   "coverage", "rejection_rate", "accepted_error_rate")


@query("unsupported_truth", f"WITH {PRED} SELECT condition, count(*) FILTER (label = 'fear') AS unsupported_truth_count FROM j GROUP BY condition")
def unsupported_truth(spark, sf_dir):
    return MT.unsupported(predictions(spark, sf_dir), CLASSES, ["condition"])


@query("confusion", f"""WITH {PRED}, a AS (SELECT unnest(['neutral','happy','angry','sad','fear']) AS label), b AS (SELECT label AS predicted FROM a), c AS (SELECT DISTINCT condition FROM j)
SELECT c.condition, a.label, b.predicted, count(j.vec_id) AS n FROM c CROSS JOIN a CROSS JOIN b LEFT JOIN j ON j.condition = c.condition AND j.label = a.label AND j.predicted = b.predicted AND j.accepted
GROUP BY ALL""")
def confusion(spark, sf_dir):
    return MT.confusion(predictions(spark, sf_dir), CLASSES, THRESHOLD, ["condition"])


PER_CLASS = f"""{PRED}, k AS (SELECT unnest(['neutral','happy','angry','sad','fear']) AS label), c AS (SELECT DISTINCT condition FROM j),
t AS (SELECT c.condition, k.label, count(*) FILTER (j.accepted AND j.label = k.label) AS support, count(*) FILTER (j.accepted AND j.predicted = k.label) AS guesses,
  count(*) FILTER (j.accepted AND j.label = k.label AND j.predicted = k.label) AS tp, bool_or(j.label = k.label) AS observed
  FROM c CROSS JOIN k JOIN j ON j.condition = c.condition GROUP BY ALL),
m AS (SELECT condition, label, observed, support, coalesce(tp / nullif(guesses, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(support + guesses, 0), 0) AS f1 FROM t)"""


@query("per_class", f"WITH {PER_CLASS} SELECT condition, label, observed, support, {s6('precision')} AS precision, {s6('recall')} AS recall, {s6('f1')} AS f1 FROM m")
def per_class(spark, sf_dir):
    return rounded(MT.per_class(predictions(spark, sf_dir), CLASSES, THRESHOLD, ["condition"]), "precision", "recall", "f1")


MACRO = "SELECT condition, avg(f1) FILTER (observed) AS macro_f1, avg(recall) FILTER (observed) AS uar FROM m GROUP BY condition"


@query("macro_scores", f"WITH {PER_CLASS}, z AS ({MACRO}) SELECT condition, {s6('macro_f1')} AS macro_f1, {s6('uar')} AS uar FROM z")
def macro_scores(spark, sf_dir):
    return rounded(MT.macro_scores(predictions(spark, sf_dir), CLASSES, THRESHOLD, ["condition"]), "macro_f1", "uar")


BRIER = """SELECT condition, count(*) AS calibration_count, avg(list_sum(list_transform(p, lambda x, i: (x - (label = ['neutral','happy','angry','sad'][i])::INT) * (x - (label = ['neutral','happy','angry','sad'][i])::INT)))) AS brier_score
 FROM j WHERE eligible AND label <> 'fear' GROUP BY condition"""
ECE = """SELECT condition, sum(n * abs(hit - conf)) / sum(n) AS expected_calibration_error FROM (SELECT condition, least(floor(confidence * 10), 9) AS bin, count(*) AS n, avg((predicted = label)::INT) AS hit, avg(confidence) AS conf
 FROM j WHERE eligible AND label <> 'fear' GROUP BY ALL) GROUP BY condition"""


@query("brier", f"WITH {PRED}, b AS ({BRIER}) SELECT condition, calibration_count, {s6('brier_score')} AS brier_score FROM b")
def brier(spark, sf_dir):
    return rounded(MT.brier(predictions(spark, sf_dir), CLASSES, ["condition"]), "brier_score")


@query("calibration_error", f"WITH {PRED}, b AS ({ECE}) SELECT condition, {s6('expected_calibration_error')} AS expected_calibration_error FROM b")
def calibration_error(spark, sf_dir):
    return rounded(MT.ece(predictions(spark, sf_dir), CLASSES, ["condition"]), "expected_calibration_error")


@query("classification_metrics", f"""WITH {PER_CLASS}, z AS ({MACRO}), b AS ({BRIER}), q AS ({ECE}),
 a AS (SELECT condition, count(*) AS sample_count, count(*) FILTER (accepted) AS accepted_count FROM j GROUP BY condition)
SELECT condition, sample_count, accepted_count, {s6('macro_f1')} AS macro_f1, {s6('uar')} AS uar, calibration_count, {s6('brier_score')} AS brier_score,
  {s6('expected_calibration_error')} AS expected_calibration_error FROM a JOIN z USING (condition) JOIN b USING (condition) JOIN q USING (condition)""")
def classification_metrics(spark, sf_dir):
    df = MT.classification_metrics(predictions(spark, sf_dir), CLASSES, THRESHOLD, ["condition"])
    return rounded(df, "macro_f1", "uar", "brier_score", "expected_calibration_error").select(
        "condition", "sample_count", "accepted_count", "macro_f1", "uar", "calibration_count", "brier_score", "expected_calibration_error")


@query("rejection_reasons", f"""WITH {PRED} SELECT condition, CASE WHEN NOT eligible THEN 'LOW_QUALITY' WHEN NOT accepted THEN 'BELOW_VALIDATION_THRESHOLD' END AS reason, count(*) AS "rows"
 FROM j WHERE NOT accepted GROUP BY ALL""")
def rejection_reasons(spark, sf_dir):
    df = MT.judged(predictions(spark, sf_dir), CLASSES, THRESHOLD)
    return MT.reason_counts(df.withColumn("reason", F.when(~F.col("eligible"), "LOW_QUALITY").when(
        ~F.col("accepted"), "BELOW_VALIDATION_THRESHOLD")), by=["condition"])


@query("recording_means", f"""WITH {SCORED}
SELECT recording_id, any_value(label) AS label, any_value(speaker_id) AS speaker_id, bool_or(eligible) AS eligible, count(*) AS windows,
 {", ".join(s6(f"coalesce(avg(p[{i + 1}]) FILTER (eligible), 0.25)") + f" AS p{i}" for i in range(4))} FROM s GROUP BY recording_id""")
def recording_means(spark, sf_dir):
    df = MT.aggregate_recordings(predictions(spark, sf_dir), CLASSES)
    return df.select("recording_id", "label", "speaker_id", "eligible", "windows", *[r6(F.col("scores")[i]).alias(f"p{i}") for i in range(4)])


_SPEAKER = PER_CLASS.replace("condition", "speaker_id").replace("'s' || (vec_id // 4) % 11 AS speaker_id,", "", 1).replace(
    "'c' || vec_id % 3 AS speaker_id", "'s' || (vec_id // 4) % 11 AS speaker_id")


@query("speaker_ranges", f"""WITH {_SPEAKER},
 z AS (SELECT speaker_id, CASE WHEN sum(support) > 0 THEN avg(f1) FILTER (observed) END AS macro_f1, CASE WHEN sum(support) > 0 THEN avg(recall) FILTER (observed) END AS uar, max(recall) FILTER (label = 'happy') AS focus_recall FROM m GROUP BY speaker_id),
 a AS (SELECT speaker_id, count(*) AS n, avg(accepted::INT) AS coverage, count(*) FILTER (accepted AND predicted <> label) / nullif(count(*) FILTER (accepted), 0) AS err FROM j GROUP BY speaker_id)
SELECT count(*) AS entity_count, min(n) AS min_rows, max(n) AS max_rows, {", ".join(f"{s6(f'{g}({c})')} AS {g}_{n}" for c, n in (("macro_f1", "macro_f1"), ("uar", "uar"), ("focus_recall", "focus_recall"), ("coverage", "coverage"), ("err", "accepted_error_rate")) for g in ("min", "max"))}
FROM a JOIN z USING (speaker_id)""")
def speaker_ranges(spark, sf_dir):
    df = MT.anonymous_ranges(predictions(spark, sf_dir), CLASSES, THRESHOLD)
    return rounded(df, *[c for c in df.columns if c.startswith(("min_", "max_")) and not c.endswith("_rows")])


@query("run_comparison", f"""WITH {PER_CLASS}, z AS ({MACRO}), a AS (SELECT condition, avg(accepted::INT) AS coverage FROM j GROUP BY condition),
 l AS (SELECT condition, avg((eligible AND list_max(p) >= 0.4)::INT) AS coverage FROM s GROUP BY condition)
SELECT condition, {s6('l.coverage')} AS left_coverage, {s6('a.coverage')} AS right_coverage, {s6('a.coverage - l.coverage')} AS delta_coverage FROM a JOIN l USING (condition)""")
def run_comparison(spark, sf_dir):
    df = predictions(spark, sf_dir)
    strict = MT.selective_metrics(df, CLASSES, 0.4, ["condition"])
    loose = MT.selective_metrics(df, CLASSES, THRESHOLD, ["condition"])
    names = ("left_coverage", "right_coverage", "delta_coverage")
    return rounded(MT.compare_runs(strict, loose, metrics=("coverage",)), *names)


SWEEP = f"""{PRED}, t AS (SELECT DISTINCT confidence AS threshold FROM j UNION SELECT 0.0 UNION SELECT 1.0),
 f AS (SELECT threshold, count(*) FILTER (confidence >= threshold) AS acc, count(*) FILTER (confidence >= threshold AND predicted = label) AS tp, count(*) FILTER (confidence < threshold AND predicted = label) AS fn, count(*) AS n
  FROM t CROSS JOIN j GROUP BY threshold),
 w AS (SELECT threshold, acc, acc - tp AS err, acc / n AS coverage, coalesce(2.0::DOUBLE * tp / nullif(2 * tp + acc - tp + fn, 0), 0) AS f1 FROM f)"""


@query("threshold_sweep", f"WITH {SWEEP} SELECT {s6('threshold', 9)} AS threshold, {s6('f1')} AS f1, acc AS accepted_count, err AS accepted_error_count, {s6('coverage')} AS coverage FROM w")
def threshold_sweep(spark, sf_dir):
    return rounded(rounded(MT.threshold_sweep(predictions(spark, sf_dir), CLASSES), "f1", "coverage"), "threshold", digits=9)


@query("threshold_choice", f"""WITH {SWEEP} SELECT {s6('threshold')} AS threshold, {s6('f1')} AS correctness_f1, acc AS accepted_count, {s6('coverage')} AS coverage, {s6('1 - coverage')} AS rejection_rate,
 err AS accepted_error_count, {s6('err / nullif(acc, 0)')} AS accepted_error_rate FROM w ORDER BY f1 DESC, threshold DESC LIMIT 1""")
def threshold_choice(spark, sf_dir):
    return rounded(MT.select_threshold(predictions(spark, sf_dir), CLASSES),
                   "threshold", "correctness_f1", "coverage", "rejection_rate", "accepted_error_rate")


@query("bootstrap_intervals")
def bootstrap_intervals(spark, sf_dir):
    return MT.bootstrap_ci(MT.aggregate_recordings(predictions(spark, sf_dir), CLASSES), CLASSES, THRESHOLD)


@query("latency_summary", f"SELECT event_type, count(value) AS sample_count, {s6('median(value)')} AS median, {s6('quantile_cont(value, 0.95)')} AS p95 FROM events GROUP BY event_type")
def latency_summary(spark, sf_dir):
    return rounded(MT.latency_summary(load(spark, sf_dir, "events"), "value", ["event_type"]), "median", "p95")


@query("price_quantiles", f"SELECT l_returnflag, l_linestatus, count(*) AS sample_count, {s6('median(l_extendedprice)')} AS median, {s6('quantile_cont(l_extendedprice, 0.95)')} AS p95 FROM lineitem GROUP BY ALL")
def price_quantiles(spark, sf_dir):
    return rounded(MT.latency_summary(load(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus"]), "median", "p95")
