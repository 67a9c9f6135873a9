"""Gating live updates: the same column rules for batches and streams."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoframe import settings
from sonoframe.functions import checks as C
from sonoframe.functions import pitch
from sonoframe.operators import model as ML
from sonoframe.operators import ordering as O
from sonoframe.operators import summaries as SU
from sonoframe.operators.frames import samples_for


def series_updates(
    df: DataFrame, window_s: float = 1.5, interval_s: float = 0.5, *, frame_ms: int = 20,
    samples: str = "samples", rate: str = "sample_rate",
) -> DataFrame:
    """Batch form of the rolling window and throttle over one stored series per row.

    The emission points are folded inside the row, so a replay of millions of
    series needs no state and no shuffle.
    """
    rest = [c for c in df.columns if c != samples]
    size, step = F.bround(F.col(rate) * window_s, 0).cast("int"), samples_for(frame_ms, F.col(rate))
    total = F.size(samples)
    ends = F.transform(F.sequence(F.lit(0), F.greatest(total - 1, F.lit(0)), step), lambda s: F.least(s + step, total))
    interval = round(interval_s * 1000)
    timed = F.transform(F.filter(ends, lambda e: e >= size), lambda e: F.struct(
        e.alias("e"), F.bround(e * 1000.0 / F.col(rate), 0).cast("long").alias("t")))
    start = F.filter(timed, lambda _: F.lit(False))

    def keep(acc, x):
        due = (F.size(acc) == 0) | (x["t"] - F.element_at(acc, -1)["t"] >= interval)
        return F.when(due, F.concat(acc, F.array(x))).otherwise(acc)

    return (
        df.withColumn("_n", size).withColumn("_emit", F.explode(F.aggregate(timed, start, keep)))
        .select(*rest, F.col("_emit.t").alias("ts_ms"),
                F.slice(samples, F.col("_emit.e") - F.col("_n") + 1, F.col("_n")).alias(samples))
    )


def _below(name: str, limit) -> Column:
    """Whether a measure misses its limit; one that is missing or not a number does."""
    return F.coalesce(F.isnan(F.col(name).cast("double")) | (F.col(name) < limit), F.lit(True))


def _gate_reason(gates: settings.QualityGates, low_activity: str, uncertain: str) -> Column:
    """Quality part of the cascade; NULL for an update that may be scored.  Missing measures reject."""
    status = F.col("quality_status")
    return (
        F.when(_below("active_frame_count", 1), "SILENCE")
        .when(_below("activity_ratio", gates.min_activity_ratio) | _below("longest_active_run", gates.min_contiguous_active_frames), low_activity)
        .when(status == "LOW_QUALITY", "LOW_QUALITY")
        .when(~status.eqNullSafe("ACCEPTABLE"), uncertain)
        .when(_below("audio_quality", settings.LIVE_MIN_AUDIO_QUALITY), "LOW_QUALITY")
    )


def quality_reason(gates: settings.QualityGates = settings.QualityGates()) -> Column:
    return _gate_reason(gates, "LOW_ACTIVITY", "UNCERTAIN_AUDIO_QUALITY")


def identity_quality_status(gates: settings.QualityGates = settings.QualityGates()) -> Column:
    """The identity-gated runtime reports low activity and unclear quality as UNCERTAIN."""
    return _gate_reason(gates, "UNCERTAIN", "UNCERTAIN")


def prediction_reason(model_status: Column) -> Column:
    """Reason after scoring, in cascade order; NULL for an accepted prediction."""
    calibrated = (
        (F.col("model_status") == "READY") & (F.col("calibration_status") == "CALIBRATED")
        & (F.length("model_version") > 0) & (F.length("validation_record_id") > 0) & F.col("decision_threshold").isNotNull())
    return (
        F.when(~model_status.eqNullSafe("READY"), F.coalesce(model_status, F.lit("NOT_CONFIGURED")))
        .when(_below("valid_frame_fraction", settings.MIN_VALID_FRAME_FRACTION), "INVALID_FRAME_CONTENT")
        .when(F.coalesce("predictor_error", F.lit(True)), "PREDICTOR_ERROR")
        .when(~F.coalesce(calibrated, F.lit(False)), F.coalesce("rejection_status", F.lit("MODEL_NOT_CALIBRATED")))
        .when(F.col("emotion").isNull(), F.coalesce("rejection_status", F.lit("BELOW_VALIDATION_THRESHOLD")))
    )


def gate_updates(df: DataFrame, gates: settings.QualityGates = settings.QualityGates(), *, model_status: str = "registry_status") -> DataFrame:
    """Add ``rejection_reason`` and ``candidate_emotion`` from quality and prediction columns."""
    reason = F.coalesce(quality_reason(gates), prediction_reason(F.col(model_status)))
    return df.withColumn("rejection_reason", reason).withColumn(
        "candidate_emotion", F.when(F.col("rejection_reason").isNull(), F.col("emotion")))


def target_events(
    df: DataFrame, gates: settings.QualityGates = settings.QualityGates(),
    min_speaker_confidence: float = settings.LIVE_MIN_SPEAKER_CONFIDENCE,
) -> DataFrame:
    """Identity-gated cascade: quality, verifier verdict, then prediction.

    ``verdict_status``/``verdict_confidence`` come from ``verdicts_as_of``, on streams from ``join_verdicts``, or
    from ``with_verifier``; no verdict means the verifier is not configured.
    """
    verdict = F.coalesce(F.col("verdict_status"), F.lit("NOT_CONFIGURED"))
    usable = (
        (F.col("model_status") == "READY") & F.col("emotion").isNotNull() & (F.col("calibration_status") == "CALIBRATED")
        & (F.length("model_version") > 0) & (F.length("validation_record_id") > 0) & F.col("decision_threshold").isNotNull())
    status = F.coalesce(
        identity_quality_status(gates),
        F.when(verdict != "TARGET_ACTIVE", verdict)
        .when(_below("verdict_confidence", min_speaker_confidence), "UNCERTAIN")
        .when(F.coalesce("predictor_error", F.lit(True)), "UNCERTAIN")
        .when(~F.coalesce(usable, F.lit(False)), C.prediction_status()),
        F.lit("TARGET_ACTIVE"))
    out = df.withColumn("status", status)
    active = F.col("status") == "TARGET_ACTIVE"
    return (
        out.withColumn("emotion_confidence", F.when(active, F.col("confidence")).otherwise(F.lit(0.0)))
        .withColumn("speaker_confidence", F.when(active, F.col("verdict_confidence")).otherwise(F.lit(0.0)))
        .withColumn("emotion", F.when(active, F.col("emotion"))).withColumn("source", F.lit("LIVE"))
    )


def verdicts_as_of(
    updates: DataFrame, verdicts: DataFrame, horizon_ms: int, *, keys: Sequence[str] = ("stream_id", "session_id"), ts_ms: str = "ts_ms",
    order: Sequence[str] = (), partitions: int | None = None,
) -> DataFrame:
    """Updates with ``verdict_status`` and ``verdict_confidence`` of the newest verdict not newer than them and less than ``horizon_ms`` old.

    ``verdicts`` has the key columns, ``ts_ms``, ``verdict_status``, ``verdict_confidence`` and the columns of ``order``, which breaks ties.
    Both tables are put in one order per key and the last verdict is carried along, so no update meets several verdicts and a frequent key is
    cut into runs.  Updates without a verdict, and those without a time, get NULL; missing keys are equal.
    """
    keys, order = list(keys), list(order)
    rows = updates.select(*[F.col(k) for k in keys], F.col(ts_ms).alias("_at"), F.lit(1).alias("_kind"), *[F.lit(None).cast(verdicts.schema[c].dataType).alias(f"_o{i}") for i, c in enumerate(order)],
                          F.struct(*updates.columns).alias("_row"), F.lit(None).cast("struct<t:long,status:string,confidence:double>").alias("_verdict"))
    said = verdicts.select(*[F.col(k) for k in keys], F.col(ts_ms).alias("_at"), F.lit(0).alias("_kind"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                           F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"),
                           F.struct(F.col(ts_ms).cast("long").alias("t"), F.col("verdict_status").alias("status"), F.col("verdict_confidence").cast("double").alias("confidence")).alias("_verdict"))
    both = rows.unionByName(said.filter(F.col("_at").isNotNull()))
    held = O.carry_last(both, keys, ["_at", "_kind", *[f"_o{i}" for i in range(len(order))]], F.col("_verdict"), "_last", partitions=partitions).filter("_kind = 1")
    fresh = F.col("_last.t") > F.col("_at") - horizon_ms
    return held.select("_row.*", F.when(fresh, F.col("_last.status")).alias("verdict_status"), F.when(fresh, F.col("_last.confidence")).alias("verdict_confidence"))


def score_updates(df: DataFrame, model: Mapping, *, record_id: str = "record", status: str = "READY") -> DataFrame:
    """Measure, gate and score update windows with one model; stateless, so it also runs on a stream.

    Pitch is measured only on rows that pass the quality gate: the others carry an
    empty array through the expensive step.
    """
    cfg = settings.FrameSettings(
        sample_rate=int(model["sample_rate"]), frame_ms=float(model["frame_ms"]), hop_ms=float(model["hop_ms"]),
        activity_rms_threshold=float(model["activity_rms_threshold"]),
        max_f0_hz=500.0 if model["sample_rate"] > 1000 else model["sample_rate"] * 0.45)
    gates = settings.QualityGates(**{
        k: (int(v) if k == "min_contiguous_active_frames" else float(v)) for k, v in model["quality_gates"].items()
        if k in settings.QUALITY_GATE_KEYS})
    measured = SU.summarise_quality(pitch.measure_quality(df, cfg), cfg.activity_rms_threshold, gates)
    measured = measured.withColumn("_work", F.when(quality_reason(gates).isNull(), F.col("samples")).otherwise(F.array().cast("array<float>")))
    features = SU.prosody_features(pitch.measure_frames(measured.drop("samples"), cfg, samples="_work"), cfg).drop("_work")
    scored = (
        ML.predict(features, model, status=status)
        .withColumn("registry_status", F.lit(status)).withColumn("predictor_error", F.lit(False))
        .withColumn("calibration_status", F.lit(model["calibration_status"])).withColumn("model_version", F.lit(model["model_version"]))
        .withColumn("validation_record_id", F.lit(record_id)).withColumn("decision_threshold", F.lit(float(model["rejection_threshold"])))
    )
    return gate_updates(scored, gates).withColumn("emotion", F.col("candidate_emotion"))


# --- plug-in points -------------------------------------------------------------------------
def with_predictor(df: DataFrame, fn, features: str = "full_vector", result: str = "prediction") -> DataFrame:
    """Apply a user predictor ``fn(matrix) -> (labels, confidences)`` per Arrow batch; errors fail closed."""
    import numpy as np
    import pandas as pd

    @F.pandas_udf("struct<emotion:string,confidence:double,predictor_error:boolean>")
    def call(vectors: pd.Series) -> pd.DataFrame:
        def answer(rows):
            labels, confidences = fn(np.stack(rows))
            return [(a, float(c), False) for a, c in zip(labels, confidences, strict=True)]

        rows = list(vectors)
        try:
            out = answer(rows) if rows else []
        except Exception:  # a failing batch is retried row by row, and only bad rows are rejected
            out = []
            for row in rows:
                try:
                    out += answer([row])
                except Exception:
                    out.append((None, 0.0, True))
        return pd.DataFrame(out, columns=["emotion", "confidence", "predictor_error"])

    return df.withColumn(result, call(F.col(features)))


def with_verifier(df: DataFrame, fn=None, samples: str = "samples") -> DataFrame:
    """Apply a user verifier ``fn(samples) -> (status, confidence)``; none means NOT_CONFIGURED."""
    import pandas as pd

    if fn is None:
        return df.withColumn("verdict_status", F.lit("NOT_CONFIGURED")).withColumn("verdict_confidence", F.lit(0.0))

    @F.pandas_udf("struct<status:string,confidence:double>")
    def call(series: pd.Series) -> pd.DataFrame:
        out = []
        for x in series:
            try:
                status, confidence = fn(x)
                ok = status in settings.SYSTEM_STATUSES and 0.0 <= confidence <= 1.0
                out.append((status, float(confidence)) if ok else ("UNCERTAIN", 0.0))
            except Exception:
                out.append(("UNCERTAIN", 0.0))
        return pd.DataFrame(out, columns=["status", "confidence"])

    return df.withColumn("_v", call(F.col(samples))).withColumn("verdict_status", F.col("_v.status")).withColumn(
        "verdict_confidence", F.col("_v.confidence")).drop("_v")
