"""Evaluation of one model over a grid of noise conditions, as one plan."""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoframe import settings
from sonoframe.operators import metrics as MT
from sonoframe.operators import mixing as X
from sonoframe.operators import model as ML
from sonoframe.operators.ordering import global_index, sized_join
from sonoframe.plans.train import gated_features
from sonoframe.session import checkpoint


def condition_predictions(
    test: DataFrame, model: Mapping, grid: Sequence[tuple], *, order: str, sources: DataFrame | None = None, seed: int = 42,
) -> DataFrame:
    """One narrow row per (record, condition): label, scores, eligibility and reason.

    Samples stay in the record's row: the grid repeats it in a generator, the mix is
    a projection and nothing wide is shuffled afterwards.  Pass ``row_index`` (a dense
    position in ``order``, best computed on the manifest before samples are joined);
    otherwise it is computed here, at the price of shuffling the samples once.
    ``sources`` has ``noise_type, source_idx, sample_rate, source_samples``.
    """
    if "row_index" not in test.columns:
        test = test.join(global_index(test.select(order), order, "row_index"), order)
    kinds = {g[1] for g in grid}
    rows = test
    if "voice" in kinds:
        rows = X.first_other(rows, order, name="_other")
        anchors = [r["_other"] for r in rows.filter(F.col("_other").isNotNull()).select("_other").distinct().collect()]  # at most five
        voices = test.filter(F.col(order).isin(anchors)).select(
            F.col(order).alias("_other"), F.col("samples").alias("_voice"), F.col("sample_rate").alias("_voice_rate"))
        rows = rows.join(F.broadcast(voices), "_other", "left")
    else:
        rows = rows.withColumn("_voice", F.lit(None).cast("array<float>")).withColumn("_voice_rate", F.lit(None).cast("int"))
    rows = X.with_conditions(rows, grid)
    if sources is not None and kinds & {"background", "reverb"}:
        counts = {r["noise_type"]: r["n"] for r in sources.groupBy("noise_type").agg(F.count("*").alias("n")).collect()}
        position = F.lit(None).cast("long")
        for kind, n in counts.items():
            position = F.when(F.col("noise_type") == kind, F.pmod("row_index", F.lit(n))).otherwise(position)
        position = F.when(F.col("kind") == "reverb", F.col("rir_index")).otherwise(position)
        rows = sized_join(
            rows.withColumn("source_idx", position.cast("int")),
            sources.select("noise_type", "source_idx", F.col("sample_rate").alias("_source_rate"), F.col("source_samples").alias("_source")),
            ["noise_type", "source_idx"], "left")
    else:
        rows = rows.withColumn("_source", F.lit(None).cast("array<float>")).withColumn("_source_rate", F.lit(None).cast("int"))
    voice = F.col("kind") == "voice"
    other = F.when(voice, F.col("_voice")).otherwise(F.col("_source"))
    other_rate = F.when(voice, F.col("_voice_rate")).when(F.col("kind").isin("background", "reverb"), F.col("_source_rate")).otherwise(
        F.col("sample_rate"))
    right_rate = F.col("sample_rate") == F.lit(int(model["sample_rate"]))
    matched = right_rate & F.coalesce(other_rate == F.col("sample_rate"), F.lit(False))
    mixed = X.mix(F.col("kind"), "samples", other, "level_db", F.lit(seed) + F.col("row_index"))
    keep = ["condition", order, "label", "speaker_id", "recording_id", "dataset_id"]
    ready = rows.select(*keep, right_rate.alias("_rate_ok"), matched.alias("_matched"), mixed.alias("_mixed")).select(
        *keep, "_rate_ok", (F.col("_matched") & F.col("_mixed").isNotNull()).alias("_mix_ok"),
        F.when(F.col("_matched") & F.col("_mixed").isNotNull(), F.col("_mixed")).otherwise(F.array().cast("array<float>")).alias("samples"))
    cfg = settings.FrameSettings(
        sample_rate=int(model["sample_rate"]), frame_ms=float(model["frame_ms"]), hop_ms=float(model["hop_ms"]),
        activity_rms_threshold=float(model["activity_rms_threshold"]),
        max_f0_hz=500.0 if model["sample_rate"] > 1000 else model["sample_rate"] * 0.45)
    gates = settings.QualityGates(**{
        k: int(v) if k == "min_contiguous_active_frames" else float(v) for k, v in model["quality_gates"].items() if k in settings.QUALITY_GATE_KEYS})
    gated = gated_features(ready, cfg, gates).drop("samples")
    scored = ML.predict(gated, model)
    reason = F.when(~F.col("_rate_ok"), "SAMPLE_RATE_MISMATCH").when(~F.col("_mix_ok"), "MIX_INVALID").otherwise(F.col("reason"))
    uniform = F.array(*[F.lit(1.0 / len(model["classes"]))] * len(model["classes"]))
    out = scored.withColumn("_reason", reason).withColumn("eligible", F.col("_reason").isNull())
    return out.select(
        *keep, "eligible", F.when(F.col("eligible"), F.col("scores")).otherwise(uniform).alias("scores"),
        F.coalesce("_reason", F.when(F.col("emotion").isNull(), F.lit("BELOW_VALIDATION_THRESHOLD"))).alias("reason"))


def evaluate_conditions(
    test: DataFrame, model: Mapping, *, order: str, snr_db: Sequence[float] = (20.0, 10.0, 5.0, 0.0),
    sir_db: Sequence[float] = (6.0, 0.0, -6.0), sources: DataFrame | None = None, seed: int = 42,
) -> dict[str, DataFrame]:
    """Metrics, rejection reasons, recording metrics, intervals and speaker ranges.  Runs jobs.

    Conditions without a source appear in ``metrics`` with a NOT_EVALUATED status.
    """
    types = {} if sources is None else {
        r["noise_type"]: r["n"] for r in sources.groupBy("noise_type").agg(F.count("*").alias("n")).collect()}
    speakers = test.select("dataset_id", "speaker_id").distinct().limit(2).count()
    noise = [t for t in settings.NOISE_TYPES[:3] if types.get(t)]
    grid = X.condition_grid(snr_db, sir_db if speakers > 1 else (), noise, types.get("reverb_impulse", 0))
    absent = [(t, "NOT_EVALUATED_NO_SOURCE") for t in settings.NOISE_TYPES[:3] if t not in noise]
    absent += [] if types.get("reverb_impulse") else [("reverb", "NOT_EVALUATED_NO_RIR")]
    absent += [] if speakers > 1 else [("other_speaker_overlap", "NOT_EVALUATED_NO_OTHER_SPEAKER")]
    classes, threshold = list(model["classes"]), float(model["rejection_threshold"])
    # narrow rows (scores, no samples), read several times below
    predictions = checkpoint(condition_predictions(test, model, grid, order=order, sources=sources, seed=seed))
    metrics = MT.classification_metrics(predictions, classes, threshold).withColumn("status", F.lit("EVALUATED"))
    if absent:
        rows = test.sparkSession.createDataFrame(absent, "condition string, status string")
        metrics = metrics.unionByName(rows, allowMissingColumns=True)
    recordings = checkpoint(MT.aggregate_recordings(predictions.filter("condition = 'clean'"), classes))
    return {
        "predictions": predictions, "metrics": metrics, "reasons": MT.reason_counts(predictions, by=["condition"]),
        "confusion": MT.confusion(predictions, classes, threshold, ["condition"]),
        "recordings": MT.classification_metrics(recordings.withColumn("condition", F.lit("clean")), classes, threshold),
        "intervals": MT.bootstrap_ci(recordings, classes, threshold, seed=seed),
        "speakers": MT.anonymous_ranges(recordings, classes, threshold),
    }


def evaluate_pair(test: DataFrame, simple: Mapping, full: Mapping, **options) -> dict[str, DataFrame]:
    """Both profiles over the same rows and conditions, and full minus simple."""
    left, right = evaluate_conditions(test, simple, **options), evaluate_conditions(test, full, **options)
    return {"simple": left["metrics"], "full": right["metrics"], "delta": MT.compare_runs(left["metrics"], right["metrics"])}
