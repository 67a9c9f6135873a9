"""Aggregating the frames of one recording.

Frames stay in an array on the recording's own row, so every summary here is a
projection: no shuffle, no skew, and bounded by the size of one row.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoframe import settings
from sonoframe.functions import series as S
from sonoframe.operators.frames import frame_levels, samples_for

G = settings.QualityGates


# --- activity, SNR and quality ---------------------------------------------------
def activity_summary(df: DataFrame, levels: str = "frame_levels", threshold: float = 0.01) -> DataFrame:
    """Activity ratio, active frames and longest active run of a frame-level array."""
    flags = F.transform(levels, lambda x: x >= F.lit(float(threshold)))
    return (
        df.withColumn("_flags", flags)
        .withColumn("active_frame_count", F.size(F.filter("_flags", lambda f: f)))
        .withColumn("longest_active_run", S.longest_run("_flags"))
        .withColumn("activity_ratio", F.when(
            F.size("_flags") > 0, F.col("active_frame_count") / F.size("_flags")).otherwise(F.lit(0.0)))
        .drop("_flags")
    )


def snr_summary(df: DataFrame, levels: str = "frame_levels", threshold: float = 0.01) -> DataFrame:
    """SNR estimate from the medians of active and inactive frame power."""
    squared_median = lambda name: S.array_median(F.transform(name, lambda x: x * x))
    noise, active = F.col("_noise_power"), F.col("_active_power")
    usable = F.coalesce(S.array_median("_quiet") > 1e-6, F.lit(False)) & (F.size("_loud") > 0)
    return (
        df.withColumn("_loud", F.filter(levels, lambda x: x >= F.lit(float(threshold))))
        .withColumn("_quiet", F.filter(levels, lambda x: x < F.lit(float(threshold))))
        .withColumn("_noise_power", F.when(usable, squared_median("_quiet")))
        .withColumn("_active_power", F.when(usable, squared_median("_loud")))
        .withColumn("estimated_snr_db", F.lit(10.0) * F.log10(F.greatest(active - noise, F.lit(1e-12)) / noise))
        .withColumn("audio_quality", F.coalesce(
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("estimated_snr_db") / 30.0)), F.lit(0.0)))
        .drop("_loud", "_quiet", "_noise_power", "_active_power")
    )


def quality_label(gates: G = G(), frames: Column | None = None) -> Column:
    """Quality label from the summary columns; an empty series is LOW_QUALITY."""
    snr = F.col("estimated_snr_db")
    empty = F.lit(False) if frames is None else frames == 0
    return (
        F.when(
            empty | (F.col("clipping_fraction") >= gates.clipping_limit)
            | (F.col("activity_ratio") < gates.min_activity_ratio)
            | (F.col("longest_active_run") < gates.min_contiguous_active_frames), "LOW_QUALITY")
        .when(snr.isNull(), "UNCERTAIN")
        .when(snr < gates.minimum_snr_db, "LOW_QUALITY")
        .when(snr < gates.acceptable_snr_db, "UNCERTAIN")
        .otherwise("ACCEPTABLE")
    )


def quality_status(df: DataFrame, gates: G = G(), levels: str = "frame_levels") -> DataFrame:
    return df.withColumn("quality_status", quality_label(gates, F.size(levels)))


def summarise_quality(df: DataFrame, threshold: float = 0.01, gates: G = G()) -> DataFrame:
    """Add activity, SNR and quality columns from ``frame_levels`` and ``clipping_fraction``."""
    return quality_status(snr_summary(activity_summary(df, threshold=threshold), threshold=threshold), gates)


def quality_features(
    df: DataFrame, cfg: settings.FrameSettings | None = None, gates: G = G(), *,
    samples: str = "samples", rate: str = "sample_rate",
) -> DataFrame:
    """All series-level quality measures with built-in functions only."""
    frame_ms = cfg.frame_ms if cfg else 25.0
    threshold = cfg.activity_rms_threshold if cfg else 0.01
    fixed = df.withColumn("_fixed", S.repair_samples(samples))
    measured = (
        fixed.withColumn("duration_s", S.duration_s("_fixed", rate))
        .withColumn("rms", F.coalesce(S.rms("_fixed"), F.lit(0.0)))
        .withColumn("zero_crossing_rate", S.zcr("_fixed"))
        .withColumn("clipping_fraction", S.clip_fraction("_fixed"))
        .withColumn("frame_levels", frame_levels("_fixed", samples_for(round(frame_ms), F.col(rate))))
        .drop("_fixed")
    )
    return summarise_quality(measured, threshold, gates)


# --- prosody: arrays f0 / periodicity / rms / zcr, NULL where not measured ---------
def pitch_summary(df: DataFrame, f0: str = "f0") -> DataFrame:
    """Median, mean, population deviation and range of the voiced pitch values."""
    return (
        df.withColumn("_voiced", S.known(f0))
        .withColumn("f0_median_hz", S.array_median("_voiced"))
        .withColumn("f0_mean_hz", S.array_mean("_voiced"))
        .withColumn("f0_std_hz", S.array_std("_voiced"))
        .withColumn("f0_range_hz", S.array_range("_voiced"))
        .drop("_voiced")
    )


def valid_deltas(df: DataFrame, values: str, name: str, step_s="step_s", missing: Column | None = None) -> DataFrame:
    """Mean and deviation of the change per second between neighbouring known frames."""
    empty = F.lit(0.0) if missing is None else F.when(missing, F.lit(None).cast("double")).otherwise(F.lit(0.0))
    return (
        df.withColumn("_delta", S.adjacent_deltas(values, step_s))
        .withColumn(f"{name}_mean", F.coalesce(S.array_mean("_delta"), empty))
        .withColumn(f"{name}_std", F.coalesce(S.array_std("_delta"), empty))
        .drop("_delta")
    )


def energy_summary(df: DataFrame, levels: str = "frame_rms", step_s="step_s") -> DataFrame:
    """Level statistics, their logs, the level slope and the frame-to-frame change."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = (
        df.withColumn("_level", S.known(levels))
        .withColumn("_log", F.transform("_level", lambda x: F.log(F.greatest(x, F.lit(1e-8)))))
        .withColumn("rms_mean", zero(S.array_mean("_level")))
        .withColumn("rms_std", zero(S.array_std("_level")))
        .withColumn("rms_q10", zero(S.array_quantile("_level", 0.1)))
        .withColumn("rms_q90", zero(S.array_quantile("_level", 0.9)))
        .withColumn("rms_range", zero(S.array_range("_level")))
        .withColumn("log_rms_mean", zero(S.array_mean("_log")))
        .withColumn("log_rms_std", zero(S.array_std("_log")))
        .withColumn("rms_slope_s", S.slope_over_time(levels, step_s))
        .drop("_level", "_log")
    )
    return (
        valid_deltas(out, levels, "_rms_delta", step_s)
        .withColumnRenamed("_rms_delta_mean", "rms_delta_mean_s")
        .withColumnRenamed("_rms_delta_std", "rms_delta_std_s")
    )


def validity_summary(
    df: DataFrame, *, valid: str = "valid", levels: str = "frame_rms", crossings: str = "frame_zcr",
    f0: str = "f0", periodicity: str = "periodicity", threshold: float = 0.01, min_periodicity: float = 0.35,
) -> DataFrame:
    """Fractions of valid, voiced, active and paused frames and their mean measures.

    Active here means *above* the threshold, and the longest active run is a share
    of all frames while the active fraction is a share of the valid ones.
    """
    n_valid, n_all = F.col("_n_valid"), F.size(valid)
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
    return (
        df.withColumn("_n_valid", F.size(F.filter(valid, lambda v: v)))
        .withColumn("_active", F.transform(levels, lambda x: F.coalesce(x > threshold, F.lit(False))))
        .withColumn("frame_count", n_all)
        .withColumn("valid_frame_fraction", share(n_valid, n_all))
        .withColumn("f0_valid_fraction", share(F.size(S.known(f0)), n_valid))
        .withColumn("active_fraction", share(F.size(F.filter("_active", lambda a: a)), n_valid))
        .withColumn("pause_fraction", F.lit(1.0) - F.col("active_fraction"))
        .withColumn("longest_active_run_fraction", share(S.longest_run("_active"), n_all))
        .withColumn("mean_periodicity", F.coalesce(S.array_mean(S.known(periodicity)), F.lit(0.0)))
        .withColumn("zcr_mean", F.coalesce(S.array_mean(S.known(crossings)), F.lit(0.0)))
        .withColumn("_hnr", F.transform(
            F.filter(periodicity, lambda p: p >= min_periodicity), S.hnr_db))
        .withColumn("hnr_median_db", F.when(F.size(S.known(f0)) > 0, S.array_median("_hnr")))
        .drop("_n_valid", "_active", "_hnr")
    )


def prosody_features(df: DataFrame, cfg: settings.FrameSettings = settings.FrameSettings()) -> DataFrame:
    """The 24 named features from per-frame arrays (see ``measure_frames``).

    Needs ``valid, frame_rms, frame_zcr, f0, periodicity`` and ``step_s``.
    """
    unvoiced = F.size(S.known("f0")) == 0
    out = pitch_summary(df)
    out = valid_deltas(out, "f0", "_f0_delta", missing=unvoiced)
    out = (
        out.withColumnRenamed("_f0_delta_mean", "f0_delta_mean_hz_s")
        .withColumnRenamed("_f0_delta_std", "f0_delta_std_hz_s")
        .withColumn("f0_slope_hz_s", F.when(~unvoiced, S.slope_over_time("f0", "step_s")))
    )
    return validity_summary(
        energy_summary(out), threshold=cfg.activity_rms_threshold, min_periodicity=cfg.min_periodicity
    )
