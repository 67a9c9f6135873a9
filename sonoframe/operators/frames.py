"""Cutting series into frames and windows.

Input rows carry ``samples ARRAY<FLOAT>`` and a sample rate (column or number).
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoframe import settings
from sonoframe.functions import series as S


def samples_for(duration_ms: float, sample_rate) -> Column:
    """Samples in a duration, rounded half to even, at least one."""
    rate = sample_rate if isinstance(sample_rate, Column) else F.lit(sample_rate)
    return F.greatest(F.lit(1), F.bround(rate * F.lit(float(duration_ms)) / 1000.0, 0).cast("int"))


def _starts(size: Column, step) -> Column:
    nothing = F.filter(F.array(F.lit(0)), lambda _: F.lit(False))
    return F.when(size > 0, F.sequence(F.lit(0), size - 1, step)).otherwise(nothing)


def frame_levels(samples, frame_size) -> Column:
    """RMS of each tumbling frame of one array, partial tail kept."""
    s = S._col(samples)
    return F.transform(_starts(F.size(s), frame_size), lambda i: S.rms(F.slice(s, i + 1, frame_size)))


def tumbling_frames(
    df: DataFrame, frame_ms: float = 25.0, *, threshold: float = 0.01,
    samples: str = "samples", rate: str = "sample_rate",
) -> DataFrame:
    """One row per non-overlapping frame: start, duration, RMS and activity status.

    The frame length is a whole number of milliseconds, the last partial frame is
    kept, and a frame is active when its RMS reaches the threshold.
    """
    rest = [c for c in df.columns if c != samples]
    size = samples_for(round(frame_ms), F.col(rate))
    return (
        df.select(*rest, samples, size.alias("_frame"))
        .select(*rest, samples, "_frame", F.explode(_starts(F.size(samples), F.col("_frame"))).alias("_start"))
        .select(
            *rest, F.slice(samples, F.col("_start") + 1, F.col("_frame")).alias("_part"), "_start", "_frame",
        )
        .select(
            *rest,
            F.expr("_start div _frame").cast("int").alias("frame_index"),
            F.bround(F.col("_start") * 1000.0 / F.col(rate), 0).cast("long").alias("start_ms"),
            (F.size("_part") * 1000.0 / F.col(rate)).alias("duration_ms"),
            S.rms("_part").alias("energy_rms"),
        )
        .withColumn("status", activity_flag("energy_rms", threshold))
    )


def activity_flag(level, threshold: float = 0.01) -> Column:
    return F.when(S._col(level) >= F.lit(float(threshold)), "UNCERTAIN").otherwise("SILENCE")


def hopping_frames(
    df: DataFrame, frame_ms: float = 25.0, hop_ms: float = 10.0, *, min_coverage: float = 0.8,
    samples: str = "samples", rate: str = "sample_rate",
) -> DataFrame:
    """One row per hop start: validity and the clamped, zero-padded frame.

    A frame is valid when it covers enough of its length and is finite throughout;
    an invalid frame keeps its row with a NULL array.
    """
    rest = [c for c in df.columns if c != samples]
    size, hop = F.col("_frame"), F.col("_hop")
    part, missing = F.col("_part"), F.col("_frame") - F.size("_part")
    padded = F.concat(S.clip_samples(part), F.array_repeat(F.lit(0.0), missing))
    return (
        df.select(
            *rest, samples, samples_for(frame_ms, F.col(rate)).alias("_frame"),
            samples_for(hop_ms, F.col(rate)).alias("_hop"),
        )
        .select(*rest, samples, "_frame", "_hop", F.explode(_starts(F.size(samples), hop)).alias("_start"))
        .select(*rest, "_frame", "_hop", "_start", F.slice(samples, F.col("_start") + 1, size).alias("_part"))
        .select(
            *rest,
            F.expr("_start div _hop").cast("int").alias("frame_index"),
            (F.col("_start") / F.col(rate)).alias("start_s"),
            ((F.size("_part") / size >= min_coverage) & S.all_finite("_part")).alias("valid"),
            padded.alias("_frame_samples"),
        )
        .select(*rest, "frame_index", "start_s", "valid", F.when(F.col("valid"), F.col("_frame_samples")).alias("frame"))
    )


def fixed_windows(
    df: DataFrame, window: int, stride: int, *, samples: str = "samples", index: str = "window_index"
) -> DataFrame:
    """Equal-length windows; the end is always covered, short input is left-padded."""
    if window <= 0 or stride <= 0 or stride > window:
        raise ValueError("window and stride must be positive and the stride must not exceed the window")
    rest = [c for c in df.columns if c != samples]
    s, n = F.col(samples), F.size(samples)
    zero = F.lit(0.0).cast("float")
    last = n - window
    starts = F.when(n <= window, F.array(F.lit(0))).otherwise(
        F.array_distinct(F.concat(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride)), F.array(last)))
    )
    padded = F.concat(F.array_repeat(zero, F.greatest(F.lit(window) - n, F.lit(0))), s)
    return (
        df.select(*rest, padded.alias(samples), F.posexplode(starts).alias(index, "_start"))
        .select(*rest, index, "_start", F.slice(samples, F.col("_start") + 1, window).alias(samples))
        .withColumnRenamed("_start", "start_sample")
    )


def replay_frames(
    df: DataFrame, frame_ms: int = 20, *, samples: str = "samples", rate: str = "sample_rate"
) -> DataFrame:
    """Cut stored series into timed capture frames, stamped at the end of the frame."""
    rest = [c for c in df.columns if c != samples]
    return (
        df.select(*rest, samples, samples_for(frame_ms, F.col(rate)).alias("_frame"))
        .select(*rest, samples, "_frame", F.explode(_starts(F.size(samples), F.col("_frame"))).alias("_start"))
        .select(*rest, "_start", F.slice(samples, F.col("_start") + 1, F.col("_frame")).alias(samples))
        .withColumn(
            "ts_ms", F.bround((F.col("_start") + F.size(samples)) * 1000.0 / F.col(rate), 0).cast("long")
        )
        .drop("_start")
    )


def assemble_features(df: DataFrame) -> DataFrame:
    """Add the ordered 24-value and 8-value FLOAT vectors built from named columns."""
    return df.withColumn("full_vector", S.full_vector()).withColumn("simple_vector", S.simple_vector())


def check_feature_contract(df: DataFrame) -> DataFrame:
    """Add one boolean per contract rule and ``contract_ok``.

    Missing values are NULL.  Only pitch-derived features may be missing, and they
    are either all missing (no voiced frame) or all present.
    """
    pitch = [F.col(n) for n in settings.PITCH_FEATURES]
    other = [F.col(n) for n in settings.FULL_FEATURES if n not in settings.PITCH_FEATURES]
    missing = sum((c.isNull().cast("int") for c in pitch), F.lit(0))
    finite = lambda c: c.isNull() | S.is_finite(c)
    conj = lambda cols: F.forall(F.array(*cols), lambda x: x)
    unit = [F.col(n) for n in ("f0_valid_fraction", "mean_periodicity", "active_fraction")]
    voiced = F.col("f0_valid_fraction") > 0
    return (
        df.withColumn("only_pitch_missing", conj([c.isNotNull() for c in other]))
        .withColumn("all_finite", conj([finite(c) for c in pitch + other]))
        .withColumn("fractions_bounded", conj([F.coalesce(c.between(0.0, 1.0), F.lit(False)) for c in unit]))
        .withColumn("pitch_all_or_none", F.when(voiced, missing == 0).otherwise(missing == len(pitch)))
        .withColumn("contract_ok", F.col("only_pitch_missing") & F.col("all_finite")
                    & F.col("fractions_bounded") & F.col("pitch_all_or_none"))
    )
