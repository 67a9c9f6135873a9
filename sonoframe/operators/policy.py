"""Turning trusted events into bounded light commands."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoframe import settings

L = settings.LightSettings


def trust(cfg: L = L()) -> Column:
    """Live, target-attributed, labelled and above the three confidence limits."""
    return F.coalesce(
        (F.col("source") == "LIVE") & F.col("emotion").isNotNull() & (F.col("status") == "TARGET_ACTIVE")
        & (F.col("emotion_confidence") >= cfg.min_emotion_confidence)
        & (F.col("speaker_confidence") >= cfg.min_speaker_confidence)
        & (F.col("audio_quality") >= cfg.min_audio_quality), F.lit(False))


def trusted(df: DataFrame, cfg: L = L(), automatic: str | None = None) -> DataFrame:
    """Events that may drive an output; ``automatic`` names a column that can switch it off."""
    condition = trust(cfg)
    return df.filter(condition if automatic is None else condition & F.col(automatic))


def _cap(cfg: L, night) -> Column:
    night = F.col(night) if isinstance(night, str) else F.lit(bool(night))
    return F.when(night, F.lit(cfg.night_max_level)).otherwise(F.lit(cfg.max_level))


def to_commands(df: DataFrame, cfg: L = L(), *, night="night_mode", simulation: bool = False) -> DataFrame:
    """Look up colour and level per label; levels are capped, transitions stay slow."""
    rgb, level = F.lit(None).cast("array<int>"), F.lit(None).cast("double")
    for name in settings.EMOTIONS:
        rgb = F.when(F.col("emotion") == name, F.array(*[F.lit(v) for v in settings.LIGHT_RGB[name]])).otherwise(rgb)
        level = F.when(F.col("emotion") == name, F.lit(settings.LIGHT_LEVEL[name])).otherwise(level)
    return df.filter(F.col("emotion").isin(*settings.EMOTIONS)).select(
        "*", rgb.alias("rgb"), F.least(level, _cap(cfg, night)).alias("brightness"),
        F.lit(max(settings.MIN_TRANSITION_MS, cfg.transition_ms)).alias("transition_ms"),
        F.lit("steady").alias("effect"), F.lit("automatic").alias("mode"), F.lit(simulation).alias("simulation"))


def route_by_source(df: DataFrame, cfg: L = L(), *, night="night_mode", automatic: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(live commands, preview commands): simulated events never reach the live output."""
    preview = df.filter(
        (F.col("source") == "SIMULATION") & F.col("emotion").isNotNull() & (F.col("status") == "TARGET_ACTIVE"))
    return (
        to_commands(trusted(df, cfg, automatic), cfg, night=night),
        to_commands(preview, cfg, night=night, simulation=True),
    )


def reclamp(df: DataFrame, cap: float = L().night_max_level, column: str = "brightness") -> DataFrame:
    """Lower current levels that exceed a new cap; all other fields stay."""
    return df.withColumn(column, F.least(F.col(column), F.lit(cap)))
