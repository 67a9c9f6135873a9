"""Predicates, parsers and row-level status rules as column functions."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoframe import settings


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c) -> Column:
    return F.nullif(F.trim(_col(c)), F.lit(""))


def safe_path(path) -> Column:
    """A relative path below ``wav/`` without parent steps that ends in ``.wav``."""
    p = F.trim(_col(path))
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    return F.coalesce(
        ~p.startswith("/")
        & ~F.exists(parts, lambda x: x == "..")
        & (F.try_element_at(parts, F.lit(1)) == "wav")
        & F.lower(F.try_element_at(parts, F.lit(-1))).rlike(r"[^.].*\.wav$"),
        F.lit(False),
    )


def parse_name(name) -> Column:
    """``struct<speaker, text, code, version, label>``; NULL when the name does not parse.

    ``label`` is NULL for codes outside the four classes.
    """
    n = _col(name)
    group = lambda i: F.regexp_extract(n, settings.NAME_PATTERN, i)
    code = F.upper(group(3))
    label = F.lit(None).cast("string")
    for known, target in settings.CODE_LABELS.items():
        label = F.when(code == known, target).otherwise(label)
    return F.when(n.rlike(settings.NAME_PATTERN), F.struct(
        group(1).alias("speaker"), group(2).alias("text"), code.alias("code"),
        group(4).alias("version"), label.alias("label"),
    ))


def content_digest(content) -> Column:
    """SHA-256 of the content, and the empty string for empty content."""
    c = _col(content)
    return F.when(F.length(c) == 0, F.lit("")).otherwise(F.sha2(c, 256))


# --- events and predictions -----------------------------------------------------
def unit_interval(c) -> Column:
    return F.coalesce(_col(c).between(0.0, 1.0), F.lit(False))


def event_violation() -> Column:
    """First broken rule of an event row, NULL when it is sound."""
    threshold = F.col("decision_threshold")
    return (
        F.when(~unit_interval("emotion_confidence"), "emotion_confidence")
        .when(~unit_interval("speaker_confidence"), "speaker_confidence")
        .when(~unit_interval("audio_quality"), "audio_quality")
        .when(F.col("timestamp_ms") < 0, "timestamp_ms")
        .when((F.col("status") == "NOT_CONFIGURED") & F.col("emotion").isNotNull(), "emotion_without_model")
        .when(threshold.isNotNull() & ~unit_interval(threshold), "decision_threshold")
    )


def prediction_violation() -> Column:
    """First broken rule of a prediction row, NULL when it is sound."""
    threshold, rejection = F.col("decision_threshold"), F.col("rejection_status")
    return (
        F.when(~unit_interval("confidence"), "confidence")
        .when(F.exists(F.map_values("scores"), lambda v: ~unit_interval(v)), "scores")
        .when(F.col("timestamp_ms") < 0, "timestamp_ms")
        .when(~unit_interval("audio_quality"), "audio_quality")
        .when(threshold.isNotNull() & ~unit_interval(threshold), "decision_threshold")
        .when(rejection.isNotNull() & ~rejection.isin(*settings.REJECTION_STATUSES), "rejection_status")
        .when((F.col("model_status") != "READY") & F.col("emotion").isNotNull(), "emotion_without_model")
    )


def prediction_status(rejection="rejection_status", model="model_status") -> Column:
    """Status a prediction shows: its rejection, else whether a model exists."""
    return F.coalesce(
        _col(rejection), F.when(_col(model).isin("NOT_CONFIGURED", "INVALID"), "NOT_CONFIGURED").otherwise("UNCERTAIN")
    )


def normalise_legacy(emotion="emotion", status="status", confidence="emotion_confidence") -> Column:
    """Read an old event row as a prediction; its identity fields are ignored."""
    e, s = _col(emotion), _col(status)
    nothing = F.lit(None).cast("string")
    return F.struct(
        e.alias("emotion"),
        F.when(e.isNull() & (s == "NOT_CONFIGURED"), "NOT_CONFIGURED").otherwise("READY").alias("model_status"),
        F.when(e.isNull() & s.isin("LOW_QUALITY", "UNCERTAIN"), s).otherwise(nothing).alias("rejection_status"),
        F.when(e.isNull(), F.lit(0.0)).otherwise(_col(confidence)).alias("confidence"),
    )


def unconfigured_prediction(quality_status="quality_status", audio_quality="audio_quality") -> Column:
    """What the fail-closed default scorer answers."""
    nothing = F.lit(None).cast("string")
    return F.struct(
        nothing.alias("emotion"), F.lit(0.0).alias("confidence"), F.lit("NOT_CONFIGURED").alias("model_status"),
        F.when(_col(quality_status) == "LOW_QUALITY", "LOW_QUALITY").otherwise(nothing).alias("rejection_status"),
        F.coalesce(_col(audio_quality), F.lit(0.0)).alias("audio_quality"),
        F.lit("UNCALIBRATED").alias("calibration_status"),
    )


# --- identifier fields ------------------------------------------------------------
def drop_private_fields(column: Column, dtype: T.DataType, keys: Sequence[str]) -> Column:
    """Remove the named fields at any depth of a typed column (walks the schema)."""
    if isinstance(dtype, T.StructType):
        kept = [f for f in dtype.fields if f.name not in keys]
        if not kept:
            return F.lit(None).cast(dtype)
        fields = [drop_private_fields(column[f.name], f.dataType, keys).alias(f.name) for f in kept]
        return F.when(column.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(column, lambda x: drop_private_fields(x, dtype.elementType, keys))
    if isinstance(dtype, T.MapType) and isinstance(dtype.keyType, T.StringType):
        kept = F.map_filter(column, lambda k, v: ~k.isin(*keys))
        return F.transform_values(kept, lambda k, v: drop_private_fields(v, dtype.valueType, keys))
    return column


def redact_json(document, keys: Sequence[str] = settings.REPORT_PRIVATE_KEYS) -> Column:
    """Remove the named keys at any depth of JSON text (text that is not JSON becomes NULL)."""
    import json

    import pandas as pd

    private = frozenset(keys)

    def prune(value):
        if isinstance(value, list):
            return [prune(v) for v in value]
        if isinstance(value, dict):
            return {k: prune(v) for k, v in value.items() if k not in private}
        return value

    def one(text):
        try:
            return json.dumps(prune(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except (TypeError, ValueError):
            return None

    @F.pandas_udf("string")
    def redact(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return redact(_col(document))


def withhold_split(counts, split: str = "test") -> Column:
    """Drop one split's entry from a ``split -> counts`` map."""
    return F.map_filter(_col(counts), lambda k, v: k != split)


def payload(scores="scores") -> list[Column]:
    """Output columns of a live result; all class scores appear, missing ones as 0."""
    s = _col(scores)
    filled = F.map_from_arrays(
        F.array(*[F.lit(e) for e in settings.EMOTIONS]),
        F.array(*[F.coalesce(F.try_element_at(s, F.lit(e)), F.lit(0.0)) for e in settings.EMOTIONS]),
    )
    return [
        F.lit("EMOTION_ONLY_EXPERIMENTAL").alias("mode"), F.lit("NOT_EVALUATED").alias("identity_status"),
        F.col("timestamp_ms"), F.col("emotion"), F.col("candidate_emotion"), filled.alias("scores"),
        F.col("confidence"), F.col("candidate_emotion").alias("confidence_for"), F.col("rejection_reason"),
        F.col("audio_active").alias("audio_activity"), F.col("activity_ratio"), F.col("audio_quality"),
        F.col("audio_quality_status"), F.col("calibration_status"), F.col("rejection_threshold"), F.col("model_version"),
    ]


def mapping_column(mapping: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
