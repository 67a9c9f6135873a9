"""Training: labelled windows to two calibrated models, in one distributed plan."""

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe import settings
from sonoframe.functions import pitch
from sonoframe.functions import scores as P
from sonoframe.operators import metrics as MT
from sonoframe.operators import mixing as X
from sonoframe.operators import model as ML
from sonoframe.operators import summaries as SU
from sonoframe.sources.writers import write_report

PROFILES = {"simple": (settings.SIMPLE_FEATURES, settings.SIMPLE_SCHEMA), "full": (settings.FULL_FEATURES, settings.FULL_SCHEMA)}


def gated_features(df: DataFrame, cfg: settings.FrameSettings, gates: settings.QualityGates = settings.QualityGates()) -> DataFrame:
    """Quality, gate reason and the 24 features; pitch is measured on accepted rows only."""
    measured = SU.summarise_quality(pitch.measure_quality(df, cfg), cfg.activity_rms_threshold, gates)
    work = F.when(F.col("quality_status") == "ACCEPTABLE", F.col("samples")).otherwise(F.array().cast("array<float>"))
    featured = SU.prosody_features(pitch.measure_frames(measured.withColumn("_work", work), cfg, samples="_work"), cfg)
    return as_stored(ML.accept_windows(featured.drop("_work")))


def plain_features(df: DataFrame, cfg: settings.FrameSettings) -> DataFrame:
    return as_stored(SU.prosody_features(pitch.measure_frames(df, cfg), cfg))


def as_stored(df: DataFrame) -> DataFrame:
    """Round features to single precision, the precision the vectors are stored in."""
    return df.withColumns({f: F.col(f).cast("float").cast("double") for f in settings.FULL_FEATURES})


def fit_profile(
    train: DataFrame, validation: DataFrame, profile: str, *, cfg: settings.FrameSettings = settings.FrameSettings(),
    kind: str = "LinearSVC", class_weight: Mapping[str, float] | None = None, model_version: str = "sonoframe-linear-1",
    provenance: Mapping | None = None, window_s: float = 1.5, update_interval_s: float = 0.5,
) -> dict:
    """Impute, scale, fit, calibrate and choose the threshold; returns the model document.  Runs jobs."""
    names, schema = PROFILES[profile]
    counted = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    held = {r["label"]: r["n"] for r in validation.groupBy("label").agg(F.count("*").alias("n")).collect()}
    classes = tuple(sorted(counted))
    if len(classes) < 2:
        raise ValueError("training needs at least two classes")
    medians = ML.fit_imputer(train, names)
    filled = ML.impute(train, medians, training=True)
    means, scales = ML.fit_scaler(filled, names)
    weight = {c: float((class_weight or {}).get(c, 1.0)) for c in classes}
    weights, intercepts = ML.fit_linear(ML.scale(filled, names, means, scales), names, classes, kind=kind, class_weight=weight)
    model = {
        "format_version": settings.MODEL_FORMAT, "model_version": model_version, "feature_profile": profile,
        "feature_schema_version": schema, "feature_names": list(names), "sample_rate": int(cfg.sample_rate),
        "frame_ms": float(cfg.frame_ms), "hop_ms": float(cfg.hop_ms), "activity_rms_threshold": float(cfg.activity_rms_threshold),
        "window_s": float(window_s), "update_interval_s": float(update_interval_s),
        "quality_gates": {k: float(getattr(settings.QualityGates(), k)) for k in settings.QUALITY_GATE_KEYS},
        "classes": list(classes), "imputation_values": [float(medians[f]) for f in names],
        "standardization_mean": [float(v) for v in means], "standardization_scale": [float(v) for v in scales],
        "weights": weights, "intercepts": intercepts,
    }
    judged = validation.withColumn("margins", ML.margin_columns(model)).select("label", "margins").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        slopes, offsets = ML.fit_calibrator(judged, classes)
        scored = judged.select("label", P.calibrated_scores("margins", slopes, offsets).alias("scores"), F.lit(True).alias("eligible"))
        chosen = MT.select_threshold(scored, classes).first()
        brier = MT.brier(scored, classes).first()["brier_score"]
        ece = MT.ece(scored, classes).first()["expected_calibration_error"]
    finally:
        judged.unpersist()
    facts = dict(provenance or {})
    manifest = facts.get("manifest_sha256") or hashlib.sha256(b"").hexdigest()
    mapping = dict(facts.get("label_mapping") or settings.LABEL_ALIASES)
    mapping_hash = hashlib.sha256(json.dumps(mapping, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    svc = kind == "LinearSVC"
    model.update({
        "calibration_slopes": slopes, "calibration_intercepts": offsets, "rejection_threshold": float(chosen["threshold"]),
        "calibration_status": "CALIBRATED", "calibration_method": settings.CALIBRATION_METHOD,
        "training_library": {
            "scikit_learn_version": facts.get("library_version", "spark.ml"), "classifier": kind, "C": 1.0,
            "dual": "auto" if svc else None, "solver": None if svc else "lbfgs", "max_iter": None if svc else 1000,
            "class_weight": weight, "standardization": settings.STANDARDIZATION_METHOD, "imputation": settings.IMPUTATION_METHOD},
        "training_manifest_sha256": manifest, "label_mapping_sha256": mapping_hash, "label_mapping": mapping,
        "dataset_split": {"method": facts.get("split_method", "group-exclusive split"), "seed": int(facts.get("seed", 42))},
        "validation": {
            "sample_count": sum(held.values()), "manifest_sha256": manifest, "threshold_selected_on": "validation",
            "threshold_selection_method": settings.THRESHOLD_METHOD, "brier_score": float(brier), "ece": float(ece),
            "class_counts": {c: int(held.get(c, 0)) for c in settings.EMOTIONS}},
        "training": {"sample_count": sum(counted.values()), "class_counts": {c: int(counted.get(c, 0)) for c in settings.EMOTIONS}},
    })
    return model


def train_profiles(
    windows: DataFrame, *, order: Sequence[str] | str, cfg: settings.FrameSettings = settings.FrameSettings(), seed: int = 42,
    snr_db: Sequence[float] = (), backgrounds: DataFrame | None = None, background_snr_db: Sequence[float] = (),
    rooms: DataFrame | None = None, kind: str = "LinearSVC", happy_weight: float = 1.0, provenance: Mapping | None = None,
    profiles: Sequence[str] = ("simple", "full"),
) -> tuple[dict[str, dict], DataFrame]:
    """(models by profile, rejection counts per split).  Test rows are never measured.

    Windows carry ``label``, ``split``, ``samples``, ``sample_rate`` and a unique order.
    """
    if not 0.0 < happy_weight <= 20.0:
        raise ValueError("happy_weight must lie in (0, 20]")
    keys = [order] if isinstance(order, str) else list(order)
    development = windows.filter(F.col("split").isin("train", "validation"))
    classes = development.agg(
        F.collect_set("label").alias("all"), F.collect_set(F.when(F.col("split") == "train", F.col("label"))).alias("train")).first()
    absent = sorted(set(classes["all"]) - set(classes["train"]))
    if absent:
        raise ValueError(f"the training split is missing classes: {', '.join(absent)}")
    wrong = development.filter(F.col("sample_rate") != cfg.sample_rate).limit(1).count()
    if wrong:
        raise ValueError("sample rate differs from the training settings")
    gated = gated_features(development, cfg).drop("samples").persist(StorageLevel.MEMORY_AND_DISK)
    rejected = MT.reason_counts(gated, by=["split"])
    accepted = gated.filter(F.col("reason").isNull())
    base = accepted.select(*keys, "label", "split", *settings.FULL_FEATURES)
    train, validation = base.filter("split = 'train'"), base.filter("split = 'validation'")
    if snr_db or background_snr_db or rooms is not None:
        originals = development.filter("split = 'train'").join(accepted.select(*keys), keys, "left_semi")
        copies = X.augment(
            originals.select(*keys, "label", "split", "sample_rate", "samples"), order=keys, seed=seed, snr_db=snr_db,
            backgrounds=backgrounds, background_snr_db=background_snr_db, rooms=rooms).filter("augmentation <> 'original'")
        noisy = plain_features(copies, cfg).drop("samples").persist(StorageLevel.MEMORY_AND_DISK)
        # white-noise copies are checked for frame validity; background and reverb copies are not
        white = F.col("augmentation").isin(*[f"{v:g}dB" for v in snr_db])
        valid = ~white | (F.col("valid_frame_fraction") >= settings.MIN_VALID_FRAME_FRACTION)
        lost = noisy.filter(~valid).withColumn("reason", F.lit("AUGMENT_INVALID_FRAME_CONTENT"))
        rejected = rejected.unionByName(MT.reason_counts(lost, by=["split"]))
        train = train.unionByName(noisy.filter(valid).select(*keys, "label", "split", *settings.FULL_FEATURES))
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        left = {r["split"]: set(r["labels"]) for r in base.groupBy("split").agg(F.collect_set("label").alias("labels")).collect()}
        for split in ("train", "validation"):
            gone = sorted(set(classes["all"]) - left.get(split, set()))
            if gone:
                raise ValueError(f"the quality-gated {split} split is missing classes: {', '.join(gone)}")
        weight = {"happy": happy_weight}
        models = {
            p: fit_profile(train, validation, p, cfg=cfg, kind=kind, class_weight=weight, provenance=provenance) for p in profiles}
    finally:
        train.unpersist()
    return models, rejected


def save_models(spark: SparkSession, models: Mapping[str, Mapping], path: str) -> None:
    """Write model documents (a handful of rows) as JSON, one object per line."""
    rows = [tuple(m.get(f.name) for f in ML.MODEL_SCHEMA.fields) for m in models.values()]
    write_report(spark.createDataFrame(rows, ML.MODEL_SCHEMA), path)
