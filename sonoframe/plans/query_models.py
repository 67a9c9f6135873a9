"""Queries for mixing, feature statistics, scoring, training and evaluation."""

from pyspark.sql import functions as F

from sonoframe import settings
from sonoframe.functions import series as S
from sonoframe.operators import mixing as X
from sonoframe.operators import model as ML
from sonoframe.plans import evaluate as EV
from sonoframe.plans import live as LV
from sonoframe.plans import train as TR
from sonoframe.plans.query_series import RMS, audio_length, half_quiet, series
from sonoframe.plans.registry import block_total, block_total_sql, load, query, r6, rounded, s6, spread

# --- mixing ---------------------------------------------------------------------------
PAIR = """pr AS (SELECT a.vec_id, list_transform(a.embedding, lambda x: x::DOUBLE) AS x, list_transform(range(1, 33), lambda k: ((b.embedding[2 * k - 1]::DOUBLE + b.embedding[2 * k]::DOUBLE) / 2)::FLOAT::DOUBLE) AS y, (a.vec_id % 4 * 5)::DOUBLE AS db
 FROM embeddings a JOIN embeddings b ON b.vec_id = CASE WHEN xor(a.vec_id, 1) IN (SELECT vec_id FROM embeddings) THEN xor(a.vec_id, 1) ELSE a.vec_id END),
tl AS (SELECT *, list_transform(range(0, 64), lambda i: y[i % 32 + 1]) AS t, list_avg(list_transform(x, lambda v: v * v)) AS px FROM pr),
lv AS (SELECT *, list_avg(list_transform(t, lambda v: v * v)) AS pt FROM tl)"""


def pairs(spark, sf_dir):
    """Each series with a level and a shorter partner: the pair means of its neighbour, or of itself where it has none."""
    halved = lambda e: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: (
        (F.get(e, 2 * k).cast("double") + F.get(e, 2 * k + 1).cast("double")) / 2).cast("float"))
    e = load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("samples"), halved(F.col("embedding")).alias("own"))
    other = e.select(F.col("vec_id").bitwiseXOR(F.lit(1)).alias("vec_id"), F.col("own").alias("other"))
    return e.join(other, "vec_id", "left").select(
        "vec_id", "samples", F.coalesce("other", "own").alias("other"), (F.pmod("vec_id", F.lit(4)) * 5).cast("double").alias("level_db"))


def _weighted(samples="samples"):
    """A position-dependent total, so that any wrong sample shows."""
    return F.aggregate(F.transform(samples, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, b: a + b)


WEIGHTED = "list_sum(list_transform({0}, lambda v, i: v::FLOAT::DOUBLE * i))"


@query("background_mix", f"WITH {PAIR}, m AS (SELECT vec_id, list_transform(range(1, 65), lambda i: (x[i] + t[i] * sqrt(px / pow(10, db / 10) / pt))::FLOAT) AS z FROM lv) SELECT vec_id, {s6(WEIGHTED.format('z'), 4)} AS total, {s6(RMS.format('z'))} AS rms FROM m")
def background_mix(spark, sf_dir):
    return X.mix_background(pairs(spark, sf_dir), "other", "level_db").select("vec_id", r6(_weighted(), 4).alias("total"), r6(S.rms("samples")).alias("rms"))


@query("interferer_mix", f"WITH {PAIR}, m AS (SELECT vec_id, list_transform(range(1, 65), lambda i: (x[i] + t[i] * sqrt(px) / (sqrt(pt) * pow(10, (db - 9) / 20)))::FLOAT) AS z FROM lv) SELECT vec_id, {s6(WEIGHTED.format('z'), 4)} AS total, {s6(RMS.format('z'))} AS rms FROM m")
def interferer_mix(spark, sf_dir):
    df = pairs(spark, sf_dir).withColumn("level_db", F.col("level_db") - 9)
    return X.mix_interferer(df, "other", "level_db").select("vec_id", r6(_weighted(), 4).alias("total"), r6(S.rms("samples")).alias("rms"))


@query("reverb_mix", f"""WITH {PAIR}, w AS (SELECT *, list_transform(range(1, 65), lambda i: list_sum(list_transform(range(1, least(i, 32) + 1), lambda k: y[k] * x[i - k + 1]))) AS c FROM lv),
 m AS (SELECT vec_id, list_transform(c, lambda v: (v * sqrt(px) / sqrt(list_avg(list_transform(c, lambda u: u * u))))::FLOAT) AS z FROM w) SELECT vec_id, {s6(WEIGHTED.format('z'), 4)} AS total, {s6(RMS.format('z'))} AS rms FROM m""")
def reverb_mix(spark, sf_dir):
    return X.apply_reverb(pairs(spark, sf_dir), "other").select("vec_id", r6(_weighted(), 4).alias("total"), r6(S.rms("samples")).alias("rms"))


@query("white_noise_mix", f"SELECT vec_id, {s6('(vec_id % 4 * 5)::DOUBLE', 3)} AS measured_snr_db FROM embeddings")
def white_noise_mix(spark, sf_dir):
    """The measured ratio of signal to added noise equals the requested one."""
    df = series(spark, sf_dir).withColumn("level_db", (F.pmod("vec_id", F.lit(4)) * 5).cast("double")).withColumn("clean", F.col("samples"))
    noisy = X.mix_white_noise(df, "level_db", F.col("vec_id") + 42)
    noise = F.zip_with("samples", "clean", lambda a, b: a.cast("double") - b.cast("double"))
    power = lambda c: S.mean_square(c)
    wide = F.transform("clean", lambda x: x.cast("double"))
    return noisy.select("vec_id", r6(F.lit(10.0) * F.log10(power(wide) / power(noise)), 3).alias("measured_snr_db"))


@query("mix_guard", """SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN 'EMPTY_SIGNAL' WHEN vec_id % 11 = 1 THEN 'NOT_FINITE' WHEN vec_id % 11 = 2 THEN 'NO_ENERGY' WHEN vec_id % 11 = 3 THEN 'LEVEL_OUT_OF_RANGE'
 WHEN vec_id % 11 = 4 THEN 'SOURCE_NO_ENERGY' WHEN vec_id % 11 = 5 THEN 'RATE_MISMATCH' END AS mix_problem, CASE WHEN vec_id % 11 <= 5 THEN 'MIX_INVALID' END AS reason FROM embeddings""")
def mix_guard(spark, sf_dir):
    m = F.pmod("vec_id", F.lit(11))
    zero, nan = F.lit(0.0).cast("float"), F.lit(float("nan")).cast("float")
    df = series(spark, sf_dir).select(
        "vec_id", "sample_rate", F.when(m == 0, F.array().cast("array<float>")).when(m == 1, F.concat("samples", F.array(nan))).when(
            m == 2, F.array(zero, zero)).otherwise(F.col("samples")).alias("samples"),
        F.when(m == 3, 61.0).otherwise(10.0).alias("level_db"),
        F.when(m == 4, F.array(zero)).otherwise(F.col("samples")).alias("other"), F.when(m == 5, 8000).otherwise(F.col("sample_rate")).alias("other_rate"))
    out = X.mixable(df, "background", other="other", rate="sample_rate", other_rate="other_rate")
    return out.select("vec_id", "mix_problem", "reason")


@query("condition_rows", """WITH g AS (SELECT unnest(['clean', 'white_noise_20db', 'white_noise_10db', 'white_noise_5db', 'white_noise_0db', 'fan_snr_20db', 'fan_snr_10db', 'fan_snr_5db', 'fan_snr_0db', 'reverb_rir_1', 'reverb_rir_2',
 'other_voice_sir_6db', 'other_voice_sir_0db', 'other_voice_sir_-6db']) AS condition) SELECT vec_id, condition FROM embeddings, g""")
def condition_rows(spark, sf_dir):
    return X.with_conditions(series(spark, sf_dir), X.condition_grid(noise_types=("fan",), rirs=2)).select("vec_id", "condition")


@query("augmented_rows", """SELECT label, augmentation, count(*) AS "rows", sum(64)::BIGINT AS samples FROM embeddings, (SELECT unnest(['original', '20dB', '5dB', 'fan@10dB', 'reverb']) AS augmentation) GROUP BY ALL""")
def augmented_rows(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    wave = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.sin(i * (F.col("n_nationkey") + 1) + 1).cast("float"))
    pick = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("source_idx"), wave.alias("source_samples"))
    train = e.select("vec_id", "label", F.col("embedding").alias("samples"))
    out = X.augment(train, order="vec_id", snr_db=(20.0, 5.0), backgrounds=pick.withColumn("noise_type", F.lit("fan")), background_snr_db=(10.0,), rooms=pick)
    return out.groupBy("label", "augmentation").agg(F.count("*").alias("rows"), F.sum(F.size("samples").cast("long")).alias("samples"))


# --- feature statistics ------------------------------------------------------------------
NAMES = [f"e{i}" for i in range(8)]


def features(spark, sf_dir):
    """Scaled means of eight blocks of values as features, some missing."""
    return load(spark, sf_dir, "embeddings").select("vec_id", "label", *[
        F.when(F.pmod(F.col("vec_id") + i, F.lit(9)) != 0, block_total("embedding", i, 8) / 3).alias(f"e{i}") for i in range(8)])


FEATURES = "f AS (SELECT vec_id, label, " + ", ".join(f"CASE WHEN (vec_id + {i}) % 9 <> 0 THEN {block_total_sql('embedding', i, 8)} / 3 END AS e{i}" for i in range(8)) + " FROM embeddings)"
FILLED = f"{FEATURES}, md AS (SELECT {', '.join(f'median(e{i}) AS m{i}' for i in range(8))} FROM f), z AS (SELECT vec_id, label, {', '.join(f'coalesce(e{i}, m{i}) AS e{i}' for i in range(8))} FROM f, md)"


@query("feature_medians", f"WITH {FEATURES} " + " UNION ALL ".join(f"SELECT 'e{i}' AS feature, count(e{i}) AS n, {s6(f'median(e{i})')} AS median FROM f" for i in range(8)))
def feature_medians(spark, sf_dir):
    return rounded(ML.feature_medians(features(spark, sf_dir), NAMES), "median")


@query("imputed_rows", f"WITH {FILLED} SELECT vec_id, {', '.join(s6(n) + ' AS ' + n for n in NAMES)} FROM z")
def imputed_rows(spark, sf_dir):
    df = features(spark, sf_dir)
    return rounded(ML.impute(df, ML.fit_imputer(df, NAMES)), *NAMES).select("vec_id", *NAMES)


@query("scaled_rows", f"WITH {FILLED}, st AS (SELECT {', '.join(f'avg({n}) AS a_{n}, stddev_pop({n}) AS d_{n}' for n in NAMES)} FROM z) SELECT vec_id, {', '.join(s6(f'({n} - a_{n}) / d_{n}') + ' AS ' + n for n in NAMES)} FROM z, st")
def scaled_rows(spark, sf_dir):
    df = features(spark, sf_dir)
    filled = ML.impute(df, ML.fit_imputer(df, NAMES))
    return rounded(ML.scale(filled, NAMES, *ML.fit_scaler(filled, NAMES)), *NAMES).select("vec_id", *NAMES)


@query("accepted_windows", """SELECT vec_id, CASE vec_id % 5 WHEN 0 THEN 'LOW_QUALITY' WHEN 1 THEN 'UNCERTAIN' ELSE CASE WHEN vec_id % 13 / 13 > 0.05 THEN 'INVALID_FRAME_CONTENT' END END AS reason FROM embeddings""")
def accepted_windows(spark, sf_dir):
    m = F.pmod("vec_id", F.lit(5))
    df = load(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(m == 0, "LOW_QUALITY").when(m == 1, "UNCERTAIN").otherwise("ACCEPTABLE").alias("quality_status"),
        (F.lit(1.0) - F.pmod("vec_id", F.lit(13)) / 13).alias("valid_frame_fraction"))
    return ML.accept_windows(df).select("vec_id", "reason")


# --- scoring with a fixed model -------------------------------------------------------------
def fixed_model() -> dict:
    wave = lambda a, b: [round(((a * 7 + b * (i + 3)) % 11 - 5) / 4.0, 3) for i in range(8)]
    return {
        "feature_names": NAMES, "feature_schema_version": "demo", "sample_rate": 1000, "frame_ms": 25.0, "hop_ms": 10.0, "activity_rms_threshold": 0.01,
        "classes": ["angry", "happy", "neutral", "sad"], "imputation_values": [0.01 * i for i in range(8)],
        "standardization_mean": [0.005 * i for i in range(8)], "standardization_scale": [0.1 + 0.01 * i for i in range(8)],
        "weights": [wave(c, c + 1) for c in range(4)], "intercepts": [0.1, -0.2, 0.05, 0.0],
        "calibration_slopes": [1.2, 0.9, 1.1, 0.7], "calibration_intercepts": [-0.3, 0.1, 0.0, 0.2], "rejection_threshold": 0.45}


def _margin_sql(c: int) -> str:
    m = fixed_model()
    terms = " + ".join(
        f"(coalesce(e{i}, {m['imputation_values'][i]}::DOUBLE) - {m['standardization_mean'][i]}::DOUBLE) / {m['standardization_scale'][i]}::DOUBLE * {m['weights'][c][i]}::DOUBLE" for i in range(8))
    return f"1 / (1 + exp(-greatest(least(({terms} + {m['intercepts'][c]}) * {m['calibration_slopes'][c]} + {m['calibration_intercepts'][c]}, 60), -60)))"


@query("predicted_rows", f"""WITH {FEATURES}, r AS (SELECT vec_id, [{', '.join(_margin_sql(c) for c in range(4))}] AS raw FROM f), s AS (SELECT vec_id, list_transform(raw, lambda x: x / list_sum(raw)) AS p FROM r)
SELECT vec_id, CASE WHEN vec_id % 6 = 0 THEN 'INVALID' ELSE 'READY' END AS model_status, CASE WHEN vec_id % 6 <> 0 AND list_max(p) >= 0.45 THEN ['angry','happy','neutral','sad'][list_position(p, list_max(p))] END AS emotion,
 {s6('CASE WHEN vec_id % 6 = 0 THEN 0 ELSE list_max(p) END')} AS confidence, CASE WHEN vec_id % 6 = 0 OR list_max(p) < 0.45 THEN 'UNCERTAIN' END AS rejection_status, {s6('CASE WHEN vec_id % 6 <> 0 THEN p[1] END')} AS p0 FROM s""")
def predicted_rows(spark, sf_dir):
    df = features(spark, sf_dir).withColumns({
        "sample_rate": F.lit(1000), "frame_ms": F.lit(25.0), "hop_ms": F.when(F.pmod("vec_id", F.lit(6)) == 0, 5.0).otherwise(10.0),
        "activity_rms_threshold": F.lit(0.01), "feature_schema_version": F.lit("demo")})
    out = ML.predict(df, fixed_model(), check_contract=True)
    return out.select("vec_id", "model_status", "emotion", r6("confidence").alias("confidence"), "rejection_status", r6(F.col("scores")[0]).alias("p0"))


@query("contract_matches", "SELECT vec_id, CASE WHEN vec_id % 6 = 0 OR vec_id % 10 = 0 THEN 'INVALID' ELSE 'READY' END AS model_status FROM embeddings")
def contract_matches(spark, sf_dir):
    df = load(spark, sf_dir, "embeddings").select("vec_id").withColumns({
        "sample_rate": F.lit(1000), "frame_ms": F.lit(25.0), "hop_ms": F.when(F.pmod("vec_id", F.lit(6)) == 0, 5.0).otherwise(10.0),
        "activity_rms_threshold": F.lit(0.01), "feature_schema_version": F.when(F.pmod("vec_id", F.lit(10)) == 0, "old").otherwise("demo")})
    return ML.match_contract(df, fixed_model()).select("vec_id", "model_status")


# --- model registry ------------------------------------------------------------------------------
def valid_document(profile: str = "simple") -> dict:
    names, schema = TR.PROFILES[profile]
    n, digest = len(names), "a" * 64
    counts = {c: 5 for c in settings.EMOTIONS}
    return {
        "format_version": 1, "model_version": "m1", "feature_profile": profile, "feature_schema_version": schema, "feature_names": list(names),
        "sample_rate": 16000, "frame_ms": 25.0, "hop_ms": 10.0, "activity_rms_threshold": 0.01, "window_s": 1.5, "update_interval_s": 0.5,
        "quality_gates": {k: 1.0 for k in settings.QUALITY_GATE_KEYS}, "classes": ["angry", "happy", "neutral", "sad"],
        "imputation_values": [0.0] * n, "standardization_mean": [0.0] * n, "standardization_scale": [1.0] * n, "weights": [[0.5] * n] * 4,
        "intercepts": [0.0] * 4, "calibration_slopes": [1.0] * 4, "calibration_intercepts": [0.0] * 4, "rejection_threshold": 0.4,
        "calibration_status": "CALIBRATED", "calibration_method": settings.CALIBRATION_METHOD,
        "training_library": {"scikit_learn_version": "1", "classifier": "LinearSVC", "C": 1.0, "dual": "auto", "solver": None, "max_iter": None,
                             "class_weight": {c: 1.0 for c in settings.EMOTIONS}, "standardization": settings.STANDARDIZATION_METHOD,
                             "imputation": settings.IMPUTATION_METHOD},
        "training_manifest_sha256": digest, "label_mapping_sha256": digest, "label_mapping": {"n": "neutral"},
        "dataset_split": {"method": "groups", "seed": 42},
        "validation": {"sample_count": 20, "manifest_sha256": digest, "threshold_selected_on": "validation",
                       "threshold_selection_method": settings.THRESHOLD_METHOD, "brier_score": 0.3, "ece": 0.1, "class_counts": counts},
        "training": {"sample_count": 20, "class_counts": counts}}


@query("model_audit", """SELECT s_suppkey, CASE s_suppkey % 9 WHEN 1 THEN 'INVALID' WHEN 2 THEN 'INVALID' WHEN 3 THEN 'INVALID' WHEN 4 THEN 'UNCALIBRATED' WHEN 5 THEN 'NOT_CONFIGURED' WHEN 6 THEN 'INVALID' ELSE 'READY' END AS model_status,
 CASE s_suppkey % 9 WHEN 1 THEN 'feature_names' WHEN 2 THEN 'positive_scales' WHEN 3 THEN 'rejection_threshold' WHEN 6 THEN 'expected_sample_rate' END AS failed_rule, CASE WHEN s_suppkey % 9 IN (0, 4, 7, 8) THEN 68 END::INTEGER AS parameter_count FROM supplier""")
def model_audit(spark, sf_dir):
    """A registry with one document per supplier row, some of them broken."""
    doc = spark.createDataFrame([tuple(valid_document().get(f.name) for f in ML.MODEL_SCHEMA.fields)], ML.MODEL_SCHEMA).first()
    m = F.pmod("s_suppkey", F.lit(9))
    import json

    text = F.lit(json.dumps(doc.asDict(recursive=True)))
    table = load(spark, sf_dir, "supplier").select("s_suppkey", (m == 5).alias("missing"), F.from_json(text, ML.MODEL_SCHEMA).alias("d"))
    table = table.select("s_suppkey", "missing", "d.*").withColumns({
        "feature_names": F.when(m == 1, F.reverse("feature_names")).otherwise(F.col("feature_names")),
        "standardization_scale": F.when(m == 2, F.transform("standardization_scale", lambda x: x * 0)).otherwise(F.col("standardization_scale")),
        "rejection_threshold": F.when(m == 3, 1.5).otherwise(F.col("rejection_threshold")),
        "calibration_status": F.when(m == 4, "UNCALIBRATED").otherwise(F.col("calibration_status")),
        "sample_rate": F.when(m == 6, 8000).otherwise(F.col("sample_rate"))})
    return ML.audit_models(table, {"sample_rate": 16000}).select("s_suppkey", "model_status", "failed_rule", "parameter_count")


# --- fitting and evaluating end to end ---------------------------------------------------------------
@query("fitted_weights")
def fitted_weights(spark, sf_dir):
    """A linear machine and its calibration fitted on the eight features."""
    df = features(spark, sf_dir).withColumn("label", F.element_at(F.array(*[F.lit(c) for c in settings.EMOTIONS]), F.pmod("label", F.lit(4)) + 1))
    filled = ML.impute(df, ML.fit_imputer(df, NAMES), training=True)
    scaled = ML.scale(filled, NAMES, *ML.fit_scaler(filled, NAMES))
    classes = sorted(settings.EMOTIONS)
    weights, intercepts = ML.fit_linear(scaled, NAMES, classes, kind="LogisticRegression")
    rows = [(c, n, float(w)) for c, ws in zip(classes, weights) for n, w in zip([*NAMES, "intercept"], [*ws, intercepts[classes.index(c)]])]
    return spark.createDataFrame(rows, "label string, feature string, weight double")


def labelled_windows(spark, sf_dir):
    """Audio-length windows with labels, speakers and a leakage-free split by speaker."""
    speaker = F.expr("vec_id div 5")
    df = audio_length(half_quiet(spread(series(spark, sf_dir))))
    return df.select(
        "vec_id", "sample_rate", "samples", F.element_at(F.array(*[F.lit(c) for c in settings.EMOTIONS]), F.pmod("label", F.lit(4)) + 1).alias("label"),
        F.concat(F.lit("s"), speaker.cast("string")).alias("speaker_id"), F.col("vec_id").cast("string").alias("recording_id"), F.lit("d").alias("dataset_id"),
        F.when(F.pmod(speaker, F.lit(5)) == 0, "validation").when(F.pmod(speaker, F.lit(5)) == 1, "test").otherwise("train").alias("split"))


@query("trained_and_evaluated")
def trained_and_evaluated(spark, sf_dir):
    """Train the 8-value profile, then evaluate it under noise conditions on the test split."""
    windows = labelled_windows(spark, sf_dir)
    models, _ = TR.train_profiles(windows, order="vec_id", profiles=("simple",))
    result = EV.evaluate_conditions(windows.filter("split = 'test'"), models["simple"], order="vec_id", snr_db=(20.0,), sir_db=(6.0,))
    return result["metrics"]


# --- plug-ins -------------------------------------------------------------------------------
QUARTER = block_total_sql("embedding", 0, 16), block_total_sql("embedding", 1, 16), block_total_sql("embedding", 2, 16), block_total_sql("embedding", 3, 16)


def loudest_quarter(matrix):
    """A user's predictor: the class of the largest quarter total; refuses rows that begin below -0.2."""
    if (matrix[:, 0] < -0.2).any():
        raise ValueError("out of range")
    totals = matrix.astype("float64").reshape(len(matrix), 4, -1).sum(axis=2)
    return [settings.EMOTIONS[i] for i in totals.argmax(axis=1)], 1 / (1 + abs(totals.sum(axis=1)))


@query("plugged_predictor", f"""WITH q AS (SELECT vec_id, embedding[1] AS first, [{", ".join(QUARTER)}] AS t FROM embeddings)
SELECT vec_id, first < -0.2::FLOAT AS failed, CASE WHEN NOT first < -0.2::FLOAT THEN {list(settings.EMOTIONS)}[list_position(t, list_max(t))] END AS emotion,
 {s6('CASE WHEN first < -0.2::FLOAT THEN 0.0 ELSE 1 / (1 + abs(list_sum(t))) END')} AS confidence FROM q""")
def plugged_predictor(spark, sf_dir):
    """A user's predictor over every series; rows it fails on are rejected alone, whatever shares their batch."""
    found = LV.with_predictor(series(spark, sf_dir), loudest_quarter, "samples")
    return found.select("vec_id", F.col("prediction.predictor_error").alias("failed"), F.col("prediction.emotion").alias("emotion"), r6("prediction.confidence").alias("confidence"))


def by_level(samples):
    """A user's verifier: by level, with a confidence beyond 1 for some, and failing on rows that begin below -0.2."""
    if samples[0] < -0.2:
        raise ValueError("out of range")
    total = float(samples.astype("float64").sum())
    return ("TARGET_ACTIVE" if total >= 0 else "NON_TARGET"), abs(total)


@query("plugged_verifier", f"""WITH q AS (SELECT vec_id, embedding[1] < -0.2::FLOAT AS failed, {QUARTER[0]} + {QUARTER[1]} + {QUARTER[2]} + {QUARTER[3]} AS t FROM embeddings)
SELECT vec_id, CASE WHEN failed OR abs(t) > 1 THEN 'UNCERTAIN' WHEN t >= 0 THEN 'TARGET_ACTIVE' ELSE 'NON_TARGET' END AS verdict_status,
 {s6('CASE WHEN failed OR abs(t) > 1 THEN 0.0 ELSE abs(t) END')} AS verdict_confidence FROM q""")
def plugged_verifier(spark, sf_dir):
    """A user's verifier over every series; failures and impossible answers are uncertain."""
    return LV.with_verifier(series(spark, sf_dir), by_level).select("vec_id", "verdict_status", r6("verdict_confidence").alias("verdict_confidence"))
