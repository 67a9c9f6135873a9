"""Queries over series: the embeddings table read as 64-sample recordings at 1 kHz."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe import settings
from sonoframe.functions import pitch as P
from sonoframe.functions import series as S
from sonoframe.operators import frames as FR
from sonoframe.operators import summaries as SU
from sonoframe.plans.registry import load, query, r6, rounded, s6, spread

RATE = 1000
CFG = settings.FrameSettings(sample_rate=RATE, max_f0_hz=450.0)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.lit(RATE).alias("sample_rate"), F.col("embedding").alias("samples"))


def poisoned(df: DataFrame) -> DataFrame:
    """Some samples replaced by NaN and infinities, by position."""
    bad = lambda text: F.lit(float(text)).cast("float")
    slot = lambda i: F.pmod(F.col("vec_id") * 7 + i, F.lit(97))
    return df.withColumn("samples", F.transform("samples", lambda x, i: (
        F.when(slot(i) == 0, bad("nan")).when(slot(i) == 1, bad("inf")).when(slot(i) == 2, bad("-inf")).otherwise(x))))


POISONED = """(SELECT vec_id, label, list_transform(embedding, lambda x, i: CASE (vec_id * 7 + i - 1) % 97
    WHEN 0 THEN 'nan'::FLOAT WHEN 1 THEN 'inf'::FLOAT WHEN 2 THEN '-inf'::FLOAT ELSE x END) AS s FROM embeddings)"""


def half_quiet(df: DataFrame) -> DataFrame:
    """First half faint, second half louder, both depending on the row."""
    faint = (F.lit(0.03) + F.lit(0.01) * F.pmod("vec_id", F.lit(7))).cast("float")
    loud = (F.lit(0.15) + F.lit(0.1) * F.pmod("vec_id", F.lit(9))).cast("float")
    return df.withColumn("samples", F.transform(
        "samples", lambda x, i: (x * F.when(i < 32, faint).otherwise(loud)).cast("float")))


HALF_QUIET = """(SELECT vec_id, label, list_transform(embedding, lambda x, i: (x * CASE WHEN i <= 32
    THEN (0.03::DOUBLE + 0.01::DOUBLE * (vec_id % 7))::FLOAT ELSE (0.15::DOUBLE + 0.1::DOUBLE * (vec_id % 9))::FLOAT END)::FLOAT) AS s FROM embeddings)"""

RMS = "sqrt(list_sum(list_transform({0}, lambda q: (q * q)::DOUBLE)) / len({0}))"


# --- flagship -----------------------------------------------------------------------
@query("activity_by_label", f"""
WITH f AS (
  SELECT vec_id, label, [{RMS.format('s[1:16]')}, {RMS.format('s[17:32]')}, {RMS.format('s[33:48]')}, {RMS.format('s[49:64]')}] AS lv
  FROM {HALF_QUIET}),
a AS (SELECT vec_id, label, len(list_filter(lv, lambda x: x >= 0.01)) AS n_active,
  CASE WHEN lv[1]>=0.01 AND lv[2]>=0.01 AND lv[3]>=0.01 AND lv[4]>=0.01 THEN 4
       WHEN (lv[1]>=0.01 AND lv[2]>=0.01 AND lv[3]>=0.01) OR (lv[2]>=0.01 AND lv[3]>=0.01 AND lv[4]>=0.01) THEN 3
       WHEN (lv[1]>=0.01 AND lv[2]>=0.01) OR (lv[2]>=0.01 AND lv[3]>=0.01) OR (lv[3]>=0.01 AND lv[4]>=0.01) THEN 2
       WHEN lv[1]>=0.01 OR lv[2]>=0.01 OR lv[3]>=0.01 OR lv[4]>=0.01 THEN 1 ELSE 0 END AS run FROM f)
SELECT label, count(*) AS recordings, sum(n_active)::BIGINT AS active_frames, max(run)::INTEGER AS longest_run,
  {s6('avg(n_active / 4.0::DOUBLE)')} AS mean_activity FROM a GROUP BY label""")
def activity_by_label(spark, sf_dir):
    df = half_quiet(series(spark, sf_dir)).withColumn("frame_levels", FR.frame_levels("samples", F.lit(16)))
    return SU.activity_summary(df).groupBy("label").agg(
        F.count("*").alias("recordings"), F.sum(F.col("active_frame_count").cast("long")).alias("active_frames"),
        F.max("longest_active_run").alias("longest_run"), r6(F.avg("activity_ratio")).alias("mean_activity"))


# --- sample repair and measures -------------------------------------------------------
@query("sample_repair", f"""
SELECT vec_id, {s6("list_sum(list_transform(s, lambda x: CASE WHEN isnan(x) THEN 0 WHEN x = 'inf'::FLOAT THEN 1 WHEN x = '-inf'::FLOAT THEN -1 ELSE x END::DOUBLE))")} AS repaired_total,
  {s6("list_sum(list_transform(list_filter(s, lambda x: NOT isnan(x)), lambda x: greatest(least(x::DOUBLE * 4, 1.0), -1.0)))")} AS clipped_total
FROM {POISONED}""")
def sample_repair(spark, sf_dir):
    df = poisoned(series(spark, sf_dir))
    louder = F.transform(F.filter("samples", lambda x: ~F.isnan(x)), lambda x: x.cast("double") * 4)
    return df.select(
        "vec_id", r6(S.array_total(S.repair_samples("samples"))).alias("repaired_total"),
        r6(S.array_total(S.clip_samples(louder))).alias("clipped_total"))


@query("series_measures", f"""
WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: (v * 4::FLOAT)::FLOAT) AS s FROM embeddings)
SELECT vec_id, {s6(RMS.format('s'))} AS rms, {s6("list_sum(list_transform(range(1, 64), lambda i: (signbit(s[i]) != signbit(s[i + 1]))::INT)) / 63.0::DOUBLE")} AS zcr,
  {s6("len(list_filter(s, lambda v: abs(v) >= 0.999::FLOAT)) / 64.0::DOUBLE")} AS clip_fraction, {s6("64 / 1000.0::DOUBLE")} AS duration_s FROM x""")
def series_measures(spark, sf_dir):
    df = series(spark, sf_dir).withColumn("samples", F.transform("samples", lambda v: v * F.lit(4.0).cast("float")))
    return df.select(
        "vec_id", r6(S.rms("samples")).alias("rms"), r6(S.zcr("samples")).alias("zcr"),
        r6(S.clip_fraction("samples")).alias("clip_fraction"), r6(S.duration_s("samples", "sample_rate")).alias("duration_s"))


# --- framing ------------------------------------------------------------------------------
@query("tumbling_frames", f"""
WITH f AS (SELECT vec_id, (i // 10)::INTEGER AS frame_index, i AS start_ms, s[i + 1:i + 10] AS p FROM {HALF_QUIET}, range(0, 64, 10) t(i))
SELECT vec_id, frame_index, start_ms, {s6('len(p) * 1.0::DOUBLE')} AS duration_ms, {s6(RMS.format('p'))} AS energy_rms,
  CASE WHEN {RMS.format('p')} >= 0.01 THEN 'UNCERTAIN' ELSE 'SILENCE' END AS status FROM f""")
def tumbling_frames(spark, sf_dir):
    df = FR.tumbling_frames(half_quiet(series(spark, sf_dir)), 10.0)
    return rounded(df.drop("label", "sample_rate"), "duration_ms", "energy_rms")


HOPS = f"""(SELECT vec_id, (i // 10)::INTEGER AS frame_index, i / 1000.0::DOUBLE AS start_s, s[i + 1:i + 25] AS p FROM {{0}}, range(0, 64, 10) t(i))"""
FRAME_OK = "len(p) / 25.0::DOUBLE >= 0.8::DOUBLE AND len(list_filter(p, lambda v: isnan(v) OR isinf(v))) = 0"


@query("hopping_frames", f"""
SELECT vec_id, frame_index, {s6('start_s')} AS start_s, {FRAME_OK} AS valid,
  CASE WHEN {FRAME_OK} THEN {s6("list_sum(list_transform(p, lambda v: greatest(least(v::DOUBLE, 1.0), -1.0)))")} END AS frame_total,
  CASE WHEN {FRAME_OK} THEN 25 END::INTEGER AS frame_size
FROM {HOPS.format(POISONED)}""")
def hopping_frames(spark, sf_dir):
    df = FR.hopping_frames(poisoned(series(spark, sf_dir)))
    return df.select(
        "vec_id", "frame_index", r6("start_s").alias("start_s"), "valid",
        r6(S.array_total("frame")).alias("frame_total"), F.when(F.col("valid"), F.size("frame")).alias("frame_size"))


@query("fixed_windows", f"""
WITH v AS (SELECT vec_id, k, t, embedding AS s FROM embeddings, (VALUES (24, 16), (80, 40)) sizes(k, t)),
p AS (SELECT vec_id, k, t, len(s) AS n, list_concat(list_transform(range(0, greatest(k - len(s), 0)), lambda i: 0::FLOAT), s) AS s FROM v),
st AS (SELECT vec_id, k, s, CASE WHEN n <= k THEN [0] ELSE list_sort(list_distinct(list_concat(range(0, n - k + 1, t), [n - k]))) END AS starts FROM p),
w AS (SELECT vec_id, (j - 1)::INTEGER AS window_index, starts[j]::INTEGER AS start_sample, s[starts[j] + 1:starts[j] + k] AS w FROM st, range(1, len(starts) + 1) t(j))
SELECT vec_id, window_index, start_sample, len(w)::INTEGER AS window_size, {s6(RMS.format('w'))} AS rms, {s6('w[1]::DOUBLE')} AS first_sample FROM w""")
def fixed_windows(spark, sf_dir):
    """Windows shorter and longer than the series, so that both overlap and padding show."""
    df = series(spark, sf_dir)
    return FR.fixed_windows(df, 24, 16).unionByName(FR.fixed_windows(df, 80, 40)).select(
        "vec_id", "window_index", "start_sample", F.size("samples").alias("window_size"),
        r6(S.rms("samples")).alias("rms"), r6(F.get("samples", F.lit(0)).cast("double")).alias("first_sample"))


@query("replayed_frames", f"""
SELECT vec_id, (i + len(p))::BIGINT AS ts_ms, len(p)::INTEGER AS frame_size, {s6(RMS.format('p'))} AS rms
FROM (SELECT vec_id, i, embedding[i + 1:i + 20] AS p FROM embeddings, range(0, 64, 20) t(i))""")
def replayed_frames(spark, sf_dir):
    return FR.replay_frames(series(spark, sf_dir), 20).select(
        "vec_id", "ts_ms", F.size("samples").alias("frame_size"), r6(S.rms("samples")).alias("rms"))


# --- quality ----------------------------------------------------------------------------------
LEVELS = f"""(SELECT vec_id, s, list_transform(range(0, 64, 8), lambda i: {RMS.format('s[i + 1:i + 8]')}) AS lv FROM {HALF_QUIET})"""
RUN = "list_reduce(list_prepend([0, 0], list_transform({0}, lambda b: [b::INT, 0])), lambda a, b: [CASE WHEN b[1] = 1 THEN a[1] + 1 ELSE 0 END, greatest(a[2], CASE WHEN b[1] = 1 THEN a[1] + 1 ELSE 0 END)])[2]"
QUALITY = f"""
WITH l AS {LEVELS},
m AS (SELECT vec_id, {RMS.format('s')} AS rms,
   list_sum(list_transform(range(1, 64), lambda i: (signbit(s[i]) != signbit(s[i + 1]))::INT)) / 63.0::DOUBLE AS zero_crossing_rate,
   len(list_filter(s, lambda v: abs(v) >= 0.999::FLOAT)) / 64.0::DOUBLE AS clipping_fraction,
   len(list_filter(lv, lambda x: x >= 0.01)) AS active_frame_count, {RUN.format("list_transform(lv, lambda x: x >= 0.01)")} AS longest_active_run,
   list_filter(lv, lambda x: x >= 0.01) AS loud, list_filter(lv, lambda x: x < 0.01) AS quiet FROM l),
p AS (SELECT *, active_frame_count / 8.0::DOUBLE AS activity_ratio,
   CASE WHEN len(loud) > 0 AND len(quiet) > 0 AND list_median(quiet) > 1e-6 THEN list_median(list_transform(quiet, lambda x: x * x)) END AS noise,
   list_median(list_transform(loud, lambda x: x * x)) AS act FROM m),
q AS (SELECT *, 10 * log10(greatest(act - noise, 1e-12) / noise) AS snr FROM p)
SELECT vec_id, {s6('rms')} AS rms, {s6('zero_crossing_rate')} AS zero_crossing_rate, {s6('clipping_fraction')} AS clipping_fraction,
  active_frame_count::INTEGER AS active_frame_count, longest_active_run::INTEGER AS longest_active_run, {s6('activity_ratio')} AS activity_ratio,
  {s6('snr')} AS estimated_snr_db, {s6('coalesce(greatest(0.0, least(1.0, snr / 30)), 0.0)')} AS audio_quality,
  CASE WHEN clipping_fraction >= 0.05 OR activity_ratio < 0.2 OR longest_active_run < 3 THEN 'LOW_QUALITY' WHEN snr IS NULL THEN 'UNCERTAIN'
    WHEN snr < 5 THEN 'LOW_QUALITY' WHEN snr < 10 THEN 'UNCERTAIN' ELSE 'ACCEPTABLE' END AS quality_status FROM q"""
_QUALITY_COLUMNS = ("rms", "zero_crossing_rate", "clipping_fraction", "activity_ratio", "estimated_snr_db", "audio_quality")


def _quality_rows(df):
    return rounded(df, *_QUALITY_COLUMNS).select(
        "vec_id", *_QUALITY_COLUMNS, "active_frame_count", "longest_active_run", "quality_status")


EIGHT_MS = settings.FrameSettings(sample_rate=RATE, frame_ms=8.0, hop_ms=8.0, max_f0_hz=450.0)


@query("quality_features", QUALITY)
def quality_features(spark, sf_dir):
    return _quality_rows(SU.quality_features(spread(half_quiet(series(spark, sf_dir))), EIGHT_MS))


@query("quality_features_arrow", QUALITY)
def quality_features_arrow(spark, sf_dir):
    df = P.measure_quality(spread(half_quiet(series(spark, sf_dir))), EIGHT_MS)
    return _quality_rows(SU.summarise_quality(df))


# --- pitch and prosody ----------------------------------------------------------------------------
# Autocorrelation written as plain sums of products over lags 1..17 of a 25-sample frame.
HANN = "(0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * (i - 1) / 24.0::DOUBLE))"
PITCH = f"""
h AS {{hops}},
v AS (SELECT vec_id, frame_index, list_concat(list_transform(p, lambda y: greatest(least(y::DOUBLE, 1.0), -1.0)), list_transform(range(len(p), 25), lambda i: 0.0::DOUBLE)) AS x
  FROM h WHERE {FRAME_OK}),
w AS (SELECT vec_id, frame_index, x, {RMS.format('x')} AS rms, list_transform(x, lambda y, i: (y - list_avg(x)) * {HANN}) AS t FROM v),
c AS (SELECT vec_id, frame_index, x, rms, list_transform(range(0, 18), lambda k: list_sum(list_transform(range(1, 26 - k), lambda i: t[i] * t[i + k]))) AS ac FROM w),
n AS (SELECT vec_id, frame_index, x, rms, CASE WHEN ac[1] > 0 THEN list_transform(ac, lambda a: a / ac[1]) END AS ac FROM c),
k AS (SELECT *, list_position(ac[3:17], list_max(ac[3:17])) + 1 AS lag FROM n),
e AS (SELECT *, CASE WHEN ac IS NULL OR rms < 1e-5 THEN 0 ELSE greatest(least(ac[lag + 1], 1.0), 0.0) END AS per,
   ac[lag] - 2 * ac[lag + 1] + ac[lag + 2] AS bend FROM k),
g AS (SELECT *, CASE WHEN per >= 1e-12 THEN 1000.0::DOUBLE / (lag + CASE WHEN abs(bend) > 1e-12 THEN greatest(least(0.5 * (ac[lag] - ac[lag + 2]) / bend, 0.5), -0.5) ELSE 0 END) END AS hz FROM e),
m AS (SELECT h.vec_id, h.frame_index, (g.vec_id IS NOT NULL) AS valid, g.rms AS rms, g.per AS per,
   list_sum(list_transform(range(1, 25), lambda i: (signbit(x[i]) != signbit(x[i + 1]))::INT)) / 24.0::DOUBLE AS zcr,
   CASE WHEN per >= 0.35 THEN CASE WHEN hz >= 60 AND hz <= 450 THEN hz ELSE 0 END END AS f0
   FROM h LEFT JOIN g ON h.vec_id = g.vec_id AND h.frame_index = g.frame_index)"""


@query("frame_measures", f"""WITH {PITCH.format(hops=HOPS.format(POISONED))}
SELECT vec_id, frame_index, valid, {s6('rms')} AS frame_rms, {s6('zcr')} AS frame_zcr, {s6('f0', 4)} AS f0, {s6('per')} AS periodicity FROM m""")
def frame_measures(spark, sf_dir):
    df = P.measure_frames(spread(poisoned(series(spark, sf_dir))), CFG)
    zipped = F.posexplode(F.arrays_zip("valid", "frame_rms", "frame_zcr", "f0", "periodicity")).alias("frame_index", "_f")
    out = df.select("vec_id", zipped).select("vec_id", "frame_index", "_f.*")
    return rounded(rounded(out, "frame_rms", "frame_zcr", "periodicity"), "f0", digits=4)


@query("frame_pitch", f"""WITH {PITCH.format(hops=HOPS.format(POISONED))}
SELECT vec_id, frame_index, {s6('per')} AS periodicity, {s6('CASE WHEN hz >= 60 AND hz <= 450 THEN hz ELSE 0 END', 4)} AS f0,
  {s6('greatest(least(10 * log10(greatest(per, 1e-8) / greatest(1 - per, 1e-8)), 40.0), -20.0)', 4)} AS hnr_db FROM g""")
def frame_pitch(spark, sf_dir):
    frames = FR.hopping_frames(spread(poisoned(series(spark, sf_dir)))).filter("valid")
    found = frames.withColumn("_p", P.frame_pitch("frame", RATE, CFG))
    return found.select(
        "vec_id", "frame_index", r6("_p.periodicity").alias("periodicity"), r6("_p.f0", 4).alias("f0"),
        r6(S.hnr_db("_p.periodicity"), 4).alias("hnr_db"))


def _agg(fn, col, cond):
    return f"{fn}({col}) FILTER ({cond})"


PROSODY = f"""WITH {PITCH.format(hops=HOPS.format(POISONED))},
d AS (SELECT *, frame_index * 0.01::DOUBLE AS t, ln(greatest(rms, 1e-8)) AS lg,
   (f0 - lag(f0) OVER w) / 0.01::DOUBLE AS df0, (rms - lag(rms) OVER w) / 0.01::DOUBLE AS drms, coalesce(rms > 0.01, false) AS act,
   greatest(least(10 * log10(greatest(per, 1e-8) / greatest(1 - per, 1e-8)), 40.0), -20.0) AS hnr
   FROM m WINDOW w AS (PARTITION BY vec_id ORDER BY frame_index)),
isl AS (SELECT *, sum((NOT act)::INT) OVER (PARTITION BY vec_id ORDER BY frame_index) AS grp FROM d),
runs AS (SELECT vec_id, max(n) AS run FROM (SELECT vec_id, grp, count(*) FILTER (act) AS n FROM isl GROUP BY ALL) GROUP BY vec_id),
a AS (SELECT vec_id, median(f0) AS f0_median_hz, avg(f0) AS f0_mean_hz, stddev_pop(f0) AS f0_std_hz, max(f0) - min(f0) AS f0_range_hz,
   CASE WHEN count(f0) > 0 THEN coalesce(avg(df0), 0) END AS f0_delta_mean_hz_s, CASE WHEN count(f0) > 0 THEN coalesce(stddev_pop(df0), 0) END AS f0_delta_std_hz_s,
   CASE WHEN count(f0) > 1 THEN regr_slope(f0, t) WHEN count(f0) = 1 THEN 0 END AS f0_slope_hz_s,
   count(f0) / greatest(count(rms), 1)::DOUBLE AS f0_valid_fraction, coalesce(avg(per), 0) AS mean_periodicity,
   coalesce(avg(rms), 0) AS rms_mean, coalesce(stddev_pop(rms), 0) AS rms_std, coalesce(quantile_cont(rms, 0.1), 0) AS rms_q10, coalesce(quantile_cont(rms, 0.9), 0) AS rms_q90,
   coalesce(max(rms) - min(rms), 0) AS rms_range, coalesce(avg(lg) FILTER (rms IS NOT NULL), 0) AS log_rms_mean, coalesce(stddev_pop(lg) FILTER (rms IS NOT NULL), 0) AS log_rms_std,
   coalesce(avg(drms), 0) AS rms_delta_mean_s, coalesce(stddev_pop(drms), 0) AS rms_delta_std_s,
   CASE WHEN count(rms) > 1 THEN regr_slope(rms, t) ELSE 0 END AS rms_slope_s,
   coalesce(count(*) FILTER (act) / nullif(count(rms), 0)::DOUBLE, 0) AS active_fraction, coalesce(avg(zcr), 0) AS zcr_mean,
   CASE WHEN count(f0) > 0 THEN median(hnr) FILTER (per >= 0.35) END AS hnr_median_db, count(*) AS nf FROM d GROUP BY vec_id)
SELECT vec_id, {", ".join(s6(n, 4) + " AS " + n for n in settings.FULL_FEATURES if n not in ("pause_fraction", "longest_active_run_fraction"))},
  {s6('1 - active_fraction', 4)} AS pause_fraction, {s6('run / nf::DOUBLE', 4)} AS longest_active_run_fraction, true AS contract_ok, 24 AS full_size, 8 AS simple_size
FROM a JOIN runs USING (vec_id)"""


@query("prosody_features", PROSODY)
def prosody_features(spark, sf_dir):
    df = SU.prosody_features(P.measure_frames(spread(poisoned(series(spark, sf_dir))), CFG), CFG)
    df = FR.assemble_features(FR.check_feature_contract(df))
    return rounded(
        df.select("vec_id", *settings.FULL_FEATURES, "contract_ok", F.size("full_vector").alias("full_size"),
                  F.size("simple_vector").alias("simple_size")), *settings.FULL_FEATURES, digits=4)


# --- frame summaries on arrays with gaps (no UDF involved) ---------------------------------------------
def _gappy(spark, sf_dir):
    """Absolute samples as frame values; faint ones count as not measured."""
    value = F.transform("samples", lambda x: F.when(F.abs(x) >= F.lit(0.03).cast("float"), F.abs(x).cast("double")))
    return spread(series(spark, sf_dir)).withColumn("v", value).withColumn("step_s", F.lit(0.01))


GAPPY = """g AS (SELECT vec_id, i - 1 AS i, CASE WHEN abs(embedding[i]) >= 0.03::FLOAT THEN abs(embedding[i])::DOUBLE END AS v, (i - 1) * 0.01::DOUBLE AS t FROM embeddings, range(1, 65) r(i)),
d AS (SELECT *, (v - lag(v) OVER (PARTITION BY vec_id ORDER BY i)) / 0.01::DOUBLE AS dv FROM g)"""


@query("pitch_summary", f"""WITH {GAPPY}
SELECT vec_id, {s6('median(v)')} AS f0_median_hz, {s6('avg(v)')} AS f0_mean_hz, {s6('stddev_pop(v)')} AS f0_std_hz, {s6('max(v) - min(v)')} AS f0_range_hz,
 {s6('avg(dv)')} AS delta_mean, {s6('stddev_pop(dv)')} AS delta_std, {s6('regr_slope(v, t)')} AS slope FROM d GROUP BY vec_id""")
def pitch_summary(spark, sf_dir):
    df = SU.valid_deltas(SU.pitch_summary(_gappy(spark, sf_dir), "v"), "v", "delta").withColumn("slope", S.slope_over_time("v", "step_s"))
    names = ("f0_median_hz", "f0_mean_hz", "f0_std_hz", "f0_range_hz", "delta_mean", "delta_std", "slope")
    return rounded(df, *names).select("vec_id", *names)


@query("energy_summary", f"""WITH {GAPPY}
SELECT vec_id, {s6('avg(v)')} AS rms_mean, {s6('stddev_pop(v)')} AS rms_std, {s6('quantile_cont(v, 0.1)')} AS rms_q10, {s6('quantile_cont(v, 0.9)')} AS rms_q90, {s6('max(v) - min(v)')} AS rms_range,
 {s6('avg(ln(greatest(v, 1e-8))) FILTER (v IS NOT NULL)')} AS log_rms_mean, {s6('stddev_pop(ln(greatest(v, 1e-8))) FILTER (v IS NOT NULL)')} AS log_rms_std, {s6('avg(dv)')} AS rms_delta_mean_s,
 {s6('stddev_pop(dv)')} AS rms_delta_std_s, {s6('regr_slope(v, t)')} AS rms_slope_s FROM d GROUP BY vec_id""")
def energy_summary(spark, sf_dir):
    names = ("rms_mean", "rms_std", "rms_q10", "rms_q90", "rms_range", "log_rms_mean", "log_rms_std",
             "rms_delta_mean_s", "rms_delta_std_s", "rms_slope_s")
    return rounded(SU.energy_summary(_gappy(spark, sf_dir), "v"), *names).select("vec_id", *names)


@query("validity_summary", f"""WITH {GAPPY},
a AS (SELECT *, coalesce(v > 0.1, false) AS act FROM g),
isl AS (SELECT *, sum((NOT act)::INT) OVER (PARTITION BY vec_id ORDER BY i) AS grp FROM a),
runs AS (SELECT vec_id, max(n) AS run FROM (SELECT vec_id, grp, count(*) FILTER (act) AS n FROM isl GROUP BY ALL) GROUP BY vec_id)
SELECT vec_id, {s6('count(v) / 64.0::DOUBLE')} AS valid_frame_fraction, {s6('count(*) FILTER (act) / count(v)::DOUBLE')} AS active_fraction,
 {s6('1 - count(*) FILTER (act) / count(v)::DOUBLE')} AS pause_fraction, {s6('any_value(run) / 64.0::DOUBLE')} AS longest_active_run_fraction,
 {s6('1.0::DOUBLE')} AS f0_valid_fraction, {s6('avg(v)')} AS mean_periodicity, {s6('avg(v)')} AS zcr_mean,
 {s6('median(greatest(least(10 * log10(greatest(v, 1e-8) / greatest(1 - v, 1e-8)), 40.0), -20.0)) FILTER (v >= 0.05)')} AS hnr_median_db
FROM a JOIN runs USING (vec_id) GROUP BY vec_id""")
def validity_summary(spark, sf_dir):
    df = _gappy(spark, sf_dir).withColumn("valid", F.transform("v", lambda x: x.isNotNull()))
    df = SU.validity_summary(df, levels="v", crossings="v", f0="v", periodicity="v", threshold=0.1, min_periodicity=0.05)
    names = ("valid_frame_fraction", "active_fraction", "pause_fraction", "longest_active_run_fraction", "f0_valid_fraction",
             "mean_periodicity", "zcr_mean", "hnr_median_db")
    return rounded(df, *names).select("vec_id", *names)


def audio_length(df: DataFrame, samples: int = 24000) -> DataFrame:
    """Stretch each stored series to 1.5 s at 16 kHz: tiled, with a quiet third."""
    tiled = lambda c, n: F.flatten(F.array_repeat(c, n))
    quiet = F.transform("samples", lambda x: x * F.lit(0.02).cast("float"))
    block = F.concat(tiled(quiet, 47), tiled(F.col("samples"), 94))
    return df.withColumn("samples", F.slice(tiled(block, samples // (141 * 64) + 1), 1, samples)).withColumn("sample_rate", F.lit(16000))


@query("audio_length_features")
def audio_length_features(spark, sf_dir):
    """Quality gate, then the 24 features, on audio-length series derived from the table."""
    cfg = settings.FrameSettings()
    gated = SU.summarise_quality(P.measure_quality(audio_length(spread(series(spark, sf_dir))), cfg)).filter(
        F.col("quality_status") == "ACCEPTABLE")
    df = SU.prosody_features(P.measure_frames(gated, cfg), cfg)
    return rounded(df.select("vec_id", "estimated_snr_db", *settings.FULL_FEATURES), "estimated_snr_db", *settings.FULL_FEATURES, digits=4)
