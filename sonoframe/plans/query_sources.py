"""Queries over the sources and sinks: rows of the tables are written to files in the shared folder and scanned back."""

from pyspark.sql import functions as F

from sonoframe import settings
from sonoframe.plans.query_series import RATE, series
from sonoframe.plans.registry import load, query, r6, s6
from sonoframe.sources import audio as AU
from sonoframe.sources import readers as R
from sonoframe.sources import writers as W
from sonoframe.streaming.replay import as_stream, shared_folder

STEPS = "pow(2, 8 * (vec_id % 4 + 1) - 1)"


def _stored_audio(spark, sf_dir, folder):
    """Every series as a PCM file; one to four bytes a sample."""
    AU.write_audio(series(spark, sf_dir).select(
        F.col("vec_id").cast("string").alias("name"), "sample_rate", "samples", (F.pmod("vec_id", F.lit(4)) + 1).cast("int").alias("width")), folder)
    return R.scan_audio(spark, folder)


def _file_id(path="path"):
    return F.regexp_extract(path, r"([^/]+)\.wav$", 1).cast("long")


@query("audio_files", f"""WITH q AS (SELECT vec_id, embedding AS e, list_transform(embedding, lambda x: greatest(least(floor(x::DOUBLE * {STEPS}), {STEPS} - 1), -{STEPS})::FLOAT::DOUBLE / {STEPS}) AS z FROM embeddings)
SELECT vec_id, {RATE} AS sample_rate, len(z)::INTEGER AS n_samples, {s6('list_sum(list_transform(z, lambda x, i: x * i))')} AS total, NULL::VARCHAR AS error FROM q""")
def audio_files(spark, sf_dir):
    """Every series written as PCM of one to four bytes a sample and decoded again."""
    back = _stored_audio(spark, sf_dir, shared_folder(spark, "audio"))
    total = F.aggregate(F.transform("samples", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return back.select(_file_id().alias("vec_id"), "sample_rate", F.size("samples").alias("n_samples"), r6(total).alias("total"), "error")


# --- labelled manifests -------------------------------------------------------------------
LISTED = """l AS (SELECT p_partkey AS id, CASE WHEN p_size % 17 = 0 THEN '' ELSE p_type || '/' || p_partkey || '.wav' END AS path,
  ['HAP', ' neu ', 'sad', 'W', p_type, ''][p_size % 6 + 1] AS emotion, CASE WHEN p_brand = 'Brand#7' THEN ' ' ELSE p_brand END AS speaker,
  p_name || ', "' || p_partkey || '"' AS recording, ['train', ' Validation', 'TEST', 'dev'][p_size % 4 + 1] AS split FROM part)"""


def _listed(spark, sf_dir):
    pick = lambda column, values: F.element_at(F.array(*values), (F.pmod("p_size", F.lit(len(values))) + 1).cast("int")).alias(column)
    return load(spark, sf_dir, "part").select(
        F.when(F.col("p_size") % 17 == 0, "").otherwise(F.concat("p_type", F.lit("/"), "p_partkey", F.lit(".wav"))).alias("path"),
        pick("emotion", [F.lit("HAP"), F.lit(" neu "), F.lit("sad"), F.lit("W"), F.col("p_type"), F.lit("")]),
        F.when(F.col("p_brand") == "Brand#7", " ").otherwise(F.col("p_brand")).alias("speaker_id"),
        F.concat("p_name", F.lit(', "'), "p_partkey", F.lit('"')).alias("recording_id"), F.lit("parts").alias("dataset_id"),
        F.lit("").alias("source_recording_id"), F.lit("").alias("augmentation_group_id"), pick("split", [F.lit(x) for x in ("train", " Validation", "TEST", "dev")]))


@query("scanned_manifest", f"""WITH {LISTED}, m AS (SELECT *, CASE lower(trim(emotion)) WHEN 'hap' THEN 'happy' WHEN 'neu' THEN 'neutral' WHEN 'sad' THEN 'sad' WHEN 'w' THEN 'angry' END AS label, lower(trim(split)) AS part FROM l)
SELECT recording AS recording_id, recording AS source_recording_id, nullif(trim(speaker), '') AS speaker_id, label, part AS split,
 CASE WHEN part NOT IN ('train', 'validation', 'test') THEN 'bad_split' WHEN path = '' THEN 'empty_path' WHEN trim(speaker) = '' THEN 'missing_speaker_or_recording'
  WHEN trim(emotion) = '' THEN 'empty_label' WHEN label IS NULL THEN 'unmapped_label' END AS violation FROM m""")
def scanned_manifest(spark, sf_dir):
    """Parts as a labelled manifest: written as CSV with quotes and commas, scanned with its rules."""
    folder = shared_folder(spark, "manifest")
    W.write_manifest(_listed(spark, sf_dir), folder)
    return R.scan_manifest(spark, folder).select("recording_id", "source_recording_id", F.nullif("speaker_id", F.lit("")).alias("speaker_id"), "label", "split", "violation")


# --- noise manifests ----------------------------------------------------------------------
KINDS = (*settings.NOISE_TYPES, "rain")
KIND_SQL = f"{list(KINDS)}[coalesce(label, 0) % 5 + 1]"


@query("scanned_noise", f"""WITH l AS (SELECT vec_id, label, {KIND_SQL} AS noise_type, embedding AS e FROM embeddings),
 b AS (SELECT *, CASE WHEN noise_type = 'rain' THEN 'unsupported_noise_type' END AS violation FROM l)
SELECT vec_id, noise_type, violation, (row_number() OVER (PARTITION BY noise_type, violation IS NULL ORDER BY vec_id) - 1)::INTEGER AS source_idx, len(e)::INTEGER AS n_samples FROM b""")
def scanned_noise(spark, sf_dir):
    """Every series as a noise source: files, a CSV list in order of their ids, and the scan that numbers the good ones."""
    folder = shared_folder(spark, "noise")
    sounds = _stored_audio(spark, sf_dir, folder + "/audio")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.pmod(F.coalesce("label", F.lit(0)), F.lit(len(KINDS))) + 1).cast("int"))
    listed = series(spark, sf_dir).orderBy("vec_id").select(F.concat(F.lit(" "), F.initcap(kind)).alias("noise_type"), F.concat(F.col("vec_id").cast("string"), F.lit(".wav")).alias("path"))
    listed.coalesce(1).write.option("header", True).csv(folder + "/list")
    base = folder + "/audio" if ":" in folder else f"file:{folder}/audio"
    found = R.scan_noise_manifest(spark, folder + "/list", sounds, base)
    return found.select(_file_id().alias("vec_id"), "noise_type", "violation", "source_idx", F.size("source_samples").alias("n_samples"))


# --- corpus metadata ----------------------------------------------------------------------
CORPUS_NAMES = tuple(settings.CORPUS_LABEL_CODES)


@query("scanned_corpus", f"""WITH l AS (SELECT c_custkey AS id, c_nationkey, {list(CORPUS_NAMES)}[c_nationkey % 7 + 1] AS emotion, {list(settings.CORPUS_LABEL_CODES.values())}[c_custkey % 7 + 1] AS code, c_mktsegment AS seg FROM customer),
 f AS (SELECT *, CASE WHEN c_nationkey = 3 THEN '../' ELSE 'wav/' END || id || '/' || lpad((c_nationkey + 1)::VARCHAR, 2, '0') || 'a01' || code || 'b.wav' AS file FROM l),
 g AS (SELECT *, CASE WHEN c_nationkey = 5 THEN c_nationkey + 2 ELSE c_nationkey + 1 END AS speaker FROM f)
SELECT file, emotion, CASE WHEN seg = 'BUILDING' THEN 'test' ELSE 'train' END AS source_split,
 CASE WHEN c_nationkey = 3 THEN 'unsafe_path' WHEN speaker <> c_nationkey + 1 THEN 'speaker_mismatch'
  WHEN code <> {list(settings.CORPUS_LABEL_CODES.values())}[c_nationkey % 7 + 1] THEN 'code_conflict' END AS violation FROM g""")
def scanned_corpus(spark, sf_dir):
    """Customers as a corpus: a file table and two label tables as CSV, scanned with the name, speaker and code rules."""
    nation = F.col("c_nationkey")
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(by, F.lit(7)) + 1).cast("int"))
    name = F.concat(F.lpad((nation + 1).cast("string"), 2, "0"), F.lit("a01"), pick(settings.CORPUS_LABEL_CODES.values(), F.col("c_custkey")), F.lit("b.wav"))
    rows = load(spark, sf_dir, "customer").select(
        F.concat(F.when(nation == 3, "../").otherwise("wav/"), F.col("c_custkey").cast("string"), F.lit("/"), name).alias("file"),
        pick(CORPUS_NAMES, nation).alias("emotion"), F.when(nation == 5, nation + 2).otherwise(nation + 1).alias("speaker"), (F.col("c_mktsegment") == "BUILDING").alias("test"))
    folder = shared_folder(spark, "corpus")
    rows.select("file", "speaker").write.option("header", True).csv(folder + "/files")
    for part, chosen in (("train", ~F.col("test")), ("test", F.col("test"))):
        rows.filter(chosen).select("file", "emotion").write.option("header", True).csv(f"{folder}/{part}")
    found = R.scan_gold_tables(spark, folder + "/files", folder + "/train", folder + "/test")
    return found.select("file", "emotion", "source_split", "violation")


# --- sinks --------------------------------------------------------------------------------
@query("stored_windows", f"SELECT vec_id, ['train', 'validation', 'test'][vec_id % 3 + 1] AS split, len(embedding)::INTEGER AS n_samples, {s6('list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * i))')} AS total FROM embeddings")
def stored_windows(spark, sf_dir):
    """Windows written as Parquet, a folder per subset, and read back with the subset from the folder."""
    folder = shared_folder(spark, "windows")
    split = F.element_at(F.array(*[F.lit(s) for s in settings.SPLITS]), (F.pmod("vec_id", F.lit(3)) + 1).cast("int"))
    W.write_windows(series(spark, sf_dir).withColumn("split", split), folder)
    total = F.aggregate(F.transform("samples", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return spark.read.parquet(folder).select("vec_id", "split", F.size("samples").alias("n_samples"), r6(total).alias("total"))


@query("stored_report", f"""SELECT event_type, count(*) AS events, {s6('avg(value)', 3)} AS mean_value, min(value) AS least, max(value) AS most, count(DISTINCT user_id) AS users,
 'event_type,events,least,mean_value,most,users' AS columns FROM events GROUP BY event_type""")
def stored_report(spark, sf_dir):
    """A report over the events: identifiers taken out, written as JSON, read back."""
    report = load(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("events"), r6(F.avg("value"), 3).alias("mean_value"), F.min("value").alias("least"), F.max("value").alias("most"),
        F.countDistinct("user_id").alias("users"), F.max("user_id").cast("string").alias("speaker_id"),
        F.struct(F.min("user_id").alias("speaker_name")).alias("test_speaker_ids"))
    folder = shared_folder(spark, "report")
    W.write_report(report, folder)
    back = spark.read.json(folder)
    return back.withColumn("columns", F.lit(",".join(sorted(back.columns))))


@query("stored_results", "SELECT event_id, user_id, event_type, round(value, 6) AS value, epoch_us(ts) // 1000 AS ts_ms FROM events WHERE ts IS NOT NULL")
def stored_results(spark, sf_dir):
    """Events as a stream of live results: a JSON object each, in files, read back."""
    rows = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("ts").cast("timestamp").alias("ts"))
    folder = shared_folder(spark, "results")
    W.write_results(as_stream(rows, folder + "/in").drop("ts"), folder + "/out", folder + "/state").awaitTermination()
    return spark.read.schema("event_id long, user_id long, event_type string, value double, ts_ms long").json(folder + "/out").withColumn("value", r6("value"))
