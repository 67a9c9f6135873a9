"""Scans: audio files, labelled and noise manifests, corpus tables, model documents."""

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonoframe import settings
from sonoframe.functions import checks as C
from sonoframe.operators import manifest as M
from sonoframe.operators.model import MODEL_SCHEMA
from sonoframe.operators.ordering import sized_join
from sonoframe.sources.audio import AudioFiles


def scan_audio(spark: SparkSession, path: str, pattern: str = "*.wav") -> DataFrame:
    """``path, sample_rate, samples, file_sha256, error`` of every PCM file below a folder.

    A file that cannot be decoded, or has no bytes, keeps its row with ``error`` set; it never fails the job.
    """
    spark.dataSource.register(AudioFiles)
    return spark.read.format("audio_files").option("pattern", pattern).load(path)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """File listing ``path, length, modificationTime``; contents are not read."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
        .select("path", "length", "modificationTime")
    )


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV with every column as STRING (quotes and line breaks as in RFC 4180)."""
    return (
        spark.read.option("header", True).option("inferSchema", False).option("multiLine", True)
        .option("quote", '"').option("escape", '"').csv(path)
    )


def _require(df: DataFrame, columns, what: str) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing required columns: {', '.join(missing)}")
    return df


def full_path(path, base: str):
    """Absolute file URI of a manifest path, relative ones below ``base``."""
    p = F.trim(F.col(path) if isinstance(path, str) else path)
    root = F.lit(base.rstrip("/") + "/")
    return F.when(p.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), p).when(p.startswith("/"), F.concat(F.lit("file:"), p)).otherwise(
        F.concat(root, p))


def scan_manifest(
    spark: SparkSession, path: str, *, label_map: Mapping[str, str] | None = None, files: DataFrame | None = None,
    base: str | None = None,
) -> DataFrame:
    """Labelled manifest with defaults, mapped labels and one ``violation`` per bad row.

    ``files`` (from ``scan_audio``: ``path, file_sha256``) adds the existence and the
    conflicting-content rules.  Nothing is dropped; filter on ``violation``.
    """
    raw = _require(read_strings(spark, path), settings.MANIFEST_REQUIRED, "the manifest")
    table = M.map_labels(M.fill_defaults(raw), "emotion", M.label_mapping(label_map))
    table = table.withColumn("speaker_id", F.trim("speaker_id"))
    if "split" in raw.columns:
        table = table.withColumn("split", F.lower(F.trim("split")))
    if files is not None:
        table = table.withColumn("_uri", full_path("path", base or ""))
        listing = files.select(F.col("path").alias("_uri"), "file_sha256", F.lit(True).alias("file_exists"))
        table = table.join(listing, "_uri", "left").withColumn("file_exists", F.coalesce("file_exists", F.lit(False)))
        # only rows that pass every earlier rule can be in conflict
        sound = M.validate_rows(table).filter(F.col("violation").isNull())
        clash = M.content_conflicts(sound).select("file_sha256", F.lit(True).alias("content_conflict"))
        table = sized_join(table, clash, "file_sha256", "left").withColumn(
            "content_conflict", F.coalesce("content_conflict", F.lit(False))).drop("_uri")
    return M.validate_rows(table)


def scan_noise_manifest(spark: SparkSession, path: str, audio: DataFrame, base: str) -> DataFrame:
    """Noise sources ``noise_type, source_idx, sample_rate, source_samples, source_sha256, violation``."""
    raw = _require(read_strings(spark, path), ("noise_type", "path"), "the noise manifest")
    kind = F.lower(F.trim("noise_type"))
    listed = raw.select(
        kind.alias("noise_type"), F.trim("path").alias("listed_path"), full_path("path", base).alias("path"),
        F.monotonically_increasing_id().alias("_row"))
    joined = listed.join(audio.select("path", "sample_rate", F.col("samples").alias("source_samples"),
                                      F.col("file_sha256").alias("source_sha256")), "path", "left")
    bad = (
        F.when(~F.coalesce(F.col("noise_type").isin(*settings.NOISE_TYPES), F.lit(False)), "unsupported_noise_type")
        .when(F.coalesce(F.col("listed_path"), F.lit("")) == "", "empty_path")
        .when(F.col("source_sha256").isNull(), "missing_file"))
    # at most a few sources per type: a source list is a hand-made table; good rows are numbered apart, without gaps
    judged = joined.withColumn("violation", bad)
    place = F.row_number().over(Window.partitionBy("noise_type", F.col("violation").isNull()).orderBy("_row")) - 1
    return judged.withColumn("source_idx", place.cast("int")).drop("_row", "listed_path")


def noise_source_counts(sources: DataFrame) -> DataFrame:
    return sources.groupBy("noise_type").agg(
        F.count("*").alias("sources"), F.array_sort(F.collect_list(F.struct("source_idx", "source_sha256"))).alias("hashes"))


def scan_gold_tables(spark: SparkSession, files: str, train: str, test: str) -> DataFrame:
    """Corpus metadata: both gold tables with their split, speaker, parsed name and codes."""
    gold = read_strings(spark, train).withColumn("source_split", F.lit("train")).unionByName(
        read_strings(spark, test).withColumn("source_split", F.lit("test")), allowMissingColumns=True)
    speakers = read_strings(spark, files).select("file", "speaker")
    named = gold.select(
        F.trim("file").alias("file"), F.lower(F.trim("emotion")).alias("emotion"), "source_split",
        C.safe_path("file").alias("safe"), C.parse_name(F.regexp_extract(F.trim("file"), r"([^/]+)$", 1)).alias("name"))
    joined = sized_join(named, speakers, "file", "left")
    code = F.try_element_at(C.mapping_column(settings.CORPUS_LABEL_CODES), F.col("emotion"))
    rule = (
        F.when(~F.col("safe"), "unsafe_path").when(code.isNull(), "unknown_label").when(F.col("name").isNull(), "bad_name")
        .when(F.coalesce(F.lpad(F.col("speaker").cast("int").cast("string"), 2, "0"), F.lit("")) != F.col("name.speaker"), "speaker_mismatch")
        .when(F.col("name.code") != code, "code_conflict"))
    return joined.withColumn("violation", rule)


def scan_models(spark: SparkSession, path: str) -> DataFrame:
    """Model documents (one JSON object per file) with an explicit schema."""
    return spark.read.schema(MODEL_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn(
        "file", F.input_file_name())
