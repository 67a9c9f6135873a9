"""Validating and reconciling labelled tables."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoframe import settings
from sonoframe.functions import checks as C
from sonoframe.operators.ordering import sized_join


def label_mapping(overrides: Mapping[str, str] | None = None, targets: Sequence[str] = settings.EMOTIONS) -> dict[str, str]:
    """Default aliases with the user's entries on top; an unknown target is an error."""
    merged = dict(settings.LABEL_ALIASES)
    for source, target in (overrides or {}).items():
        wanted = str(target).strip().casefold()
        if wanted not in targets:
            raise ValueError(f"label map target {target!r} is not a supported label")
        merged[str(source).strip().casefold()] = wanted
    return merged


def map_labels(
    df: DataFrame, column: str, mapping: DataFrame | Mapping[str, str] | None = None, name: str = "label"
) -> DataFrame:
    """Add the normalised label: trimmed, case-folded and looked up (NULL if unknown).

    A small Python mapping becomes a map literal inside the projection; a mapping
    table ``(alias, target)`` of any size is joined behind a size check.
    """
    key = F.lower(F.trim(F.col(column)))
    if isinstance(mapping, DataFrame):
        return sized_join(
            df.withColumn("alias", key), mapping.select("alias", F.col("target").alias(name)), "alias", "left"
        ).drop("alias")
    lookup = C.mapping_column(label_mapping() if mapping is None else mapping)
    return df.withColumn(name, F.try_element_at(lookup, key))


def split_unmapped(df: DataFrame, raw: str, label: str = "label", *, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(mapped rows, count of every unmapped spelling after trimming).

    ``strict`` makes an unmapped row fail the job instead.
    """
    spelled = F.trim(F.col(raw))
    if strict:
        failing = F.when(F.col(label).isNull(), F.raise_error(F.concat(F.lit("unmapped label: "), spelled))).otherwise(F.col(label))
        df = df.withColumn(label, failing.cast("string"))
    mapped = df.filter(F.col(label).isNotNull())
    skipped = df.filter(F.col(label).isNull()).groupBy(spelled.alias("raw_label")).agg(F.count("*").alias("rows"))
    return mapped, skipped


def fill_defaults(df: DataFrame, dataset: str = "custom") -> DataFrame:
    """Trim the manifest columns, default the dataset and the source recording."""
    optional = lambda c: C.blank_to_null(c) if c in df.columns else F.lit(None).cast("string")
    return (
        df.withColumn("dataset_id", F.coalesce(optional("dataset_id"), F.lit(dataset)))
        .withColumn("recording_id", F.trim("recording_id"))
        .withColumn("source_recording_id", F.coalesce(optional("source_recording_id"), C.blank_to_null("recording_id")))
        .withColumn("augmentation_group_id", F.coalesce(optional("augmentation_group_id"), F.lit("")))
    )


def validate_rows(df: DataFrame, *, has_split: bool | None = None) -> DataFrame:
    """Add ``violation``: the first rule a manifest row breaks, NULL for a good row.

    Expects ``label`` (see ``map_labels``) and, when the later rules should apply,
    ``file_exists`` and ``content_conflict``.  An unmapped label stops the later
    checks, because such a row is skipped rather than rejected.
    """
    has_split = "split" in df.columns if has_split is None else has_split
    blank = lambda c: C.blank_to_null(c).isNull()
    rule = F.when(F.lit(False), F.lit(""))
    if has_split:
        known = F.coalesce(F.lower(F.trim("split")).isin(*settings.SPLITS), F.lit(False))
        rule = rule.when(~known, "bad_split")
    rule = (
        rule.when(blank("path"), "empty_path")
        .when(blank("speaker_id") | blank("recording_id"), "missing_speaker_or_recording")
        .when(blank("emotion"), "empty_label")
        .when(F.col("label").isNull(), "unmapped_label")
    )
    if "file_exists" in df.columns:
        rule = rule.when(~F.col("file_exists"), "missing_file")
    if "content_conflict" in df.columns:
        rule = rule.when(F.col("content_conflict"), "conflicting_content")
    return df.withColumn("violation", rule)


def missing_files(manifest: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """Manifest rows whose file is not in the listing."""
    return manifest.join(files.select(path).distinct(), path, "left_anti")


def with_digest(df: DataFrame, content: str, name: str = "file_sha256") -> DataFrame:
    return df.withColumn(name, C.content_digest(content))


def content_conflicts(df: DataFrame, digest: str = "file_sha256", label: str = "label") -> DataFrame:
    """Digests that occur under more than one label (empty content is ignored).

    Rows collapse to (digest, label) before the second grouping, so a digest
    shared by a third of all rows costs one row per label.
    """
    return (
        df.filter((F.col(digest) != "") & F.col(label).isNotNull())
        .groupBy(digest, label).agg(F.count("*").alias("_n"))
        .groupBy(digest)
        .agg(F.array_sort(F.collect_list(label)).alias("labels"), F.sum("_n").alias("rows"))
        .filter(F.size("labels") > 1)
    )


def check_lookup(df: DataFrame, dim: DataFrame, key: str, value: str, expected: Column) -> DataFrame:
    """Rows whose looked-up value is absent or differs, with the reason."""
    found = sized_join(df.withColumn("_expected", expected), dim.select(key, F.col(value).alias("_found")), key, "left")
    return (
        found.withColumn("reason", F.when(F.col("_found").isNull(), "absent").when(
            F.col("_found") != F.col("_expected"), "mismatch"))
        .filter(F.col("reason").isNotNull()).drop("_found", "_expected")
    )


def check_code_label(df: DataFrame, code: str, label: str, codes: Mapping[str, str] = settings.CORPUS_LABEL_CODES) -> DataFrame:
    """Rows whose code does not belong to their label, or whose label is unknown."""
    expected = F.try_element_at(C.mapping_column(codes), F.lower(F.trim(F.col(label))))
    return (
        df.withColumn("expected_code", expected)
        .withColumn("reason", F.when(F.col("expected_code").isNull(), "unknown_label").when(
            F.col("expected_code") != F.col(code), "code_conflict"))
        .filter(F.col("reason").isNotNull())
    )


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys present on one side only; both sides are made distinct first."""
    a = left.select(key).distinct().withColumn("_in_left", F.lit(True))
    b = right.select(key).distinct().withColumn("_in_right", F.lit(True))
    return (
        a.join(b, key, "full_outer")
        .filter(F.col("_in_left").isNull() | F.col("_in_right").isNull())
        .select(key, F.when(F.col("_in_left"), "left_only").otherwise("right_only").alias("side"))
    )


def duplicates(df: DataFrame, keys: Sequence[str] | str) -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)


def leakage(df: DataFrame, entity: Sequence[str] | str, split: str = "split") -> DataFrame:
    """Entities that occur in more than one split."""
    entity = [entity] if isinstance(entity, str) else list(entity)
    return (
        df.groupBy(*entity, split).agg(F.count("*").alias("_n"))
        .groupBy(*entity).agg(F.count("*").alias("splits"), F.array_sort(F.collect_list(split)).alias("split_names"))
        .filter(F.col("splits") > 1)
    )


def check_provenance(runs: DataFrame, models: DataFrame, key: str) -> DataFrame:
    """Status of each evaluation request against the model it names; first mismatch wins."""
    m = models.select(key, *[F.col(c).alias(f"_m_{c}") for c in (
        "label_mapping_sha256", "manifest_sha256", "seed", "split_sha256")])
    joined = sized_join(runs, m, key, "left")
    same = lambda c: F.col(c).eqNullSafe(F.col(f"_m_{c}"))
    status = (
        F.when(F.col("_m_manifest_sha256").isNull(), "MODEL_NOT_READY")
        .when(~same("label_mapping_sha256"), "LABEL_MAPPING_MISMATCH")
        .when(~same("manifest_sha256"), "MANIFEST_MISMATCH")
        .when(F.col("seed").isNotNull() & (F.col("seed") != F.col("_m_seed")), "SPLIT_MISMATCH")
        .when(~same("split_sha256"), "SPLIT_MISMATCH")
        .otherwise("READY")
    )
    return joined.withColumn("provenance_status", status).drop(*[c for c in joined.columns if c.startswith("_m_")])


def dataset_card(
    gold: DataFrame, windows: DataFrame, *, label: str = "label", split: str = "split", speaker: str = "speaker_id",
    mapped: str = "mapped",
) -> DataFrame:
    """Counts that describe a prepared corpus, in long form ``(section, split, item, value)``."""
    count = F.count("*").alias("value")
    nothing = F.lit("")
    return (
        gold.groupBy(split, label).agg(count).select(F.lit("gold_class").alias("section"), F.col(split).alias("split"), F.col(label).alias("item"), "value")
        .unionByName(gold.groupBy(split).agg(count).select(F.lit("gold_rows").alias("section"), F.col(split).alias("split"), nothing.alias("item"), "value"))
        .unionByName(gold.filter(F.col(mapped).isNull()).groupBy(label).agg(count).select(
            F.lit("ignored_class").alias("section"), nothing.alias("split"), F.col(label).alias("item"), "value"))
        .unionByName(windows.groupBy(split, mapped).agg(count).select(
            F.lit("window_class").alias("section"), F.col(split).alias("split"), F.col(mapped).alias("item"), "value"))
        .unionByName(windows.groupBy(split).agg(F.countDistinct(speaker).alias("value")).select(
            F.lit("speakers").alias("section"), F.col(split).alias("split"), nothing.alias("item"), "value"))
    )
