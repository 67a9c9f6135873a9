"""Auditing text tables: findings carry locations and kinds, never matched values."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoframe import settings
from sonoframe.operators.ordering import sized_join
from sonoframe.session import checkpoint

FINDING = ("scope", "kind", "path", "line", "commit")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_lines(text) -> Column:
    """Lines of a text without a trailing empty one, split at every Unicode line end."""
    parts = F.split(_col(text), settings.LINE_BREAK, -1)
    last_empty = F.element_at(parts, -1) == ""
    return F.when(last_empty, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def matches(line, kind: str) -> Column:
    """Whether a line holds the pattern; word and space classes follow Unicode."""
    return _col(line).rlike("(?iU)" + settings.AUDIT_PATTERNS[kind])


def line_kinds(line) -> Column:
    found = F.array(*[F.when(matches(line, kind), F.lit(kind)) for kind in settings.AUDIT_PATTERNS])
    return F.filter(found, lambda k: k.isNotNull())


def _finding(df: DataFrame, kind: Column, line: Column, scope: str, path: str, commit: str | None) -> DataFrame:
    return df.select(
        F.lit(scope).alias("scope"), kind.alias("kind"), F.col(path).cast("string").alias("path"),
        line.cast("int").alias("line"),
        (F.lit(None) if commit is None else F.col(commit)).cast("string").alias("commit"))


def scan_text(df: DataFrame, path: str, text: str, *, scope: str = "current", commit: str | None = None) -> DataFrame:
    """One finding per (line, pattern kind).  A pure map: no shuffle at any size."""
    keep = [path] + ([commit] if commit else [])
    lines = df.select(*keep, F.posexplode(text_lines(text)).alias("_pos", "_line"))
    hits = lines.select(*keep, "_pos", F.explode(line_kinds("_line")).alias("_kind"))
    return _finding(hits, F.col("_kind"), F.col("_pos") + 1, scope, path, commit)


def json_keys(document) -> Column:
    """Normalised object keys at any depth of a JSON text; NULL when it is not JSON or an object repeats a key.

    The parsed value is opened level by level: objects give their keys and values, lists their elements, until nothing is
    left to open.  There are never more levels than opening brackets, and a step without anything to open costs nothing.
    """
    d = _col(document)
    value = F.try_parse_json(d)

    def opened(values, kind: str) -> Column:
        return F.filter(F.transform(values, lambda v: F.try_variant_get(v, "$", kind)), lambda v: v.isNotNull())

    def deeper(so_far, _):
        objects, lists = opened(so_far["open"], "map<string,variant>"), opened(so_far["open"], "array<variant>")
        return F.when(F.size(so_far["open"]) == 0, so_far).otherwise(F.struct(
            F.concat(so_far["names"], F.flatten(F.transform(objects, F.map_keys))).alias("names"),
            F.concat(F.flatten(F.transform(objects, F.map_values)), F.flatten(lists)).alias("open")))

    start = F.struct(F.array().cast("array<string>").alias("names"), F.array(value).alias("open"))
    levels = F.sequence(F.lit(0), F.length(F.regexp_replace(d, r"[^\[{]", "")))
    names = F.aggregate(levels, start, deeper, lambda end: end["names"])
    return F.when(value.isNotNull(), F.transform(names, lambda name: F.lower(F.replace(name, F.lit("-"), F.lit("_")))))


def has_private_keys(document, keys: Sequence[str] = settings.PUBLIC_SPEAKER_KEYS) -> Column:
    """Whether a JSON text has one of the keys at any depth.

    Where an object repeats a key, its values cannot be told apart, and the text is judged as a whole: it counts if it
    holds one of the keys in quotes, or an escaped character that might hide one.
    """
    d = _col(document)
    wanted = F.array(*[F.lit(k) for k in keys])
    plain = F.lower(F.replace(d, F.lit("-"), F.lit("_")))
    named = F.exists(wanted, lambda k: F.contains(plain, F.concat(F.lit('"'), k, F.lit('"')))) | F.contains(plain, F.lit("\\u"))
    repeats = F.try_parse_json(d).isNull() & F.get_json_object(d, "$").isNotNull()
    return F.coalesce(F.arrays_overlap(json_keys(d), wanted), repeats & named, F.lit(False))


REPORT_PREFIXES = ("reports/", "models/")
_REPORT_KIND = "speaker_identifiers_in_report"


def scan_json_keys(
    df: DataFrame, path: str, text: str, *, scope: str = "current", commit: str | None = None,
    keys: Sequence[str] = settings.PUBLIC_SPEAKER_KEYS, prefixes: Sequence[str] = REPORT_PREFIXES,
) -> DataFrame:
    """Published JSON documents that carry identifier keys at any depth."""
    hits = df.filter(_published(path, prefixes)).filter(has_private_keys(text, keys))
    return _finding(hits, F.lit(_REPORT_KIND), F.lit(None), scope, path, commit)


def _published(path, prefixes: Sequence[str]) -> Column:
    normal = normal_path(path)
    published = normal.endswith(".json")
    return published & _starts_any(normal, prefixes) if prefixes else published


def normal_path(path) -> Column:
    return F.lower(F.replace(_col(path), F.lit("\\"), F.lit("/")))


def _starts_any(c: Column, prefixes: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def path_suffix(path) -> Column:
    """Last suffix of the file name, empty for dot files and names without one."""
    name = F.regexp_extract(_col(path), r"([^/]*)/*$", 1)
    return F.regexp_extract(name, r"^.*[^/](\.[^./]+)$", 1)


def path_kinds(path) -> Column:
    """Which path rules a tracked path breaks."""
    p = normal_path(path)
    name, suffix = F.regexp_extract(p, r"([^/]*)/*$", 1), path_suffix(p)
    internal = name.isin(*settings.INTERNAL_NAMES) | _starts_any(p, settings.INTERNAL_PREFIXES)
    private = (
        _starts_any(p, settings.PRIVATE_PREFIXES) | suffix.isin(*settings.AUDIO_SUFFIXES)
        | suffix.isin(*settings.MODEL_SUFFIXES)
        | (name.contains("manifest") & suffix.isin(*settings.MANIFEST_SUFFIXES)))
    kinds = F.array(F.when(internal, F.lit("internal_file_tracked")), F.when(private, F.lit("private_artifact_tracked")))
    return F.filter(kinds, lambda k: k.isNotNull())


def classify_paths(df: DataFrame, path: str, *, scope: str = "current", commit: str | None = None) -> DataFrame:
    keep = [path] + ([commit] if commit else [])
    hits = df.select(*keep, F.explode(path_kinds(path)).alias("_kind"))
    return _finding(hits, F.col("_kind"), F.lit(None), scope, path, commit)


def flag_large(df: DataFrame, path: str, size, *, scope: str = "current", limit: int = settings.LARGE_BYTES) -> DataFrame:
    """Objects above the size limit (from listing metadata, content is not read)."""
    kind = "large_staged_file" if scope == "staged" else "large_tracked_file"
    return _finding(df.filter(_col(size) > limit), F.lit(kind), F.lit(None), scope, path, None)


def header_findings(df: DataFrame, path: str, column: str, *, scope: str = "local") -> DataFrame:
    """Columns of a (table, column) listing whose names identify persons."""
    normal = F.translate(F.lower(F.trim(_col(column))), "- ", "__")
    hits = df.filter(normal.isin(*settings.IDENTIFIER_COLUMNS))
    return _finding(hits, F.lit("personal_identifier_column"), F.lit(1), scope, path, None)


def text_kind(content) -> Column:
    """``binary`` (has a NUL byte), ``undecodable`` or ``text``."""
    c = _col(content)
    return (
        F.when(F.contains(c, F.lit(bytearray(b"\x00"))), "binary")
        .when(F.is_valid_utf8(c.cast("string")), "text").otherwise("undecodable")
    )


def scan_files(files: DataFrame, *, scope: str = "current", path: str = "path", content: str = "content") -> DataFrame:
    """Path, size, encoding, line and JSON findings of a (path, content) table."""
    kinds = files.withColumn("_kind", text_kind(content))
    decoded = kinds.filter(F.col("_kind") == "text").select(path, F.decode(F.col(content), "UTF-8").alias("_text"))
    parts = [
        classify_paths(files, path, scope=scope),
        flag_large(files, path, F.length(content), scope=scope),
        _finding(kinds.filter(F.col("_kind") == "undecodable"), F.lit("unscannable_text"), F.lit(None), scope, path, None),
        scan_text(decoded, path, "_text", scope=scope), scan_json_keys(decoded, path, "_text", scope=scope),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scan_versions(df: DataFrame, path: str, text: str, commit: str) -> DataFrame:
    """Findings over every stored version of every path (scope ``history``).

    Each distinct content is scanned once, by its digest; what was found is stored, narrow rows without any text, and joined
    back to all versions with that content.  The join is salted where the findings are too many to broadcast, so a content shared by a third of
    the versions does not land in one task.  Paths are judged by themselves.
    """
    named = df.select(path, commit, F.col(text).alias("_text")).withColumn("_digest", F.sha2("_text", 256))
    contents = named.groupBy("_digest").agg(F.first("_text").alias("_text"))
    # the kind of a JSON finding is settled by its path later; here only whether its content has such keys
    lines = contents.select("_digest", F.posexplode(text_lines("_text")).alias("_pos", "_line")).select(
        "_digest", (F.col("_pos") + 1).alias("_at"), F.explode(line_kinds("_line")).alias("_kind"))
    keyed = contents.filter(has_private_keys("_text")).select("_digest", F.lit(None).cast("int").alias("_at"), F.lit(_REPORT_KIND).alias("_kind"))
    found = checkpoint(lines.unionByName(keyed))
    hits = sized_join(named.drop("_text"), found, "_digest").filter((F.col("_kind") != _REPORT_KIND) | _published(path, REPORT_PREFIXES))
    return _finding(hits, F.col("_kind"), F.col("_at"), "history", path, commit).unionByName(
        classify_paths(df, path, scope="history", commit=commit))


def summarise_findings(findings: DataFrame) -> DataFrame:
    """Per (scope, kind, path): sorted lines, number of versions and the greatest version id.

    One aggregation, so the findings, and with them the texts, are computed once.  Rows are made distinct by version first, so a
    hot path is spread over its versions, and each partial row holds distinct lines only.
    """
    return findings.groupBy("scope", "kind", "path").agg(
        F.count_distinct("commit").alias("commits"), F.max("commit").alias("latest"), F.array_sort(F.collect_set("line")).alias("lines"))


def verdict(findings: DataFrame) -> DataFrame:
    """One row: blocking findings, the rest, and PASS or FAIL."""
    blocking = F.count_if(F.col("scope").isin(*settings.BLOCKING_SCOPES))
    return findings.agg(
        blocking.alias("blocking"), F.count_if(F.col("scope") == "history").alias("historical"),
        F.count_if(F.col("scope") == "local-config").alias("local_config"),
        F.when(blocking > 0, "FAIL").otherwise("PASS").alias("result"))
