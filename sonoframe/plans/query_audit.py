"""Queries that audit the text tables: whole texts, every line."""

from pyspark.sql import functions as F

from sonoframe import settings
from sonoframe.operators import privacy as V
from sonoframe.plans.registry import load, query, spread

# the same patterns in the SQL dialect of the checking engine
_SQL_PATTERN = {k: v.replace("'", "''") for k, v in settings.AUDIT_PATTERNS.items()}
_BREAKS = "'\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]'"


def lines_sql(table: str, path: str, text: str = "text", extra: str = "") -> str:
    split = f"string_split_regex({text}, {_BREAKS})"
    return f"""(SELECT {path} AS path{extra}, i AS line, l[i] AS t FROM (SELECT *, {split} AS l FROM {table}) q, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i) r
  WHERE NOT (i = len(l) AND l[i] = ''))"""


def found_sql(lines: str, scope: str = "current", extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT '{scope}' AS scope, '{k}' AS kind, path::VARCHAR AS path, line::INTEGER AS line{extra or ', NULL::VARCHAR AS commit'} FROM {lines} WHERE regexp_matches(t, '(?i){p}')"
        for k, p in _SQL_PATTERN.items())


DOCS = f"dl AS MATERIALIZED {lines_sql('documents', 'doc_id')}"


@query("text_findings", f"WITH {DOCS} {found_sql('dl')}")
def text_findings(spark, sf_dir):
    return V.scan_text(spread(load(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


@query("page_findings", f"WITH pl AS MATERIALIZED {lines_sql('pages', 'url', 'html')} {found_sql('pl')}")
def page_findings(spark, sf_dir):
    return V.scan_text(spread(load(spark, sf_dir, "pages").select("url", "html")), "url", "html")


# turns of conversations, and documents as versions of few paths; a fifth of those are one of two JSON reports
VERSIONS = f"""vt AS (SELECT conv_id::VARCHAR AS path, text, lpad(turn::VARCHAR, 4, '0') AS commit FROM conversations UNION ALL
 SELECT CASE doc_id % 5 WHEN 0 THEN 'reports/' || source || '.json' WHEN 1 THEN 'recordings/' || source || '.txt' WHEN 2 THEN source || '/progress.md' ELSE 'docs/' || source || '.txt' END,
  CASE WHEN doc_id % 15 = 0 THEN '{{"a": [{{"Speaker-ID": 1}}]}}' WHEN doc_id % 5 = 0 THEN '{{"note": "\\"speaker_id\\": 1"}}' ELSE text END, lpad(doc_id::VARCHAR, 9, '0') FROM documents),
 cl AS MATERIALIZED {lines_sql('vt', 'path', 'text', ', commit')}"""
VERSION_FINDINGS = found_sql("cl", "history", ", commit") + """
 UNION ALL SELECT 'history', 'speaker_identifiers_in_report', path, NULL, commit FROM vt WHERE path LIKE 'reports/%' AND text LIKE '%Speaker-ID%'
 UNION ALL SELECT 'history', 'private_artifact_tracked', path, NULL, commit FROM vt WHERE path LIKE 'recordings/%'
 UNION ALL SELECT 'history', 'internal_file_tracked', path, NULL, commit FROM vt WHERE path LIKE '%/progress.md'"""


def versions(spark, sf_dir):
    turns = spread(load(spark, sf_dir, "conversations")).select(
        F.col("conv_id").cast("string").alias("path"), "text", F.lpad(F.col("turn").cast("string"), 4, "0").alias("commit"))
    m, named = F.pmod("doc_id", F.lit(5)), lambda before, after: F.concat(F.lit(before), F.col("source"), F.lit(after))
    path = F.when(m == 0, named("reports/", ".json")).when(m == 1, named("recordings/", ".txt")).when(m == 2, named("", "/progress.md")).otherwise(named("docs/", ".txt"))
    text = F.when(F.pmod("doc_id", F.lit(15)) == 0, '{"a": [{"Speaker-ID": 1}]}').when(m == 0, '{"note": "\\"speaker_id\\": 1"}').otherwise(F.col("text"))
    docs = spread(load(spark, sf_dir, "documents")).select(path.alias("path"), text.alias("text"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("commit"))
    return turns.unionByName(docs)


@query("version_findings", f"WITH {VERSIONS} {VERSION_FINDINGS}")
def version_findings(spark, sf_dir):
    return V.scan_versions(versions(spark, sf_dir), "path", "text", "commit")


ALL_FINDINGS = f"""{DOCS}, {VERSIONS}, f AS ({found_sql('dl')} UNION ALL {VERSION_FINDINGS})"""


def _all(spark, sf_dir):
    return text_findings(spark, sf_dir).unionByName(version_findings(spark, sf_dir))


@query("finding_summary", f"""WITH {ALL_FINDINGS}
SELECT scope, kind, path, coalesce(list_sort(list(DISTINCT line) FILTER (line IS NOT NULL)), []) AS lines, count(DISTINCT commit) AS commits, max(commit) AS latest FROM f GROUP BY scope, kind, path""")
def finding_summary(spark, sf_dir):
    return V.summarise_findings(_all(spark, sf_dir))


@query("audit_verdict", f"""WITH {ALL_FINDINGS} SELECT count(*) FILTER (scope IN ('current', 'staged', 'local')) AS blocking, count(*) FILTER (scope = 'history') AS historical, count(*) FILTER (scope = 'local-config') AS local_config,
 CASE WHEN count(*) FILTER (scope IN ('current', 'staged', 'local')) > 0 THEN 'FAIL' ELSE 'PASS' END AS result FROM f""")
def audit_verdict(spark, sf_dir):
    return V.verdict(_all(spark, sf_dir))


# --- paths, sizes, headers, encodings -----------------------------------------------------
def tracked(spark, sf_dir):
    """File paths made from page addresses, spread over folders and suffixes."""
    p = F.col("page_id")
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(p, F.lit(n)) + 1).cast("int"))
    folder = pick(5, "src/", "Docs\\Superpowers\\", "data/private/", "Recordings/", "reports/")
    name = pick(7, "page", "Progress", "train_Manifest", ".hidden", "model", "clip", "AGENTS")
    suffix = pick(6, ".md", ".csv", ".WAV", ".json", "", ".onnx")
    host = F.regexp_extract("url", "//([^/]+)/", 1)
    return load(spark, sf_dir, "pages").withColumn("path", F.concat(folder, host, F.lit("/"), name, suffix))


TRACKED = """p AS (SELECT *, ['src/','Docs\\Superpowers\\','data/private/','Recordings/','reports/'][page_id % 5 + 1] || regexp_extract(url, '//([^/]+)/', 1) || '/' ||
 ['page','Progress','train_Manifest','.hidden','model','clip','AGENTS'][page_id % 7 + 1] || ['.md','.csv','.WAV','.json','','.onnx'][page_id % 6 + 1] AS path FROM pages)"""


@query("path_findings", f"""WITH {TRACKED}, k AS (SELECT *, page_id % 5 = 1 OR (page_id % 6 = 0 AND page_id % 7 IN (1, 6)) AS internal,
 page_id % 5 IN (2, 3) OR page_id % 6 IN (2, 5) OR (page_id % 7 = 2 AND page_id % 6 IN (1, 3)) AS private FROM p)
SELECT 'current' AS scope, 'internal_file_tracked' AS kind, path FROM k WHERE internal UNION ALL SELECT 'current', 'private_artifact_tracked', path FROM k WHERE private""")
def path_findings(spark, sf_dir):
    return V.classify_paths(tracked(spark, sf_dir), "path").select("scope", "kind", "path")


@query("large_objects", f"""WITH {TRACKED} SELECT 'staged' AS scope, 'large_staged_file' AS kind, path FROM p WHERE octet_length(encode(html)) > 4096""")
def large_objects(spark, sf_dir):
    return V.flag_large(tracked(spark, sf_dir), "path", F.octet_length("html"), scope="staged", limit=4096).select("scope", "kind", "path")


@query("header_findings", """SELECT 'local' AS scope, 'personal_identifier_column' AS kind, event_id::VARCHAR AS path, 1 AS line FROM events WHERE event_id % 5 IN (1, 3, 4)""")
def header_findings(spark, sf_dir):
    names = F.array(*[F.lit(v) for v in ("value", "User-ID", "ts", " full name ", "EMAIL")])
    df = load(spark, sf_dir, "events").select("event_id", F.element_at(names, (F.pmod("event_id", F.lit(5)) + 1).cast("int")).alias("column"))
    return V.header_findings(df, "event_id", "column").select("scope", "kind", "path", "line")


@query("text_kinds", """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'binary' WHEN 1 THEN 'undecodable' ELSE 'text' END AS kind FROM documents""")
def text_kinds(spark, sf_dir):
    raw = F.encode("text", "UTF-8")
    broken = F.concat(raw, F.lit(bytearray(b"\xff\xfe")))
    nul = F.concat(raw, F.lit(bytearray(b"\x00")), raw)
    m = F.pmod("doc_id", F.lit(5))
    content = F.when(m == 0, nul).when(m == 1, broken).otherwise(raw)
    return load(spark, sf_dir, "documents").select("doc_id", V.text_kind(content).alias("kind"))


@query("json_key_findings", """SELECT event_id::VARCHAR AS path FROM events WHERE event_id % 7 IN (1, 3, 5, 6)""")
def json_key_findings(spark, sf_dir):
    """Event properties wrapped in nested documents; identifier keys at several depths, escaped ones and beside repeated ones."""
    m = F.pmod("event_id", F.lit(7))
    wrap = lambda before, after: F.concat(F.lit(before), F.col("props"), F.lit(after))
    text = (
        F.when(m == 1, wrap('{"a": [{"b": ', ', "Speaker-IDs": [1]}]}'))
        .when(m == 2, wrap('{"note": "\\"speaker_id\\": 1", "x": ', "}"))
        .when(m == 3, wrap('[[{"speaker\\u005fname" : ', "}]]"))
        .when(m == 4, wrap('{"speaker_id": ', ""))
        .when(m == 5, wrap('{"x": {"y": {"z": {"per_speaker_recording_aggregated": ', "}}}}"))
        .when(m == 6, wrap('{"k": ', ', "k": {"Speaker-ID": 2}}'))
        .otherwise(wrap('{"k": ', ', "k": [2]}')))
    df = load(spark, sf_dir, "events").select("event_id", text.alias("doc"))
    return df.filter(V.has_private_keys("doc")).select(F.col("event_id").cast("string").alias("path"))


@query("published_json_findings", f"""WITH {TRACKED} SELECT path FROM p WHERE page_id % 5 = 4 AND page_id % 6 = 3 AND page_id % 2 = 1""")
def published_json_findings(spark, sf_dir):
    doc = F.when(F.pmod("page_id", F.lit(2)) == 1, F.to_json(F.struct(F.struct(F.col("url").alias("speaker_id")).alias("inner")))).otherwise(
        F.to_json(F.struct("url")))
    return V.scan_json_keys(tracked(spark, sf_dir).withColumn("doc", doc), "path", "doc").select("path")
