"""Queries over labelled tables: validation, reconciliation, grouping, splits, pairing."""

from pyspark.sql import functions as F

from sonoframe import settings
from sonoframe.functions import checks as C
from sonoframe.operators import groups as G
from sonoframe.operators import manifest as M
from sonoframe.operators import mixing as X
from sonoframe.operators.ordering import global_index
from sonoframe.plans.registry import load, query

PRIORITY_MAP = {"1-urgent": "angry", "2-high": "happy", "3-medium": "neutral", "5-low": "sad"}
PRIORITY_SQL = "CASE lower(trim(o_orderpriority)) WHEN '1-urgent' THEN 'angry' WHEN '2-high' THEN 'happy' WHEN '3-medium' THEN 'neutral' WHEN '5-low' THEN 'sad' END"
LANG_LABEL = {"en": "neutral", "fr": "happy", "de": "angry", "es": "sad"}
LANG_SQL = "CASE lang WHEN 'en' THEN 'neutral' WHEN 'fr' THEN 'happy' WHEN 'de' THEN 'angry' WHEN 'es' THEN 'sad' END"


# --- labels ---------------------------------------------------------------------------
@query("label_mapping", f"SELECT o_orderkey, {PRIORITY_SQL} AS label FROM orders")
def label_mapping(spark, sf_dir):
    df = load(spark, sf_dir, "orders").withColumn("raw", F.concat(F.lit(" "), F.upper("o_orderpriority"), F.lit(" ")))
    return M.map_labels(df, "raw", M.label_mapping(PRIORITY_MAP)).select("o_orderkey", "label")


@query("label_mapping_table", f"SELECT o_orderkey, {PRIORITY_SQL} AS label FROM orders")
def label_mapping_table(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    alias = F.lower("o_orderpriority")
    mapping = orders.select(alias.alias("alias")).distinct().withColumn(
        "target", F.try_element_at(C.mapping_column(PRIORITY_MAP), F.col("alias"))).filter(F.col("target").isNotNull())
    return M.map_labels(orders, "o_orderpriority", mapping).select("o_orderkey", "label")


@query("unmapped_labels", f"""SELECT trim(o_orderpriority) AS raw_label, count(*) AS "rows" FROM orders WHERE {PRIORITY_SQL} IS NULL GROUP BY 1""")
def unmapped_labels(spark, sf_dir):
    df = M.map_labels(load(spark, sf_dir, "orders"), "o_orderpriority", PRIORITY_MAP)
    return M.split_unmapped(df, "o_orderpriority")[1]


# --- a manifest made from the documents table --------------------------------------------
def manifest(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return d.select(
        "doc_id", "text",
        F.when(F.pmod("doc_id", F.lit(37)) == 0, " ").otherwise(F.concat(F.lit("wav/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".wav"))).alias("path"),
        F.when(F.pmod("doc_id", F.lit(41)) == 0, "").when(F.pmod("doc_id", F.lit(43)) == 0, "DIS").otherwise(
            F.try_element_at(C.mapping_column(LANG_LABEL), F.col("lang"))).alias("emotion"),
        F.when(F.pmod("doc_id", F.lit(53)) == 0, "").otherwise(F.concat("source", F.lit("-"), F.expr("doc_id div 100").cast("string"))).alias("speaker_id"),
        F.col("doc_id").cast("string").alias("recording_id"),
        F.when(F.pmod("doc_id", F.lit(3)) == 0, " ").otherwise(F.col("lang")).alias("dataset_id"),
        F.when(F.pmod("doc_id", F.lit(2)) == 0, "").otherwise(F.concat(F.lit("r"), F.expr("doc_id div 4").cast("string"))).alias("source_recording_id"),
        F.when(F.pmod("doc_id", F.lit(61)) == 0, "dev").when(F.pmod("doc_id", F.lit(10)) == 0, " Test ").when(
            F.pmod("doc_id", F.lit(10)) == 1, "VALIDATION").otherwise("train").alias("split"))


MANIFEST = f"""man AS (SELECT doc_id, text, CASE WHEN doc_id % 37 = 0 THEN ' ' ELSE 'wav/' || source || '/' || doc_id || '.wav' END AS path,
 CASE WHEN doc_id % 41 = 0 THEN '' WHEN doc_id % 43 = 0 THEN 'DIS' ELSE {LANG_SQL} END AS emotion,
 CASE WHEN doc_id % 53 = 0 THEN '' ELSE source || '-' || doc_id // 100 END AS speaker_id, doc_id::VARCHAR AS recording_id,
 CASE WHEN doc_id % 3 = 0 THEN 'custom' ELSE lang END AS dataset_id,
 CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR ELSE 'r' || doc_id // 4 END AS source_recording_id,
 CASE WHEN doc_id % 61 = 0 THEN 'dev' WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'validation' ELSE 'train' END AS split,
 CASE WHEN text = '' THEN '' ELSE sha256(text) END AS file_sha256 FROM documents)"""


def prepared(spark, sf_dir):
    """Manifest with defaults, mapped labels and content hashes."""
    df = M.map_labels(M.fill_defaults(manifest(spark, sf_dir)), "emotion")
    return M.with_digest(df.withColumn("split", F.lower(F.trim("split"))), "text").drop("text")


@query("row_validation", f"""WITH {MANIFEST}, x AS (SELECT file_sha256 FROM man WHERE file_sha256 <> '' AND split <> 'dev' AND trim(path) <> '' AND speaker_id <> '' AND emotion NOT IN ('', 'DIS') AND doc_id IN (SELECT doc_id FROM labels) GROUP BY 1 HAVING count(DISTINCT emotion) > 1)
SELECT doc_id, CASE WHEN split = 'dev' THEN 'bad_split' WHEN trim(path) = '' THEN 'empty_path' WHEN speaker_id = '' THEN 'missing_speaker_or_recording' WHEN emotion = '' THEN 'empty_label'
 WHEN emotion = 'DIS' THEN 'unmapped_label' WHEN doc_id NOT IN (SELECT doc_id FROM labels) THEN 'missing_file' WHEN file_sha256 IN (SELECT file_sha256 FROM x) THEN 'conflicting_content' END AS violation FROM man""")
def row_validation(spark, sf_dir):
    df = prepared(spark, sf_dir)
    present = load(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("file_exists")).distinct()
    df = df.join(present, "doc_id", "left").fillna(False, ["file_exists"])
    passed = M.validate_rows(df).filter("violation is null")  # conflicts are sought among rows that are good so far
    clash = M.content_conflicts(passed).select("file_sha256", F.lit(True).alias("content_conflict"))
    df = df.join(clash, "file_sha256", "left").fillna(False, ["content_conflict"])
    return M.validate_rows(df).select("doc_id", "violation")


@query("column_defaults", f"WITH {MANIFEST} SELECT doc_id, dataset_id, source_recording_id, '' AS augmentation_group_id FROM man")
def column_defaults(spark, sf_dir):
    return M.fill_defaults(manifest(spark, sf_dir)).select("doc_id", "dataset_id", "source_recording_id", "augmentation_group_id")


@query("missing_files", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_files(spark, sf_dir):
    return M.missing_files(load(spark, sf_dir, "documents").select("doc_id"), load(spark, sf_dir, "labels"), "doc_id")


@query("content_digests", "SELECT doc_id, CASE WHEN text = '' THEN '' ELSE sha256(text) END AS file_sha256, md5(text) AS md5 FROM documents")
def content_digests(spark, sf_dir):
    return M.with_digest(load(spark, sf_dir, "documents"), "text").select("doc_id", "file_sha256", F.md5("text").alias("md5"))


@query("content_conflicts", """SELECT sha256(text) AS file_sha256, list_sort(list(DISTINCT (doc_id % 3)::VARCHAR)) AS labels, count(*) AS "rows" FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id % 3) > 1""")
def content_conflicts(spark, sf_dir):
    df = M.with_digest(load(spark, sf_dir, "documents"), "text").withColumn("label", F.pmod("doc_id", F.lit(3)).cast("string"))
    return M.content_conflicts(df)


@query("path_safety", """SELECT page_id, page_id % 4 IN (0, 2) AND page_id % 3 <> 2 AND page_id % 8 <> 2 AS safe FROM pages""")
def path_safety(spark, sf_dir):
    start = F.when(F.pmod("page_id", F.lit(4)) == 1, "/wav/").when(F.pmod("page_id", F.lit(4)) == 3, "x/wav/").when(
        F.pmod("page_id", F.lit(8)) == 2, "wav/../").otherwise("wav/")
    end = F.when(F.pmod("page_id", F.lit(3)) == 0, ".WAV").when(F.pmod("page_id", F.lit(3)) == 1, ".wav").otherwise(".mp3")
    host = F.regexp_extract("url", "//([^/]+)/", 1)
    return load(spark, sf_dir, "pages").select("page_id", C.safe_path(F.concat(start, host, F.lit("/a"), end)).alias("safe"))


def named(spark, sf_dir):
    letter = F.substring(F.lit("NFWTAELX"), F.pmod("doc_id", F.lit(8)).cast("int") + 1, F.lit(1))
    number = F.lpad(F.regexp_extract("source", r"(\d+)", 1), 2, "0")
    stem = F.concat(number, F.when(F.pmod("doc_id", F.lit(5)) == 0, "c").otherwise("b"), F.lpad(F.pmod("doc_id", F.lit(10)).cast("string"), 2, "0"), letter, F.lit("a.wav"))
    return load(spark, sf_dir, "documents").select("doc_id", "lang", "source", C.parse_name(stem).alias("n"))


@query("name_parse", """SELECT doc_id, lpad(regexp_extract(source, '\\d+'), 2, '0') AS speaker, 'b' || lpad((doc_id % 10)::VARCHAR, 2, '0') AS utterance, substr('NFWTAELX', (doc_id % 8)::INT + 1, 1) AS code, 'a' AS version,
 ['neutral','happy','angry','sad'][doc_id % 8 + 1] AS label FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL FROM documents WHERE doc_id % 5 = 0""")
def name_parse(spark, sf_dir):
    return named(spark, sf_dir).select("doc_id", "n.speaker", F.col("n.text").alias("utterance"), "n.code", "n.version", "n.label")


# --- matching ----------------------------------------------------------------------------
@query("lookup_check", """SELECT c_custkey, CASE WHEN s.s_nationkey IS NULL THEN 'absent' ELSE 'mismatch' END AS reason FROM customer c
 LEFT JOIN supplier s ON s.s_suppkey = c.c_custkey WHERE s.s_nationkey IS NULL OR s.s_nationkey <> c.c_nationkey""")
def lookup_check(spark, sf_dir):
    customers = load(spark, sf_dir, "customer").withColumn("s_suppkey", F.col("c_custkey"))
    return M.check_lookup(customers, load(spark, sf_dir, "supplier"), "s_suppkey", "s_nationkey", F.col("c_nationkey")).select("c_custkey", "reason")


@query("code_label_check", """SELECT doc_id, CASE WHEN lang = 'es' THEN 'unknown_label' ELSE 'code_conflict' END AS reason FROM documents WHERE doc_id % 5 <> 0 AND
 (lang = 'es' OR substr('NFWTAELX', (doc_id % 8)::INT + 1, 1) <> CASE lang WHEN 'en' THEN 'N' WHEN 'fr' THEN 'F' WHEN 'de' THEN 'W' END)""")
def code_label_check(spark, sf_dir):
    label = F.try_element_at(C.mapping_column({"en": "neutral", "fr": "happiness", "de": "anger", "es": "grief"}), F.col("lang"))
    df = named(spark, sf_dir).filter(F.col("n").isNotNull()).select("doc_id", F.col("n.code").alias("code"), label.alias("gold"))
    return M.check_code_label(df, "code", "gold").select("doc_id", "reason")


@query("reconciliation", """SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'left_only' ELSE 'right_only' END AS side FROM (SELECT DISTINCT doc_id AS k FROM labels) a
 FULL JOIN (SELECT DISTINCT page_id AS k FROM pages) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def reconciliation(spark, sf_dir):
    return M.reconcile(load(spark, sf_dir, "labels").select(F.col("doc_id").alias("k")), load(spark, sf_dir, "pages").select(F.col("page_id").alias("k")), "k")


@query("duplicate_keys", """SELECT sha256(text) AS digest, count(*) AS "rows" FROM documents GROUP BY 1 HAVING count(*) > 1""")
def duplicate_keys(spark, sf_dir):
    return M.duplicates(load(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest")), "digest")


@query("split_leakage", f"WITH {MANIFEST} SELECT file_sha256, count(DISTINCT split) AS splits, list_sort(list(DISTINCT split)) AS split_names FROM man GROUP BY 1 HAVING count(DISTINCT split) > 1")
def split_leakage(spark, sf_dir):
    return M.leakage(prepared(spark, sf_dir), "file_sha256")


@query("provenance_check", """WITH m AS (SELECT source, md5(min(lang)) AS l, md5(source) AS h, count(*) % 2 AS seed, md5(max(lang)) AS s FROM documents GROUP BY source),
 r AS (SELECT doc_id, CASE WHEN doc_id % 19 = 0 THEN 'none' ELSE source END AS source, CASE WHEN doc_id % 5 = 0 THEN md5(lang) ELSE md5('de') END AS l, CASE WHEN doc_id % 7 = 0 THEN md5(lang) ELSE md5(source) END AS h,
  CASE WHEN doc_id % 3 = 0 THEN doc_id % 2 END AS seed, CASE WHEN doc_id % 11 = 0 THEN md5(lang) ELSE md5('fr') END AS s FROM documents)
SELECT doc_id, CASE WHEN m.h IS NULL THEN 'MODEL_NOT_READY' WHEN r.l <> m.l THEN 'LABEL_MAPPING_MISMATCH' WHEN r.h <> m.h THEN 'MANIFEST_MISMATCH' WHEN r.seed IS NOT NULL AND r.seed <> m.seed THEN 'SPLIT_MISMATCH'
 WHEN r.s <> m.s THEN 'SPLIT_MISMATCH' ELSE 'READY' END AS provenance_status FROM r LEFT JOIN m ON m.source = r.source""")
def provenance_check(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    models = d.groupBy("source").agg(
        F.md5(F.min("lang")).alias("label_mapping_sha256"), F.md5("source").alias("manifest_sha256"),
        (F.count("*") % 2).alias("seed"), F.md5(F.max("lang")).alias("split_sha256"))
    mod = lambda n: F.pmod("doc_id", F.lit(n)) == 0
    runs = d.select(
        "doc_id", F.when(mod(19), "none").otherwise(F.col("source")).alias("source"),
        F.when(mod(5), F.md5("lang")).otherwise(F.md5(F.lit("de"))).alias("label_mapping_sha256"),
        F.when(mod(7), F.md5("lang")).otherwise(F.md5("source")).alias("manifest_sha256"),
        F.when(mod(3), F.pmod("doc_id", F.lit(2))).alias("seed"),
        F.when(mod(11), F.md5("lang")).otherwise(F.md5(F.lit("fr"))).alias("split_sha256"))
    return M.check_provenance(runs, models, "source").select("doc_id", "provenance_status")


# --- groups and splits -----------------------------------------------------------------------
GROUPS = f"""RECURSIVE {MANIFEST},
 good AS (SELECT *, 'speaker' || chr(1) || dataset_id || chr(1) || speaker_id AS anchor FROM man),
 e AS (SELECT DISTINCT anchor AS a, unnest(list_concat(['recording' || chr(1) || dataset_id || chr(1) || recording_id, 'source_recording' || chr(1) || dataset_id || chr(1) || source_recording_id, 'path' || chr(1) || path],
   CASE WHEN file_sha256 <> '' THEN ['sha256' || chr(1) || file_sha256] ELSE [] END)) AS b FROM good),
 step AS (SELECT DISTINCT x.a AS a, y.a AS b FROM e x JOIN e y ON x.b = y.b),
 reach AS (SELECT a, b FROM step UNION SELECT r.a, s.b FROM reach r JOIN step s ON r.b = s.a),
 root AS (SELECT r.a AS anchor, least(min(e.b), min(r.b)) AS group_key FROM reach r JOIN e ON e.a = r.b GROUP BY r.a),
 grp AS (SELECT good.*, group_key, dense_rank() OVER (ORDER BY group_key) - 1 AS group_id FROM good JOIN root USING (anchor))"""


def grouped(spark, sf_dir):
    return G.connected_groups(prepared(spark, sf_dir))


@query("connected_groups", f"WITH {GROUPS} SELECT doc_id, group_key, group_id FROM grp")
def connected_groups(spark, sf_dir):
    return grouped(spark, sf_dir).select("doc_id", "group_key", "group_id")


@query("split_conflicts", f"""WITH {GROUPS} SELECT group_id, count(DISTINCT split) AS splits, count(*) AS "rows" FROM grp GROUP BY group_id HAVING count(DISTINCT split) > 1""")
def split_conflicts(spark, sf_dir):
    return G.split_conflicts(grouped(spark, sf_dir))


@query("split_summary", f"""WITH {GROUPS}, c AS (SELECT split, dataset_id, count(*) AS n FROM grp GROUP BY ALL),
 m AS (SELECT split, list_sort(list(dataset_id || '=' || n)) AS dataset_counts FROM c GROUP BY split)
SELECT split, count(*) AS sample_count, count(DISTINCT (dataset_id, speaker_id)) AS speaker_count, count(DISTINCT group_id) AS group_count, any_value(dataset_counts) AS dataset_counts,
 {", ".join(f"CASE WHEN split <> 'test' THEN count(*) FILTER (emotion = '{c}') END AS n_{c}" for c in settings.EMOTIONS)} FROM grp JOIN m USING (split) GROUP BY split""")
def split_summary(spark, sf_dir):
    df = G.split_summary(grouped(spark, sf_dir), withhold="test")
    entries = F.transform(F.map_entries("dataset_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return df.withColumn("dataset_counts", F.array_sort(entries))


@query("class_counts", f"""WITH c AS (SELECT source, {", ".join(f"count(*) FILTER ({LANG_SQL} = '{c}') AS n_{c}" for c in settings.EMOTIONS)} FROM documents GROUP BY source)
SELECT *, list_filter([{", ".join(f"CASE WHEN n_{c} = 0 THEN '{c}' END" for c in settings.EMOTIONS)}], lambda x: x IS NOT NULL) AS missing_classes FROM c""")
def class_counts(spark, sf_dir):
    df = load(spark, sf_dir, "documents").withColumn("label", F.try_element_at(C.mapping_column(LANG_LABEL), F.col("lang")))
    return G.class_counts(df, by=["source"])


@query("dataset_card", f"""WITH g AS (SELECT doc_id, source, lang AS label, CASE WHEN doc_id % 4 = 0 THEN 'test' ELSE 'train' END AS split, CASE WHEN lang <> 'es' THEN {LANG_SQL} END AS mapped FROM documents), w AS (SELECT * FROM g WHERE mapped IS NOT NULL)
SELECT 'gold_class' AS section, split, label AS item, count(*) AS value FROM g GROUP BY ALL UNION ALL SELECT 'gold_rows', split, '', count(*) FROM g GROUP BY ALL
UNION ALL SELECT 'ignored_class', '', label, count(*) FROM g WHERE mapped IS NULL GROUP BY ALL UNION ALL SELECT 'window_class', split, mapped, count(*) FROM w GROUP BY ALL UNION ALL SELECT 'speakers', split, '', count(DISTINCT source) FROM w GROUP BY ALL""")
def dataset_card(spark, sf_dir):
    mapped = F.when(F.col("lang") != "es", F.try_element_at(C.mapping_column(LANG_LABEL), F.col("lang")))
    gold = load(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("label"), F.when(F.pmod("doc_id", F.lit(4)) == 0, "test").otherwise("train").alias("split"),
        mapped.alias("mapped"), F.col("source").alias("speaker_id"))
    return M.dataset_card(gold, gold.filter(F.col("mapped").isNotNull()))


@query("complement_rows", f"WITH {MANIFEST} SELECT doc_id FROM man WHERE split NOT IN ('test', 'validation')")
def complement_rows(spark, sf_dir):
    df = prepared(spark, sf_dir).select("doc_id", "split")
    return G.complement(df, df.filter("split = 'validation'"), df.filter("split = 'test'"), key="doc_id").select("doc_id")


@query("uncovered_labels", "SELECT DISTINCT lang || source AS label FROM documents EXCEPT SELECT DISTINCT lang || source FROM documents WHERE doc_id % 2 = 0")
def uncovered_labels(spark, sf_dir):
    df = load(spark, sf_dir, "documents").select("doc_id", F.concat("lang", "source").alias("label"))
    return G.uncovered(df.filter(F.pmod("doc_id", F.lit(2)) == 0), df)


@query("group_split")
def group_split(spark, sf_dir):
    return G.stratified_group_split(grouped(spark, sf_dir).filter(F.col("label").isNotNull())).select("doc_id", "group_id", "label", "fold", "split")


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("covering_pairs", """WITH m AS (SELECT o_custkey, bit_or(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 4 WHEN '4-NOT SPECIFIED' THEN 8 WHEN '5-LOW' THEN 16 END)::INTEGER AS mask FROM orders GROUP BY 1),
 t AS (SELECT [count(*) FILTER (mask & 1 > 0), count(*) FILTER (mask & 2 > 0), count(*) FILTER (mask & 4 > 0), count(*) FILTER (mask & 8 > 0), count(*) FILTER (mask & 16 > 0)] AS h FROM m),
 p AS (SELECT a.o_custkey, count(*) AS partners FROM m a JOIN m b ON a.o_custkey < b.o_custkey, t WHERE (a.mask | b.mask) = 31
   AND list_min(list_transform(h, lambda x, i: x - ((a.mask >> (i - 1)::INT) & 1) - ((b.mask >> (i - 1)::INT) & 1))) >= 1 GROUP BY 1)
SELECT m.o_custkey, m.mask, coalesce(partners, 0) AS partners, (sum(coalesce(partners, 0)) OVER (ORDER BY m.o_custkey) - coalesce(partners, 0))::BIGINT AS first_position FROM m LEFT JOIN p USING (o_custkey)""")
def covering_pairs(spark, sf_dir):
    return G.covering_pairs(load(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", PRIORITIES)


# --- pairing ---------------------------------------------------------------------------------
@query("global_index", "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS idx FROM lineitem")
def global_index_rows(spark, sf_dir):
    df = load(spark, sf_dir, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber")
    return global_index(df, ["l_shipdate", "l_orderkey", "l_linenumber"]).drop("l_shipdate")


@query("round_robin", """WITH i AS (SELECT doc_id, source, row_number() OVER (ORDER BY source, doc_id) - 1 AS row_index FROM documents)
SELECT doc_id, row_index, (row_index % 25)::INTEGER AS source_idx, n_name FROM i JOIN nation ON n_nationkey = row_index % 25""")
def round_robin(spark, sf_dir):
    sources = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("source_idx"), "n_name")
    docs = load(spark, sf_dir, "documents").select("doc_id", "source")
    return X.assign_round_robin(docs, sources, ["source", "doc_id"]).select("doc_id", "row_index", "source_idx", "n_name")


@query("first_other", """WITH d AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 6 < 3 THEN 0 ELSE doc_id // 20 END AS rec FROM documents)
SELECT a.doc_id, (SELECT min(b.doc_id) FROM d b WHERE (b.lang <> a.lang OR b.source <> a.source) AND (b.lang <> a.lang OR b.rec <> a.rec)) AS other FROM d a""")
def first_other(spark, sf_dir):
    rec = F.when(F.pmod("doc_id", F.lit(6)) < 3, F.lit(0)).otherwise(F.expr("doc_id div 20"))
    d = load(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("dataset_id"), F.col("source").alias("speaker_id"), rec.alias("recording_id"))
    return X.first_other(d, "doc_id").select("doc_id", "other")


@query("preassigned_split", """WITH c AS (SELECT c_nationkey AS group_id, c_mktsegment AS label, ['train', 'validation', 'test'][c_nationkey % 3 + 1] AS split FROM customer)
SELECT split, label, count(*) AS records, count(DISTINCT group_id) AS groups FROM c GROUP BY ALL""")
def preassigned_split(spark, sf_dir):
    """Customers that bring a split by nation: checked for names, group conflicts, empty subsets and classes, then counted."""
    split = F.element_at(F.array(*[F.lit(s) for s in settings.SPLITS]), (F.pmod("c_nationkey", F.lit(3)) + 1).cast("int"))
    df = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("group_id"), F.col("c_mktsegment").alias("label"), split.alias("split"))
    return G.preassigned_split(df).groupBy("split", "label").agg(F.count("*").alias("records"), F.countDistinct("group_id").alias("groups"))
