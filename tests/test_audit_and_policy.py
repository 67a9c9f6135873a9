import re

import pytest
from pyspark.sql import functions as F

from sonoframe import settings
from sonoframe.functions import checks as C
from sonoframe.operators import policy as L
from sonoframe.operators import privacy as V

TEXTS = [
    "token = none", "api_key: " + "A1b2" * 5, "write to someone.name+x@mail.example.org now", r"C:\Users\me\file.txt", "/home/me/x and /Users/you",
    "https://user:secret@host.example/x", "Bearer " + "abcDEF12" * 3, "ghp_" + "a" * 24, "AKIA" + "B2" * 8, "écontact@example.com", "a@b.c", "ssh://x:y@z",
]


def test_patterns_agree_with_python(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = {r["t"]: r["k"] for r in df.select("t", V.line_kinds("t").alias("k")).collect()}
    for t in TEXTS:
        assert got[t] == [k for k, p in settings.AUDIT_PATTERNS.items() if re.search("(?i)" + p, t)], t


def test_lines_agree_with_python(spark):
    texts = ["", "a", "a\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x1dg\x1eh\x85i\u2028j\u2029", "\n\n", "x\n\ny"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["l"] for r in df.select("t", V.text_lines("t").alias("l")).collect()}
    assert got == {t: t.splitlines() for t in texts}


def test_findings_locate_but_never_show(spark):
    df = spark.createDataFrame([("x.txt", "one\n" + TEXTS[1] + "\n" + TEXTS[2] + "\n" + TEXTS[4])], "path string, content string")
    rows = V.scan_text(df, "path", "content").orderBy("line").collect()
    assert [(r["kind"], r["line"]) for r in rows] == [("credential", 2), ("email", 3), ("absolute_path", 4)]
    assert not any("A1b2" in str(v) or "mail.example" in str(v) for r in rows for v in r)


def test_nested_keys(spark):
    docs = {'{"a": [{"Speaker-ID": 1}]}': True, '{"a": "speaker_id"}': False, '{"a": "\\"speaker_id\\": 1"}': False, "[]": False,
            '[[{"x": {"test_speaker_ids" : []}}]]': True, '{"speaker_id": ': False, '{"a": ":", "b": {"per_speaker_recording_aggregated": 1}}': True,
            '{"speaker\\u005fid": [null, 1.5e3]}': True, "[" * 300 + '{"speaker_id": 1}' + "]" * 300: True, '{"k": 1, "k": {"Speaker-ID": 2}}': True,
            '{"k": 1, "k": {"other": "speaker_id,"}}': False, '{"k": 1, "k": {"speaker\\u005fid": 2}}': True, "null": False, "speaker_id": False}
    df = spark.createDataFrame([(d,) for d in docs], "d string")
    assert {r["d"]: r["h"] for r in df.select("d", V.has_private_keys("d").alias("h")).collect()} == docs


def test_file_findings(spark):
    files = [("src/AGENTS.md", b"hi"), ("data/private/x.txt", b"hi"), ("a/train_manifest.json", b"{}"), ("m.onnx", b"\x00\x01"), ("bad.txt", b"\xff\xfe x"),
             ("big.txt", b"a" * (1024 * 1024 + 1)), ("reports/r.json", b'{"speaker_ids": []}'), ("nul.txt", b"x@y.example\x00"), ("fine.txt", b"x@y.example")]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary")
    got = {(r["path"], r["kind"]) for r in V.scan_files(df).collect()}
    assert got == {("src/AGENTS.md", "internal_file_tracked"), ("data/private/x.txt", "private_artifact_tracked"), ("a/train_manifest.json", "private_artifact_tracked"),
                   ("m.onnx", "private_artifact_tracked"), ("bad.txt", "unscannable_text"), ("big.txt", "large_tracked_file"),
                   ("reports/r.json", "speaker_identifiers_in_report"), ("fine.txt", "email")}
    suffixes = spark.createDataFrame([(".onnx",), ("a/.hidden.pt",), ("b.tar.gz",), ("c.",), ("d",)], "p string").select(V.path_suffix("p")).collect()
    assert [r[0] for r in suffixes] == ["", ".pt", ".gz", "", ""]


def test_summary_and_verdict(spark):
    rows = [("history", "email", "a", 3, "c1"), ("history", "email", "a", 1, "c2"), ("history", "email", "a", 1, "c1"), ("local-config", "x", "b", None, None)]
    df = spark.createDataFrame(rows, "scope string, kind string, path string, line int, commit string")
    got = {r["path"]: (r["lines"], r["commits"], r["latest"]) for r in V.summarise_findings(df).collect()}
    assert got == {"a": ([1, 3], 2, "c2"), "b": ([], 0, None)}
    assert V.verdict(df).first()["result"] == "PASS"
    assert V.verdict(df.withColumn("scope", F.lit("staged"))).first()["result"] == "FAIL"


EVENT = dict(emotion="happy", status="TARGET_ACTIVE", emotion_confidence=0.95, speaker_confidence=0.95, audio_quality=0.95, source="LIVE", night_mode=False)


@pytest.mark.parametrize("change, count", [({}, 1), ({"status": "NON_TARGET"}, 0), ({"emotion_confidence": 0.6}, 0), ({"speaker_confidence": 0.7}, 0),
                                           ({"audio_quality": 0.4}, 0), ({"source": "SIMULATION"}, 0), ({"emotion": None}, 0)])
def test_trust_rules(spark, change, count):
    schema = "emotion string, status string, emotion_confidence double, speaker_confidence double, audio_quality double, source string, night_mode boolean"
    df = spark.createDataFrame([tuple({**EVENT, **change}.values())], schema)
    shown, preview = L.route_by_source(df)
    assert shown.count() == count and preview.count() == (1 if change.get("source") == "SIMULATION" else 0)
    if count:
        row = shown.first()
        assert (row["rgb"], row["brightness"], row["transition_ms"]) == ([255, 224, 158], 0.34, 3000)
        assert L.to_commands(df, night=True).first()["brightness"] == 0.12


def test_redaction_key_sets(spark):
    df = spark.createDataFrame([('{"speaker_id": 1, "test_speaker_ids": [2], "x": [{"speaker_names": "n", "y": 1}]}',), ("oops",)], "d string")
    rows = df.select(C.redact_json("d").alias("r"), C.redact_json("d", settings.DISPLAY_PRIVATE_KEYS).alias("s")).collect()
    assert rows[0]["r"] == '{"x":[{"y":1}]}' and rows[0]["s"] == '{"speaker_id":1,"x":[{"speaker_names":"n","y":1}]}' and rows[1]["r"] is None


def test_findings_are_computed_once_for_the_summary(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = [("history", "k", "p", 2, "c1"), ("history", "k", "p", 2, "c2"), ("history", "k", "p", 1, "c1"), ("history", "k", "q", None, None), ("history", None, "q", None, "c3")]
    found = spark.createDataFrame(rows, "scope string, kind string, path string, line int, commit string")
    summary = V.summarise_findings(found.mapInPandas(counted, found.schema)).collect()
    assert sorted((r["path"], str(r["kind"]), r["lines"], r["commits"], r["latest"]) for r in summary) == [
        ("p", "k", [1, 2], 2, "c2"), ("q", "None", [], 1, "c3"), ("q", "k", [], 0, None)]
    assert seen.value == len(rows)
