import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoframe import settings
from sonoframe.operators import groups as G
from sonoframe.operators import history as H
from sonoframe.operators import manifest as M
from sonoframe.operators import mixing as X
from sonoframe.operators import ordering as O

COLUMNS = "row int, dataset_id string, speaker_id string, recording_id string, source_recording_id string, augmentation_group_id string, path string, file_sha256 string, label string, split string"


def union_find(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for r in rows:
        keys = [("speaker", r[1], r[2]), ("recording", r[1], r[3]), ("source_recording", r[1], r[4])]
        keys += [("augmentation", r[1], r[5])] if r[5] else []
        keys += [("path", r[6])] + ([("sha256", r[7])] if r[7] else [])
        for k in keys[1:]:
            a, b = sorted((find(keys[0]), find(k)))
            parent[b] = a
    roots = [find(("speaker", r[1], r[2])) for r in rows]
    order = {root: i for i, root in enumerate(sorted(set(roots)))}
    return {r[0]: order[root] for r, root in zip(rows, roots)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_connected_groups_equal_union_find(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(120):
        s = int(rng.integers(0, 45))
        rows.append((i, "d", f"s{s}", f"r{i}" if rng.random() < 0.9 else f"r{rng.integers(0, 120)}", f"q{i}",
                     f"a{rng.integers(0, 40)}" if rng.random() < 0.15 else "", f"p{i}",
                     f"h{rng.integers(0, 30)}" if rng.random() < 0.2 else "", "sad", "train"))
    got = {r["row"]: r["group_id"] for r in G.connected_groups(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == union_find(rows)


def test_long_chain_is_one_group(spark):
    n = 400
    edges = spark.createDataFrame([(f"{i:05d}", f"{i + 1:05d}") for i in range(n)], "a string, b string")
    roots = G.smallest_reachable(edges).select("root").distinct().collect()
    assert [r["root"] for r in roots] == ["00000"]


@pytest.mark.parametrize("edges_at_once", [7, 1 << 18])
def test_a_hub_contracts_inside_tasks(spark, monkeypatch, edges_at_once):
    monkeypatch.setattr(G, "_EDGES", edges_at_once)
    random = np.random.default_rng(5)
    pairs = [("hub", f"n{i:04d}") for i in range(600)] + [(f"n{random.integers(0, 900):04d}", f"n{random.integers(0, 900):04d}") for _ in range(500)]
    want = {n: n for p in pairs for n in p}
    for _ in range(len(want)):
        before = dict(want)
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
        if before == want:
            break
    edges = spark.createDataFrame(pairs, "a string, b string").repartition(8)
    assert {r["node"]: r["root"] for r in G.smallest_reachable(edges).collect()} == want
    inside = edges.mapInArrow(G._contracted, "u string, v string")
    assert all(r["v"] < r["u"] for r in inside.collect())


def split_table(spark, speakers=25):
    labels = settings.EMOTIONS
    rows = [(s * 8 + i, "d", f"s{s:02d}", f"r{s}-{i}", f"r{s}-{i}", "", f"p{s}-{i}", "", labels[(s + i) % 4], "") for s in range(speakers) for i in range(8)]
    rows += [(10_000 + i, "d", "s00", f"big{i}", f"big{i}", "", f"b{i}", "", labels[i % 4], "") for i in range(80)]
    return spark.createDataFrame(rows, COLUMNS)


def test_group_split_has_no_leakage(spark):
    grouped = G.connected_groups(split_table(spark))
    out = G.stratified_group_split(grouped)
    assert M.leakage(out, "speaker_id").count() == 0 and M.leakage(out, "group_id").count() == 0
    counts = {r["fold"]: r["n"] for r in out.groupBy("fold").agg(F.countDistinct("group_id").alias("n")).collect()}
    assert set(counts) == {0, 1, 2, 3, 4} and max(counts.values()) - min(counts.values()) <= 4
    assert out.filter("speaker_id = 's00'").select("split").distinct().collect()[0][0] == "train"
    again = G.stratified_group_split(grouped.repartition(3))
    key = lambda df: sorted((r["row"], r["split"]) for r in df.collect())
    assert key(out) == key(again)


def test_group_split_needs_five_groups(spark):
    with pytest.raises(ValueError, match="at least 5"):
        G.stratified_group_split(G.connected_groups(split_table(spark, 3)))


def test_preassigned_split_rules(spark):
    rows = [(i, "d", f"s{i}", f"r{i}", f"r{i}", "", f"p{i}", "", settings.EMOTIONS[i % 4], ("train", "train", "validation", "test", "train")[i % 5]) for i in range(20)]
    good = G.connected_groups(spark.createDataFrame(rows, COLUMNS))
    assert G.preassigned_split(good).count() == 20
    clash = rows + [(99, "d", "s0", "r99", "r99", "", "p99", "", "sad", "test")]
    with pytest.raises(ValueError, match="conflicting"):
        G.preassigned_split(G.connected_groups(spark.createDataFrame(clash, COLUMNS)))
    with pytest.raises(ValueError, match="must contain"):
        G.preassigned_split(good.filter("split <> 'test'"))


def pair_rows(rng, entities):
    return [(f"e{e:02d}", settings.EMOTIONS[c]) for e in range(entities) for c in range(4) if rng.random() < 0.45]


@pytest.mark.parametrize("seed", [0, 5])
def test_covering_pair_choice_equals_brute_force(spark, seed):
    rows = pair_rows(np.random.default_rng(seed), 14)
    names = sorted({e for e, _ in rows})
    wanted = []
    for pair in itertools.combinations(names, 2):
        chosen = {c for e, c in rows if e in pair}
        rest = {c for e, c in rows if e not in pair}
        if len(chosen) == 4 and len(rest) == 4:
            wanted.append(pair)
    df = spark.createDataFrame(rows, "entity string, label string")
    assert df.transform(lambda d: G.covering_pairs(d, "entity", "label")).agg(F.sum("partners")).first()[0] == len(wanted)
    for pick in (1, 7, 42):
        expected = wanted[int(np.random.default_rng(pick).integers(0, len(wanted)))]
        assert G.pick_covering_pair(df, "entity", "label", pick) == expected


@pytest.mark.parametrize("seed", range(4))
def test_first_other_equals_scan(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, "d", f"s{rng.integers(0, 3)}", f"r{rng.integers(0, 4)}") for i in range(60)]
    df = spark.createDataFrame(rows, "pos int, dataset_id string, speaker_id string, recording_id string")
    got = {r["pos"]: r["other"] for r in X.first_other(df, "pos").collect()}
    for pos, _, s, r in rows:
        assert got[pos] == next((p for p, _, s2, r2 in rows if s2 != s and r2 != r), None)


def test_manifest_rules(spark):
    rows = [("a.wav", "HAP", "s1", "r1"), ("b.wav", "DIS", "s1", "r2"), (" ", "sad", "s1", "r3"), ("c.wav", "sad", "", "r4"), ("d.wav", " ", "s2", "r5")]
    df = spark.createDataFrame(rows, "path string, emotion string, speaker_id string, recording_id string")
    out = M.validate_rows(M.map_labels(M.fill_defaults(df), "emotion"))
    found = {r["recording_id"]: (r["label"], r["violation"]) for r in out.collect()}
    assert found == {"r1": ("happy", None), "r2": (None, "unmapped_label"), "r3": ("sad", "empty_path"),
                     "r4": ("sad", "missing_speaker_or_recording"), "r5": (None, "empty_label")}
    assert out.filter("recording_id = 'r1'").first()["dataset_id"] == "custom"
    assert M.label_mapping({" DIS ": "Sad"})["dis"] == "sad"
    with pytest.raises(ValueError):
        M.label_mapping({"x": "bored"})
    with pytest.raises(Exception, match="unmapped label"):
        M.split_unmapped(M.map_labels(df, "emotion"), "emotion", strict=True)[0].collect()


def test_ordered_helpers_on_a_hot_key(spark):
    rng = np.random.default_rng(3)
    rows = [(("hot" if rng.random() < 0.7 else f"k{rng.integers(0, 5)}"), i, float(rng.integers(0, 50))) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, pos int, v double")
    index = {r["pos"]: r["idx"] for r in O.global_index(df, ["k", "pos"]).collect()}
    assert [p for p, _ in sorted(index.items(), key=lambda kv: kv[1])] == [p for k, p, _ in sorted(rows, key=lambda r: (r[0], r[1]))]
    ranks = {r["pos"]: r["rn"] for r in O.keyed_rank(df, "k", "pos", "rn", partitions=9).collect()}
    newest = {r["pos"]: r["rn"] for r in O.keyed_rank(df, "k", "pos", "rn", newest_first=True, partitions=9).collect()}
    peaks = {r["pos"]: r["peak"] for r in O.carry_max(df, "k", "pos", "v", "peak", partitions=9).collect()}
    for key in {r[0] for r in rows}:
        mine = sorted((p, v) for k, p, v in rows if k == key)
        assert [ranks[p] for p, _ in mine] == list(range(1, len(mine) + 1)) and [newest[p] for p, _ in mine] == list(range(len(mine), 0, -1))
        assert [peaks[p] for p, _ in mine] == [max((v for _, v in mine[:i]), default=None) for i in range(len(mine))]
    got = {r["k"]: r for r in O.exact_quantiles(df, "v", {"m": 0.5, "q": 0.95}, "k").collect()}
    for key in {r[0] for r in rows}:
        mine = [v for k, _, v in rows if k == key]
        assert got[key]["m"] == pytest.approx(np.median(mine)) and got[key]["q"] == pytest.approx(np.quantile(mine, 0.95))


def test_salted_join_equals_broadcast_join(spark):
    left = spark.range(2000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("k"), "id")
    right = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = sorted(map(tuple, O.sized_join(left, right, "k", how).collect()), key=repr)
        b = sorted(map(tuple, O.sized_join(left, right, "k", how, limit=0).collect()), key=repr)
        assert a == b


def fold_labels(labels):
    recent, shown, out = [], None, []
    for x in labels:
        if x is None:
            recent, shown = [], None
        else:
            recent = (recent + [x])[-3:]
            shown = x if shown is None or recent.count(x) >= 2 else shown
        out.append(shown)
    return out


def test_runs_split_a_key_of_one_instant_evenly(spark):
    """A third of the rows are one key, all on one day: its rows still spread over runs like all others."""
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"), (F.col("id") % 86_400).alias("t"), "id")
    runs = [r["count"] for r in O.keyed_runs(df, "k", ["t", "id"], 24).groupBy("_part").count().collect()]
    hot = [r["count"] for r in O.keyed_runs(df, "k", ["t", "id"], 24).filter("k = 0").groupBy("_grp").count().collect()]
    assert len(hot) >= 8 and max(hot) <= max(runs) <= 2 * np.median(runs)


@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_smoothing_equals_the_fold_however_it_is_cut(spark, partitions):
    rng = np.random.default_rng(partitions)
    rows = [(f"k{k}", i, None if (x := int(rng.integers(0, 5))) == 0 else "HANS"[x - 1]) for k in range(4) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, pos int, label string")
    got = {(r["k"], r["pos"]): r["smoothed"] for r in H.smooth_labels(df, "k", "pos", "label", partitions=partitions).collect()}
    for k in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == k]
        assert [got[(k, p)] for _, p, _ in mine] == fold_labels([x for _, _, x in mine])


@pytest.mark.parametrize("partitions", [None, 3, 37])
@pytest.mark.parametrize("interval", [1, 90, 500, 50_000])
def test_throttle_equals_the_fold_however_it_is_cut(spark, partitions, interval):
    rng = np.random.default_rng(interval)
    rows = [(k, int(t), i) for k, n in ((None, 900), (1, 150), (2, 40), (3, 1), (-4, 7)) for i, t in enumerate(rng.integers(0, 20_000, n))]
    rows += [(1, 20_000 + int(t), 1_000 + i) for i, t in enumerate(rng.integers(0, 40, 300))] + [(1, None, 5_000)]
    df = spark.createDataFrame(rows, "k long, t long, event_id long")
    got = sorted(map(tuple, H.throttle(df, "k", "t", interval, order="event_id", partitions=partitions).collect()), key=repr)
    want = []
    for k in (None, 1, 2, 3, -4):
        last = None
        for row in sorted((r for r in rows if r[0] == k and r[1] is not None), key=lambda r: r[1:]):
            if last is None or row[1] - last >= interval:
                last = row[1]
                want.append(row)
    assert got == sorted(want, key=repr)


def test_bounded_histories(spark):
    df = spark.createDataFrame([("k", i, float(i)) for i in range(100)], "k string, pos int, v double")
    row = H.rolling_summary(df, "k", "pos", "v", 3).first()
    assert (row["sample_count"], row["retained_count"], row["median"]) == (100, 3, 98.0) and row["p95"] == pytest.approx(98.9)
    long_way = O.newest_rows(df, "k", "pos", 1_001, "r", partitions=7).filter("r <= 3")
    assert sorted((r["pos"], r["r"]) for r in long_way.collect()) == [(97, 3), (98, 2), (99, 1)]
    kept = H.keep_newest(df, "k", "pos", 4).collect()
    assert sorted(r["pos"] for r in kept) == [96, 97, 98, 99] and kept[0]["dropped_count"] == 96
    newest = H.latest_per_key(spark.createDataFrame([("k", 1), ("k", 2)], "k string, ts int"), "k", "ts").first()
    assert (newest["ts"], newest["replaced_count"]) == (2, 1)
