"""Connected source groups and leakage-free splits."""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoframe import settings
from sonoframe.operators.ordering import global_index, running_totals, sized_join
from sonoframe.session import checkpoint

_SEP = "\x01"


def _node(kind: str, *parts) -> Column:
    return F.concat_ws(_SEP, F.lit(kind), *[F.col(p) for p in parts])


def record_keys(df: DataFrame) -> DataFrame:
    """Add ``_anchor`` (the speaker key) and ``_keys`` (every other key of the record)."""
    present = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    optional = [
        ("augmentation", "augmentation_group_id", ("dataset_id", "augmentation_group_id")),
        ("path", "path", ("path",)),
        ("sha256", "file_sha256", ("file_sha256",)),
    ]
    source = F.when(present("source_recording_id"), F.col("source_recording_id")).otherwise(F.col("recording_id"))
    keys = [
        _node("recording", "dataset_id", "recording_id"),
        F.concat_ws(_SEP, F.lit("source_recording"), F.col("dataset_id"), source),
    ]
    keys += [F.when(present(c), _node(kind, *parts)) for kind, c, parts in optional if c in df.columns]
    return df.withColumn("_anchor", _node("speaker", "dataset_id", "speaker_id")).withColumn(
        "_keys", F.filter(F.array(*keys), lambda k: k.isNotNull())
    )


_EDGES = 1 << 18  # edges that a task contracts at once


def _contracted(batches):
    """Edges (a, b) of a partition as stars: every node but the smallest of its component points at the smallest.

    At most ``_EDGES`` edges are held; each such piece is contracted by itself.
    """
    above: dict = {}

    def top(x):
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    def stars():
        pairs = [(n, top(n)) for n in above]
        above.clear()
        pairs = [p for p in pairs if p[0] != p[1]]
        return pa.RecordBatch.from_pydict(
            {"u": pa.array([p[0] for p in pairs], pa.string()), "v": pa.array([p[1] for p in pairs], pa.string())})

    seen = 0
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = top(above.setdefault(a, a)), top(above.setdefault(b, b))
            above[max(a, b)] = min(a, b)
        seen += batch.num_rows
        if seen >= _EDGES:
            yield stars()
            seen = 0
    yield stars()


def smallest_reachable(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of an undirected edge list ``(a, b)`` of strings.

    Tasks first contract their own edges to stars before anything is shuffled; then
    large-star and small-star steps (Kiveris et al., "Connected
    components in MapReduce and beyond", 2014) alternate: each round points nodes at the
    smallest neighbour seen, so chains shrink geometrically.  A node's minimum is
    a pre-aggregated ``min``, stored before it is joined back, so that the join is a broadcast
    of a measured table or salted: a node with a third of all edges stays in no single task.
    Edges are deduplicated and checkpointed each round; small counts reach the driver.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    directed = checkpoint(edges.filter("a <> b").select("a", "b").mapInArrow(_contracted, "u string, v string").distinct())
    for _ in range(max_rounds):
        # settled: every node has one target, and no target points further
        ends = directed.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
            directed.select(F.col("v").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        unsettled = ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out > 1 or (out = 1 and into = 1)")
        if not unsettled.limit(1).count():
            break
        both = directed.unionByName(directed.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = checkpoint(sized_join(both, lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        target = checkpoint(large.groupBy("u").agg(F.min("v").alias("m")))
        small = (
            sized_join(large, target, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(target.select("u", F.col("m").alias("v")))
            .distinct()
        )
        directed = checkpoint(small)
    else:
        raise RuntimeError("connected groups did not settle; raise max_rounds")
    return nodes.join(directed.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"))


def connected_groups(df: DataFrame, *, dense: bool = True) -> DataFrame:
    """Add ``group_key`` (smallest key of the component) and dense ``group_id``.

    Records belong together when they share a speaker, recording, source
    recording, augmentation group, path or content hash.  Keys seen with one speaker
    only cannot connect anything and leave before the iteration, which then runs on
    speakers alone: each shared key ties its speakers to the smallest of them, so a
    key of a million records adds a star and no pairs.  Runs jobs.
    """
    keyed = record_keys(df)
    edges = checkpoint(keyed.select(F.col("_anchor").alias("a"), F.explode("_keys").alias("b")).distinct())
    shared = checkpoint(edges.groupBy("b").agg(F.count("*").alias("n"), F.min("a").alias("low")).filter("n > 1").select("b", "low"))
    ties = sized_join(edges, shared, "b").filter("a <> low").select("a", F.col("low").alias("b")).distinct()
    roots = smallest_reachable(ties)
    smallest = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
    anchors = smallest.join(roots, "node", "left").select("node", "m", F.coalesce("root", "node").alias("root"))
    names = anchors.groupBy("root").agg(F.min("m").alias("group_key"))
    if dense:
        names = dense_group_id(names)
    owners = anchors.join(names, "root").drop("root", "m").withColumnRenamed("node", "_anchor")
    # one row per speaker on the right: measured, then broadcast or salted
    return sized_join(keyed, checkpoint(owners), "_anchor").drop("_anchor", "_keys")


def dense_group_id(df: DataFrame, key: str = "group_key", name: str = "group_id") -> DataFrame:
    """Consecutive ids from 0 in key order, without a global window."""
    ids = global_index(df.select(key).distinct(), key, name)
    return df.join(ids, key)


# --- counting over splits and groups ----------------------------------------------
def class_counts(
    df: DataFrame, label: str = "label", domain: Sequence[str] = settings.EMOTIONS, by: Sequence[str] = ()
) -> DataFrame:
    """Count per class with zeros for absent classes, plus the absent ones as a list."""
    counted = df.groupBy(*by).agg(*[
        F.coalesce(F.count_if(F.col(label) == c), F.lit(0)).alias(f"n_{c}") for c in domain])
    absent = F.filter(
        F.array(*[F.when(F.col(f"n_{c}") == 0, F.lit(c)) for c in domain]), lambda x: x.isNotNull())
    return counted.withColumn("missing_classes", absent)


def split_summary(df: DataFrame, *, label: str = "label", group: str = "group_id", withhold: str | None = None) -> DataFrame:
    """Rows, distinct speakers, groups, per-dataset rows and class counts per split.

    ``withhold`` names a split whose class counts stay hidden.
    """
    datasets = (
        df.groupBy("split", "dataset_id").agg(F.count("*").alias("n"))
        .groupBy("split").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dataset_id", "n")))).alias("dataset_counts"))
    )
    shown = F.lit(True) if withhold is None else F.col("split") != withhold
    classes = [
        F.when(shown, F.count_if(F.col(label) == c)).alias(f"n_{c}") for c in settings.EMOTIONS]
    return (
        df.groupBy("split").agg(
            F.count("*").alias("sample_count"), F.countDistinct("dataset_id", "speaker_id").alias("speaker_count"),
            F.countDistinct(group).alias("group_count"), *classes)
        .join(datasets, "split")
    )


def split_conflicts(df: DataFrame, group: str = "group_id", split: str = "split") -> DataFrame:
    """Connected groups whose rows were preassigned to different splits."""
    return (
        df.groupBy(group, split).agg(F.count("*").alias("_n"))
        .groupBy(group).agg(F.count("*").alias("splits"), F.sum("_n").alias("rows")).filter("splits > 1")
    )


def complement(df: DataFrame, *taken: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in none of the taken sets."""
    for other in taken:
        df = df.join(other.select(key).distinct(), key, "left_anti")
    return df


def uncovered(train: DataFrame, other: DataFrame, label: str = "label") -> DataFrame:
    """Labels that occur in ``other`` and never in ``train``."""
    return other.select(label).distinct().subtract(train.select(label).distinct())


# --- splits --------------------------------------------------------------------------
def preassigned_split(df: DataFrame, *, label: str = "label", group: str = "group_id") -> DataFrame:
    """Check a table that brings its own split and return it unchanged.  Runs jobs."""
    named = F.coalesce(F.col("split").isin(*settings.SPLITS), F.lit(False))
    facts = df.agg(
        F.count_if(~named).alias("unnamed"),
        *[F.count_if(F.col("split") == s).alias(s) for s in settings.SPLITS],
        F.countDistinct(F.when(F.col("split") == "train", F.col(label))).alias("train_classes"),
    ).first()
    if facts["unnamed"]:
        raise ValueError("a preassigned split must be supplied for every record")
    if split_conflicts(df, group).limit(1).count():
        raise ValueError("a connected source group has conflicting preassigned splits")
    if any(facts[s] == 0 for s in settings.SPLITS):
        raise ValueError("a preassigned split must contain train, validation and test records")
    if facts["train_classes"] < 2:
        raise ValueError("the training split contains fewer than two classes")
    return df


def stratified_group_split(
    df: DataFrame, seed: int = 42, *, label: str = "label", group: str = "group_id", folds: int = 5
) -> DataFrame:
    """Assign whole groups to train/validation/test and add ``fold`` and ``split``.

    Groups are ordered by dominant class, then size (largest first), then a seeded
    hash, and dealt out in a snake over the folds; fold 0 validates, fold 1 tests.
    The snake starts at the last fold, so a group with a third of all rows trains.
    Only (group, class) counts are shuffled.  Runs jobs.
    """
    per_class = df.groupBy(group, label).agg(F.count("*").alias("n"))
    groups = per_class.groupBy(group).agg(
        F.max_by(label, F.struct("n", F.col(label))).alias("_class"), F.sum("n").alias("_rows"),
    ).withColumn("_larger_first", -F.col("_rows")).withColumn("_shuffle", F.xxhash64(F.lit(seed), F.col(group)))
    ordered = global_index(groups, ["_class", "_larger_first", "_shuffle", group], "_pos")
    lap, seat = F.expr(f"_pos div {folds}"), F.pmod("_pos", F.lit(folds))
    fold = F.when(lap % 2 == 0, folds - 1 - seat).otherwise(seat).cast("int")
    assigned = checkpoint(ordered.select(group, fold.alias("fold")))
    facts = assigned.agg(F.count("*").alias("groups")).first()
    if facts["groups"] < folds:
        raise ValueError(f"at least {folds} independent groups are required")
    out = sized_join(df, assigned, group).withColumn(
        "split", F.when(F.col("fold") == 0, "validation").when(F.col("fold") == 1, "test").otherwise("train"))
    seen = per_class.join(assigned, group).agg(
        F.countDistinct(label).alias("classes"),
        F.countDistinct(F.when(F.col("fold") >= 2, F.col(label))).alias("train_classes")).first()
    if seen["classes"] < 2 or seen["train_classes"] < 2:
        raise ValueError("at least two classes are required, also in the training split")
    return out


# --- validation pair selection --------------------------------------------------------
def covering_pairs(
    df: DataFrame, entity: str, label: str, classes: Sequence[str] = settings.EMOTIONS
) -> DataFrame:
    """Count, per entity, the later partners that make a usable validation pair.

    A pair ``a < b`` is usable when the two together hold every class and the rest
    of the table still holds every class.  Both conditions depend only on which
    classes an entity holds, so entities collapse to at most ``2^C`` class
    masks; counting later partners needs one running total per mask, never a
    pair of rows.  Returns ``entity, mask, partners, first_position``, where
    ``first_position`` is the position of the entity's first pair in the sorted
    list of all pairs.  Runs jobs.
    """
    bit = F.lit(0)
    for i, c in enumerate(classes):
        bit = F.when(F.col(label) == c, F.lit(1 << i)).otherwise(bit)
    masks = df.groupBy(entity).agg(F.bit_or(bit).cast("int").alias("mask"))
    masks = checkpoint(masks)
    per_mask = {r["mask"]: r["n"] for r in masks.groupBy("mask").agg(F.count("*").alias("n")).collect()}
    full, present = (1 << len(classes)) - 1, sorted(per_mask)
    holders = [sum(n for m, n in per_mask.items() if m >> i & 1) for i in range(len(classes))]

    def usable(m1: int, m2: int) -> bool:
        leaves = all(holders[i] - (m1 >> i & 1) - (m2 >> i & 1) >= 1 for i in range(len(classes)))
        return (m1 | m2) == full and leaves

    for m in present:
        masks = masks.withColumn(f"_is_{m}", (F.col("mask") == m).cast("long"))
    ranked = running_totals(masks, entity, {f"_upto_{m}": f"_is_{m}" for m in present})
    partners = F.lit(0).cast("long")
    for m1 in present:
        later = sum((F.lit(per_mask[m2]) - F.col(f"_upto_{m2}") for m2 in present if usable(m1, m2)), F.lit(0).cast("long"))
        partners = F.when(F.col("mask") == m1, later).otherwise(partners)
    counted = ranked.select(entity, "mask", partners.cast("long").alias("partners"))
    return running_totals(counted, entity, {"_total": "partners"}).select(
        entity, "mask", "partners", (F.col("_total") - F.col("partners")).alias("first_position"))


def pick_covering_pair(
    df: DataFrame, entity: str, label: str, seed: int = 42, classes: Sequence[str] = settings.EMOTIONS
) -> tuple | None:
    """The seeded choice among all usable pairs, as ``(a, b)``.  Runs jobs."""
    counted = checkpoint(covering_pairs(df, entity, label, classes))
    total = counted.agg(F.sum("partners").alias("n")).first()["n"] or 0
    if not total:
        raise ValueError("no pair of entities covers every class and leaves every class")
    position = int(np.random.default_rng(seed).integers(0, total))
    first = counted.filter((F.col("first_position") <= position) & (
        F.col("first_position") + F.col("partners") > position)).first()
    offset = position - first["first_position"]
    # class holders after removing the first entity decide which partners are usable
    wanted = [m for m in range(1 << len(classes)) if (m | first["mask"]) == (1 << len(classes)) - 1]
    holders = counted.agg(*[F.count_if(F.col("mask").bitwiseAND(F.lit(1 << i)) > 0).alias(str(i)) for i in range(len(classes))]).first()
    wanted = [m for m in wanted if all(
        holders[i] - (first["mask"] >> i & 1) - (m >> i & 1) >= 1 for i in range(len(classes)))]
    later = counted.filter((F.col(entity) > F.lit(first[entity])) & F.col("mask").isin(*wanted)).select(entity)
    second = global_index(later, entity, "_pos").filter(F.col("_pos") == offset).first()
    return first[entity], second[entity]
