"""SimHash near-duplicates by equality joins over one-wildcard segment variants (operator 6)."""

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoframe.llm.components import components
from sonoframe.llm.shared import attach, checked_columns, pieces, stored

SEED, SHINGLE, DISTANCE, BITS = 42, 3, 3, 64
SEGMENTS = 2            # 3 differing bits over 2 segments leave one segment with at most one of them
WIDTH = BITS // SEGMENTS


def fingerprint(text: bytes | None) -> int:
    """Signed 64-bit SimHash of the 3-word shingles of an encoded text; no words: zero."""
    words = (text or b"").lower().split()  # on bytes: A-Z only, and exactly space and 09-0D separate
    if not words:
        return 0
    joined, ends = b" ".join(words), list(accumulate(len(w) + 1 for w in words))
    if len(words) < SHINGLE:
        hashes = xxhash.xxh64_digest(joined, SEED)
    else:
        digest = xxhash.xxh64_digest
        hashes = b"".join([digest(joined[s:e - 1], SEED) for s, e in zip([0, *ends], ends[SHINGLE - 1:])])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, BITS)
    return int.from_bytes(np.packbits(bits.sum(axis=0, dtype=np.int32) * 2 > len(bits)).tobytes(), "big", signed=True)


def _fingerprints(batches):
    for batch in pieces(batches):
        texts = batch.column(1).cast(pa.binary())
        prints = pa.array([fingerprint(t.as_py()) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), prints, *batch.columns[2:]], ["doc_id", "fp", *batch.schema.names[2:]])


def _near(keys, prints):
    """Index pairs that join different groups: rows of one key whose fingerprints differ in at most 3 bits.

    Works on offsets of all key groups at once and drops pairs that earlier offsets have joined, so a dense group
    yields one link per row, not all its pairs.
    """
    label = np.arange(len(keys))
    variant = keys >> 32
    low = (variant // WIDTH * WIDTH).astype(np.uint64)
    alive, found = np.arange(len(keys) - 1), []
    step = 1
    while len(alive):
        alive = alive[alive + step < len(keys)]
        alive = alive[keys[alive] == keys[alive + step]]
        i, j = alive, alive + step
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
        differ = prints[i] ^ prints[j]
        close = np.bitwise_count(differ) <= DISTANCE
        # equal segments meet under every wildcard; the first one stands for all
        same = (differ >> low[i]) & np.uint64((1 << WIDTH) - 1) == 0
        close &= ~same | (variant[i] % WIDTH == 0)
        i, j = i[close], j[close]
        if len(i):
            found.append(np.stack([i, j]))
            while len(i):
                a, b = label[i], label[j]
                np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                while (label != label[label]).any():
                    label = label[label]
                apart = label[i] != label[j]
                i, j = i[apart], j[apart]
        step += 1
    return np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)


def _links(batches):
    """Links between fingerprints that share a variant; rows come sorted by key and a key never spans two partitions."""
    keys, prints = np.empty(0, np.int64), np.empty(0, np.uint64)

    def linked(end):
        i, j = _near(keys[:end], prints[:end])
        ends = [pa.array(prints[:end][k].view(np.int64)) for k in (i, j)]
        return pa.RecordBatch.from_arrays(ends, ["a", "b"])

    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
        prints = np.concatenate([prints, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        end = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last key may go on
        if end:
            yield linked(end)
            keys, prints = keys[end:], prints[end:]
    if len(keys):
        yield linked(len(keys))


def _with_components(rows: DataFrame, *beside: str) -> DataFrame:
    """``doc_id, fp``, the long columns named ``beside``, ``component_id`` and ``root``, the fingerprint that names the component, of (id, text, ...) rows."""
    prints = stored(rows.mapInArrow(_fingerprints, ", ".join(f"{c} long" for c in ("doc_id", "fp", *beside))))
    first = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    variants = first.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("v")).select(
        F.expr(f"(cast(v as long) << 32) | (shiftrightunsigned(fp, v div {WIDTH} * {WIDTH}) & 4294967295L & ~shiftleft(1L, v % {WIDTH}))").alias("key"), "fp")
    links = variants.repartition("key").sortWithinPartitions("key").mapInArrow(_links, "a long, b long")
    roots = components(links)
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    linked = stored(members.join(first, members.node == first.fp).select("fp", "root", "first"))
    smallest = stored(linked.groupBy("root").agg(F.min("first").alias("smallest")))
    named = attach(linked.select("fp", "root"), smallest, "root", "inner").select(F.col("fp").alias("linked_fp"), "root", "smallest")
    components_of = stored(first.join(named, first.fp == F.col("linked_fp"), "left").select(
        "fp", F.when(F.col("linked_fp").isNull(), F.col("first")).otherwise(F.col("smallest")).alias("component_id"), F.coalesce("root", "fp").alias("root")))
    return attach(prints, components_of, "fp").select("doc_id", "fp", *beside, "component_id", "root")


def simhash_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` of every row: documents linked by fingerprints at 3 or fewer differing bits.

    All fingerprints are compared once per distinct value, however many copies a text has.  Each is indexed under 64
    keys, a 32-bit half with one bit masked; two fingerprints within 3 bits share a half up to one bit and so meet under a key,
    where the whole distance is verified.  Nothing is capped.

    Null and blank texts have the fingerprint zero and link to each other like any other; very long texts count whole.  Rows that repeat
    an id stay separate rows.  A null id keeps its fingerprint and gets its component's smallest id, null
    if it has none.  An empty table gives an empty result; further columns are not carried.
    """
    rows = checked_columns(docs, id_column, text_column).select(F.col(id_column).cast("long"), F.col(text_column).cast("string"))
    return _with_components(rows).drop("root")


def keep_one_per_component(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row of every component, that with the smallest id; columns stay.

    Rows are told apart by id and text.  Of rows of one component that repeat its smallest id, the one with the smallest hash of its
    text stays, and of equal texts one row; a row whose id also belongs to a near-copy stays if its own text is near no other.
    Rows without an id stay, as no other row can stand for them.  Null, blank and very long texts are compared like any other, an empty
    table gives an empty result, and further columns pass through under any name.
    """
    number, text = F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").cast("string")
    digest = F.xxhash64(text).alias("digest")
    found = stored(_with_components(docs.select(number, text.alias("text"), digest), "digest"))
    dropped = stored(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest")).distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("row"), number, digest)  # as one column, so that no name can clash
    kept = attach(rows, dropped, (F.col("id") == F.col("gone_id")) & (F.col("digest") == F.col("gone_digest")), "left_anti")
    smallest = found.filter("doc_id = component_id")
    repeated = stored(smallest.groupBy("doc_id", "root").agg(F.count("*").alias("n"), F.min("digest").alias("least")).filter("n > 1").drop("n"))
    if not repeated.isEmpty():
        named = stored(attach(smallest.select("doc_id", "root", "digest"), repeated, ["doc_id", "root"], "inner").select(
            F.col("doc_id").alias("same_id"), F.col("digest").alias("same_digest"), (F.col("digest") == F.col("least")).alias("stays")).distinct())
        marked = attach(kept, named, (F.col("id") == F.col("same_id")) & (F.col("digest") == F.col("same_digest")))
        one = marked.filter("stays").groupBy("id", "digest").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
        kept = marked.filter("stays is null").select("row").unionByName(one.select("row"))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
