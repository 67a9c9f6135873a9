"""Exact duplicates by an extendible-hash index on shared files (operator 13)."""

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoframe.llm.shared import attach, forget, pieces, stored

CAPACITY = 16_384        # index entries of a bucket; a fuller one is split
DEPTH = 24               # bits that the directory may use; entries that still overfill a bucket stay chained in it
OWNER_BYTES = 64 << 20   # what one owner task reads
HELD = 32 << 20          # bytes of texts that a scanning task compares with at a time
FAN = 1_024              # entries of one key that an owner takes at once; more of them meet in salted groups first
_ENTRY_BYTES = 64        # of an entry without its text

_INDEXED = "row long, doc_id long, entry long, sha binary, key long, text binary, n long, best_id long, best_row long"
_CHAINED = "entry long, head long, n long, best_id long, best_row long"


def normalised(text: bytes | None) -> bytes:
    """The text with A-Z lower-cased, all other bytes as they are; null is empty."""
    return (text or b"").lower()


def _rank(doc_id: int | None, row: int) -> tuple:
    """The greater stays: the largest id, null ids last, and of rows with one id the first row."""
    return (doc_id is not None, doc_id or 0, -row)


def _scanned(key_bits: int, held_bytes: int):
    """Kernel: a row for every document, and an index entry for every text that differs from the texts before it.

    Equal keys are compared byte by byte, so a text that repeats within a stretch of ``held_bytes`` gives one entry.
    """
    names = [f.split()[0] for f in _INDEXED.split(", ")]
    types = [pa.binary() if " binary" in f else pa.int64() for f in _INDEXED.split(", ")]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def run(batches):
        chains, held = {}, 0  # key: [text, entry, digest, n, best_id, best_row] of each text

        def entries():
            flat = [(key, e) for key, chain in chains.items() for e in chain]
            for at in range(0, len(flat), 256):
                yield table([(None, None, e[1], None, key, *e[:1], *e[3:]) for key, e in flat[at:at + 256]])

        for batch in pieces(batches, 256):
            out = []
            for row, doc, text in zip(*[c.to_pylist() for c in (batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()))]):
                text = normalised(text)
                key = xxhash.xxh3_64_intdigest(text) >> (64 - key_bits) << (64 - key_bits)
                key -= (key >> 63) << 64
                chain = chains.setdefault(key, [])
                for e in chain:
                    if e[0] == text:
                        break
                else:
                    e = [text, row, hashlib.sha256(text).digest(), 0, doc, row]
                    chain.append(e)
                    held += len(text) + 200
                e[3] += 1
                if _rank(doc, row) > _rank(e[4], e[5]):
                    e[4], e[5] = doc, row
                out.append((row, doc, e[1], e[2], None, None, None, None, None))
            if out:
                yield table(out)
            if held > held_bytes:
                yield from entries()
                chains.clear()
                held = 0
        yield from entries()

    return run


def _chains(batches):
    """Kernel: entries sorted by group (key, group, entry, text, n, best_id, best_row); chain those of a group and compare their bytes.

    Every entry gets the first entry with its text as its head, and the sum and best row of all with it.  An entry without
    a text has a key of its own.
    """

    def rows_of(chains):
        for text, entries, n, best_id, best_row in chains:
            for entry in entries:
                yield entry, entries[0], n, best_id, best_row

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], [f.split()[0] for f in _CHAINED.split(", ")])

    group, chains, out = None, [], []
    for batch in pieces(batches, 256):
        for key, part, entry, text, n, best_id, best_row in zip(*[c.to_pylist() for c in batch.columns]):
            if (key, part) != group:
                out += rows_of(chains)
                group, chains = (key, part), []
            for chain in chains:
                if chain[0] == text:
                    chain[1].append(entry)
                    chain[2] += n
                    if _rank(best_id, best_row) > _rank(chain[3], chain[4]):
                        chain[3], chain[4] = best_id, best_row
                    break
            else:
                chains.append([text, [entry], n, best_id, best_row])
        if len(out) > 4_096:
            yield table(out)
            out = []
    out += rows_of(chains)
    if out:
        yield table(out)


def _prefix(key: Column, bits: int, of: int = 64) -> Column:
    """The first ``bits`` bits of a number of ``of`` bits."""
    return F.shiftrightunsigned(key, of - bits)


def directory(entries: DataFrame, capacity: int = CAPACITY, depth: int = DEPTH) -> tuple[DataFrame, int]:
    """The index directory over ``key, bytes``: ``slot, bucket, local_depth, n, bytes``, and its depth in bits; stored.

    One pass counts the entries by their first ``depth`` bits.  Then the directory doubles from a single bucket on: each
    round looks at one bit more and splits the buckets that hold more than ``capacity`` entries, until none does or
    ``depth`` is reached.  ``bucket`` is the first slot of a bucket, counted in slots of ``depth`` bits.  The directory has two slots at least.
    """
    counted = stored(entries.groupBy(_prefix(F.col("key"), depth).alias("fine")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    whole = F.lit(0).cast("long").alias("bucket"), F.lit(0).alias("local_depth")
    left, closed, bits = counted, [counted.select("fine", *whole, "n", "bytes").filter(F.lit(total <= capacity))], 1
    while total > capacity:
        at = _prefix(F.col("fine"), bits, depth)
        full = stored(left.groupBy(at.alias("prefix")).agg(F.sum("n").alias("all")).filter((F.col("all") > capacity) & F.lit(bits < depth)))
        beside = attach(left.withColumn("prefix", at), full, "prefix")
        closed.append(beside.filter("all is null").select("fine", (F.col("prefix") * (1 << (depth - bits))).alias("bucket"), F.lit(bits).alias("local_depth"), "n", "bytes"))
        if full.isEmpty():
            break
        left, bits = stored(beside.filter("all is not null").select("fine", "n", "bytes")), bits + 1
    buckets = closed[0]
    for more in closed[1:]:
        buckets = buckets.unionByName(more)
    slots = buckets.groupBy(_prefix(F.col("fine"), bits, depth).alias("slot"), "bucket", "local_depth").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    return stored(slots), bits


def _owners(slots: DataFrame) -> tuple[DataFrame, int]:
    """``slot, owner``: runs of buckets in key order, dealt to owner tasks by their bytes; as many rows as the directory."""
    total, buckets = slots.agg(F.sum("bytes"), F.countDistinct("bucket")).first()
    if not buckets:
        return slots.select("slot", F.lit(0).alias("owner")), 1
    owners = max(min(buckets, 3 * slots.sparkSession.sparkContext.defaultParallelism), -(-total // OWNER_BYTES))
    sizes = slots.groupBy("bucket").agg(F.sum("bytes").alias("bytes"))
    upto = F.expr("sum(bytes) over (order by bucket rows between unbounded preceding and current row)")
    numbered = sizes.select("bucket", F.floor((upto - F.col("bytes")) * F.lit(float(owners)) / F.lit(float(total))).cast("int").alias("owner"))
    return stored(attach(slots, stored(numbered), "bucket", "inner").select("slot", F.least("owner", F.lit(owners - 1)).alias("owner"))), owners


def exact_groups(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, capacity: int = CAPACITY, fan: int = FAN, key_bits: int = 64, held_bytes: int = HELD,
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row; of equal texts the row with the largest id stays.

    Texts are equal when they have the same bytes after lower-casing A-Z; a null text is an empty one.  A first pass writes the index
    entries to shared files, one for each text of a task, with the task's own repeats counted in.  A directory that doubles
    until no bucket is overfull deals the entries out by the first bits of their 64-bit keys; each owner task reads one
    key range, chains the entries of a key and compares the bytes of those that share it.  Texts only travel for keys
    with several entries.  A text with more than ``fan`` entries meets in salted groups first, so a third of all rows in one group of copies
    costs its owner one row per salt.

    Every row is returned, in rows that repeat an id too: of such rows with one text the first read stays.  Null ids
    come after all others, and ``keep_id`` is null where a group has no id.  An empty table gives an empty result, and further
    columns are not carried.  ``key_bits`` narrows keys for tests, so that different texts collide.
    """
    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    files = stored(read.mapInArrow(_scanned(key_bits, held_bytes), _INDEXED))
    rows = files.filter("row is not null").select("row", "doc_id", "entry", "sha")
    entries = files.filter("key is not null").select("key", "entry", "text", "n", "best_id", "best_row")
    shared = stored(entries.groupBy("key").agg(F.count("*").alias("sharers")).filter("sharers > 1"))

    wide, narrowed = shared.filter(F.col("sharers") > fan), None
    if not wide.isEmpty():
        # entries of a frequent text: groups of about the square root of their number, then one entry from each group
        salted = attach(entries, stored(wide), "key", "inner").withColumn("part", F.pmod(F.xxhash64("entry"), F.ceil(F.sqrt("sharers"))).cast("long"))
        dealt = salted.select("key", "part", "entry", "text", "n", "best_id", "best_row").repartition("key", "part").sortWithinPartitions("key", "part", "entry")
        narrowed = stored(dealt.mapInArrow(_chains, _CHAINED))
        heads = narrowed.filter("entry = head").select(F.col("entry").alias("head"), F.col("n").alias("all"), F.col("best_id").alias("id"), F.col("best_row").alias("at"))
        others = narrowed.filter("entry <> head").select("entry", F.lit(True).alias("gone"))
        left = attach(entries, stored(others), "entry").filter("gone is null").drop("gone")
        entries = stored(attach(left, stored(heads), F.col("entry") == F.col("head")).select(
            "key", "entry", "text", F.coalesce("all", "n").alias("n"),
            F.when(F.col("all").isNull(), F.col("best_id")).otherwise(F.col("id")).alias("best_id"), F.coalesce("at", "best_row").alias("best_row")))

    marked = attach(entries, shared, "key").withColumn("text", F.when(F.col("sharers").isNotNull(), F.col("text"))).drop("sharers")
    slots, bits = directory(marked.select("key", (F.coalesce(F.length("text"), F.lit(0)) + _ENTRY_BYTES).cast("long").alias("bytes")), capacity)
    owned, owners = _owners(slots)
    placed = attach(marked.withColumn("slot", _prefix(F.col("key"), bits)), owned, "slot", "inner")
    ranges = placed.select("owner", "key", F.lit(0).cast("long").alias("part"), "entry", "text", "n", "best_id", "best_row").repartitionById(owners, "owner")
    chained = stored(ranges.drop("owner").sortWithinPartitions("key", "entry").mapInArrow(_chains, _CHAINED).filter("n > 1"))

    if narrowed is not None:
        heads = chained.select(F.col("entry").alias("of"), F.col("n").alias("all"), F.col("best_id").alias("id"), F.col("best_row").alias("at"))
        others = attach(narrowed.filter("entry <> head").select("entry", "head"), stored(heads), F.col("head") == F.col("of"), "inner")
        chained = stored(chained.select("entry", "n", "best_id", "best_row").unionByName(others.select("entry", F.col("all").alias("n"), F.col("id").alias("best_id"), F.col("at").alias("best_row"))))
    forget(shared)
    groups = chained.select("entry", F.col("n").alias("size"), "best_id", "best_row")
    alone = F.col("size").isNull()
    return attach(rows, groups, "entry").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"), F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("best_row"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
