"""Mixing sources to target weights by subset-sum budget fitting over document lengths (operator 9)."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoframe.llm.shared import attach, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1.0, 2.0, 3.0)   # of the sources in code point order, repeating
MOST = 3                    # times that a source and each of its documents may be used
WINDOW = 1 << 16            # words of a source's budget that the dynamic programme fits; a working-set bound
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST, total_share: float = 1.0) -> DataFrame:
    """``source, source_size, target``: a row per source from its ``source, source_size`` row.

    The budget is shared by weight.  A target stops at ``most`` times its source's size; what is over is shared among
    the others by weight until none is above.  Only sums over the sources reach the driver.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")  # one narrow row per source
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = stored(sizes.withColumn("weight", weight))
    cap = F.col("source_size") * most
    budget = total_share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, None
    while True:  # the level only rises, so sources once full stay full
        is_full = cap <= F.col("weight") * level
        spent, open_weight, now = rows.agg(F.sum(F.when(is_full, cap)), F.sum(F.when(~is_full, F.col("weight"))), F.count(F.when(is_full, 1))).first()
        if now == full or not open_weight:
            break
        full, level = now, (budget - (spent or 0)) / open_weight
    target = F.when((cap <= F.col("weight") * level) | F.lit(not open_weight), cap.cast("double")).otherwise(F.col("weight") * level)
    return rows.select("source", "source_size", target.alias("target"))


def closest_subset(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their sum is as close to the budget as can be.

    Bounded-knapsack dynamic programming over sums up to twice the budget, each count in binary pieces.  A sum remembers the
    piece that first reached it, which is enough to backtrack because earlier pieces reached the rest.  Ties go to the smaller sum.
    """
    taken = np.zeros(len(lengths), np.int64)
    if budget <= 0:
        return taken
    limit, reached, pieces = 2 * budget + 1, 1, []
    by_piece = np.full(limit, -1, np.int64)
    for i in range(len(lengths)):
        left, times = min(int(counts[i]), (limit - 1) // int(lengths[i])), 1
        while left and not reached >> budget & 1:
            times = min(times, left)
            new = (reached << times * int(lengths[i])) & ((1 << limit) - 1) & ~reached
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes((limit + 7) // 8, "little"), np.uint8), bitorder="little")
                by_piece[np.flatnonzero(bits)] = len(pieces)
                pieces.append((i, times))
                reached |= new
            left, times = left - times, 2 * times
    sums = np.flatnonzero(by_piece >= 0)
    sums = np.append(sums, 0)
    at = int(min(sums, key=lambda s: (abs(s - budget), s)))
    while at:
        i, times = pieces[by_piece[at]]
        taken[i] += times
        at -= times * int(lengths[i])
    return taken


def plan_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = WINDOW) -> np.ndarray:
    """Documents to take of each length for a budget of words below their sum.

    All but about a window of the budget is taken in proportion from every length, which keeps the mix of lengths; the
    rest is fitted by ``closest_subset`` over what is left.
    """
    taken = np.zeros(len(lengths), np.int64)
    use = lengths > 0
    size = int((lengths * counts).sum())
    if size == 0 or budget <= 0:
        return taken
    reach = max(window, int(lengths.max()))
    part = max(0, budget - reach) / size
    taken[use] = np.floor(counts[use] * part).astype(np.int64)
    rest = budget - int((taken * lengths).sum())
    # flooring leaves up to one document of each length open: take these while they are surely needed
    for i in np.flatnonzero(use & (counts > taken))[::-1]:
        if rest - lengths[i] < reach:
            continue
        taken[i] += 1
        rest -= int(lengths[i])
    order = np.flatnonzero(use & (counts > taken))[::-1]
    taken[order] += closest_subset(lengths[order], (counts - taken)[order], rest)
    return taken


def _plans(window: int):
    """Kernel: a source's rows (length, number of documents, target) to the number of documents used once more."""

    def run(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("size", kind="stable")
        lengths, counts = table["size"].to_numpy(np.int64), table["n"].to_numpy(np.int64)
        size = int(table["source_size"].iloc[0])
        target = float(table["target"].iloc[0])
        whole = int(target // size) if size else 0
        table["whole"] = np.int64(whole)
        table["extra"] = plan_lengths(lengths, counts, round(target - whole * size), window)
        return table

    return run


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights=WEIGHTS,
        most: int = MOST, total_share: float = 1.0, seed: str = SEED, window: int = WINDOW) -> DataFrame:
    """A row per document with the number of times that the mix uses it.

    Columns ``doc_id, source, size, source_size, target, times, taken``; size is the words of the text, taken ``times * size``.
    Each source uses all its documents as often as its target holds all of them, and some once more: how many of each exact
    length is a subset-sum problem over the (length, count) table, which has a row per distinct length.  Which documents of a length are used is drawn
    by a seeded hash of id and text, so reruns agree.

    Null texts count 0 words, and so do empty ones; they take nothing, and ``times`` is what the whole source is used.  A null source is a source of its own, last in order.  Rows that repeat an id
    are documents of their own; if they are equal, which of them is used once more makes no difference.  An
    empty table gives an empty result; further columns are not carried.
    """
    return _mix(docs, id_column, text_column, source_column, weights, most, total_share, seed, window).drop("chance")


def _chance(id_column: str, text_column: str, seed: str) -> Column:
    return F.xxhash64(F.lit(seed), F.col(f"`{id_column}`"), F.col(f"`{text_column}`"))


def _mix(docs: DataFrame, id_column: str, text_column: str, source_column: str, weights, most: int, total_share: float, seed: str, window: int) -> DataFrame:
    """The rows of ``mix`` with the ``chance`` that id and text give a document."""
    chance = _chance(id_column, text_column, seed)
    sized = stored(docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{source_column}`").alias("source"),
                               word_count(F.col(f"`{text_column}`")).alias("size"), chance.alias("chance")))
    lengths = stored(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    targets = source_targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most, total_share)
    targets = stored(targets.withColumnRenamed("source", "of_source"))
    known = attach(lengths, targets, F.col("source").eqNullSafe(F.col("of_source")), "inner").drop("of_source")
    planned = T.StructType([*known.schema.fields, T.StructField("whole", T.LongType()), T.StructField("extra", T.LongType())])
    plan = stored(known.groupBy("source").applyInPandas(_plans(window), planned)
                  .withColumnsRenamed({"source": "of_source", "size": "of_size"}))
    # a length with some documents to choose is dealt into about sqrt(n) buckets of as many, by hash order
    buckets = F.ceil(F.sqrt("n")).cast("long")
    bucket = F.floor((F.shiftrightunsigned("chance", 33) / F.lit(float(1 << 31))) * buckets).cast("long")
    joined = stored(attach(sized, plan, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("size") == F.col("of_size")), "inner")
                    .select("doc_id", "source", "size", "chance", "source_size", "target", "whole", "extra", "n", bucket.alias("bucket")))
    some = joined.filter("extra > 0 and extra < n")
    key = ["source", "size", "bucket"]
    held = some.groupBy(*key).agg(F.count("*").alias("held"), F.first("extra").alias("extra"))
    before = F.sum("held").over(Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    edge = stored(held.withColumn("before", F.coalesce(before, F.lit(0))).select(
        F.col("source").alias("e_source"), F.col("size").alias("e_size"), F.col("bucket").alias("e_bucket"), "held", "before"))
    match = F.col("source").eqNullSafe(F.col("e_source")) & (F.col("size") == F.col("e_size")) & (F.col("bucket") == F.col("e_bucket"))
    placed = attach(some, edge, match, "inner")
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("chance", "doc_id"))
    cut = placed.filter("before < extra and before + held > extra").withColumn("more", (F.col("before") + rank <= F.col("extra")).cast("long"))
    whole = placed.filter("before >= extra or before + held <= extra").withColumn("more", (F.col("before") < F.col("extra")).cast("long"))
    plain = joined.filter("extra <= 0 or extra >= n").withColumn("more", (F.col("extra") > 0).cast("long"))
    out = ["doc_id", "source", "size", "source_size", "target", "whole", "more", "chance"]
    both = plain.select(out).unionByName(whole.select(out)).unionByName(cut.select(out))
    return both.withColumn("times", F.col("whole") + F.col("more")).withColumn("taken", F.col("times") * F.col("size")).drop("whole", "more")


def mixed_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", *, weights=WEIGHTS,
                    most: int = MOST, total_share: float = 1.0, seed: str = SEED, window: int = WINDOW) -> DataFrame:
    """``docs`` with every row as often as the mix uses it, columns as they were, under any name.

    Rows are told apart by id, text and source.  Rows equal in all three share their uses evenly, what is left over by a hash of the whole row, so
    reruns agree.  Null and empty texts have no words; they come as often as their whole source does.  A null source or id is one of its own.  Very long texts are taken
    whole or not at all.  An empty table gives an empty result.
    """
    uses = _mix(docs, id_column, text_column, source_column, weights, most, total_share, seed, window)
    names = {"doc_id": "mixed_id", "source": "mixed_source", "chance": "mixed_chance"}
    uses = stored(uses.groupBy(*names).agg(F.sum("times").alias("uses"), F.count("*").alias("rows")).filter("uses > 0").withColumnsRenamed(names))
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns])  # as one column, so that no name can clash
    rows = docs.select(row.alias("row"), F.col(f"`{id_column}`").alias("id"), F.col(f"`{source_column}`").alias("source"), _chance(id_column, text_column, seed).alias("chance"))
    same = F.col("id").eqNullSafe(F.col("mixed_id")) & F.col("source").eqNullSafe(F.col("mixed_source")) & (F.col("chance") == F.col("mixed_chance"))
    used = attach(rows, uses, same, "inner")
    times = used.select("row", F.col("uses").alias("times"))
    if not uses.filter("rows > 1").isEmpty():
        rank = F.row_number().over(Window.partitionBy("id", "source", "chance").orderBy(F.xxhash64(F.to_json("row"))))
        shared = used.filter("rows > 1").withColumn("rank", rank).select("row", F.expr("uses div rows + if(rank <= uses % rows, 1, 0)").alias("times"))
        times = used.filter("rows = 1").select("row", F.col("uses").alias("times")).unionByName(shared)
    copies = times.filter("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return copies.select(*[F.col("row")[c].alias(c) for c in docs.columns])
