"""Vector code compression: product codes learned and assigned by limb-split exact matrix products (operator 11)."""

import hashlib
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoframe.llm.shared import attach, pieces, stored
from sonoframe.llm.vectors import matrix

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024.0
PIECE = 2_048           # vectors compared at a time
DOUBLE_BITS = 52        # sums of limb products stay within this many bits, one below what a double holds exactly
LONG_MAX = 2**63 - 1
_SUMS = "part int, entry int, place int, n long, total decimal(38,0)"


def integers(x: np.ndarray, scale: float = SCALE) -> np.ndarray:
    """``floor(scale * x)``, as 64-bit integers, or as Python integers where one is beyond 62 bits."""
    if np.abs(x).max(initial=0) * scale < 2.0**62:
        return np.floor(x * scale).astype(np.int64)
    # a double of 2^53 and more is whole itself, and its product may be beyond every double
    whole = [int(v) * int(scale) if abs(v) >= 2.0**53 and scale == int(scale) else int(np.floor(v * scale)) for v in x.ravel().tolist()]
    return np.array(whole, object).reshape(x.shape)


def _largest(m: np.ndarray) -> int:
    return max(int(m.max()), -int(m.min())) if m.size else 0


def _limbs(m: np.ndarray, bits: int) -> list[np.ndarray]:
    """``m`` as doubles of ``bits`` bits each, lowest first; the last one carries the sign."""
    limbs, size = [], _largest(m)
    while size >> bits:
        limbs.append((m & ((1 << bits) - 1)).astype(np.float64))
        m, size = m >> bits, (size >> bits) + 1
    return [*limbs, m.astype(np.float64)]


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of 64-bit integer rows: one double-precision matrix product per pair of limbs, added up in 64 bits."""
    bits = (DOUBLE_BITS - (max(1, a.shape[1]) - 1).bit_length()) // 2
    total = np.zeros((len(a), len(b)), np.int64)
    for i, x in enumerate(_limbs(a, bits)):
        for j, y in enumerate(_limbs(b, bits)):
            total += (x @ y.T).astype(np.int64) << np.int64(bits * (i + j))
    return total


def nearest(a: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of ``book`` for every row, the first of several, and the squared distance."""
    if a.shape[1] * (2 * max(_largest(a), _largest(book))) ** 2 > LONG_MAX:  # only here distances need more than 64 bits
        a, book = a.astype(object), book.astype(object)
        products = a @ book.T
    else:
        products = exact_products(a, book)
    away = (a * a).sum(axis=1)[:, None] - 2 * products + (book * book).sum(axis=1)[None, :]
    index = np.argmin(away, axis=1)
    return index, away[np.arange(len(a)), index]


def _cuts(size: int, parts: int) -> list[tuple[int, int]]:
    return [(size * p // parts, size * (p + 1) // parts) for p in range(parts)]


def _vectors(batches, column: int):
    for batch in pieces(batches, PIECE):
        yield batch, matrix(batch.column(column))


def _part_sums(books, scale: float):
    """Kernel: for every entry of every codebook, count and componentwise sum of the parts that a task assigns to it."""

    def run(batches):
        sums = {}
        for _, x in _vectors(batches, 0):
            whole = integers(x, scale)
            for p, (start, end) in enumerate(_cuts(whole.shape[1], len(books.value))):
                own = whole[:, start:end]
                index, _ = nearest(own, books.value[p])
                order = np.argsort(index, kind="stable")
                first = np.flatnonzero(np.concatenate([[True], np.diff(index[order]) > 0])) if len(order) else order
                for entry, n, total in zip(index[order][first], np.diff(np.append(first, len(order))), np.add.reduceat(own[order], first, axis=0) if len(order) else ()):
                    had = sums.get((p, int(entry)), (0, 0))
                    sums[p, int(entry)] = had[0] + int(n), had[1] + total.astype(object)
        for (p, entry), (n, total) in sums.items():
            places = len(total)
            if places:
                yield pa.RecordBatch.from_arrays([
                    pa.array([p] * places, pa.int32()), pa.array([entry] * places, pa.int32()), pa.array(range(places), pa.int32()),
                    pa.array([n] * places, pa.int64()), pa.array([Decimal(v) for v in total], pa.decimal128(38, 0))], ["part", "entry", "place", "n", "total"])

    return run


def _coded(books, scale: float):
    """Kernel: code and error of every vector, beside the columns that came with it."""

    def run(batches):
        for batch, x in _vectors(batches, 0):
            whole = integers(x, scale)
            codes, error = [], 0
            for p, (start, end) in enumerate(_cuts(whole.shape[1], len(books.value))):
                index, away = nearest(whole[:, start:end], books.value[p])
                codes.append(index)
                error = error + away.astype(object)
            text = [bytes(c).hex() for c in np.stack(codes, axis=1).astype(np.uint8)]
            error = pa.array([min(int(e), LONG_MAX) for e in error], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(text, pa.string()), error, batch.column(2)], ["vec_id", "code", "error", "label"])

    return run


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' integers in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join([str(int(v)) for book in books for v in book.ravel()]).encode()).hexdigest()


def fit_books(rows: DataFrame, size: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> list[np.ndarray]:
    """Codebooks of the vectors ``x`` of one size: first those of the smallest ids, then ``rounds`` of assigning and averaging.

    A round is one pass in which each task sums the parts of every entry; only ``parts * entries`` sums reach the driver.
    """
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").toArrow().column("x").combine_chunks()
    start = integers(matrix(first).reshape(len(first), size), scale)
    books = [start[:, a:b] for a, b in _cuts(size, parts)]
    for _ in range(rounds):
        sent = rows.sparkSession.sparkContext.broadcast(books)
        sums = rows.select("x").mapInArrow(_part_sums(sent, scale), _SUMS).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        books = [book.astype(object) for book in books]
        for r in sums.collect():
            books[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
        books = [book.astype(np.int64) if _largest(book) < 2**62 else book for book in books]
        sent.destroy()
    return books


def encode(
    rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str | None = "label", *,
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE,
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every vector that can be coded.

    Components become ``floor(scale * x)`` and vectors are cut into ``parts`` consecutive parts, equal ones where the size
    allows it.  A part's code is the index of the nearest of its codebook's at most 256 entries, by exact squared distance and the lower
    index on ties, as two hex digits; ``error`` sums the squared distances and ``label_error`` the errors of equal labels.
    Inner products come from double-precision matrix products of integer limbs so narrow that no sum passes 2^53, and are
    put together in 64-bit integers; vectors too long for 64-bit distances are compared in Python integers.

    Rows whose vector is null or holds null or non-finite components are left out.  Vectors of different sizes have
    codebooks of their own.  An empty vector has code zero and no error.  Of rows that repeat an id the smaller vectors come
    first among the first entries, and null ids come last; such rows take part like others.  With fewer vectors than
    entries, codebooks are shorter.  Null labels are one label; without a label column ``label_error`` sums over all.  Errors stop at the end of 64
    bits, and sums of a component beyond 38 digits raise.  An empty table gives an empty result; further columns are not carried.
    """
    if not 1 <= entries <= 256:
        raise ValueError("two hex digits name 1 to 256 entries")
    spark = rows.sparkSession
    label = F.lit(None).cast("int") if label_column is None else F.col(f"`{label_column}`")
    read = rows.select(F.col(f"`{vector_column}`").cast("array<double>").alias("x"), F.col(f"`{id_column}`").cast("long").alias("vec_id"), label.alias("label"))
    bad: Column = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = stored(read.filter(F.col("x").isNotNull() & ~bad))
    found = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), T.StructField("label", kept.schema["label"].dataType)])
    coded = [spark.createDataFrame([], found).withColumn("codebooks_sha256", F.lit(""))]
    for (size,) in kept.select(F.size("x")).distinct().collect():
        same = kept.filter(F.size("x") == size)
        books = fit_books(same, size, parts, entries, rounds, scale)
        sent = spark.sparkContext.broadcast(books)
        coded.append(same.mapInArrow(_coded(sent, scale), found).withColumn("codebooks_sha256", F.lit(books_digest(books))))
    codes = stored(reduce(DataFrame.unionByName, coded))
    per_label = stored(codes.groupBy(F.col("label").alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum")))
    held = F.least("_sum", F.lit(str(LONG_MAX)).cast("decimal(38,0)")).cast("long").alias("label_error")
    return attach(codes, per_label, codes["label"].eqNullSafe(per_label["_label"]), "inner").select("vec_id", "code", "error", held, "codebooks_sha256")
