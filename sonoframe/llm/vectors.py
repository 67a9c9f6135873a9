"""Valid vectors, query blocks of bounded size and top-k merging, shared by the vector searches."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoframe.llm.shared import stored

QUERY_BLOCK = 16_384    # queries sent to the executors at once
SEEDS = 2_048           # candidates that give every query a first bound


def valid_vectors(df: DataFrame, id_column: str, vector_column: str, keep_zero: bool) -> DataFrame:
    """``vec_id, v`` of the rows whose vector is there, not empty and finite throughout."""
    rows = df.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.col(f"`{vector_column}`").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~bad)
    return rows if keep_zero else rows.filter(F.exists("v", lambda x: x != 0))


def matrix(column) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.empty((0, 0))


def collected(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a table of bounded size."""
    table = df.toArrow()
    return table.column("vec_id").to_numpy(), matrix(table.column("v").combine_chunks())


def query_blocks(rows: DataFrame, is_query: Column):
    """The queries in blocks of about ``QUERY_BLOCK``, ids and vectors."""
    queries = stored(rows.filter(is_query).select("vec_id", "v"))
    blocks = -(-queries.count() // QUERY_BLOCK)
    for b in range(blocks):
        yield collected(queries.filter(F.pmod(F.xxhash64(F.lit("block"), "vec_id"), F.lit(blocks)) == b))


class Best:
    """The k best (score, id) of every query so far, small scores first; an id counts once for a query.

    Scores are kept in the type given, ``bound`` as a double: whole scores beyond 2^53 are ordered exactly, their bounds are not.
    """

    def __init__(self, n: int, k: int, bound: np.ndarray, kind=np.float64):
        self.k, self.bound = k, bound.copy()
        self.ids, self.s, self.n = np.zeros((n, k), np.int64), np.zeros((n, k), kind), np.zeros(n, np.int64)

    def _held(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        there = np.arange(self.k) < self.n[rows][:, None]
        return np.repeat(rows, self.n[rows]), self.ids[rows][there], self.s[rows][there]

    def add(self, q, ids, s) -> None:
        """Merge new pairs; only the queries that they belong to are sorted again."""
        if not len(q):
            return
        q, ids, s = [np.concatenate(x) for x in zip(self._held(np.unique(q)), (q, ids, s))]
        order = np.lexsort((s, ids, q))
        q, ids, s = q[order], ids[order], s[order]
        first = np.concatenate([[True], (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])])
        q, ids, s = q[first], ids[first], s[first]
        order = np.lexsort((ids, s, q))
        q, ids, s = q[order], ids[order], s[order]
        starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        sizes = np.diff(np.append(starts, len(q)))
        rank = np.arange(len(q)) - np.repeat(starts, sizes)
        self.n[q[starts]] = np.minimum(sizes, self.k)
        kept = rank < self.k
        self.ids[q[kept], rank[kept]], self.s[q[kept], rank[kept]] = ids[kept], s[kept]
        full = rank == self.k - 1
        self.bound[q[full]] = np.minimum(self.bound[q[full]], s[full])

    def batch(self, query_ids, sign: int) -> pa.RecordBatch:
        q, ids, s = self._held(np.arange(len(self.n)))
        return pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(ids), pa.array(sign * s)], ["query_id", "vec_id", "score"])


FOUND = "query_id long, vec_id long, score double"


def ranked(found: DataFrame, k: int, *, largest_first: bool = False) -> DataFrame:
    """The k best of what the tasks found, at most k rows a query from each; ties to the smaller id."""
    found = found.groupBy("query_id", "vec_id").agg((F.max if largest_first else F.min)("score").alias("score"))
    order = F.desc("score") if largest_first else F.asc("score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
