"""Exact top-k inner products over norm-sorted, rotated vectors (operator 8)."""

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoframe.llm.shared import stored
from sonoframe.llm.vectors import SEEDS, Best, collected, matrix, query_blocks, ranked, valid_vectors

HEAD = 16          # rotated components summed before the residual bound is asked
PIECE = 2_048      # candidates compared at a time
EXACT = 2.0**52    # products below are exact in double precision
PRODUCTS = "query_id long, vec_id long, score long"


def _floor(x: Column) -> Column:
    """Floor of a double as a double; one of 2^52 and more is whole, and may be beyond every long."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(F.least(F.greatest(x, F.lit(-1e308)), F.lit(1e308)))


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-number vectors as 64-bit integers, exact; beyond double precision by Python integers, held to 63 bits and sign."""
    if np.linalg.norm(a, axis=1).max(initial=0) * np.linalg.norm(b, axis=1).max(initial=0) < EXACT:
        return np.rint(a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return np.clip(whole(a) @ whole(b).T, 1 - 2**63, 2**63 - 1).astype(np.int64)


def _gram(batches):
    """Kernel: a partition's part of the sum of outer products, a row per dimension."""
    total = None
    for batch in batches:
        v = matrix(batch.column(0))
        if len(v):
            total = v.T @ v if total is None else total + v.T @ v
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "sums"])


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"i": rows["i"].iloc[:1], "sums": [np.sum(np.stack(rows["sums"].to_list()), axis=0)]})


def rotation(rows: DataFrame) -> np.ndarray:
    """Right singular vectors of all vectors, strongest first, from sums added up by partition; dimensions squared in size."""
    sums = rows.select("v").mapInArrow(_gram, "i int, sums array<double>").groupBy("i").applyInPandas(_added, "i int, sums array<double>").orderBy("i").collect()
    sums = np.array([r["sums"] for r in sums])
    return np.linalg.eigh(sums)[1][:, ::-1] if np.isfinite(sums).all() else np.eye(len(sums))


def _search(block, k: int):
    """Kernel: candidates by descending length against a query block; a negated score makes small ones best."""

    def run(batches):
        query_ids, queries, turned, bound = block.value
        q_head, q_rest, q_norm = turned[:, :HEAD], np.linalg.norm(turned[:, HEAD:], axis=1), np.linalg.norm(queries, axis=1)
        best = Best(len(queries), k, bound, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, PIECE):
                batch = whole.slice(at, PIECE)
                ids, v, z = batch.column(0).to_numpy(), matrix(batch.column(1)), matrix(batch.column(2))
                norms = np.linalg.norm(v, axis=1)
                slack = 1e-9 * q_norm * norms.max() + 1e-9
                live = np.flatnonzero(~(q_norm * norms.max() + slack < -best.bound))  # what no double can tell stays in
                upper = q_head[live] @ z[:, :HEAD].T + np.outer(q_rest[live], np.linalg.norm(z[:, HEAD:], axis=1)) + slack[live][:, None]
                may = ~(upper < -best.bound[live][:, None])
                may &= ids[None, :] != query_ids[live][:, None]
                rows, columns = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
                if not len(rows):
                    continue
                scores = exact_products(queries[live[rows]], v[columns])
                least = -best.bound[live[rows]]
                least = least - 1e-12 * np.where(np.isfinite(least), np.abs(least), 0)  # a bound is rounded to a double, scores are not
                i, j = np.nonzero(may[np.ix_(rows, columns)] & (scores >= least[:, None]))
                best.add(live[rows][i], ids[columns][j], -scores[i, j])
        yield best.batch(query_ids, -1)

    return run


def _rotated(turn: np.ndarray):
    def run(batches):
        for batch in batches:
            z = matrix(batch.column(1)) @ turn
            yield batch.append_column("z", pa.array(list(z), pa.list_(pa.float64())))

    return run


def top_products(rows: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest inner products of each query with all rows but its own.

    Vectors become ``floor(scale * x)``.  Candidates are dealt by descending length and rotated by their singular vectors; a
    query block of bounded size meets a partition's candidates from the longest on.  A pair whose length product, or whose first rotated components
    and the Cauchy-Schwarz bound of the rest, cannot reach the query's k-th best score is not multiplied out.  The rest is
    multiplied exactly.  First bounds come from the ``SEEDS`` longest candidates, which are true scores.

    Null and empty vectors and those with null or non-finite components take no part, nor do rows with a null id.  Vectors only meet
    vectors of their size.  Ties go to the smaller id.  Rows that repeat an id count once, with the best score, and are no
    candidates of their own id.  Scores are exact in 64 bits and stop at their ends.  An empty table gives an empty result; further columns
    are not carried.
    """
    spark = rows.sparkSession
    valid = valid_vectors(rows, id_column, vector_column, keep_zero=True).withColumn("v", F.transform("v", lambda x: _floor(x * scale)))
    found = [spark.createDataFrame([], PRODUCTS)]
    for (size,) in valid.select(F.size("v")).distinct().collect():
        same = valid.filter(F.size("v") == size)
        turn = rotation(same)
        norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
        dealt = same.mapInArrow(_rotated(turn), "vec_id long, v array<double>, z array<double>").withColumn("norm", norm)
        index = stored(dealt.repartitionByRange(F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id"))
        seed_ids, seeds = collected(index.orderBy(F.desc("norm"), "vec_id").limit(SEEDS).select("vec_id", "v"))
        for query_ids, queries in query_blocks(index, is_query):
            start = Best(len(queries), k, np.full(len(queries), np.inf), np.int64)
            for at in range(0, len(queries), 512):
                scores = exact_products(queries[at:at + 512], seeds)
                i, j = np.nonzero(seed_ids[None, :] != query_ids[at:at + 512][:, None])
                start.add(at + i, seed_ids[j], -scores[i, j])
            block = spark.sparkContext.broadcast((query_ids, queries, queries @ turn, start.bound))
            found.append(index.select("vec_id", "v", "z").mapInArrow(_search(block, k), PRODUCTS))
    return ranked(reduce(DataFrame.unionByName, found), k, largest_first=True)
