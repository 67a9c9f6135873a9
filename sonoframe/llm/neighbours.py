"""Approximate nearest neighbours by vantage-point trees per shard (operator 10)."""

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoframe.llm.shared import share, stored
from sonoframe.llm.vectors import FOUND, SEEDS, Best, collected, matrix, query_blocks, ranked, valid_vectors

SHARD = 20_000      # vectors of one tree; a partition with more has several
LEAF = 64
FACTOR = 1.25       # how much sooner than the triangle inequality a branch is cut; 1 is exact


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all pairs by the product form: a little rough, for choosing only."""
    return np.sqrt(np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)))


def slack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What ``distances`` may be off by, and more: its rounding grows with the lengths of both vectors."""
    return 1e-6 * (1 + np.linalg.norm(a, axis=1)[:, None] + np.linalg.norm(b, axis=1)[None, :])


class Tree:
    """A vantage-point tree over the rows of a matrix; each node splits its rows at the median distance from one of them."""

    def __init__(self, vectors: np.ndarray, seed: int = 5):
        self.vectors, self.random = vectors, np.random.default_rng(seed)
        self.root = self._split(np.arange(len(vectors)))

    def _split(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        point = int(self.random.choice(rows))
        away = np.linalg.norm(self.vectors[rows] - self.vectors[point], axis=1)
        middle = float(np.median(away))
        inner = away <= middle
        if inner.all():  # all as far: nothing to split by distance
            return rows
        return point, middle, self._split(rows[inner]), self._split(rows[~inner])

    def search(self, queries: np.ndarray, ids: np.ndarray, query_ids: np.ndarray, best: Best, factor: float) -> None:
        """Put what may be among the nearest of each query into ``best``."""

        def visit(node, active, home):
            """Take the queries down a node together, so that it is visited once; ``home`` stays on each query's own side."""
            if not len(active):
                return
            if isinstance(node, np.ndarray):
                for at in range(0, len(node), 4 * LEAF):
                    leaf(node[at:at + 4 * LEAF], active)
                return
            point, middle, inner, outer = node
            away = np.linalg.norm(queries[active] - self.vectors[point], axis=1)
            near = away <= middle
            if home:
                visit(inner, active[near], True)
                visit(outer, active[~near], True)
                return
            # the other side is as far as the query is from the border, at least
            across = lambda: np.abs(away - middle) * factor <= best.bound[active] * (1 + 1e-9) + 1e-12 * (away + middle)
            visit(inner, active[near | across()], False)
            visit(outer, active[~near | across()], False)  # bounds may have fallen since

        def leaf(rows, active):
            rough = distances(queries[active], self.vectors[rows])
            i, j = np.nonzero((rough <= best.bound[active][:, None] + slack(queries[active], self.vectors[rows])) & (ids[rows][None, :] != query_ids[active][:, None]))
            exact = np.sqrt(((queries[active[i]] - self.vectors[rows[j]]) ** 2).sum(axis=1))
            best.add(active[i], ids[rows[j]], exact)

        everyone = np.arange(len(queries))
        visit(self.root, everyone, True)   # first the leaf that each query falls into, for a bound
        visit(self.root, everyone, False)


def _search(block, k: int, factor: float):
    """Kernel: one tree per shard of a partition, searched with a query block."""

    def run(batches):
        query_ids, queries, bound = block.value
        best = Best(len(queries), k, bound)
        ids, parts, held = [], [], 0

        def shard():
            vectors = np.concatenate(parts)
            Tree(vectors).search(queries, np.concatenate(ids), query_ids, best, factor)
            ids.clear(), parts.clear()

        for whole in batches:
            for at in range(0, whole.num_rows, SHARD):
                batch = whole.slice(at, SHARD)
                if held and held + batch.num_rows > SHARD:
                    shard()
                    held = 0
                ids.append(batch.column(0).to_numpy()), parts.append(matrix(batch.column(1)))
                held += batch.num_rows
        if held:
            shard()
        yield best.batch(query_ids, 1.0)

    return run


def nearest(rows: DataFrame, is_query: Column, k: int = 10, factor: float = FACTOR, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: about the k nearest rows of each query, without its own, by Euclidean distance.

    Every row is indexed.  A partition's vectors form vantage-point trees; a query block of bounded size goes down them, first each
    to its own leaf, then to all others, and leaves out a branch whose border is further than its k-th nearest so far divided by ``factor``.  Factor 1 is exact; larger
    ones leave out more.  First bounds are distances to a bounded sample of about ``SEEDS`` rows.  Scores are computed on the original vectors in double precision.

    Null, empty and zero vectors and those with null or non-finite components take no part, nor do rows with a null id.  Vectors only
    meet vectors of their size.  Ties go to the smaller id.  Rows that repeat an id count once, with the smallest distance, and are no
    candidates of their own id.  An empty table gives an empty result; further columns are not carried.
    """
    spark = rows.sparkSession
    valid = valid_vectors(rows, id_column, vector_column, keep_zero=False)
    found = [spark.createDataFrame([], FOUND)]
    for size, n in valid.groupBy(F.size("v")).count().collect():
        index = valid.filter(F.size("v") == size)
        sample = index.filter(share("vec_id", "seeds", min(1.0, SEEDS / n)))
        seed_ids, seeds = collected(sample)
        for query_ids, queries in query_blocks(index, is_query):
            start = Best(len(queries), k, np.full(len(queries), np.inf))
            for at in range(0, len(queries), 512):
                if len(seeds):
                    away = distances(queries[at:at + 512], seeds)
                    i, j = np.nonzero(seed_ids[None, :] != query_ids[at:at + 512][:, None])
                    start.add(at + i, seed_ids[j], (away + slack(queries[at:at + 512], seeds))[i, j])
            block = spark.sparkContext.broadcast((query_ids, queries, start.bound))
            found.append(index.mapInArrow(_search(block, k, factor), FOUND))
    return ranked(reduce(DataFrame.unionByName, found), k)
