"""Distributed union-find over links between long node ids."""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoframe.llm.shared import attach, forget, stored

# Links held at once by one task; a partition with more is contracted piece by piece.
CHUNK = 500_000
_FIELDS = "child long, parent long, moved boolean"


def _contract(batches):
    """Replace the links of a partition by stars around the smallest node, each child once per piece.

    ``moved`` tells whether a piece was anything else than such stars already.
    """
    above, rows = {}, 0

    def top(x):
        root = x
        while above.get(root, root) != root:
            root = above[root]
        while above.get(x, x) != root:
            above[x], x = root, above[x]
        return root

    def stars():
        children = [x for x in above if above[x] != x]
        parents = [top(x) for x in children]
        moved = len(children) != rows or any(direct.get(x) != p for x, p in zip(children, parents))
        return pa.RecordBatch.from_pydict({
            "child": pa.array(children, pa.int64()), "parent": pa.array(parents, pa.int64()),
            "moved": pa.array([moved] * len(children), pa.bool_())})

    direct = {}
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows += 1
            direct[max(a, b)] = min(a, b)
            a, b = top(a), top(b)
            above.setdefault(a, a)
            above.setdefault(b, b)
            if a != b:
                above[max(a, b)] = min(a, b)
        if rows >= CHUNK:
            yield stars()
            above.clear(), direct.clear()
            rows = 0
    if rows:
        yield stars()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node that is linked, directly or through others, to a smaller node; stored.

    ``links`` has two long columns.  Every partition first contracts its own links to stars, so a node leaves it
    once at most however many links it has.  Then two steps alternate until neither changes anything: the links of a
    child meet and are contracted, and children of a node that has a parent itself move up.  The first step is keyed by
    the child, which occurs once per partition; the second is a join of two stored tables.  Null ends are ignored.
    """
    a, b = links.columns
    ends = links.select(F.col(a).alias("child"), F.col(b).alias("parent")).filter("child <> parent")
    current = stored(ends.mapInArrow(_contract, _FIELDS))
    while True:
        hooked = stored(current.select("child", "parent").repartition("child").mapInArrow(_contract, _FIELDS))
        # one parent is enough to move up; links to the others stay in the table themselves
        up = stored(hooked.groupBy(F.col("child").alias("parent")).agg(F.min("parent").alias("above")))
        jumped = stored(attach(hooked.select("child", "parent"), up, "parent").select(
            "child", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")))
        done = hooked.filter("moved").isEmpty() and jumped.filter("moved").isEmpty()
        forget(current), forget(hooked), forget(up)
        current = jumped
        if done:
            return current.select(F.col("child").alias("node"), F.col("parent").alias("root"))
