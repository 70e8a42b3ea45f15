"""Connected components by repeated contraction."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flagstone.llm.common import stored


class Forest:
    """Union-find over any ordered keys; the smaller key becomes the root."""

    def __init__(self):
        self.parent = {}

    def root(self, x):
        parent = self.parent
        top = x
        while (p := parent.get(top, top)) != top:
            top = p
        while (p := parent.get(x, x)) != top:
            parent[x], x = top, p
        return top

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _forest_edges(batches):
    """A task's edges as stars: connectivity stays, and each node has one edge at most."""
    held = Forest()
    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.join(a, b)
    if held.parent:
        nodes = list(held.parent)
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, kind), pa.array([held.root(n) for n in nodes], kind)], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """`(node, root)` for each node of the edges `(a, b)`: the smallest node of its component, for all nodes but roots.

    In each round every node points to its smallest neighbour where that is smaller, and edges are rewritten to
    these parents, so at least one end of every edge goes away. Each round is written to the shared folder. Nulls
    and loops have no effect; an empty table gives no rows. No task sees a whole component: a task's share of
    the edges is first cut to a forest, and the joins by node are of the kind that adaptive execution splits.
    """
    kind = edges.schema["a"].dataType.simpleString()
    left = edges.filter("a <> b").select("a", "b")
    left = stored(left.mapInArrow(_forest_edges, f"a {kind}, b {kind}").distinct(), "edges")
    hooks = []
    while not left.isEmpty():
        both = left.union(left.select("b", "a")).toDF("node", "other")
        parents = both.groupBy("node").agg(F.min("other").alias("parent")).filter("parent < node")
        parents = stored(parents, "parents")
        hooks.append(parents)
        for end in ("a", "b"):
            left = left.join(parents.withColumnRenamed("node", end), end, "left")
            left = left.withColumn(end, F.coalesce("parent", end)).drop("parent")
        left = left.select("a", "b").filter("a <> b")
        left = stored(left.mapInArrow(_forest_edges, f"a {kind}, b {kind}").distinct(), "edges")
    if not hooks:
        return left.toDF("node", "root")
    # A node that goes away in some round follows the later rounds from its parent on.
    found = hooks[-1].select("node", F.col("parent").alias("root"))
    for hook in reversed(hooks[:-1]):
        later = found.toDF("parent", "later")
        moved = hook.join(later, "parent", "left").select("node", F.coalesce("later", "parent").alias("root"))
        # A node that other nodes pointed to may come back in a later round; its root is the same.
        found = moved.unionByName(found).distinct()
    return stored(found, "components")


def smallest_keys(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """`(node, component)`: the smallest `first` of all classes `(node, first)` in a node's component."""
    labelled = classes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = (
        labelled.join(roots.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("first").alias("least"))
    )
    return labelled.join(least, "root", "left").select("node", F.coalesce("least", "first").alias("component"))
