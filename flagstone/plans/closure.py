"""Transitive closure: by blocks where edges say where they lie, else by a frontier loop with jumps for deep graphs."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flagstone.plans.shared import SMALL_ROWS, cut_lineage, hint_if_small

# Steps per round on a small graph, where the fixed cost of a round would dominate.
HOPS = 4
# Rounds on the plain edges; a walk that is not over by then gets jumps.
PLAIN_ROUNDS = 2


def reachable(edges: DataFrame, start: DataFrame, source: str, target: str, include_start: bool = False) -> DataFrame:
    """Nodes reached from `start` (column `node`) along edges from `source` to `target`.

    A start node is part of the result only when an edge leads to it, or with `include_start`.
    Each round joins only the newest nodes, and a visited set ends cycles. Both are counted: small
    ones are broadcast, so the edges are scanned but not shuffled; large ones are joined by shuffle.
    A small graph is broadcast itself and walked several steps per round. The distinct edges are stored once
    and read in every round. Walks that go deep also follow jumps, so a chain takes as many rounds as its
    length has binary digits, not one per step.

    Edges with a column `place` (a block number; nodes that lie near each other share it) are walked block by block.
    """
    if "place" in edges.columns:
        return walk_by_place(edges, start, source, target, include_start)[0]
    return walk(edges, start, source, target, include_start)[0]


def walk(edges: DataFrame, start: DataFrame, source: str, target: str, include_start: bool = False) -> tuple[DataFrame, int]:
    """The nodes of `reachable`, and the rounds it took."""
    plain = cut_lineage(edges.select(F.col(source).alias("node"), F.col(target).alias("_next")).distinct())
    steps, size = plain, plain.limit(SMALL_ROWS + 1).count()
    jumps = None
    frontier = cut_lineage(start.select("node").distinct())
    visited = frontier if include_start else frontier.limit(0)
    rows, rounds = frontier.count(), 0
    seen = rows if include_start else 0
    while rows:
        if rounds == PLAIN_ROUNDS:
            jumps = _first_jumps(plain)
        if rounds >= PLAIN_ROUNDS and jumps is not None:
            jumps = cut_lineage(_doubled(jumps, size))
            added = jumps.count()
            # A jump leads where its steps lead, so it adds no node; the plain edges are walked from every node as before.
            steps, size = (steps.unionByName(jumps), size + added) if added else (steps, size)
            jumps = jumps if added else None
        small = size <= SMALL_ROWS
        hops = HOPS if small else 1
        known, newest, levels = hint_if_small(visited, seen), frontier, []
        for hop in range(1, hops + 1):
            if small:
                found = newest.join(F.broadcast(steps), "node")
            else:
                found = steps.join(hint_if_small(newest, rows), "node", "left_semi")
            found = found.select(F.col("_next").alias("node"))
            newest = (found.join(known, "node", "left_anti") if seen else found).distinct()
            levels.append(newest.withColumn("_hop", F.lit(hop)))
        reached = reduce(DataFrame.unionByName, levels).groupBy("node").agg(F.min("_hop").alias("_hop"))
        reached = cut_lineage(reached)
        # Nodes first found by the last step are those whose own edges are still to follow.
        frontier = reached.filter(F.col("_hop") == hops).select("node")
        added, rows = reached.agg(F.count(F.lit(1)), F.count_if(F.col("_hop") == hops)).first()
        visited, seen, rounds = visited.unionByName(reached.select("node")), seen + added, rounds + 1
        if rounds % 10 == 0:
            visited = cut_lineage(visited)
    return visited, rounds


def _first_jumps(steps: DataFrame) -> DataFrame:
    """One step of each node: to a node that goes on, where there is one."""
    goes_on = steps.select(F.col("node").alias("_next"), F.lit(1).alias("_on")).distinct()
    picked = F.max_by("_next", F.struct(F.coalesce("_on", F.lit(0)), "_next"))
    return steps.join(goes_on, "_next", "left").groupBy("node").agg(picked.alias("_next"))


def _doubled(jumps: DataFrame, size: int) -> DataFrame:
    """Jumps of twice the steps; those that would leave the graph or come back to their start end."""
    second = hint_if_small(jumps.select(F.col("node").alias("_next"), F.col("_next").alias("_then")), size)
    return jumps.join(second, "_next").filter("node <> _then").select("node", F.col("_then").alias("_next"))


def walk_by_place(edges: DataFrame, start: DataFrame, source: str, target: str, include_start: bool = False) -> tuple[DataFrame, int]:
    """The nodes of `reachable` for edges with a `place`, and the rounds it took.

    A task follows all edges of one place to the end. Only nodes that occur at several places are told to the other
    ones, in rounds: as many as a path changes places, not as it has steps. Places may be cut anywhere; the result does not
    depend on them. One place is held in memory at a time.
    """
    plain = cut_lineage(edges.select("place", F.col(source).alias("node"), F.col(target).alias("_next")))
    ends = plain.select("node", "place").unionByName(plain.select(F.col("_next").alias("node"), "place"))
    several = ends.groupBy("node").agg(F.min("place").alias("_low"), F.max("place").alias("_high")).filter("_low < _high")
    several = cut_lineage(several.select("node"))
    size = several.count()
    starts = cut_lineage(start.select("node").distinct())
    begun = hint_if_small(starts.withColumn("_begins", F.lit(True)), starts.count())
    shown = hint_if_small(several.select(F.col("node").alias("_next"), F.lit(True).alias("_told")), size)
    flagged = cut_lineage(
        plain.join(begun, "node", "left").join(shown, "_next", "left")
        .select("place", "node", "_next", F.col("_begins").isNotNull().alias("_begins"), F.col("_told").isNotNull().alias("_told"), F.lit(True).alias("_edge"))
    )
    # Where the nodes of several places have edges to follow.
    onward = cut_lineage(plain.select("node", "place").join(hint_if_small(several, size), "node", "left_semi").distinct())

    def with_told(told: DataFrame) -> DataFrame:
        rows = told.select("place", "node", F.lit(None).cast(plain.schema["_next"].dataType).alias("_next"))
        return flagged.unionByName(rows.withColumns({"_begins": F.lit(True), "_told": F.lit(False), "_edge": F.lit(False)}))

    kind = plain.schema["node"].dataType.simpleString()
    known, told, todo, rounds = several.limit(0), onward.limit(0), flagged, 0
    while True:
        reached = todo.groupBy("place").applyInArrow(_follower("_told"), f"node {kind}").distinct()
        newest = cut_lineage(reached.join(known, "node", "left_anti"))
        found, rounds = newest.count(), rounds + 1
        if not found:
            break
        known = cut_lineage(known.unionByName(newest))
        added = onward.join(hint_if_small(newest, found), "node", "left_semi")
        told = cut_lineage(told.unionByName(added.select(*told.columns)))
        # Only places that were told something new are walked again, from all that they were ever told.
        again = added.select("place").distinct()
        todo = with_told(told).join(again, "place", "left_semi")
    nodes = with_told(told).groupBy("place").applyInArrow(_follower(), f"node {kind}")
    if include_start:
        nodes = nodes.unionByName(starts)
    return cut_lineage(nodes.distinct()), rounds


def _follower(only: str | None = None):
    """A task's work for one place: the nodes that its edges lead to from the rows that begin, those flagged `only`.
    It needs nothing but itself, so that executors without this package can run it."""

    def closure(a: np.ndarray, b: np.ndarray, n: int, newest: np.ndarray) -> np.ndarray:
        """Which of the nodes 0 to n - 1 the edges from `a` to `b` lead to."""
        order = np.argsort(a, kind="stable")
        b, first = b[order], np.searchsorted(a[order], np.arange(n + 1))
        seen = np.zeros(n, bool)
        while len(newest):
            size = first[newest + 1] - first[newest]
            before = np.cumsum(size) - size
            found = np.unique(b[np.repeat(first[newest] - before, size) + np.arange(size.sum())])
            newest = found[~seen[found]]
            seen[newest] = True
        return seen

    def run(rows: pa.Table) -> pa.Table:
        both = pa.chunked_array([*rows["node"].chunks, *rows["_next"].chunks], type=rows.schema.field("node").type)
        coded = both.combine_chunks().dictionary_encode(null_encoding="encode")
        codes, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        a, b = codes[:rows.num_rows], codes[rows.num_rows:]
        # A row that was told from elsewhere is no edge. Nulls are reached, but equal nothing.
        given, begins = rows["node"].is_valid().to_numpy(), rows["_begins"].to_numpy()
        edge = given & rows["_edge"].to_numpy()
        seen = closure(a[edge], b[edge], len(names), np.unique(a[begins & given]))
        if only:
            wanted = np.zeros(len(names), bool)
            wanted[b[rows[only].to_numpy()]] = True
            seen &= wanted
        return pa.table({"node": names.take(pa.array(np.flatnonzero(seen)))})

    return run
