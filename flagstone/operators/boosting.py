"""Gradient boosting with second-order sums: histogram trees as Spark aggregations.

Features are cut into bins once. A level of a tree is one aggregation: gradient and curvature sums by (node, feature, bin),
which tasks add up before they shuffle, so what is shuffled is bounded by nodes x features x bins. Prefix sums over a
feature's bins give all splits, and the best of each node comes to the driver. Sums are exact: a row's numbers are whole
units of 1e-12, added up as two long integers and put together as decimals, so no partitioning changes a tree.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import astuple, dataclass, field, replace
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from flagstone.functions.numbers import sigmoid
from flagstone.functions.text import quoted
from flagstone.plans.shared import bounded_rows, measured

# Trees after which rows are stored with their margins, so that no expression holds all trees.
STORE_EVERY = 8
EXACT = "decimal(28,12)"
# Units of a row's numbers, and the bits of their lower half: sums of halves fit a long for 2**42 rows.
UNITS, LOW_BITS = 1e12, 20


@dataclass(frozen=True)
class Node:
    """A node of a tree: 1 is the root, 2n and 2n + 1 are the children of n (values up to the threshold go to 2n).
    A leaf has no feature; its value includes the learning rate."""

    tree: int
    node: int
    feature: str | None
    threshold: float | None
    value: float | None
    rows: int
    gain: float | None


@dataclass(frozen=True)
class Settings:
    """How trees grow: `l1` shrinks gradient sums towards 0, `l2` is added to curvature sums, a leaf has `min_rows` rows at least, a
    split gains more than `min_gain`; `symmetric` trees have one split per level. A tree sees `feature_share` of the features and
    `row_share` of the rows, both chosen by hash (the rows' by their key)."""

    trees: int = 20
    depth: int = 3
    rate: float = 0.1
    l1: float = 0.0
    l2: float = 1.0
    min_rows: int = 1
    min_gain: float = 1e-9
    bins: int = 64
    symmetric: bool = False
    feature_share: float = 1.0
    row_share: float = 1.0
    seed: int = 1


# Names of settings in the search space.
SEARCHED = {"learning_rate": "rate", "max_depth": "depth", "feature_fraction": "feature_share", "bagging_fraction": "row_share",
            "reg_alpha": "l1", "reg_lambda": "l2", "min_data_in_leaf": "min_rows"}


def searched_settings(parameters: dict, **others) -> Settings:
    """Settings from the parameters of a trial."""
    return Settings(**{SEARCHED[name]: value for name, value in parameters.items()}, **others)


@dataclass
class Model:
    """Trees, the features that they split, and the margin that all rows start from."""

    features: list[str]
    base: float
    nodes: list[Node] = field(default_factory=list)

    def table(self, spark) -> DataFrame:
        schema = "tree int, node int, feature string, threshold double, value double, rows long, gain double"
        return spark.createDataFrame([astuple(n) for n in self.nodes], schema)


def filled(name: str) -> Column:
    return F.coalesce(quoted(name).cast("double"), F.lit(0.0))


def bin_edges(df: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """For each feature the upper ends of its bins but the last: all distinct values where there are at most `bins`, else approximate
    quantiles. One pass tells the features of many values, one counts the values of the others."""
    row = df.agg(*[F.approx_count_distinct(filled(f), 0.01).alias(f"d{i}") for i, f in enumerate(features)],
                 *[F.percentile_approx(filled(f), [i / bins for i in range(1, bins)], 10_000).alias(f"q{i}") for i, f in enumerate(features)]).first()
    few = [i for i in range(len(features)) if row[f"d{i}"] <= bins]
    values: dict[int, list[float]] = {i: [] for i in few}
    if few:
        long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("f"), filled(features[i]).alias("v")) for i in few])).alias("e")).select("e.*")
        for r in bounded_rows(long.distinct(), 2 * bins * len(few) + 1):
            values[r["f"]].append(r["v"])
    return [sorted(values[i])[:-1] if i in values else sorted(set(row[f"q{i}"] or [])) for i in range(len(features))]


def bin_of(name: str, edges: list[float]) -> Column:
    """The place of the first edge that is not below the value."""
    if not edges:
        return F.lit(0)
    at = F.lit(len(edges))
    if len(edges) <= 4:
        for i in reversed(range(len(edges))):
            at = F.when(filled(name) <= edges[i], i).otherwise(at)
        return at
    ends = F.array(*[F.lit(float(e)) for e in edges])
    return F.aggregate(ends, F.lit(0), lambda n, e: n + F.when(e < filled(name), 1).otherwise(0))


def leaf_expression(nodes: dict[int, Node], result, at: int = 1, place: dict[str, int] | None = None) -> Column:
    """A tree as one expression over raw features, or over `_bins` where `place` has the places of features."""
    n = nodes[at]
    if n.feature is None:
        return result(n)
    goes_left = (filled(n.feature) if place is None else F.get("_bins", F.lit(place[n.feature]))) <= F.lit(n.threshold)
    return F.when(goes_left, leaf_expression(nodes, result, 2 * at, place)).otherwise(leaf_expression(nodes, result, 2 * at + 1, place))


def shrunk(g: Column, l1: float) -> Column:
    return F.signum(g) * F.greatest(F.lit(0.0), F.abs(g) - F.lit(l1))


def quality(g: Column, h: Column, s: Settings) -> Column:
    # Without curvature there is nothing to gain.
    return F.when(h + s.l2 > 0, shrunk(g, s.l1) * shrunk(g, s.l1) / (h + F.lit(s.l2))).otherwise(0.0)


def halves(x: Column, name: str) -> list[Column]:
    """A number of at most 1 in whole units, as `<name>_high` and `<name>_low`."""
    units = F.floor(x * F.lit(UNITS) + F.lit(0.5))
    return [F.shiftright(units, LOW_BITS).alias(f"{name}_high"), units.bitwiseAND(F.lit((1 << LOW_BITS) - 1).cast("long")).alias(f"{name}_low")]


def exact_sum(name: str) -> Column:
    units = F.sum(f"{name}_high").cast("decimal(20,0)") * F.lit(1 << LOW_BITS) + F.sum(f"{name}_low").cast("decimal(20,0)")
    return (units.cast("decimal(24,0)") * F.lit(Decimal("0.000000000001"))).cast(EXACT)


def best_splits(sums: DataFrame, s: Settings) -> DataFrame:
    """`(node, feature, bin, gain, g, h, n)`: the best split of each node by gain, then feature, then bin, and the sums of its left
    side, from `(node, feature, bin, g, h, n)`. Of symmetric trees there is one split, of node 0, without sums."""
    along = Window.partitionBy("node", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("node", "feature")
    rows = sums.select(
        "node", "feature", "bin", *[F.sum(c).over(along).alias(f"{c}l") for c in ("g", "h", "n")],
        *[F.sum(c).over(whole).alias(f"{c}a") for c in ("g", "h", "n")])
    rows = rows.filter((F.col("nl") >= s.min_rows) & (F.col("na") - F.col("nl") >= s.min_rows) & (F.col("nl") < F.col("na")))
    real = {c: F.col(c).cast("double") for c in ("gl", "hl", "ga", "ha")}
    left, right, both = (real["gl"], real["hl"]), (real["ga"] - real["gl"], real["ha"] - real["hl"]), (real["ga"], real["ha"])
    gain = (quality(*left, s) + quality(*right, s) - quality(*both, s)) / 2
    rows = rows.withColumn("gain", F.round(gain, 9))
    if s.symmetric:
        # A node that cannot be split there gains nothing; rows are nodes x features x bins at most.
        rows = rows.groupBy("feature", "bin").agg(F.sum(F.greatest("gain", F.lit(0.0))).alias("gain")).withColumn("node", F.lit(0))
        rows = rows.select("*", *[F.lit(0).alias(c) for c in ("gl", "hl", "nl")])
    order = F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "gl", "hl", "nl")
    return rows.groupBy("node").agg(F.max(order).alias("best")).select(
        "node", (-F.col("best.f")).alias("feature"), (-F.col("best.b")).alias("bin"), "best.gain",
        *[F.col(f"best.{c}l").alias(c) for c in ("g", "h", "n")])


def boost(train: DataFrame, features: list[str], label: str = "frd", settings: Settings = Settings(), key: str | None = None) -> Model:
    """Fit trees for a label of 0 and 1 by log loss, from the log-odds of the label on. Nulls of features count as 0, rows without a
    label do not count. The same rows give the same trees in any partitioning. An empty table, or one class, is an error.
    `key` is needed where trees see a share of the rows only."""
    s = settings
    if s.row_share < 1 and key is None:
        raise ValueError("rows are sampled by key")
    rows = train.filter(quoted(label).isNotNull())
    edges = bin_edges(rows, features, s.bins)
    bins = F.array(*[bin_of(f, e).cast("int") for f, e in zip(features, edges)])
    rows = measured(rows.select(bins.alias("_bins"), quoted(label).cast("double").alias("_y"), F.lit(0.0).alias("_margin"),
                                (F.lit(0) if key is None else F.xxhash64(quoted(key))).alias("_id")))
    n, positives = rows.agg(F.count(F.lit(1)), F.sum("_y")).first()
    if not n or not 0 < positives < n:
        raise ValueError("both classes are needed")
    model = Model(list(features), math.log(positives / (n - positives)))
    place = {f: i for i, f in enumerate(features)}
    pending: list[dict[int, Node]] = []  # trees that stored margins lack, by bins

    def tree_by_bins(nodes: dict[int, Node]) -> dict[int, Node]:
        return {k: v if v.feature is None else Node(v.tree, k, v.feature, edges[place[v.feature]].index(v.threshold), v.value, v.rows, v.gain)
                for k, v in nodes.items()}

    for tree in range(s.trees):
        margin = reduce(lambda a, t: a + leaf_expression(t, lambda x: F.lit(x.value), place=place), pending, F.col("_margin"))
        if len(pending) == STORE_EVERY:
            rows, pending = measured(rows.withColumn("_margin", margin)), []
            margin = F.col("_margin")
        p = sigmoid(margin + F.lit(model.base))
        some = rows
        if s.row_share < 1:
            some = rows.filter(F.pmod(F.xxhash64("_id", F.lit(s.seed), F.lit(tree)), F.lit(1_000_000)) < s.row_share * 1_000_000)
        used = _features_of(tree, len(features), s)
        stated = some.select("_bins", *halves(p - F.col("_y"), "g"), *halves(p * (1 - p), "h"))
        nodes: dict[int, Node] = {}
        splits: dict[int, tuple[int, int, float]] = {}  # node: feature, bin, gain
        # Sums of gradient, curvature and rows; those of children follow from a split's left side.
        totals = {1: tuple(stated.agg(exact_sum("g"), exact_sum("h"), F.count(F.lit(1))).first())}
        open_nodes = [1]
        for _ in range(s.depth):
            here = stated.withColumn("node", _node_expression(splits)).filter(F.col("node").isin(open_nodes))
            long = here.select("node", "g_high", "g_low", "h_high", "h_low", F.posexplode("_bins").alias("feature", "bin"))
            sums = long.filter(F.col("feature").isin(used)).groupBy("node", "feature", "bin").agg(
                exact_sum("g").alias("g"), exact_sum("h").alias("h"), F.count(F.lit(1)).alias("n"))
            sums = measured(sums) if s.symmetric else sums
            # One row per node.
            found = [r for r in best_splits(sums, s).collect() if r["gain"] > s.min_gain]
            if s.symmetric and found:
                f, b, gain = found[0]["feature"], found[0]["bin"], found[0]["gain"]
                left = sums.filter((F.col("feature") == f) & (F.col("bin") <= b)).groupBy("node").agg(F.sum("g"), F.sum("h"), F.sum("n"))
                lefts = {r[0]: tuple(r)[1:] for r in left.collect()}
                found = [{"node": n, "feature": f, "bin": b, "gain": gain, **dict(zip("ghn", lefts.get(n, (0, 0, 0))))} for n in open_nodes]
            open_nodes = []
            for r in found:
                node, left = r["node"], (r["g"], r["h"], r["n"])
                splits[node] = (r["feature"], r["bin"], r["gain"])
                totals[2 * node], totals[2 * node + 1] = left, tuple(a - b for a, b in zip(totals[node], left))
                open_nodes += [2 * node, 2 * node + 1]
            if not open_nodes:
                break
        for node in [1, *(c for x in splits for c in (2 * x, 2 * x + 1))]:
            g, h, count = float(totals[node][0]), float(totals[node][1]), int(totals[node][2])
            if node in splits:
                f, b, gain = splits[node]
                nodes[node] = Node(tree, node, features[f], edges[f][b], None, count, gain)
            else:
                value = -s.rate * math.copysign(max(0.0, abs(g) - s.l1), g) / (h + s.l2) if h + s.l2 > 0 else 0.0
                nodes[node] = Node(tree, node, None, None, value, count, None)
        model.nodes += [nodes[k] for k in sorted(nodes)]
        pending.append(tree_by_bins(nodes))
    return model


def _features_of(tree: int, n: int, s: Settings) -> list[int]:
    """The places of the features that a tree may split, at least one."""
    if s.feature_share >= 1:
        return list(range(n))
    order = sorted(range(n), key=lambda i: hashlib.md5(f"{s.seed}|{tree}|{i}".encode()).digest())
    return sorted(order[:max(1, round(s.feature_share * n))])


def _node_expression(splits: dict[int, tuple[int, int, float]], at: int = 1) -> Column:
    """The deepest node that a row is in, by bins."""
    if at not in splits:
        return F.lit(at)
    f, b, _ = splits[at]
    return F.when(F.get("_bins", F.lit(f)) <= b, _node_expression(splits, 2 * at)).otherwise(_node_expression(splits, 2 * at + 1))


def boosted_margin(model: Model) -> Column:
    """The margin as one expression of raw features."""
    trees: dict[int, dict[int, Node]] = {}
    for n in model.nodes:
        trees.setdefault(n.tree, {})[n.node] = n
    parts = [leaf_expression(t, lambda x: F.lit(x.value)) for _, t in sorted(trees.items())]
    return reduce(lambda a, b: a + b, parts, F.lit(model.base))


def boosted_scores(df: DataFrame, model: Model) -> DataFrame:
    """Add `logit` (the margin) and `score`, the probability of class 1; row by row, no shuffle."""
    return df.withColumn("logit", boosted_margin(model)).withColumn("score", sigmoid(F.col("logit")))


def with_rows(df: DataFrame, nodes: list[Node]) -> list[Node]:
    """The same trees with the rows of `df` that reach each node, counted in one pass over the leaves."""
    trees: dict[int, dict[int, Node]] = {}
    for n in nodes:
        trees.setdefault(n.tree, {})[n.node] = n
    order = sorted(trees)
    reached = F.array(*[F.struct(F.lit(t).alias("tree"), leaf_expression(trees[t], lambda x: F.lit(x.node)).alias("node")) for t in order])
    counts: dict[tuple[int, int], int] = {}
    # One row per leaf at most.
    for r in df.select(F.explode(reached).alias("e")).groupBy("e.tree", "e.node").count().collect():
        at = r["node"]
        while at:
            counts[r["tree"], at] = counts.get((r["tree"], at), 0) + r["count"]
            at //= 2
    return [replace(n, rows=counts.get((n.tree, n.node), 0)) for n in nodes]
