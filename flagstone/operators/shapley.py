"""Attributions of any scorer against a background set, and exact ones of tree ensembles."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb, factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from flagstone.functions.text import quoted
from flagstone.operators.boosting import Node
from flagstone.plans.shared import bounded_rows

# Rows of a background set, and rows that a scorer is given at a time.
BACKGROUND_ROWS, SCORED_ROWS = 1000, 1 << 18


def coalitions(features: int, most: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Sets of features (rows of a boolean matrix, neither empty nor full) and their weights in the regression.

    Sizes are taken from the outside (one feature, all but one, two, ...) while all sets of a size and its opposite fit into
    `most`; the weight of the other sizes is spread over seeded draws of a set together with its opposite.
    """
    sizes = list(range(1, features))
    weight = {s: (features - 1) / (s * (features - s)) for s in sizes}  # of all sets of a size together
    rows, weights, left = [], [], max(most, 2)
    while sizes:
        pair = {sizes[0], sizes[-1]}
        if sum(comb(features, s) for s in pair) > left:
            break
        for s in sorted(pair):
            for some in combinations(range(features), s):
                rows.append(np.isin(np.arange(features), some))
                weights.append(weight[s] / comb(features, s))
            left -= comb(features, s)
            sizes.remove(s)
    if sizes:
        rng = np.random.default_rng(seed)
        total = sum(weight[s] for s in sizes)
        draws = max(left // 2, 1)
        for _ in range(draws):
            size = rng.choice(sizes, p=[weight[s] / total for s in sizes])
            one = np.isin(np.arange(features), rng.choice(features, size, replace=False))
            rows += [one, ~one]
            weights += [total / (2 * draws)] * 2
    return np.array(rows, dtype=bool).reshape(-1, features), np.array(weights)


def regression(sets: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What turns the values of all sets (less the base) into attributions that sum to a given total: a matrix for the values,
    and the share of each feature in what is missing from the total."""
    z = sets.astype(float)
    inverse = np.linalg.pinv(z.T @ (weights[:, None] * z)) if len(z) else np.eye(sets.shape[1])
    share = inverse.sum(axis=1) / inverse.sum()
    fitted = inverse @ (z.T * weights) if len(z) else np.zeros((sets.shape[1], 0))
    return fitted - share[:, None] * fitted.sum(axis=0), share


def background_set(background: DataFrame, features: list[str], most: int = BACKGROUND_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a background set and their shares. More than `most` distinct rows are an error; nulls count as 0."""
    values = [F.coalesce(quoted(f).cast("double"), F.lit(0.0)).alias(f"_{i}") for i, f in enumerate(features)]
    counted = background.select(*values).groupBy(*[f"_{i}" for i in range(len(features))]).agg(F.count(F.lit(1)).alias("_n"))
    rows = sorted(tuple(r) for r in bounded_rows(counted, most))
    if not rows:
        raise ValueError("the background set has no rows")
    table = np.array(rows, dtype=float)
    return table[:, :-1], table[:, -1] / table[:, -1].sum()


def background_attributions(
    df: DataFrame, load: Callable[[], Callable], features: list[str], background: DataFrame, key: str = "row_id",
    most_sets: int = 2048, seed: int = 1, most_background: int = BACKGROUND_ROWS,
) -> DataFrame:
    """Attributions of any scorer in the shape of `attribution.attributions`: Shapley values by weighted least squares over sets of
    features, where the value of a set is the mean score over all background rows that have the row's values in the set.

    `load` runs once per task and returns a function from a pandas frame of the features to one number per row. `base` is the
    mean score of the background, and base plus all phis is the score of the row. With at most `most_sets` sets in all
    (2 ** features - 2), the result is exact; else sets are drawn as in `coalitions`. Nulls count as 0, the key may be null or
    repeated. The background has at most `most_background` distinct rows. Equal rows of a batch are scored once; no
    shuffle. An empty table gives no rows.
    """
    rows_b, shares = background_set(background, features, most_background)
    sets, weights = coalitions(len(features), most_sets, seed)
    fitted, share = regression(sets, weights)

    def run(frames: Iterator) -> Iterator:
        scorer = load()

        def score(values: np.ndarray) -> np.ndarray:
            return np.asarray(scorer(pd.DataFrame(values, columns=features)), dtype=float)

        base = None
        for frame in frames:
            if base is None:
                base = float(shares @ score(rows_b))
            values = frame[[f"_{i}" for i in range(len(features))]].to_numpy(dtype=float)
            distinct, place = np.unique(values, axis=0, return_inverse=True)
            total = score(distinct) - base
            held = np.empty((len(distinct), len(sets)))
            step = max(1, SCORED_ROWS // max(1, len(sets) * len(rows_b)))
            wide = max(1, SCORED_ROWS // len(rows_b))
            for at in range(0, len(distinct), step):
                some = distinct[at:at + step]
                for low in range(0, len(sets), wide):
                    inside = sets[low:low + wide]
                    mixed = np.where(inside[None, :, None, :], some[:, None, None, :], rows_b[None, None, :, :])
                    found = score(mixed.reshape(-1, len(features))).reshape(len(some), len(inside), len(rows_b))
                    held[at:at + step, low:low + wide] = found @ shares
            phis = (held - base) @ fitted.T + total[:, None] * share
            yield pd.DataFrame({"_key": frame["_key"], "base": base, "features": [features] * len(frame), "values": list(values),
                                "phis": list(phis[place.reshape(-1)])})

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(quoted(key).alias("_key"), *[F.coalesce(quoted(f).cast("double"), F.lit(0.0)).alias(f"_{i}") for i, f in enumerate(features)])
    schema = f"_key {kind}, base double, features array<string>, values array<double>, phis array<double>"
    return rows.mapInPandas(run, schema).withColumnRenamed("_key", key)


def leaves(nodes: list[Node], features: list[str]) -> list[tuple[float, list[tuple[int, float, float, float]]]]:
    """The leaves of an ensemble: value, and per feature of the path its place, the interval `(low, high]` that leads to the leaf, and
    the share of training rows that go on at the feature's nodes of the path."""
    place = {f: i for i, f in enumerate(features)}
    found = []

    def walk(tree: dict[int, Node], node: Node, path: dict[int, tuple[float, float, float]]):
        if node.feature is None:
            found.append((node.value, [(i, *p) for i, p in sorted(path.items())]))
            return
        i = place[node.feature]
        low, high, share = path.get(i, (-np.inf, np.inf, 1.0))
        for child, bounds in ((2 * node.node, (low, min(high, node.threshold))), (2 * node.node + 1, (max(low, node.threshold), high))):
            part = tree[child].rows / node.rows if node.rows else 0.5
            walk(tree, tree[child], {**path, i: (*bounds, share * part)})

    for t in sorted({n.tree for n in nodes}):
        tree = {n.node: n for n in nodes if n.tree == t}
        walk(tree, tree[1], {})
    return found


def path_weights(inside: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Of a path of k features, for each row (rows of `inside`, whether a feature lets the row on) and feature: the sum over sets of
    the other features of the set's Shapley weight times the chance to reach the leaf with these features known.

    The path is extended feature by feature, to the sums over sets of each size; a feature is unwound from them again by
    extending the path of the others.
    """
    n, k = inside.shape
    out = np.zeros((n, k))
    by_size = np.array([factorial(s) * factorial(k - s - 1) / factorial(k) for s in range(k)])
    for i in range(k):
        sums = np.zeros((n, k))
        sums[:, 0] = 1.0
        for j in range(k):
            if j != i:
                longer = sums * shares[j]
                longer[:, 1:] += sums[:, :-1] * inside[:, j, None]
                sums = longer
        out[:, i] = sums @ by_size
    return out


def tree_attributions(df: DataFrame, model: list[Node], features: list[str], base: float = 0.0, key: str = "row_id") -> DataFrame:
    """Exact attributions of the margin of a tree ensemble (`boosting.boost`), in the shape of `attribution.attributions`.

    The value of a set of features is what the trees give where a node of any other feature sends a row both ways, in the
    shares of the training rows (by halves where there are none). `base` is that of the empty set, and base plus all phis is the margin. Each batch of rows
    meets the table of leaves (bounded by the model); rows are not shuffled. Nulls count as 0.
    """
    table = leaves(model, features)
    empty = base + sum(value * float(np.prod([p[3] for p in path])) for value, path in table)

    def run(frames: Iterator) -> Iterator:
        for frame in frames:
            values = frame[[f"_{i}" for i in range(len(features))]].to_numpy(dtype=float)
            distinct, place = np.unique(values, axis=0, return_inverse=True)
            phis = np.zeros_like(distinct)
            for value, path in table:
                if not path:
                    continue
                at = [p[0] for p in path]
                low, high, shares = (np.array([p[c] for p in path]) for c in (1, 2, 3))
                own = distinct[:, at]
                inside = ((own > low) & (own <= high)).astype(float)
                phis[:, at] += value * (inside - shares) * path_weights(inside, shares)
            yield pd.DataFrame({"_key": frame["_key"], "base": empty, "features": [features] * len(frame), "values": list(values),
                                "phis": list(phis[place.reshape(-1)])})

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(quoted(key).alias("_key"), *[F.coalesce(quoted(f).cast("double"), F.lit(0.0)).alias(f"_{i}") for i, f in enumerate(features)])
    schema = f"_key {kind}, base double, features array<string>, values array<double>, phis array<double>"
    return rows.mapInPandas(run, schema).withColumnRenamed("_key", key)
