"""Which features tell of each other: mutual information, the tree of the most informative pairs, and filling a hidden
feature by exact inference on that tree."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from flagstone.functions.text import quoted
from flagstone.plans.shared import bounded_rows, measured

# Values of all features together, pairs of features, and pairs of values along the tree; more are an error.
MOST_VALUES, MOST_PAIRS, MOST_CHANCES = 2000, 200_000, 1_000_000
BLOCK_ROWS = 4096
# Digits to which pieces of information are compared, so that the tree does not depend on the order of sums.
DIGITS = 9


def feature_values(df: DataFrame, features: list[str]) -> dict[str, list[str]]:
    """The values of each feature in order; nulls are no values."""
    cells = [F.struct(F.lit(f).alias("feature"), quoted(f).cast("string").alias("value")) for f in features]
    long = df.select(F.inline(F.array(*cells)))
    values: dict[str, list[str]] = {f: [] for f in sorted(features)}
    for r in bounded_rows(long.filter("value is not null").distinct(), MOST_VALUES):
        values[r["feature"]].append(r["value"])
    return {f: sorted(found) for f, found in values.items()}


def _codes(column: pa.Array, values: list[str]) -> np.ndarray:
    """The place of each value; -1 for nulls and values that are not among them."""
    if not values:
        return np.full(len(column), -1)
    found = pc.index_in(column, value_set=pa.array(values, pa.string()), skip_nulls=True)
    return pc.fill_null(found, -1).to_numpy(zero_copy_only=False)


def pair_counts(df: DataFrame, values: dict[str, list[str]]) -> DataFrame:
    """How often each two values of two features occur in one row: `(feature, code, other, other_code, n)`, features in
    order, codes the places in `values`; a pair of a value with itself counts the value.

    One pass over the rows. A task adds up products of 0/1 matrices and sends one row per pair of values that it saw.
    """
    names = list(values)
    starts = np.concatenate([[0], np.cumsum([len(values[n]) for n in names])]).astype(int)
    width = int(starts[-1])

    def count(batches):
        total = np.zeros((width, width), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                hot = np.zeros((part.num_rows, width), np.float32)  # whole numbers below 2^24 are exact
                for i, name in enumerate(names):
                    codes = _codes(part.column(i), values[name])
                    seen = np.flatnonzero(codes >= 0)
                    hot[seen, starts[i] + codes[seen]] = 1
                total += (hot.T @ hot).astype(np.int64)
        a, b = np.nonzero(np.triu(total))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(total[a, b])], names=["a", "b", "n"])

    columns = [quoted(f).cast("string").alias(f"_{i}") for i, f in enumerate(names)]
    found = df.select(*columns).mapInArrow(count, "a long, b long, n long")
    found = found.groupBy("a", "b").agg(F.sum("n").alias("n"))
    places = [(int(starts[i] + j), name, j) for i, name in enumerate(names) for j in range(len(values[name]))]
    # At most MOST_VALUES rows.
    coded = F.broadcast(df.sparkSession.createDataFrame(places, "place long, feature string, code int"))
    first = coded.select(F.col("place").alias("a"), "feature", "code")
    second = coded.select(F.col("place").alias("b"), F.col("feature").alias("other"), F.col("code").alias("other_code"))
    return found.join(first, "a").join(second, "b").select("feature", "code", "other", "other_code", "n")


def mutual_information(counts: DataFrame) -> DataFrame:
    """`(feature, other, information)` in nats for each two features of `pair_counts`, over the rows where both are
    known; none for features that are never known together."""
    pair = ["feature", "other"]

    def over(*by):
        return F.sum("n").over(Window.partitionBy(*pair, *by))

    parts = counts.filter("feature < other").select(
        *pair, "n", over().alias("rows"), over("code").alias("n_code"), over("other_code").alias("n_other"))
    share = F.col("n") / F.col("rows")
    term = share * F.log(share * F.col("rows") / F.col("n_code") * F.col("rows") / F.col("n_other"))
    return parts.groupBy(*pair).agg(F.round(F.sum(term), DIGITS).alias("information"))


def strongest_tree(information: DataFrame) -> list[tuple[str, str, float]]:
    """The pairs `(feature, other, information)` of the tree (a forest, where features are never known together) of the
    greatest total information; ties by name."""
    above: dict[str, str] = {}

    def root(name: str) -> str:
        while name in above:
            name = above[name]
        return name

    tree = []
    for r in sorted(bounded_rows(information, MOST_PAIRS), key=lambda r: (-r["information"], r["feature"], r["other"])):
        a, b = root(r["feature"]), root(r["other"])
        if a != b:
            above[a] = b
            tree.append((r["feature"], r["other"], r["information"]))
    return tree


def dependence_tree(df: DataFrame, features: list[str]) -> DataFrame:
    """The tree of `features` as rows `(feature, other, information)`."""
    counts = pair_counts(df, feature_values(df, features))
    return df.sparkSession.createDataFrame(strongest_tree(mutual_information(counts)), "feature string, other string, information double")


def _from_root(tree: list[tuple[str, str, float]], target: str) -> list[tuple[str, str]]:
    """`(feature, parent)` for the features that the tree joins to the target, parents first."""
    beside = defaultdict(list)
    for a, b, _ in tree:
        beside[a].append(b)
        beside[b].append(a)
    order, reached = [], [(target, None)]
    for name, parent in reached:  # grows while it is read
        for other in beside[name]:
            if other != parent:
                order.append((other, name))
                reached.append((other, name))
    return order


def fill_masked_by_tree(df: DataFrame, target: str, features: list[str], key: str = "row_id", k: int = 2) -> DataFrame:
    """The `k` likeliest values of a hidden feature per row: `(key, candidate, p, rank)`, ties by the smaller candidate.

    The tree is that of the target and the features over rows with a target, its chances counted with one added. A
    row's known features say what they say on the tree: a feature behind a known one adds nothing, and unknown ones (null, or
    of a value that no counted row has) are summed over. Rows without known features keep the priors; a table without any
    target gives no rows. Rows are scored where they lie.
    """
    features = [f for f in features if f != target]
    rows = df.filter(quoted(target).isNotNull())
    values = feature_values(rows, [target, *features])
    out = StructType([df.schema[key], StructField("candidate", StringType()), StructField("p", DoubleType()), StructField("rank", IntegerType())])
    names = values[target]
    if not names:
        return df.sparkSession.createDataFrame([], out)
    counts = measured(pair_counts(rows, values))
    order = _from_root(strongest_tree(mutual_information(counts)), target)
    pairs = [tuple(sorted(p)) for p in order] + [(target, target)]
    wanted = F.broadcast(df.sparkSession.createDataFrame(pairs, "feature string, other string"))  # one row per feature
    seen = defaultdict(list)
    for r in bounded_rows(counts.join(wanted, ["feature", "other"]), MOST_CHANCES):
        seen[r["feature"], r["other"]].append((r["code"], r["other_code"], r["n"]))
    prior = np.ones(len(names))
    for code, _, n in seen[target, target]:
        prior[code] += n
    prior = np.log(prior / prior.sum())
    chances = {}
    for name, parent in order:
        found = np.ones((len(values[name]), len(values[parent])))
        for code, other, n in seen[min(name, parent), max(name, parent)]:
            found[(code, other) if name < parent else (other, code)] += n
        chances[name] = found / found.sum(axis=0)
    used = [name for name, _ in order]

    def fill(batches):
        for batch in batches:
            held = {name: np.zeros((batch.num_rows, len(values[name]))) for name in [target, *used]}
            for name, parent in reversed(order):
                said = held.pop(name)
                top = said.max(axis=1, keepdims=True)
                told = np.log(np.exp(said - top) @ chances[name])
                codes = _codes(batch.column(1 + used.index(name)), values[name])
                known = codes >= 0
                told[known] = np.log(chances[name][codes[known]])
                held[parent] += told
            weights = held[target] + prior
            p = np.exp(weights - weights.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = np.argsort(-p, axis=1, kind="stable")[:, :k]
            each = best.shape[1]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), each))), pa.array(np.array(names, object)[best.ravel()], pa.string()),
                pa.array(np.take_along_axis(p, best, 1).ravel()), pa.array(np.tile(np.arange(1, each + 1, dtype=np.int32), batch.num_rows)),
            ], names=out.names)

    columns = [quoted(f).cast("string").alias(f"_{i}") for i, f in enumerate(used)]
    return df.select(quoted(key).alias("_key"), *columns).mapInArrow(fill, out)
