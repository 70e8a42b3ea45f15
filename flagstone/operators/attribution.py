"""Linear scorecards, their exact per-feature attributions, and sampled ones of any scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from flagstone.functions.numbers import sigmoid
from flagstone.functions.text import quoted
from flagstone.plans.shared import bounded_rows


def card(coefficients: DataFrame | dict[str, float]) -> dict[str, float]:
    """A coefficient table as a dict; its size follows the number of columns."""
    if isinstance(coefficients, dict):
        return coefficients
    return {r["feature"]: r["coefficient"] for r in bounded_rows(coefficients.select("feature", "coefficient"))}


def card_logit(coefficients: dict[str, float], intercept: float = 0.0) -> Column:
    """Sum of coefficient times flag; a null flag adds nothing."""
    terms = [F.lit(float(c)) * F.coalesce(quoted(f).cast("double"), F.lit(0.0)) for f, c in coefficients.items()]
    return reduce(lambda a, b: a + b, terms, F.lit(float(intercept)))


def scorecard(df: DataFrame, coefficients: DataFrame | dict[str, float], intercept: float = 0.0) -> DataFrame:
    """Add `logit` and `score` (its sigmoid); row by row, no shuffle."""
    return df.withColumn("logit", card_logit(card(coefficients), intercept)).withColumn("score", sigmoid(F.col("logit")))


def background_means(background: DataFrame, features: list[str]) -> dict[str, float]:
    """Mean of each feature over a background set: one row reaches the driver."""
    means = [F.avg(F.coalesce(quoted(f).cast("double"), F.lit(0.0))).alias(f"_{i}") for i, f in enumerate(features)]
    row = background.agg(*means).first()
    return {f: (row[i] if row[i] is not None else 0.0) for i, f in enumerate(features)}


def attributions(
    df: DataFrame, coefficients: DataFrame | dict[str, float], background: DataFrame,
    key: str = "row_id", intercept: float = 0.0, keep: list[str] = [],
) -> DataFrame:
    """`base` and, in the order of the card, the arrays `features`, `values` and `phis`, with phi =
    coefficient * (value - background mean). Base plus all phis is the logit. No shuffle; the names
    are a constant that rows hold only where they are asked for."""
    weights = card(coefficients)
    means = background_means(background, list(weights))
    values = {f: F.coalesce(quoted(f).cast("double"), F.lit(0.0)) for f in weights}
    phis = [F.lit(float(c)) * (values[f] - F.lit(means[f])) for f, c in weights.items()]
    base = intercept + sum(c * means[f] for f, c in weights.items())
    return df.select(
        key, *[quoted(c) for c in keep], F.lit(float(base)).alias("base"),
        F.array(*[F.lit(f) for f in weights]).alias("features"),
        F.array(*values.values()).alias("values"), F.array(*phis).alias("phis"),
    )


def sampled_attributions(
    df: DataFrame, load: Callable[[], Callable], features: list[str], background: dict[str, float],
    key: str = "row_id", permutations: int = 8, seed: int = 1,
) -> DataFrame:
    """Attributions of any scorer, in the shape of `attributions`: Shapley values by sampled orders.

    `load` runs once per task and returns a function from a pandas frame of the features to one number per row. For
    each seeded order of the features a row walks from the background values to its own, one feature at a time, and
    a feature's phi is its mean change of the score. So base plus all phis is the score of the row, and a linear scorer
    gets its exact attributions. Nulls count as 0. All rows of a batch walk together; no shuffle.
    """
    orders = [list(np.random.default_rng([seed, i]).permutation(len(features))) for i in range(permutations)]
    start = np.array([float(background[f]) for f in features])

    def run(frames: Iterator) -> Iterator:
        score = load()
        for frame in frames:
            own = frame[features].fillna(0).to_numpy(dtype=float)
            now = np.tile(start, (len(own), 1))
            base = np.asarray(score(pd.DataFrame(now, columns=features)), dtype=float)
            phis = np.zeros_like(own)
            for order in orders:
                now, last = np.tile(start, (len(own), 1)), base
                for f in order:
                    now[:, f] = own[:, f]
                    after = np.asarray(score(pd.DataFrame(now, columns=features)), dtype=float)
                    phis[:, f] += (after - last) / len(orders)
                    last = after
            yield pd.DataFrame({
                key: frame[key], "base": base, "features": [features] * len(own), "values": list(own), "phis": list(phis)})

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, base double, features array<string>, values array<double>, phis array<double>"
    rows = df.select(quoted(key), *[quoted(f).cast("double").alias(f) for f in features])
    return rows.mapInPandas(run, schema)


def attribution_rows(attributed: DataFrame, key: str = "row_id") -> DataFrame:
    """Long form: `(key, base, feature, value, phi)`."""
    rows = attributed.select(key, "base", F.inline(F.arrays_zip("features", "values", "phis")))
    return rows.withColumnsRenamed({"features": "feature", "values": "value", "phis": "phi"})


def feature_importance(attributed: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature; one partial row per feature and task is shuffled."""
    return _importance(attributed).select("feature", "importance")


def _importance(attributed: DataFrame) -> DataFrame:
    names = attributed.select("features").limit(1).scalar()
    rows = attributed.select(F.posexplode("phis").alias("place", "phi"))
    means = rows.groupBy("place").agg(F.avg(F.abs("phi")).alias("importance"))
    return means.select("place", F.get(names, "place").alias("feature"), "importance")


def dependence(attributed: DataFrame, feature: str, other: str, key: str = "row_id") -> DataFrame:
    """Value and attribution of one feature beside the value of an interacting one."""
    def entry(column: str, name: str) -> Column:
        return F.element_at(column, F.array_position("features", F.lit(name)).cast("int"))

    return attributed.select(
        key, entry("values", feature).alias("value"), entry("phis", feature).alias("phi"),
        entry("values", other).alias("other_value"),
    )


def decision_path(attributed: DataFrame, key: str = "row_id") -> DataFrame:
    """Per row the score as it builds up from the base, least important feature first.

    The order of the features is one for all rows. The running sum works inside the row's own array,
    so rows are not shuffled.
    """
    ranked = bounded_rows(_importance(attributed))
    ranked = sorted(ranked, key=lambda r: (r["importance"], r["feature"]))
    if not ranked:
        return attributed.select(key, F.lit(0).alias("step"), F.lit("").alias("feature"),
                                 F.col("base").alias("phi"), F.col("base").alias("total")).limit(0)
    # The order is known here, so a total is the one before it and more values. A projection holds the totals of some
    # features, so that neither the number of projections nor the terms of all totals grow with the square of the features.
    rows = attributed.select(key, F.col("base").alias("_total"), "phis")
    totals, last, size = [], F.col("_total"), max(1, int(len(ranked) ** 0.5))
    for at in range(0, len(ranked), size):
        found = {}
        for step, r in enumerate(ranked[at:at + size], at):
            last = last + F.get("phis", F.lit(r["place"]))
            found[f"_total{step}"] = last
        rows = rows.withColumns(found)
        totals += found
        last = F.col(totals[-1])
    steps = F.array(*[
        F.struct(F.lit(r["feature"]).alias("feature"), F.get("phis", F.lit(r["place"])).alias("phi"), F.col(t).alias("total"))
        for r, t in zip(ranked, totals)])
    rows = rows.select(key, F.posexplode(steps).alias("step", "_e"))
    return rows.select(key, "step", "_e.feature", "_e.phi", "_e.total")
