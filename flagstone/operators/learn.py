"""Batch scoring with user models, masked-value prediction from counts, boosted trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import Column, DataFrame, functions as F

from flagstone.functions.numbers import softmax
from flagstone.functions.text import choose, quoted, whole_columns
from flagstone.plans.shared import bounded_rows, measured


def score_batches(df: DataFrame, load: Callable[[], Callable], schema: str) -> DataFrame:
    """Score with any user model, batch by batch, on a stored or streaming table.

    `load` runs once per task and returns a function from a pandas frame to a pandas frame with the
    columns of `schema`.
    """
    def run(frames: Iterator) -> Iterator:
        model = load()
        for frame in frames:
            yield model(frame)

    return df.mapInPandas(run, schema)


def value_model(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """Log-probabilities of each value of each feature given each value of the target, from counts with one
    added: `(candidate, prior, feature, value, logp)`.

    Only pairs that occur have a row. A row of null `value` holds for all other values of its feature, for each
    candidate and feature. One pass over the rows counts everything; the rest works on those counts.
    """
    rows = df.filter(quoted(target).isNotNull()).select(
        quoted(target).cast("string").alias("candidate"),
        *[quoted(f).cast("string").alias(f) for f in features],
        F.lit("").alias("_rows"),
    )
    long = rows.unpivot(["candidate"], [quoted(f) for f in [*features, "_rows"]], "feature", "value")
    counts = measured(long.filter("value is not null").groupBy("candidate", "feature", "value").count())
    sizes = counts.filter("feature = '_rows'")
    every = sizes.agg(F.sum("count") + F.count(F.lit(1))).scalar()
    priors = sizes.select("candidate", F.log((F.col("count") + 1) / every).alias("prior"))
    pairs = counts.filter("feature <> '_rows'")
    kinds = pairs.groupBy("feature").agg(F.count_distinct("value").alias("kinds"))
    totals = pairs.groupBy("candidate", "feature").agg(F.sum("count").alias("total"))
    others = totals.select("candidate", "feature", F.lit(None).cast("string").alias("value"), F.lit(0).cast("long").alias("count"))
    sized = pairs.unionByName(others).join(totals, ["candidate", "feature"]).join(kinds, "feature").join(priors, "candidate")
    chance = (F.col("count") + 1) / (F.col("total") + F.col("kinds"))
    return sized.select("candidate", "prior", "feature", "value", F.log(chance).alias("logp"))


def _likeliest(weights: DataFrame, names: list[str], key: str, k: int) -> DataFrame:
    """The `k` best candidates of each row from its array `_w` of log weights, ties by the smaller candidate."""
    ordered = F.array_sort(F.transform(
        softmax(F.col("_w")),
        lambda p, i: F.struct((-p).alias("minus"), F.get(F.array(*[F.lit(n) for n in names]), i).alias("candidate")),
    ))
    best = weights.select(key, F.posexplode(F.slice(ordered, 1, k)).alias("_i", "_e"))
    return best.select(key, "_e.candidate", (-F.col("_e.minus")).alias("p"), (F.col("_i") + 1).alias("rank"))


def _no_candidates(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.lit("").alias("candidate"), F.lit(0.0).alias("p"), F.lit(1).alias("rank")).limit(0)


def fill_masked(df: DataFrame, target: str, features: list[str], key: str = "row_id", k: int = 2) -> DataFrame:
    """The `k` likeliest values of a hidden feature per row, from the values of other features.

    For flags and other features with few values: the counted model becomes one expression, so
    rows are scored where they lie. Values that no row with a target has say nothing.
    """
    priors: dict[str, float] = {}
    chances: dict[tuple[str, str], dict[str, float]] = {}
    others: dict[tuple[str, str], float] = {}
    values: dict[str, set[str]] = {}
    for r in bounded_rows(value_model(df, target, features)):
        priors[r["candidate"]] = r["prior"]
        if r["value"] is None:
            others[r["candidate"], r["feature"]] = r["logp"]
        else:
            chances.setdefault((r["candidate"], r["feature"]), {})[r["value"]] = r["logp"]
            values.setdefault(r["feature"], set()).add(r["value"])
    whole = whole_columns(df)

    def weight(candidate: str) -> Column:
        total = F.lit(priors[candidate])
        for f in features:
            if (candidate, f) in others:
                by_value = {v: others[candidate, f] for v in sorted(values[f])} | chances.get((candidate, f), {})
                total = total + choose(f, by_value, F.lit(0.0), f in whole)
        return total

    names = sorted(priors)
    if not names:
        return _no_candidates(df, key)
    return _likeliest(df.select(key, F.array(*[weight(n) for n in names]).alias("_w")), names, key, k)


def fill_masked_by_join(df: DataFrame, target: str, features: list[str], key: str = "row_id", k: int = 2) -> DataFrame:
    """The same for features with very many values; the hidden feature itself must have few (`bounded_rows`).

    A value's log-probabilities are one array over all candidates. A row's known values meet their arrays by a join on
    feature and value, and the row adds them up; a row of unknown values keeps the priors. Keys are unique.
    """
    model = measured(value_model(df, target, features))
    found = bounded_rows(model.select("candidate", "prior").distinct(), 10_000)
    priors = {r["candidate"]: r["prior"] for r in found}
    names = sorted(priors)
    if not names:
        return _no_candidates(df, key)
    place = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])[F.col("candidate")]
    # Lists of at most one entry per candidate.
    entries = model.withColumn("place", place).groupBy("feature", "value").agg(
        F.map_from_entries(F.collect_list(F.struct("place", "logp"))).alias("logps"))
    others = entries.filter("value is null").select("feature", F.col("logps").alias("others"))
    known = entries.filter("value is not null").join(others, "feature")
    array = F.transform(
        F.sequence(F.lit(0), F.lit(len(names) - 1)),
        lambda i: F.coalesce(F.element_at("logps", i), F.element_at("others", i), F.lit(0.0)))
    known = known.select("feature", "value", array.alias("logps"))
    long = df.select(key, *[quoted(f).cast("string").alias(f) for f in features]).unpivot(
        [key], [quoted(f) for f in features], "feature", "value"
    )
    start = F.array(*[F.lit(priors[n]) for n in names])
    # At most one array per feature of the row.
    added = F.aggregate(F.collect_list("logps"), start, lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    weights = long.join(known, ["feature", "value"], "left").groupBy(key).agg(added.alias("_w"))
    return _likeliest(weights, names, key, k)


def gbt_stages(features: list[str], label: str = "frd", seed: int = 1, **options) -> Pipeline:
    inputs = VectorAssembler(inputCols=features, outputCol="inputs", handleInvalid="keep")
    return Pipeline(stages=[inputs, GBTClassifier(featuresCol="inputs", labelCol=label, seed=seed, **options)])


def gbt_baseline(train: DataFrame, features: list[str], label: str = "frd", seed: int = 1, **options) -> PipelineModel:
    """Boosted trees on the flags, as a baseline for other models. Nulls count as 0."""
    return gbt_stages(features, label, seed, **options).fit(_plain(train, features, label))


def gbt_score(model: PipelineModel, df: DataFrame, features: list[str], label: str | None = "frd",
              keep: list[str] = []) -> DataFrame:
    """Add `score`, the probability of class 1."""
    scored = model.transform(_plain(df, features, label, keep))
    columns = [quoted(c) for c in keep] + ([] if label is None else [quoted(label)])
    return scored.select(*columns, vector_to_array("probability")[1].alias("score"))


def _plain(df: DataFrame, features: list[str], label: str | None, keep: list[str] = []) -> DataFrame:
    columns = [F.coalesce(quoted(f).cast("double"), F.lit(0.0)).alias(f) for f in features]
    return df.select(*[quoted(c) for c in keep], *columns, *([] if label is None else [quoted(label)]))


# The search space.
SEARCH_SPACE = {
    "maxDepth": [3, 4, 5, 6, 7],
    "stepSize": [0.03, 0.2],
    "subsamplingRate": [0.5, 1.0],
    "minInstancesPerNode": [200, 600, 1000],
}


def search(
    train: DataFrame, features: list[str], grid: dict[str, list] = SEARCH_SPACE, label: str = "frd",
    seed: int = 1, parallelism: int = 4, train_ratio: float = 0.8, **options,
) -> tuple[PipelineModel, DataFrame]:
    """Fit every point of the grid; return the best model and the table of trials."""
    stages = gbt_stages(features, label, seed, **options)
    trees = stages.getStages()[-1]
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(trees.getParam(name), values)
    points = builder.build()
    tuner = TrainValidationSplit(
        estimator=stages, estimatorParamMaps=points, trainRatio=train_ratio, seed=seed, parallelism=parallelism,
        evaluator=BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC"),
    )
    rows_in = _plain(train, features, label).persist()
    try:
        tuned = tuner.fit(rows_in)
    finally:
        rows_in.unpersist()
    names = list(grid)
    rows = [
        (i, *[str(point[trees.getParam(n)]) for n in names], float(metric))
        for i, (point, metric) in enumerate(zip(points, tuned.validationMetrics, strict=True))
    ]
    schema = "trial int, " + ", ".join(f"{n} string" for n in names) + ", auc double"
    return tuned.bestModel, train.sparkSession.createDataFrame(rows, schema)
