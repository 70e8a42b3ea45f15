"""Feature lists, coefficient cards and vocabulary files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flagstone.sources.events import read_indexed


def read_feature_list(spark: SparkSession, path: str, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """One feature name per line, as `(pos, feature)`; keeps names with one of the prefixes."""
    return feature_list(_lines(spark, path).select("pos", F.col("line").alias("feature")), prefixes)


def feature_list(features: DataFrame, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Names with one of the prefixes. Positions stay those of the full list."""
    if not prefixes:
        return features
    wanted = F.lit(False)
    for prefix in prefixes:
        wanted = wanted | F.col("feature").startswith(prefix)
    return features.filter(wanted)


def read_coefficients(spark: SparkSession, path: str) -> DataFrame:
    """CSV `,coefficient` as `(feature, coefficient)`."""
    return read_indexed(spark, path, "feature", "_c0 string, coefficient double")


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """One token per line, as `(token, id)` with id = line number from 0."""
    return _lines(spark, path).select(F.col("line").alias("token"), F.col("pos").alias("id"))


def write_vocab(vocab: DataFrame, path: str) -> None:
    """One token per line in id order. A vocabulary grows with the columns, not with the rows."""
    vocab.repartition(1).sortWithinPartitions("id").select("token").write.mode("overwrite").text(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of one file with their positions; of several files they would not be defined."""
    whole = spark.read.text(path, wholetext=True)
    if len(whole.inputFiles()) > 1:
        raise ValueError(f"{path} has several files")
    text = F.regexp_replace("value", r"\r?\n$", "")
    return whole.select(F.posexplode(F.split(text, r"\r?\n")).alias("pos", "line"))
