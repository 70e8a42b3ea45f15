"""Rows by position, batches and seeded picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flagstone.plans.hashing import digest
from flagstone.plans.ordered import nth_value, with_position


def first_rows(df: DataFrame, n: int, key: str = "row_id") -> DataFrame:
    """The first `n` rows in the order of a unique key: finds the n-th key, then filters."""
    cut = nth_value(df, n, F.col(key))
    if cut is None:
        return df if n > 0 else df.limit(0)
    return df.filter(F.col(key) <= F.lit(cut))


def first_half(df: DataFrame, key: str = "row_id") -> DataFrame:
    return first_rows(df, df.count() // 2, key)


def row_at(df: DataFrame, place: int, key: str = "row_id") -> DataFrame:
    """The row at a 0-based place."""
    found = nth_value(df, place + 1, F.col(key))
    return df.limit(0) if found is None else df.filter(F.col(key) == F.lit(found))


def batches(df: DataFrame, size: int, key: str = "row_id", drop_last: bool = False, name: str = "batch") -> DataFrame:
    """Add a 0-based batch number over the order of a unique key; may drop a short last batch."""
    placed = with_position(df, key, "_position")
    placed = placed.withColumn(name, F.floor((F.col("_position") - 1) / F.lit(size)).cast("long"))
    if drop_last:
        placed = placed.filter(F.col(name) < F.floor(F.col("_position_total") / F.lit(size)))
    return placed.drop("_position", "_position_total")


def shuffled(df: DataFrame, key: str = "row_id", seed: int = 0) -> DataFrame:
    """All rows in a seeded random order. Only of use when the order itself is consumed."""
    return df.orderBy(digest(key, seed))


def random_row(df: DataFrame, key: str = "row_id", seed: int = 0) -> DataFrame:
    """One row, picked by the smallest digest; each task passes on one row."""
    picked = df.agg(F.min_by(F.struct("*"), digest(key, seed)).alias("_row"))
    return picked.filter(F.col("_row").isNotNull()).select("_row.*")


def top_candidates(df: DataFrame, by: list[str], score: str, tie: str, k: int = 2) -> DataFrame:
    """The `k` best rows of each group, ties by the smaller `tie`. Spark keeps `k` per group in
    each task before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def sorted_labels(labels: Column) -> Column:
    return F.array_sort(labels)
