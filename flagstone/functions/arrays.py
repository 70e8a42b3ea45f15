"""Token-id arrays and the numeric input side of tabular models."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from flagstone.functions.numbers import once
from flagstone.functions.text import quoted


def bracket(ids: Column, first: int, last: int) -> Column:
    """Put the ids of the start and end tokens around an array."""
    return F.concat(F.array(F.lit(first)), ids, F.array(F.lit(last)))


def constant_array(value: int, length: int | Column) -> Column:
    return F.array_repeat(F.lit(value), length)


def pad_to(ids: Column, length: Column, pad: int) -> Column:
    """Fill up to `length` with `pad`."""
    return F.concat(ids, F.array_repeat(F.lit(pad), (length - F.size(ids)).cast("int")))


def pad_longest(df: DataFrame, ids: str, pad: int, mask: str = "attention_mask") -> DataFrame:
    """Pad all rows to the longest one; `mask` is 1 on real tokens and 0 on padding."""
    longest = df.agg(F.max(F.size(ids))).scalar()
    size = F.size(ids)
    return df.withColumn(mask, pad_to(F.array_repeat(F.lit(1), size), longest, 0)).withColumn(
        ids, pad_to(F.col(ids), longest, pad)
    )


def category_offsets(sizes: list[int], reserved: int = 0) -> list[int]:
    """Start id of each column's categories: exclusive prefix sums, after `reserved` ids."""
    return list(accumulate([reserved, *sizes]))[:-1]


def offset_encode(columns: list[str], sizes: list[int], reserved: int = 0) -> Column:
    """One id space over all categorical columns."""
    starts = category_offsets(sizes, reserved)
    return F.array(*[(quoted(c) + F.lit(s)).cast("long") for c, s in zip(columns, starts, strict=True)])


def standardise(df: DataFrame, columns: list[str], mean_std: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """`(x - mean) / std`; both are taken from the table (sample std) where not given."""
    if mean_std is None:
        stats = [F.struct(F.avg(quoted(c)).alias("mean"), F.stddev_samp(quoted(c)).alias("std")).alias(f"_{i}")
                 for i, c in enumerate(columns)]
        row = df.agg(*stats).first()
        mean_std = {c: tuple(row[i]) for i, c in enumerate(columns)}
    scaled = {c: (quoted(c) - F.lit(mean_std[c][0])) / F.lit(mean_std[c][1]) for c in columns}
    return df.withColumns(scaled)


def layer_norm(values: Column, eps: float = 1e-5) -> Column:
    """Zero mean and unit (population) variance inside one array."""
    def scaled(mean: Column) -> Column:
        squares = F.aggregate(values, F.lit(0.0), lambda a, b: a + (b - mean) * (b - mean))
        return once(
            F.sqrt(squares / F.size(values) + F.lit(eps)),
            lambda std: F.transform(values, lambda v: (v - mean) / std),
        )

    return once(F.aggregate(values, F.lit(0.0), lambda a, b: a + b) / F.size(values), scaled)
