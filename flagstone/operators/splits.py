"""Splitting and sampling by time, by seeded hash and by plan."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from flagstone.functions.numbers import minus_days, whole_days
from flagstone.functions.text import quoted
from flagstone.operators.columns import predictors
from flagstone.plans.hashing import below, digest
from flagstone.plans.ordered import nth_digest
from flagstone.plans.shared import measured


def fraud_spans(df: DataFrame, org: str = "org_id", ts: str = "datetime", label: str = "frd") -> DataFrame:
    """First and last fraud time per organisation; null without fraud."""
    fraud_time = F.when(F.col(label) == 1, F.col(ts))
    return df.groupBy(org).agg(F.min(fraud_time).alias("first_fraud"), F.max(fraud_time).alias("last_fraud"))


def time_cutoffs(spans: DataFrame, k: int = 5) -> DataFrame:
    """Start of the evaluation window: the last fraud time less a k-th of the whole days."""
    days = whole_days(F.col("first_fraud"), F.col("last_fraud")) / F.lit(float(k))
    return spans.withColumn("cutoff", minus_days(F.col("last_fraud"), days))


def time_split(
    df: DataFrame, k: int = 5, org: str = "org_id", ts: str = "datetime", label: str = "frd",
    name: str = "eval", strict: bool = False,
) -> DataFrame:
    """Add `eval`: true for rows after the cut-off of their organisation.

    An organisation without fraud is all evaluation; with `strict` it is an error.
    """
    cutoffs = measured(time_cutoffs(fraud_spans(df, org, ts, label), k).select(F.col(org).alias("_org"), "cutoff"))
    joined = df.join(cutoffs, F.col(org).eqNullSafe(F.col("_org")), "left")
    missing = F.raise_error(F.lit("organisation without fraud")) if strict else F.lit(True)
    late = F.coalesce(F.col(ts) > F.col("cutoff"), F.lit(False))
    flag = F.when(F.col("cutoff").isNull(), missing).otherwise(late)
    return joined.select(*[quoted(c) for c in df.columns if c != name], flag.alias(name))


def with_eval(df: DataFrame, k: int = 5, **names) -> DataFrame:
    """Keep an existing `eval` column, else split by time."""
    return df if "eval" in df.columns else time_split(df, k, **names)


def hash_split(
    df: DataFrame, key: str, fraction: float, seed: int, exact: bool = False, name: str = "sampled"
) -> DataFrame:
    """Add a flag that is true for about `fraction` of the rows, or for exactly `ceil(fraction * n)`.

    The exact form finds the digest at the cut (keys must be unique) and compares each row with
    it; the rows themselves are not shuffled.
    """
    mark = digest(key, seed)
    if not exact:
        return df.withColumn(name, below(mark, fraction))
    size = math.ceil(round(fraction * df.count(), 9))
    cut = nth_digest(df, size, mark)
    return df.withColumn(name, F.lit(False) if cut is None else mark <= F.lit(cut))


def complement(df: DataFrame, sample: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows that are not in the sample."""
    return df.join(sample.select(key), key, "left_anti")


def stratified(df: DataFrame, by: str, fractions: dict, key: str, seed: int, exact: bool = False) -> DataFrame:
    """A fraction of each class; with `exact`, `round(fraction * n)` (half to even) rows of each.

    Classes not named are left out.
    """
    mark = digest(key, seed)
    if exact:
        sizes = {r[0]: r[1] for r in df.filter(F.col(by).isin(list(fractions))).groupBy(by).count().collect()}
        keep = F.lit(False)
        for value, fraction in fractions.items():
            group = df.filter(F.col(by) == value)
            cut = nth_digest(group, round(fraction * sizes.get(value, 0)), mark)
            if cut is not None:
                keep = keep | ((F.col(by) == value) & (mark <= F.lit(cut)))
        return df.filter(keep)
    keep = F.lit(False)
    for value, fraction in fractions.items():
        keep = keep | ((F.col(by) == value) & below(mark, fraction))
    return df.filter(keep)


def subset(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """A random part of the rows."""
    return df.filter(below(digest(key, seed), fraction))


def fraud_split(
    df: DataFrame, key: str = "row_id", variable: bool = False, k: int = 5, by_time: bool = True,
    extra: tuple[str, ...] | list[str] = (), train_fraction: float = 0.8, seed: int = 1, exact: bool = False,
    **time_options,
) -> DataFrame:
    """Add `split`: `test` is the evaluation window, the rest is `train` or `val` by seeded hash.

    Returns key, predictors, `frd`, the other columns and `split`, with `frd` as a number. Without
    `by_time` the test part is a random k-th. With `exact` the train part has exactly
    `round(train_fraction * n)` rows (half to even) of the n that are not `test`. `time_options` (`org`, `ts`,
    `strict`) go to `time_split`.
    """
    numbered = df.withColumn("frd", F.col("frd").cast("int"))
    if by_time:
        held = with_eval(numbered, k, **time_options)
    else:
        held = numbered.withColumn("eval", below(digest(key, seed), 1 / k, start=9))
    mark = digest(key, seed)
    train = below(mark, train_fraction)
    if exact:
        rest = held.filter(~F.col("eval"))
        cut = nth_digest(rest, round(train_fraction * rest.count()), mark)
        train = F.lit(False) if cut is None else mark <= F.lit(cut)
    split = F.when(F.col("eval"), "test").otherwise(F.when(train, "train").otherwise("val"))
    # A row with a null flag belongs to neither side.
    placed = held.filter(F.col("eval").isNotNull()).withColumn("split", split)
    inputs = predictors(df, variable, extra)
    rest = [c for c in placed.columns if c not in inputs and c not in (key, "frd", "split")]
    return placed.select(key, *[quoted(c) for c in inputs], "frd", *[quoted(c) for c in rest], "split")
