"""Probabilities, labels and time spans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def whole_days(start: Column, end: Column) -> Column:
    """Full days from `start` to `end`, floored (negative spans round down)."""
    return F.floor(F.timestamp_diff("MICROSECOND", start, end) / F.lit(86_400_000_000)).cast("long")


def minus_days(ts: Column, days: Column) -> Column:
    """`ts` less a fractional number of days, to the microsecond."""
    micros = F.rint(days * F.lit(86_400_000_000.0)).cast("long")
    return F.timestamp_add("MICROSECOND", -micros, ts)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` computed once per row, also where `use` repeats it per element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def softmax(logits: Column) -> Column:
    """Class probabilities of an array, shifted by its maximum."""
    def shares(powers: Column) -> Column:
        total = F.aggregate(powers, F.lit(0.0), lambda a, b: a + b)
        return once(total, lambda t: F.transform(powers, lambda p: p / t))

    powers = once(F.array_max(logits), lambda top: F.transform(logits, lambda z: F.exp(z - top)))
    return once(powers, shares)


def arg_max(values: Column) -> Column:
    """0-based place of the largest element, first on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def rounded_label(p: Column) -> Column:
    """0/1 by half-to-even rounding, so 0.5 is 0."""
    return F.rint(p).cast("int")


def label_above(p: Column, threshold: Column | float, inclusive: bool = False) -> Column:
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (p >= t if inclusive else p > t).cast("int")


def ratio(a: Column, b: Column) -> Column:
    """`a / b`, or 0 where `b` is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f_score(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def g_mean(tpr: Column, fpr: Column) -> Column:
    return F.sqrt(tpr * (1 - fpr))


def cross_entropy(label: Column, logit: Column) -> Column:
    """Binary cross-entropy of one row, stable for large logits."""
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))
