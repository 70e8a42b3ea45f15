"""Global order without a one-task window.

Keys are cut into ranges of about equal row count. Each range is summed where it lies, the few
range totals are prefix-summed, and a window then runs inside each range. Results are exact;
the approximate quantiles only decide where ranges begin.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType

from flagstone.functions.text import quoted
from flagstone.plans.shared import bounded_rows, cut_lineage, measured

# A window task gets about this many rows, unless that makes more than MAX_RANGES ranges.
RANGE_ROWS = 1_000_000
MAX_RANGES = 10_000
# Ranges per round, and the rows that are few enough to sort, when looking for one row.
SEARCH_RANGES = 1000
SORT_ROWS = 100_000


def _ranges(df: DataFrame, key: Column, ranges: int, name: str = "_range") -> DataFrame:
    """Add the range number of a numeric key, rising with the key. As in a window, null keys come first and
    NaN last; each has a range of its own."""
    keyed = df.withColumn("_key", key.cast("double"))
    steps = [i / ranges for i in range(1, ranges)]
    cuts = sorted(set(keyed.approxQuantile("_key", steps, 1 / (2 * ranges)))) if steps else []
    if not cuts:
        return keyed.withColumn(name, F.lit(0)).drop("_key")
    edges = [float("-inf"), *cuts, float("inf")]
    cutter = Bucketizer(splits=edges, inputCol="_key", outputCol=name, handleInvalid="keep")
    number = F.when(F.col("_key").isNull(), F.lit(-1)).otherwise(F.col(name).cast("int"))
    return cutter.transform(keyed).withColumn(name, number).drop("_key")


def ranged(df: DataFrame, key: str, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, bool]:
    """`df` with its ranges of `key`, and whether there is more than one. The rows are counted, and
    a large table is scanned once more for the key alone; nothing is kept."""
    ranges = min(MAX_RANGES, -(-df.count() // range_rows))
    return (_ranges(df, F.col(key), ranges), True) if ranges > 1 else (df, False)


COMBINE = {
    # The sum before the first value is 0, with and without ranges.
    "sum": (F.sum, lambda base, inside: F.coalesce(base, F.lit(0)) + F.coalesce(inside, F.lit(0))),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
}


def running(
    df: DataFrame,
    key: str,
    wanted: dict[str, tuple[str, str]],
    by: list[str] | None = None,
    descending: bool = False,
    split: bool = True,
) -> DataFrame:
    """Add, for each `{name: (function, column)}`, `name` (the `sum`, `min` or `max` up to and including
    this row in the order of `key`) and `name_total` (that of the group).

    `df` comes from `ranged`, with `split` as it says; keys are unique within a group.
    """
    by = by or []
    columns = [c for c in df.columns if c not in wanted and c != "_range"]
    order = F.col(key).desc() if descending else F.col(key).asc()
    up_to_here = (Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy(*by)
    if not split:
        inside = group.orderBy(order).rowsBetween(*up_to_here)
        nothing = F.lit(None)
        found = [COMBINE[f][1](nothing, COMBINE[f][0](c).over(inside)).alias(n) for n, (f, c) in wanted.items()]
        whole = [COMBINE[f][0](c).over(group).alias(f"{n}_total") for n, (f, c) in wanted.items()]
        return df.select(*[quoted(c) for c in columns], *found, *whole)
    flip = -1 if descending else 1
    parts = df.groupBy(*by, "_range").agg(*[COMBINE[f][0](c).alias(f"_{n}") for n, (f, c) in wanted.items()])
    before = group.orderBy(flip * F.col("_range")).rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(
        *[F.col(b).alias(f"_by_{b}") for b in by],
        F.col("_range").alias("_base_range"),
        *[COMBINE[f][0](f"_{n}").over(before).alias(f"_{n}") for n, (f, _) in wanted.items()],
        *[COMBINE[f][0](f"_{n}").over(group).alias(f"{n}_total") for n, (f, _) in wanted.items()],
    )
    # Without groups the bases have at most MAX_RANGES rows; with groups their size is measured.
    bases = measured(bases) if by else F.broadcast(bases)
    same = F.col("_range") == F.col("_base_range")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    inside = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(*up_to_here)
    found = [COMBINE[f][1](F.col(f"_{n}"), COMBINE[f][0](c).over(inside)).alias(n) for n, (f, c) in wanted.items()]
    return df.join(bases, same).select(
        *[quoted(c) for c in columns], "_range", *found, *[f"{n}_total" for n in wanted]
    )


def running_totals(
    df: DataFrame, key: str, sums: dict[str, str], by: list[str] | None = None, descending: bool = False,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Running and whole sums `{name: column}` of a table."""
    cut, split = ranged(df, key, range_rows)
    return running(cut, key, {n: ("sum", c) for n, c in sums.items()}, by, descending, split).drop("_range")


def with_position(df: DataFrame, key: str, name: str = "position") -> DataFrame:
    """Add the 1-based position in the order of a unique numeric key, and `<name>_total`."""
    return running_totals(df.withColumn("_one", F.lit(1).cast("long")), key, {name: "_one"}).drop("_one")


def nth_value(df: DataFrame, n: int, order: Column):
    """The n-th smallest (from 1) value of a unique numeric `order`; None where there are fewer rows.

    Each round keeps one of about a thousand ranges, so a few narrow scans leave a set small enough
    to sort; the table itself is never shuffled. A null key, or one that is repeated at the cut, is an error.
    """
    rest = df.select(order.alias("_order"))
    rows, nulls = rest.agg(F.count(F.lit(1)), F.count_if(F.col("_order").isNull())).first()
    if nulls:
        raise ValueError("a key is null")
    if not 1 <= n <= rows:
        return None
    whole = isinstance(rest.schema["_order"].dataType, IntegralType)
    while rows > SORT_ROWS:
        # Counted from the smallest key, since doubles cannot tell all large numbers apart.
        low = rest.agg(F.min("_order")).scalar() if whole else F.lit(0)
        cut = _ranges(rest, F.col("_order") - low if whole else F.col("_order"), SEARCH_RANGES)
        chosen, n, found = _part_with(cut.groupBy("_range").count(), n, SEARCH_RANGES + 2)
        if found == rows:
            raise ValueError("keys are repeated or lie too close together")
        # Every round filters the source again; nothing is kept between rounds.
        rest, rows = cut.filter(F.col("_range") == chosen).drop("_range"), found
    return _sorted_at(rest, n)


def nth_digest(df: DataFrame, n: int, order: Column) -> str | None:
    """The same for hex digests. Three more digits per round make 4096 parts of equal size. Equal digests mean
    repeated keys, which is an error at the cut."""
    rest, width = df.select(order.alias("_order")), 0
    rows = None
    while rows is None or rows > SORT_ROWS:
        if width >= 32:
            raise ValueError("keys are repeated")
        width += 3
        parts = rest.groupBy(F.substring("_order", 1, width).alias("_part")).count()
        chosen, n, rows = _part_with(parts, n, 16**3)
        if chosen is None:
            return None
        rest = rest.filter(F.substring("_order", 1, width) == chosen)
    return _sorted_at(rest, n)


def _sorted_at(rest: DataFrame, n: int):
    """The n-th of at most SORT_ROWS keys, which the next one must not equal."""
    found = [r["_order"] for r in rest.orderBy("_order").offset(n - 1).limit(2).collect()]
    if len(found) == 2 and found[0] == found[1]:
        raise ValueError("keys are repeated")
    return found[0]


def _part_with(counts: DataFrame, n: int, most: int) -> tuple:
    """Of `(part, count)` rows: the part that holds the n-th row, its place in it, and its size."""
    for part, count in sorted(bounded_rows(counts, most)):
        if 1 <= n <= count:
            return part, n, count
        n -= count
    return None, 0, 0


def dense_positions(df: DataFrame, key: str, name: str) -> DataFrame:
    """Add the 0-based position in the order of a unique key of any type.

    Rows are range-partitioned and sorted by the key, and written once. The position is then the
    offset of a row's partition plus its place in it.
    """
    ordered = cut_lineage(df.repartitionByRange(key).sortWithinPartitions(key))
    tagged = ordered.withColumn("_id", F.monotonically_increasing_id())
    tagged = tagged.withColumn("_part", F.shiftright("_id", 33))
    sizes = tagged.groupBy("_part").count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the shuffle.
    offsets = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    place = F.col("_id").bitwiseAND((1 << 33) - 1)
    return (
        tagged.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + place)
        .drop("_id", "_part", "_offset")
    )


def last_before(df: DataFrame, by: str, position: str, value: str, chunk: int | Column) -> DataFrame:
    """Add `last`: the latest non-null `value` of the same `by` at or before this row's position.

    Positions are cut into chunks. Each chunk's latest value is carried to the later ones, so a hot
    `by` value is spread over as many tasks as it has chunks.
    """
    item = F.when(F.col(value).isNotNull(), F.struct(position, value))
    cut = df.withColumn("_chunk", F.floor(F.col(position) / F.lit(chunk)).cast("long"))
    ends = cut.groupBy(by, "_chunk").agg(F.max(item).alias("_end"))
    earlier = Window.partitionBy(by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(by, "_chunk", F.max("_end").over(earlier).alias("_carried"))
    inside = Window.partitionBy(by, "_chunk").orderBy(position).rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    joined = cut.withColumn("_inside", F.max(item).over(inside)).join(carried, [by, "_chunk"])
    return joined.select(*df.columns, F.coalesce("_inside", "_carried")[value].alias("last"))
