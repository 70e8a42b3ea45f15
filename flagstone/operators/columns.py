"""Choosing, casting and filtering columns by name."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from flagstone.functions.text import quoted

# Name prefixes of risk flags and the fixed columns of an event table.
FLAG_PREFIXES = ("tmxrc", "sumrc")
FLAG_PREFIXES_V2 = ("tsrc", "tmxrc")
FIXED_COLUMNS = ["frd", "datetime", "eval", "policy_score", "org_id", "policy", "transaction_amount"]


def columns_with_prefix(df: DataFrame, prefixes: tuple[str, ...] = FLAG_PREFIXES) -> list[str]:
    return [c for c in df.columns if c.startswith(tuple(prefixes))]


def predictors(df: DataFrame, variable: bool = False, extra: tuple[str, ...] | list[str] = ()) -> list[str]:
    """Flag columns by substring, then numeric `intvar` columns, then a list of the caller."""
    found = [c for c in df.columns if any(p in c for p in FLAG_PREFIXES)]
    if variable:
        found += [c for c in df.columns if "intvar" in c]
    return found + list(extra)


def select_features(df: DataFrame, wanted: list[str], keep: list[str] = FIXED_COLUMNS) -> DataFrame:
    """The wanted and the kept columns that exist, in the order of the lists."""
    present = set(df.columns)
    return df.select(*[quoted(c) for c in [*wanted, *keep] if c in present])


def columns_to_remove(df: DataFrame, candidates: list[str], keep: list[str]) -> list[str]:
    """Candidates that are not kept and that the table has."""
    present, kept = set(df.columns), set(keep)
    return [c for c in candidates if c not in kept and c in present]


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*names)


def clean_name(name: str) -> str:
    return "_".join(name.split())


def clean_names(df: DataFrame) -> DataFrame:
    """Blanks in column names become underscores."""
    return df.withColumnsRenamed({c: clean_name(c) for c in df.columns if clean_name(c) != c})


def clean_feature_names(features: DataFrame) -> DataFrame:
    """The same rule for a feature list."""
    return features.withColumn("feature", F.regexp_replace(F.trim("feature"), r"\s+", "_"))


def column_slice(df: DataFrame, start: int, stop: int) -> DataFrame:
    """Columns by place: `start` up to but without `stop`."""
    return df.select(*[quoted(c) for c in df.columns[start:stop]])


def to_number(df: DataFrame, name: str, kind: str = "int") -> DataFrame:
    """Numeric cast; under ANSI mode text that is no number is an error."""
    return df.withColumn(name, quoted(name).cast(kind))


def to_long(df: DataFrame, names: list[str]) -> DataFrame:
    """Integer cast, truncating toward zero."""
    return df.withColumns({c: quoted(c).cast("long") for c in names})


def to_text(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({c: quoted(c).cast("string") for c in names})


def fill_zero(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    # The list is quoted because names may hold dots or blanks.
    return df.na.fill(0, names and [f"`{c}`" for c in names])


def add_constant(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def to_long_form(df: DataFrame, ids: list[str], names: list[str]) -> DataFrame:
    """One row per `(ids, feature, value)`."""
    return df.unpivot([quoted(c) for c in ids], [quoted(c) for c in names], "feature", "value")


def with_class_weights(df: DataFrame, label: str = "frd", name: str = "weights_column") -> DataFrame:
    """Fraud rows weigh the rounded (half to even) ratio of the classes, other rows 1."""
    odds = df.agg(F.bround(F.try_divide(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)))).scalar()
    return df.withColumn(name, F.when(F.col(label) == 1, odds).when(F.col(label) == 0, F.lit(1.0)))


def attach_labels(features: DataFrame, labels: DataFrame, key: str = "row_id") -> DataFrame:
    """Put labels beside their feature rows by a stable key."""
    return features.join(labels, key)


def features_and_label(df: DataFrame, features: list[str], label: str = "frd", others: list[str] = []) -> DataFrame:
    """`x` (array of longs) and `y`, with other columns such as the split."""
    x = F.array(*[quoted(c).cast("long") for c in features])
    return df.select(*[quoted(c) for c in others], x.alias("x"), quoted(label).cast("long").alias("y"))


def not_null(df: DataFrame, name: str = "policy_score") -> DataFrame:
    return df.filter(quoted(name).isNotNull())


def with_label(df: DataFrame, value: int, columns: list[str] | None = None, label: str = "frd") -> DataFrame:
    """Rows of one class, as predictors only when `columns` is given."""
    kept = df.filter(F.col(label) == value)
    return kept if columns is None else kept.select(*[quoted(c) for c in columns])


def flag_is(df: DataFrame, name: str, value: bool) -> DataFrame:
    """Rows with a true or a false flag; null is neither."""
    return df.filter(F.col(name) == F.lit(value))


def keep_listed(long: DataFrame, features: DataFrame) -> DataFrame:
    """Rows of a long table whose feature is in the list."""
    return long.join(features.select("feature"), "feature", "left_semi")


def name_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("feature").exceptAll(b.select("feature"))


def name_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("feature").intersect(b.select("feature"))


def policy_counts(df: DataFrame, by: list[str] = ["org_id", "frd"], counted: str = "policy") -> DataFrame:
    """Non-null count per group."""
    return df.groupBy(*by).agg(F.count(quoted(counted)).alias("count"))


def value_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """Matrix of counts: a row per value (nulls are not counted), a column per feature; one pass."""
    long = df.select(*[quoted(c).cast("string").alias(c) for c in names]).unpivot(
        [], [quoted(c) for c in names], "feature", "value"
    )
    counts = long.filter("value is not null").groupBy("value", "feature").count()
    return counts.groupBy("value").pivot("feature", list(names)).sum("count")


def class_ratio(df: DataFrame, by: str = "split", label: str = "frd") -> DataFrame:
    """Non-fraud rows per fraud row, to two decimals (half to even); null without fraud."""
    odds = F.try_divide(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1))
    return df.groupBy(by).agg(F.bround(odds, 2).alias("ratio"))


def shape(df: DataFrame) -> DataFrame:
    """Row and column count."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def mean_pool(df: DataFrame, key: str, vector: str, piece: int = 512) -> DataFrame:
    """Element-wise mean of the vectors of a key.

    Vectors are summed as wholes inside the tasks: a task sends one row per key, place and length of a piece of `piece`
    numbers, so neither the rows of a hot key nor the rows of long vectors grow with the table. Nulls are left out of the mean of
    their place (null where nothing is left); shorter vectors count for their own places; keys of empty vectors only give no row.
    """
    # A table of vectors of one length has one length of piece but for the last, so nothing is padded.
    values = F.col("_piece")["values"]
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(vector) - 1) / piece).cast("int")), lambda i: F.struct(
        i.alias("place"), F.slice(vector, i * piece + 1, piece).cast("array<double>").alias("values")))
    rows = df.filter(F.size(vector) > 0).select(F.col(key), F.explode(cut).alias("_piece"))
    known = F.transform(values, lambda x: F.when(x.isNull(), 0.0).otherwise(1.0))
    rows = rows.select(
        key, F.col("_piece")["place"].alias("_place"), F.size(values).alias("_size"),
        array_to_vector(F.concat(F.transform(values, lambda x: F.coalesce(x, F.lit(0.0))), known)).alias("_numbers"))
    sums = rows.groupBy(key, "_place", "_size").agg(vector_to_array(Summarizer.sum(F.col("_numbers"))).alias("_sums"))
    halves = sums.select(key, "_place", F.slice("_sums", F.lit(1), F.col("_size")).alias("_s"), F.slice("_sums", F.col("_size") + 1, F.col("_size")).alias("_n"))

    def added(name: str) -> Column:
        # At most one entry per length of a piece.
        return F.aggregate(F.collect_list(name), F.array().cast("array<double>"), lambda a, b: F.zip_with(
            a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0))))

    means = halves.groupBy(key, "_place").agg(F.zip_with(added("_s"), added("_n"), lambda s, n: F.when(n > 0, s / n)).alias("_mean"))
    ordered = F.array_sort(F.collect_list(F.struct("_place", "_mean")))
    return means.groupBy(key).agg(F.flatten(F.transform(ordered, lambda e: e["_mean"])).alias(vector))
