"""Named sampling plans: parallel lists per organisation, as rows that join to the events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flagstone.plans.hashing import digest, hex_number
from flagstone.plans.shared import measured

PLAN = (
    "name string, org_list array<string>, nonfrd_ratio array<double>, frd_ratio array<double>,"
    " date_range array<struct<first int, last int>>, month_range array<struct<first int, last int>>,"
    " event_types array<string>, primary_industry array<string>, exclude_dates array<array<int>>,"
    " exclude_months array<array<int>>, output_folder string"
)


def plans_from_dicts(spark: SparkSession, plans: dict[str, dict]) -> DataFrame:
    """A plan table from a dict of named dicts of lists."""
    fields = [f.name for f in spark.createDataFrame([], PLAN).schema]
    rows = [tuple(name if f == "name" else plan.get(f) for f in fields) for name, plan in plans.items()]
    return spark.createDataFrame(rows, PLAN)


def read_plans(spark: SparkSession, path: str) -> DataFrame:
    """A plan table from JSON lines."""
    return spark.read.schema(PLAN).json(path)


def plan_rows(plans: DataFrame, name: str | None = None) -> DataFrame:
    """One row per organisation of the named plan (of all plans without a name).

    The organisation list decides the length: shorter lists give null, longer ones are cut. A
    repeated organisation keeps its first entry. An unknown name gives no rows.
    """
    chosen = plans if name is None else plans.filter(F.col("name") == name)
    placed = chosen.select("*", F.posexplode("org_list").alias("pos", "org_id"))

    def at(column: str) -> Column:
        return F.get(F.col(column), F.col("pos"))

    rows = placed.select(
        "name", "org_id", "pos",
        at("nonfrd_ratio").alias("nonfrd_ratio"), at("frd_ratio").alias("frd_ratio"),
        at("date_range")["first"].alias("first_date"), at("date_range")["last"].alias("last_date"),
        at("month_range")["first"].alias("first_month"), at("month_range")["last"].alias("last_month"),
        at("event_types").alias("event_type"), at("primary_industry").alias("industry"),
        at("exclude_dates").alias("exclude_dates"), at("exclude_months").alias("exclude_months"),
        "output_folder",
    )
    others = [c for c in rows.columns if c not in ("name", "org_id")]
    first = F.min_by(F.struct(*others), F.col("pos")).alias("_r")
    return rows.groupBy("name", "org_id").agg(first).select("name", "org_id", "_r.*")


def with_plan(df: DataFrame, rows: DataFrame, org: str = "org_id") -> DataFrame:
    """Events of planned organisations with their plan. Plan rows are counted and measured first."""
    return df.join(measured(rows).withColumnRenamed("org_id", org), org)


def day_number(ts: Column) -> Column:
    return F.year(ts) * 10000 + F.month(ts) * 100 + F.day(ts)


def month_number(ts: Column) -> Column:
    return F.year(ts) * 100 + F.month(ts)


def in_dates(df: DataFrame, ts: str = "datetime") -> DataFrame:
    """Rows in the planned range of days that are not on an excluded day; a missing range keeps all."""
    day = day_number(F.col(ts))
    inside = F.coalesce(day.between(F.col("first_date"), F.col("last_date")), F.lit(True))
    return df.filter(inside & ~F.coalesce(F.array_contains("exclude_dates", day), F.lit(False)))


def in_months(df: DataFrame, ts: str = "datetime") -> DataFrame:
    """Rows in the planned range of months that are not in an excluded month."""
    month = month_number(F.col(ts))
    inside = F.coalesce(month.between(F.col("first_month"), F.col("last_month")), F.lit(True))
    return df.filter(inside & ~F.coalesce(F.array_contains("exclude_months", month), F.lit(False)))


def down_sample(df: DataFrame, key: str = "row_id", label: str = "frd", seed: int = 1) -> DataFrame:
    """Keep each row with the ratio of its organisation and class; a missing ratio keeps all."""
    rate = F.coalesce(F.when(F.col(label) == 1, F.col("frd_ratio")).otherwise(F.col("nonfrd_ratio")), F.lit(1.0))
    drawn = hex_number(digest(key, seed), 1) / F.lit(16.0**8)
    return df.filter(drawn < rate)


def apply_plan(df: DataFrame, rows: DataFrame, key: str = "row_id", seed: int = 1) -> DataFrame:
    """Restrict events to a plan: organisations, days, months, then sampling."""
    kept = down_sample(in_months(in_dates(with_plan(df, rows))), key, seed=seed)
    return kept.select(*df.columns)
