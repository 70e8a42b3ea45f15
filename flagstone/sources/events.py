"""Event tables from CSV and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

# Fixed value: how event files write times.
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"


def read_events(
    spark: SparkSession, path: str | list[str], schema: StructType | str | None = None, columns: list[str] | None = None
) -> DataFrame:
    """CSV with a header. Without a schema the types are inferred, which reads the text twice.

    `columns` keeps only these; a pruned CSV scan parses no other column.
    """
    reader = spark.read.option("header", True).option("mode", "FAILFAST").option("timestampNTZFormat", TIME_FORMAT)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    return df if columns is None else df.select(*[F.col(f"`{c}`") for c in columns])


def read_indexed(spark: SparkSession, path: str, key: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV whose first header cell is blank: that column becomes `key`."""
    df = read_events(spark, path, schema)
    return df.withColumnRenamed(df.columns[0], key)


def read_csv_tree(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """All `*.csv` files below a folder, without headers, with the path of each row's file. Rows that do not
    fit the schema are an error."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").option("header", False)
    reader = reader.option("mode", "FAILFAST").option("timestampNTZFormat", TIME_FORMAT)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    return df.select("*", F.col("_metadata.file_path").alias("path"))


def event_path(root: str, industry: str, event: str, first: int, last: int) -> str:
    """Path of the event table of one industry, event type and range of days (yyyymmdd)."""
    return f"{root.rstrip('/')}/Data/fe_{industry}_{event}_{first}_{last}.csv"


def read_planned_events(spark: SparkSession, plan: dict, schema: StructType | str | None = None) -> DataFrame:
    """The event table that a plan's folder and first entries name."""
    first, last = plan["date_range"][0]
    path = event_path(plan["output_folder"], plan["primary_industry"][0], plan["event_types"][0], first, last)
    return read_events(spark, path, schema)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A split or encoded set saved earlier."""
    return spark.read.parquet(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One folder per split, so that readers of one split scan only its files."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def write_encoded(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_trials(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
