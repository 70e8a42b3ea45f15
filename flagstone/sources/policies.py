"""Rule-policy documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_policies(spark: SparkSession, folder: str, org_id: str) -> DataFrame:
    """Policies of one organisation as `(policy, path, document)`, from files
    `<org>_policy_<name>_<version>.json`."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", f"{org_id}_policy_*json").text(folder)
    return policy_registry(
        files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("document")), org_id
    )


def policy_registry(files: DataFrame, org_id: str) -> DataFrame:
    """Name the documents of one organisation.

    A policy is called by its file name without first and last part, in lower case. Of files with
    one name the last path is kept.
    """
    name = F.element_at(F.split("path", "/"), -1)
    parts = F.split(name, "_")
    ours = files.filter(name.startswith(f"{org_id}_policy_") & name.endswith("json"))
    named = ours.withColumn("policy", F.lower(F.array_join(F.slice(parts, 2, F.size(parts) - 2), "_")))
    return named.groupBy("policy").agg(F.max("path").alias("path"), F.max_by("document", "path").alias("document"))
