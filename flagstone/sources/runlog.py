"""Training logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

ENTRY = (
    "epoch double, step long, loss double, learning_rate double, eval_loss double, eval_accuracy double,"
    " eval_runtime double, eval_samples_per_second double, eval_steps_per_second double"
)
LOG = f"best_metric double, best_model_checkpoint string, global_step long, max_steps long, log_history array<struct<{ENTRY}>>"


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """One row per log entry, with the path of its log as `run`."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("run"), "value")
    return log_entries(files)


def log_entries(files: DataFrame) -> DataFrame:
    """Entries of logs held as JSON text in `value`. A text that is no log is an error."""
    others = [c for c in files.columns if c != "value"]
    parsed = files.select(*others, F.from_json("value", LOG, {"mode": "FAILFAST"}).alias("log"))
    entries = F.coalesce("log.log_history", F.raise_error(F.lit("a training log without log_history")))
    return parsed.select(*others, F.inline(entries))
