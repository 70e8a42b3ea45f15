"""Training-log analysis: best checkpoint, early stopping, speed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flagstone.plans.ordered import ranged, running


def best_checkpoint(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Step with the lowest evaluation loss, the earliest on ties."""
    by = by or []
    scored = log.filter(F.col("eval_loss").isNotNull() & ~F.isnan("eval_loss"))
    best = F.min_by(F.struct("step", "epoch", "eval_loss"), F.struct("eval_loss", "step"))
    return scored.groupBy(*by).agg(best.alias("_b")).filter(F.col("_b").isNotNull()).select(*by, "_b.*")


def speed_summary(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Evaluation time, mean rate and the rows per evaluation that they imply."""
    timed = log.filter(F.col("eval_runtime").isNotNull())
    rows = F.col("eval_runtime") * F.col("eval_samples_per_second")
    return timed.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("evaluations"),
        F.sum("eval_runtime").alias("runtime"),
        F.avg("eval_samples_per_second").alias("samples_per_second"),
        F.avg(rows).alias("rows"),
    )


def early_stopping(
    log: DataFrame, patience: int = 7, run: list[str] = ["run"], epoch: str = "epoch", loss: str = "eval_loss"
) -> DataFrame:
    """Rows up to the stop of each run, with `improved`, `counter`, `best_loss` and `stop`.

    The first loss is the best. An equal or lower loss improves and resets the counter; any other,
    NaN too, raises it; the run stops when it reaches `patience`. Very long runs are split into ranges
    of epochs.
    """
    value = F.when(~F.isnan(loss), F.col(loss))
    cut, split = ranged(log.withColumns({"_one": F.lit(1).cast("long"), "_value": value}), epoch)
    best = running(cut, epoch, {"_place": ("sum", "_one"), "best_loss": ("min", "_value")}, run, split=split)
    # A loss is at or below all earlier ones where it is the least so far.
    improved = (F.col("_place") == 1) | F.coalesce(F.col("_value") == F.col("best_loss"), F.lit(False))
    marked = best.withColumn("improved", improved).withColumn("_at", F.when(improved, F.col("_place")))
    marked = running(marked, epoch, {"_last": ("max", "_at")}, run, split=split)
    counted = marked.withColumn("counter", (F.col("_place") - F.col("_last")).cast("int"))
    counted = counted.withColumn("stop", F.col("counter") >= patience)
    counted = counted.withColumn("_stopped", F.when(F.col("stop"), F.col("_place")))
    ended = running(counted, epoch, {"_end": ("min", "_stopped")}, run, split=split)
    kept = ended.filter("_end_total is null or _place <= _end_total")
    return kept.select(*log.columns, "improved", "counter", "best_loss", "stop")


def stop_points(log: DataFrame, patience: int = 7, run: list[str] = ["run"], epoch: str = "epoch",
                loss: str = "eval_loss") -> DataFrame:
    """Per run: epochs run, best loss and its epoch, and whether it stopped early."""
    rows = early_stopping(log, patience, run, epoch, loss)
    best = F.max(F.when(F.col("improved"), F.col(epoch)))
    return rows.groupBy(*run).agg(
        F.count(F.lit(1)).alias("epochs"), F.min("best_loss").alias("best_loss"),
        best.alias("best_epoch"), F.bool_or("stop").alias("stopped"),
    )
