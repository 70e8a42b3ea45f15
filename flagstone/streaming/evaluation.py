"""Evaluation of scored rows as they arrive: counts per distinct score, batch by batch, and the report of all so far.

Counts by (group, score) add up over batches and say all that the exact AUC needs. A batch writes its counts to a folder of
its own number, over what an earlier try has left there, so a replayed batch counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from flagstone.operators.metrics import auc_of_counts, score_counts

COUNTS = "score double, p long, n long"


def evaluate_stream(
    scored: DataFrame, folder: str, checkpoint: str, label: str = "y", score: str = "score", by: list[str] | None = None, available_now: bool = True,
) -> StreamingQuery:
    """Count a stream of scored rows into `folder`; by default process what has arrived and stop. A restart with the same checkpoint
    goes on. A missing score or another label than 0 and 1 stops the stream."""
    def keep(batch: DataFrame, number: int) -> None:
        score_counts(batch, label, score, by).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = scored.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_report(spark: SparkSession, folder: str, by: dict[str, str] | None = None) -> DataFrame:
    """Per group (`by`: names and types): `n` rows, `p` positives and the exact `auc` of all batches so far (null where a class is
    missing)."""
    names = list(by or {})
    schema = ", ".join([*(f"`{name}` {kind}" for name, kind in (by or {}).items()), COUNTS, "batch long"])
    counts = spark.read.schema(schema).parquet(folder).groupBy(*names, "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    sizes = counts.groupBy(*names).agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    found = auc_of_counts(counts, names)
    if not names:
        return sizes.crossJoin(found.select("auc"))  # one row each
    same = F.lit(True)
    for name in names:
        same = same & sizes[name].eqNullSafe(found[name])
    return sizes.join(found, same, "left").select(*[sizes[name] for name in names], "n", "p", found["auc"])
