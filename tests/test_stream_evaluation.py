import random

import pytest

from flagstone.operators import metrics as M
from flagstone.streaming import evaluation as V


def test_files_that_drop_in_are_evaluated_once(spark, tmp_path):
    rng, schema = random.Random(3), "org string, y int, score double"
    source, kept, progress = (str(tmp_path / n) for n in ("in", "counts", "progress"))
    held = []
    for turn in range(3):  # each turn is a restart
        rows = [(rng.choice(["a", "b", None]), rng.randint(0, 1), rng.choice([0.1, 0.5, round(rng.random(), 2)])) for _ in range(80)]
        held += rows + [("c", 1, 0.3)]
        spark.createDataFrame(rows + [("c", 1, 0.3)], schema).coalesce(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        V.evaluate_stream(stream, kept, progress, by=["org"]).awaitTermination()
        whole = spark.createDataFrame(held, schema)
        wanted = {r.org: r.auc for r in M.auc(whole, by=["org"]).collect()}
        found = {r.org: r for r in V.stream_report(spark, kept, {"org": "string"}).collect()}
        assert set(found) == {"a", "b", None, "c"} and found["c"].auc is None and found["c"].n == turn + 1
        assert all(found[o].auc == (None if w is None else pytest.approx(w)) for o, w in wanted.items())
        assert sum(r.n for r in found.values()) == len(held)


def test_a_replayed_batch_counts_once_and_one_group(spark, tmp_path):
    kept = str(tmp_path / "counts")
    df = spark.createDataFrame([(1, 0.9), (0, 0.2), (0, 0.95)], "y int, score double")
    for _ in range(2):
        M.score_counts(df).write.mode("overwrite").parquet(f"{kept}/batch=0")
    report = V.stream_report(spark, kept).collect()
    assert [(r.n, r.p, r.auc) for r in report] == [(3, 1, 0.5)]
