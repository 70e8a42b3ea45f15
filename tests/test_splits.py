from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from flagstone.operators import sampling_plan as G, splits as S

DAY = datetime(2024, 1, 1)


def events(spark):
    rows = [(i, "a", DAY + timedelta(days=i), int(i % 3 == 0)) for i in range(31)]
    rows += [(100 + i, "b", DAY + timedelta(hours=i), 0) for i in range(5)]
    rows += [(200, None, DAY, 1), (201, None, DAY + timedelta(days=9), 1)]
    return spark.createDataFrame(rows, "row_id long, org_id string, datetime timestamp_ntz, frd int")


def test_time_split(spark):
    found = {r.row_id: r.eval for r in S.time_split(events(spark)).collect()}
    # Fraud on days 0..30: a fifth of 30 days before day 30 is day 24, which itself is not late.
    assert [i for i in range(31) if found[i]] == list(range(25, 31))
    assert all(found[100 + i] for i in range(5))
    assert not found[200] and found[201]


def test_fractional_window(spark):
    # Nine whole days by 5 make 1.8 days.
    row = S.time_cutoffs(S.fraud_spans(events(spark)).filter("org_id is null")).first()
    assert row.cutoff == DAY + timedelta(days=9) - timedelta(days=1.8)


def test_strict_split_wants_fraud(spark):
    with pytest.raises(PySparkException):
        S.time_split(events(spark), strict=True).collect()


def test_splits_are_disjoint_and_complete(spark):
    df = spark.range(3000).select(
        F.col("id").alias("row_id"), F.concat(F.lit("o"), F.col("id") % 3).alias("org_id"),
        F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit(DAY)).cast("timestamp_ntz").alias("datetime"),
        (F.col("id") % 7 == 0).cast("string").cast("boolean").cast("int").cast("string").alias("frd"),
        F.lit(1).alias("tmxrc_x"),
    )
    parts = S.fraud_split(df)
    assert parts.count() == 3000 and parts.select("row_id").distinct().count() == 3000
    sizes = {r.split: r["count"] for r in parts.groupBy("split").count().collect()}
    assert set(sizes) == {"train", "val", "test"}
    assert 0.75 < sizes["train"] / (sizes["train"] + sizes["val"]) < 0.85
    again = S.fraud_split(df.repartition(5))
    assert parts.select("row_id", "split").exceptAll(again.select("row_id", "split")).isEmpty()


def test_exact_train_size(spark):
    df = spark.range(103).select(F.col("id").alias("row_id"), F.lit("1").alias("frd"), (F.col("id") < 10).alias("eval"))
    sizes = {r.split: r["count"] for r in S.fraud_split(df, exact=True).groupBy("split").count().collect()}
    assert sizes == {"test": 10, "train": 74, "val": 19}


def test_null_eval_is_on_neither_side(spark):
    df = spark.createDataFrame([(1, True, "1"), (2, False, "0"), (3, None, "0")], "row_id long, eval boolean, frd string")
    assert {r.row_id: r.split for r in S.fraud_split(df).collect()}[1] == "test"
    assert S.fraud_split(df).count() == 2


@pytest.mark.parametrize("fraction, size", [(0.2, 21), (0.3, 31), (1.0, 101), (0.0, 0)])
def test_exact_split_size(spark, fraction, size):
    df = spark.range(101).withColumnRenamed("id", "row_id")
    flagged = S.hash_split(df, "row_id", fraction, 42, exact=True)
    assert flagged.filter("sampled").count() == size and flagged.count() == 101


def test_stratified_exact(spark):
    df = spark.range(100).select(F.col("id").alias("row_id"), (F.col("id") % 10 == 0).cast("int").alias("frd"))
    found = S.stratified(df, "frd", {0: 0.5, 1: 0.25}, "row_id", 3, exact=True)
    # Half to even: a quarter of 10 rows is 2.
    assert {r.frd: r["count"] for r in found.groupBy("frd").count().collect()} == {0: 45, 1: 2}


PLANS = {
    "short": {
        "org_list": ["a", "b", "a"], "nonfrd_ratio": [0.5] * 7, "frd_ratio": [1.0], "date_range": [(20240101, 20240110)] * 2,
        "exclude_dates": [[20240102]], "output_folder": "/x",
    },
    "other": {"org_list": ["c"]},
}


def test_plan_rows_follow_the_organisations(spark):
    plans = G.plans_from_dicts(spark, PLANS)
    rows = {r.org_id: r for r in G.plan_rows(plans, "short").collect()}
    assert set(rows) == {"a", "b"} and rows["a"].pos == 0
    assert rows["a"].frd_ratio == 1.0 and rows["b"].frd_ratio is None and rows["b"].nonfrd_ratio == 0.5
    assert rows["a"].exclude_dates == [20240102] and rows["b"].exclude_dates is None
    assert G.plan_rows(plans, "unknown").count() == 0


def test_apply_plan(spark):
    kept = G.apply_plan(events(spark), G.plan_rows(G.plans_from_dicts(spark, PLANS), "short"))
    days = {r.datetime.day for r in kept.filter("org_id = 'a' and frd = 1").collect()}
    assert days == {1, 4, 7, 10}
    assert kept.filter("org_id is null").isEmpty()
