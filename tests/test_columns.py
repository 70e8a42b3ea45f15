import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from flagstone.functions import arrays as A, numbers as M, text as X
from flagstone.operators import columns as C


def test_selection_follows_the_wanted_list(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "frd int, tmxrc_a int, `tmxrc_b c` int, other int")
    picked = C.select_features(df, ["tmxrc_b c", "tmxrc_gone", "tmxrc_a"])
    assert picked.columns == ["tmxrc_b c", "tmxrc_a", "frd"]
    assert C.columns_to_remove(df, ["tmxrc_a", "tmxrc_b c", "tmxrc_gone"], ["tmxrc_a"]) == ["tmxrc_b c"]
    assert C.clean_names(df).columns == ["frd", "tmxrc_a", "tmxrc_b_c", "other"]
    assert C.predictors(df, extra=["other"]) == ["tmxrc_a", "tmxrc_b c", "other"]


def test_bad_number_is_an_error(spark):
    df = spark.createDataFrame([("1",), ("x",)], "frd string")
    with pytest.raises(PySparkException):
        C.to_number(df, "frd").collect()


def test_long_cast_truncates_toward_zero(spark):
    df = spark.createDataFrame([(1.9,), (-1.9,)], "x double")
    assert sorted(r.x for r in C.to_long(df, ["x"]).collect()) == [-1, 1]


def test_class_weights_round_half_to_even(spark):
    # 5 non-fraud rows to 2 fraud rows is 2.5, which rounds to 2.
    df = spark.createDataFrame([(0,)] * 5 + [(1,)] * 2, "frd int")
    rows = C.with_class_weights(df).collect()
    assert {(r.frd, r.weights_column) for r in rows} == {(0, 1.0), (1, 2.0)}


def test_ratio_without_fraud_is_null(spark):
    df = spark.createDataFrame([("a", 0), ("b", 0), ("b", 1)], "split string, frd int")
    assert {r.split: r.ratio for r in C.class_ratio(df).collect()} == {"a": None, "b": 1.0}


def test_ratio_rounds_half_to_even(spark):
    df = spark.createDataFrame([("a", 0)] * 9 + [("a", 1)] * 8, "split string, frd int")
    assert C.class_ratio(df).first().ratio == 1.12


def test_value_counts_has_a_column_per_feature(spark):
    df = spark.createDataFrame([(0, None), (1, 1), (1, 1)], "a int, `b c` int")
    rows = {r["value"]: (r["a"], r["b c"]) for r in C.value_counts(df, ["a", "b c"]).collect()}
    assert rows == {"0": (1, None), "1": (2, 2)}


def test_text_functions(spark):
    df = spark.createDataFrame([(" B, a,,b ,A", r"x|{y}\z", "My Rule/One")], "items string, label string, name string")
    row = df.select(
        X.comma_items(F.col("items")).alias("items"), X.comma_text(F.col("items")).alias("joined"),
        X.escape_label(F.col("label")).alias("label"), X.policy_key(F.col("name")).alias("name"),
    ).first()
    assert row["items"] == ["b", "a"] and row["joined"] == "b, a"
    assert row["label"] == r"x\|\{y\}\\z" and row["name"] == "my_rule-one"


@pytest.mark.parametrize("text, micros", [("2024-01-02 03:04:05.1", 100000), ("2024-01-02 03:04:05.123456", 123456)])
def test_times_take_one_to_six_digits(spark, text, micros):
    row = spark.createDataFrame([(text,)], "t string").select(X.parse_time(F.col("t")).alias("t")).first()
    assert row.t.microsecond == micros


def test_times_need_a_fraction(spark):
    with pytest.raises(PySparkException):
        spark.createDataFrame([("2024-01-02 03:04:05",)], "t string").select(X.parse_time(F.col("t"))).collect()


@pytest.mark.parametrize("p, label", [(0.5, 0), (0.51, 1), (0.49, 0)])
def test_half_rounds_to_even(spark, p, label):
    assert spark.range(1).select(M.rounded_label(F.lit(p)).alias("l")).first().l == label


def test_softmax_and_layer_norm(spark):
    df = spark.createDataFrame([([1000.0, 1000.0, 0.0],)], "v array<double>")
    row = df.select(M.softmax(F.col("v")).alias("s"), A.layer_norm(F.col("v")).alias("n")).first()
    assert row.s == [0.5, 0.5, 0.0]
    assert abs(sum(row.n)) < 1e-9 and row.n[0] == pytest.approx(2 ** -0.5, abs=1e-6)


def test_category_offsets():
    assert A.category_offsets([3, 2, 4]) == [0, 3, 5]
    assert A.category_offsets([3, 2, 4], reserved=2) == [2, 5, 7]


def test_mean_pool(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 6.0]), ("b", [5.0, 5.0])], "k string, v array<float>")
    assert {r.k: r.v for r in C.mean_pool(df, "k", "v").collect()} == {"a": [2.0, 4.0], "b": [5.0, 5.0]}


def test_mean_pool_of_null_ragged_and_long_vectors(spark):
    rows = [
        ("a", [1.0, None, 3.0]), ("a", [3.0, None]), ("a", None), ("a", []), ("b", []), ("c", None), (None, [2.0]), (None, [4.0]),
        ("d", [float(i) for i in range(2000)]), ("d", [float(i + 2) for i in range(1200)]), ("e", [float("nan"), 1.0]), ("e", [1.0, 1.0])]
    df = spark.createDataFrame(rows, "k string, v array<float>").repartition(3)
    got = {r.k: r.v for r in C.mean_pool(df, "k", "v").collect()}
    assert got["a"] == [2.0, None, 3.0] and got[None] == [3.0] and set(got) == {"a", None, "d", "e"}
    assert got["d"] == [i + 1.0 if i < 1200 else float(i) for i in range(2000)]
    assert math.isnan(got["e"][0]) and got["e"][1] == 1.0
    assert C.mean_pool(df.limit(0), "k", "v").collect() == []


def test_mean_pool_shuffles_no_row_per_element(spark):
    df = spark.range(0, 400, 1, 4).select(F.lit("hot").alias("k"), F.array_repeat(F.col("id").cast("double"), 700).alias("v"))
    pooled = C.mean_pool(df, "k", "v")
    assert pooled.first().v == [199.5] * 700
    assert "posexplode" not in pooled._jdf.queryExecution().toString()
