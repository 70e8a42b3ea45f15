"""Helpers for global order, forced into many small ranges."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from flagstone.operators import ranking as T
from flagstone.plans import ordered as O


@pytest.mark.parametrize("range_rows", [1_000_000, 37])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, range_rows, descending):
    rng = random.Random(5)
    # One key is far out and one group holds most rows.
    rows = [(k, rng.choice("aaab"), rng.randint(0, 9)) for k in [*rng.sample(range(10_000), 400), 10**9]]
    df = spark.createDataFrame(rows, "k long, g string, v long")
    found = O.running_totals(df, "k", {"run": "v"}, by=["g"], descending=descending, range_rows=range_rows).collect()
    for g in "ab":
        total, want = 0, {}
        for k, _, v in sorted((r for r in rows if r[1] == g), reverse=descending):
            total += v
            want[k] = total
        assert {r.k: r.run for r in found if r.g == g} == want
        assert {r.run_total for r in found if r.g == g} == {total}


def test_positions_in_many_ranges(spark, monkeypatch):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("row_id"))
    found = O.running_totals(df.withColumn("one", F.lit(1)), "row_id", {"p": "one"}, range_rows=50).collect()
    assert all(r.p == r.row_id + 1 and r.p_total == 1000 for r in found)


def test_nth_value_narrows(spark, monkeypatch):
    monkeypatch.setattr(O, "SORT_ROWS", 10)
    monkeypatch.setattr(O, "SEARCH_RANGES", 8)
    df = spark.range(2000).select((F.col("id") * F.col("id")).alias("v"))
    for n in (1, 777, 2000):
        assert O.nth_value(df, n, F.col("v")) == (n - 1) ** 2
    assert O.nth_value(df, 2001, F.col("v")) is None
    assert O.nth_value(df, 0, F.col("v")) is None


def test_nth_digest_narrows(spark, monkeypatch):
    monkeypatch.setattr(O, "SORT_ROWS", 2)
    marks = sorted(hashlib.md5(str(i).encode()).hexdigest() for i in range(500))
    df = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("m"))
    assert [O.nth_digest(df, n, F.col("m")) for n in (1, 250, 500)] == [marks[0], marks[249], marks[499]]
    assert O.nth_digest(df, 501, F.col("m")) is None and O.nth_digest(df, 0, F.col("m")) is None


def test_dense_positions_of_text(spark):
    names = [f"{i:05d}/~" for i in range(300)]
    df = spark.createDataFrame([(n,) for n in random.Random(1).sample(names, 300)], "k string")
    assert {r.k: r.p for r in O.dense_positions(df, "k", "p").collect()} == {n: i for i, n in enumerate(names)}


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_last_before(spark, chunk):
    rng = random.Random(2)
    rows = [(rng.choice("xxxy"), p, rng.choice([None, f"v{p}"])) for p in range(200)]
    df = spark.createDataFrame(rows, "g string, p long, v string")
    want, last = {}, {}
    for g, p, v in rows:
        last[g] = v or last.get(g)
        want[p] = last[g]
    assert {r.p: r.last for r in O.last_before(df, "g", "p", "v", chunk).collect()} == want


def test_rows_by_position(spark):
    df = spark.range(11).select((F.col("id") * 10).alias("row_id"))
    assert T.first_half(df).count() == 5
    assert T.first_rows(df, 3).count() == 3 and T.first_rows(df, 100).count() == 11 and T.first_rows(df, 0).count() == 0
    assert T.row_at(df, 4).first().row_id == 40 and T.row_at(df, 11).count() == 0
    assert {r.batch: r["count"] for r in T.batches(df, 4).groupBy("batch").count().collect()} == {0: 4, 1: 4, 2: 3}
    assert T.batches(df, 4, drop_last=True).count() == 8
    assert T.random_row(df.limit(0)).count() == 0


def test_null_keys_stay_and_sums_start_at_zero_with_and_without_ranges(spark):
    rows = [(None, 1, 5), (None, 2, 6), *[(k, k % 2, None if k < 3 else k) for k in range(1, 30)]]
    df = spark.createDataFrame(rows, "k int, g int, x int")
    for by in ([], ["g"]):
        whole = O.running_totals(df, "k", {"s": "x"}, by=by)
        split = O.running_totals(df, "k", {"s": "x"}, by=by, range_rows=3)
        keep = lambda d: sorted((r.k, r.g, r.s) for r in d.collect() if r.k is not None)
        assert keep(whole) == keep(split) and split.count() == len(rows)
    plain = spark.createDataFrame([(1, None), (2, None), (3, 4)], "k int, x int")
    for size in (1, 100):
        assert [r.s for r in O.running_totals(plain, "k", {"s": "x"}, range_rows=size).orderBy("k").collect()] == [0, 0, 4]


def test_nth_rejects_null_and_repeated_keys(spark, monkeypatch):
    monkeypatch.setattr(O, "SORT_ROWS", 3)
    one = spark.createDataFrame([(None,), (1,), (2,)], "k int")
    with pytest.raises(ValueError):
        O.nth_value(one, 1, F.col("k"))
    same = spark.createDataFrame([(7,)] * 9, "k int")
    with pytest.raises(ValueError):
        O.nth_value(same, 4, F.col("k"))
    with pytest.raises(ValueError):
        O.nth_digest(same, 4, F.md5(F.col("k").cast("string")))
    near = spark.createDataFrame([(2**62 + i,) for i in range(50)], "k long")
    assert [O.nth_value(near, n, F.col("k")) - 2**62 for n in (1, 20, 50)] == [0, 19, 49]
    assert O.nth_value(near, 51, F.col("k")) is None
