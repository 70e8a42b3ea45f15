import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flagstone.llm.mixing import apply_copies, fit_rates, mix
from flagstone.llm.queries import MIXTURE, QUERIES, domain_labels

SF = "/root/testdata/sf0.1"


def nearest_rates(tokens, p, target):
    """Projected gradient with the full matrix, document by document."""
    a = tokens[:, None] * p
    mass, r = a.sum(axis=0), np.ones(len(tokens))
    for _ in range(3000):
        r = np.maximum(0, r - p @ ((a.T @ r - target) / mass))
    return r


@pytest.mark.parametrize("shares", [[0.5, 0.3, 0.2], [0.05, 0.05, 0.9]])
def test_rates_equal_a_dense_solution_and_match_the_targets(spark, shares):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.3, 0.3, 0.3], 40)[rng.integers(0, 40, 200)]
    tokens = rng.integers(1, 500, 200).astype(float)
    rows = [(i, int(t), *map(float, x)) for i, (t, x) in enumerate(zip(tokens, p))]
    df = spark.createDataFrame(rows, "doc_id long, tokens long, p0 double, p1 double, p2 double")
    total = float(tokens.sum())
    rate, got = fit_rates(df, shares, total)
    found = np.array([r[1] for r in sorted(df.select("doc_id", rate).collect())])
    wanted = nearest_rates(tokens, p, total * np.array(shares) / sum(shares))
    assert (found >= 0).all() and np.abs(found - wanted).max() < 0.05 * max(1, wanted.max())
    if shares[2] != 0.9:
        assert np.abs(np.array(got) / total - np.array(shares)).max() < 1e-3


def test_query_matches_weights_and_posteriors_tell_labels(spark):
    rows = QUERIES["op2_source_mixing"](spark, SF)
    sums = rows.agg(*[F.sum(F.col("tokens") * F.col("rate") * F.col(f"{d}_posterior")) for d in MIXTURE], F.sum(F.col("tokens") * F.col("copies"))).first()
    whole = sum(sums[:3])
    for got, wanted in zip(sums, MIXTURE.values()):
        assert math.isclose(got / whole, wanted, abs_tol=0.002)
    assert math.isclose(sums[3], whole, rel_tol=0.03)
    told = rows.join(domain_labels(spark, SF), "doc_id").collect()
    right = sum(r[f"{r.domain}_posterior"] > 0.5 for r in told)
    assert len(told) > 3000 and right >= 0.9 * len(told)
    assert rows.count() == rows.select("doc_id").distinct().count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_posteriors_sum_to_one_and_copies_follow_rates(spark):
    rows = QUERIES["op2_source_mixing"](spark, "/root/testdata/sf0.001").collect()
    for r in rows:
        assert math.isclose(sum(r[f"{d}_posterior"] for d in MIXTURE), 1, abs_tol=1e-9)
        assert math.floor(r.rate) <= r.copies <= math.floor(r.rate) + 1


def test_nulls_repeats_no_labels_and_empty_tables(spark):
    schema = "doc_id long, text string, tokens int, domain string, rate double"
    docs = spark.createDataFrame([(1, None, 1, "x", 0.5), (None, "a b", 1, "x", 0.5), (2, "a " * 30_000, 1, "x", 0.5), (2, "a " * 30_000, 1, "x", 0.5)], schema)
    labels = spark.createDataFrame([(None, "a"), (1, None), (2, "a"), (2, "b"), (1, "other")], "doc_id long, domain string")
    got = mix(docs, labels, {"a": 1, "b": 1}).collect()
    assert len(got) == 4 and all(math.isclose(r.a_posterior, 0.5) and r.copies == 1 for r in got)
    assert sorted(r.tokens for r in got) == [0, 2, 30_000, 30_000]
    assert mix(docs.limit(0), labels, {"a": 1, "b": 2}).collect() == []
    assert mix(docs, labels.limit(0), {"a": 1}).count() == 4


def test_copies_are_applied_with_all_columns(spark):
    docs = spark.createDataFrame([(1, "a", 7), (2, "b", 8), (3, "c", 9), (None, "d", 0)], "doc_id long, text string, copies long")
    mixed = spark.createDataFrame([(1, 0), (2, 3), (3, 1), (None, 0)], "doc_id long, copies long")
    for name in ("copies", "_id", "_copy", "_Times", "n"):
        got = apply_copies(docs.withColumnRenamed("copies", name), mixed)
        assert got.columns == ["doc_id", "text", name]
        assert sorted(map(tuple, got.collect())) == [(2, "b", 8)] * 3 + [(3, "c", 9)]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_the_pipeline_keeps_each_clean_document_once_and_repeats_none(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [r.doc_id for r in corpus_pipeline.source_mixing(spark, docs, sf).select("doc_id").collect()]
    assert len(kept) == len(set(kept))
    clean = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1 and toxic = 0").collect()}
    here = {r.doc_id for r in docs.select("doc_id").collect()}
    assert clean and clean & here <= set(kept)
    # Toxic texts are thinned towards their share.
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("toxic = 1").collect()}
    assert len(toxic & set(kept)) < 0.6 * len(toxic & here)


def test_rates_of_a_whole_domain_are_one_at_most_and_fixed_rows_stay(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.5, 0.5], 300)
    rows = [(i, int(rng.integers(1, 99)), *map(float, x), bool(x[1] >= 0.5)) for i, x in enumerate(p)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long, p0 double, p1 double, fixed boolean")
    rate, _ = fit_rates(df, [0.01, 0.99], whole_domain=1)
    found = df.select("fixed", rate.alias("rate")).collect()
    assert all(r.rate == 1 if r.fixed else 0 <= r.rate <= 1 for r in found)
    assert min(r.rate for r in found) < 0.01


def test_scarce_and_unlabelled_domains_do_not_limit_the_rest(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    toxic = {i for i in range(3000) if i % 1000 == 7}  # 0.1 %
    words = lambda i: " ".join(("vile" if i in toxic else "calm") + f"{x}" for x in rng.integers(0, 50, 30))
    docs = spark.createDataFrame([(i, words(i), "en", "web", 100) for i in range(3000)], "doc_id long, text string, lang string, source string, n_chars long")
    schema = "doc_id long, quality int, toxic int"
    marked = [(i, 1, int(i in toxic)) for i in range(3000)]
    for name, rows in {"scarce": marked, "no_toxic": [(i, q, 0) for i, q, _ in marked], "none": []}.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name / "labels.parquet"))
        kept = corpus_pipeline.source_mixing(spark, docs, str(tmp_path / name)).select("doc_id").collect()
        assert sorted(r.doc_id for r in kept) == list(range(3000)), name
    # The default total too: a domain without held-out labels is no limit.
    labels = spark.createDataFrame([(i, "a") for i in range(3000)], "doc_id long, domain string")
    assert mix(docs, labels, {"a": 0.9, "b": 0.1}).filter("rate <> 1 or copies <> 1").count() == 0


def test_the_whole_domain_stays_and_a_common_one_is_cut_to_its_share(spark):
    rows = [(i, 10, float(i % 4 == 0), float(i % 4 != 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long, p0 double, p1 double")
    rate, got = fit_rates(df, [0.01, 0.99], whole_domain=1)
    assert np.allclose(got, [3000 / 99, 3000], rtol=1e-3)
    assert np.allclose(fit_rates(df, [0.9, 0.1], whole_domain=1)[1], [1000, 3000], rtol=1e-3)
