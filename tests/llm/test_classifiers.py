import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flagstone.llm import quality, toxicity
from flagstone.llm.quality import score_quality, text_view
from flagstone.llm.queries import QUERIES
from flagstone.llm.toxicity import Rows, best_threshold, chain_odds, fit_link, score_toxicity

SF = "/root/testdata/sf0.1"


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def accuracy(told, truth):
    told, truth = np.array(told, bool), np.array(truth, bool)
    return (told & truth).sum() / truth.sum(), (told & truth).sum() / max(1, told.sum())


def test_quality_on_labels_that_were_held_out(spark):
    docs, labels = tables(spark)
    out = F.col("doc_id") % 4 == 3
    got = score_quality(docs, labels.filter(~out)).join(labels.filter(out), "doc_id").select("kept", labels.quality).collect()
    recall, precision = accuracy([not r[0] for r in got], [r[1] == 0 for r in got])
    assert len(got) > 500 and recall >= 0.97 and precision >= 0.98
    lost = [r for r in got if r[1] == 1 and not r[0]]
    assert len(lost) <= 0.005 * len(got)


def test_views_exchange_labels(spark):
    """With few labels, metadata that tells quality must help the text view, and the other way round."""
    rng, rows, labels = random.Random(3), [], []
    for i in range(1200):
        good = rng.random() < 0.5
        words = [rng.choice("alpha beta gamma delta".split()) for _ in range(60)]
        text = " ".join(words) if good else " ".join(w + rng.choice(["%%%", "***", "!!"]) for w in words)
        rows.append((i, text, "en", "s1" if good else "s2", len(text)))
        if i < 60:
            labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in score_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    truth = [r[3] == "s1" for r in rows]
    assert [got[i].kept for i in range(1200)] == truth
    assert np.mean([(got[i].metadata_probability > 0.5) == truth[i] for i in range(1200)]) > 0.98


def test_quality_without_labels_nulls_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, y int, fold int"
    rows = [(1, None, None, None, None, 0, 0), (None, "", "en", "a", -5, 0, 0), (2, "x " * 50_000, "en", "b", 3, 0, 0), (2, "x " * 50_000, "en", "b", 3, 0, 0)]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(None, 1), (1, None), (7, 1), (2, 0), (2, 1)], "doc_id long, quality int")
    got = score_quality(docs, labels).collect()
    assert len(got) == 4 and all(r.kept and r.quality is None for r in got)
    assert score_quality(docs.limit(0), labels).collect() == []
    assert score_quality(docs, labels.limit(0)).count() == 4
    assert all(np.isfinite(text_view(t)).all() for t in (b"", b"   ", b"\n\n", b"!!! ||| 12"))


def test_toxicity_on_labels_that_were_held_out(spark):
    docs, labels = tables(spark)
    labels = labels.select("doc_id", (1 - F.col("quality")).alias("poor"), "toxic")
    out = F.col("doc_id") % 4 == 3
    got = score_toxicity(docs, labels.filter(~out), ["poor", "toxic"]).select("doc_id", F.col("toxic").alias("told")).join(labels.filter(out), "doc_id").collect()
    recall, precision = accuracy([r.told for r in got], [r.toxic == 1 for r in got])
    # About 300 toxic rows to learn from, in four languages.
    assert len(got) > 500 and recall >= 0.9 and precision >= 0.98


def test_later_links_use_earlier_categories():
    """The second category holds only together with the first: the chain must give the second link a positive weight for it."""
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(800):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(np.array([1 if a else 2, 3 if b else 4, *rng.integers(10, 60, 5)], dtype=np.int32))
        y.append((a, a and b))
    rows, y = Rows(rows), np.array(y, float)
    first = fit_link(rows, np.zeros((800, 0)), y[:, 0])
    second = fit_link(rows, chain_odds([first], rows), y[:, 1])
    odds = chain_odds([first, second], rows)
    assert second.earlier[0] > 0 and ((odds > 0) == (y > 0.5)).all()


def test_threshold_keeps_equal_probabilities_together():
    p, y = np.array([0.9, 0.8, 0.8, 0.1]), np.array([1.0, 1, 0, 0])
    assert 0.1 < best_threshold(p, y) <= 0.8 and best_threshold(p, np.zeros(4)) == 2.0


def test_toxicity_without_labels_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, 0), (None, "", 0), (3, "word " * 50_000, 1), (3, "word", 1)], "doc_id long, text string, bad int")
    labels = spark.createDataFrame([(None, 1), (1, None), (3, 0)], "doc_id long, bad int")
    got = score_toxicity(docs, labels, ["bad"]).collect()
    assert len(got) == 4 and not any(r.bad for r in got)
    none = score_toxicity(docs, labels.limit(0), ["bad"]).collect()
    assert len(none) == 4 and all(r.bad_probability is None and not r.bad for r in none)
    assert score_toxicity(docs.limit(0), labels, ["bad"]).collect() == []


@pytest.mark.parametrize("name", ["op7_quality_co_training", "op10_toxicity_chain"])
def test_queries_give_one_row_per_document(spark, name):
    got = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert got.count() == got.select("doc_id").distinct().count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_constants_fit(spark):
    assert len(text_view(b"a")) == quality.TEXT_WIDTH and len(quality.meta_view(None, None, None)) == quality.META_WIDTH
    assert toxicity.features(b"").size == 0


def test_a_labelled_key_of_many_rows_does_not_break_the_bound(spark, monkeypatch):
    docs = spark.range(4000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("word "), F.col("id") % 900).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("bad")).distinct()
    sizes, fit = [], toxicity.fit_chain
    monkeypatch.setattr(toxicity, "fit_chain", lambda sample, categories: sizes.append(sample.count()) or fit(sample, categories))
    got = score_toxicity(docs, labels, ["bad"], sample_rows=1001)
    assert got.count() == 4000 and sizes == [1001]


def test_toxicity_learns_from_all_labelled_rows(spark, monkeypatch):
    """Beyond the 12 000 rows that were once a sample, each labelled row counts in the features and the fits."""
    docs = spark.range(15_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word w"), F.col("id") % 700, F.when(F.col("id") % 5 == 0, " bad").otherwise("")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 5 == 0).cast("int").alias("bad"))
    counted, make = [], toxicity._counted
    monkeypatch.setattr(toxicity, "_counted", lambda sample, categories: counted.append(make(sample, categories)) or counted[0])
    got = score_toxicity(docs, labels, ["bad"])
    assert got.filter(F.col("bad") == (F.col("doc_id") % 5 == 0)).count() == 15_000
    assert counted[0][0, :, -3:-1].sum(axis=0).tolist() == [15_000, 3_000]
    number = int(toxicity.features(b"bad")[0])
    assert counted[0][0, :, number].sum() == 3_000
