"""The pipeline against brute force, stage by stage, and what holds for the subpackage as a whole."""

import re

import numpy as np
import pytest

import corpus_pipeline
from flagstone.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WHITE = re.compile(r"[\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def results(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.stored(stage(spark, docs, SF), name)
        out.append((name, before, docs))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_return_the_columns_of_documents(results):
    assert [n for n, *_ in results] == ["quality_classifier", "exact_dedup", "minhash_near_dedup", "source_mixing", "best_fit_packing"]
    for _, before, after in results[:-1]:
        assert after.dtypes == before.dtypes


def test_quality_stage_keeps_good_documents_and_drops_poor_ones(spark, results):
    _, before, after = results[0]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = set(texts(after))
    assert all(i in kept for i in texts(before) if labels.get(i) == 1)
    poor = [i for i in texts(before) if labels.get(i) == 0]
    assert sum(i in kept for i in poor) <= 0.1 * len(poor)


def test_exact_stage_equals_brute_force(results):
    _, before, after = results[1]
    best = {}
    for i, t in texts(before).items():
        key = WHITE.sub("", t or "")
        best[key] = max(best.get(key, (-1, 0)), (len(t or ""), -i))
    assert set(texts(after)) == {-i for _, i in best.values()}


def test_near_stage_equals_brute_force(results):
    from tests.llm.test_minhash import brute

    _, before, after = results[2]
    wanted = {i for i, (_, component) in brute(list(texts(before).items()), 5, 80).items() if i == component}
    assert set(texts(after)) == wanted


def test_mixing_stage_repeats_or_drops_whole_rows(results):
    _, before, after = results[3]
    rows = texts(before)
    assert all(rows[i] == t for i, t in texts(after).items()) and 0 < after.count() <= 1.05 * before.count()


def test_packing_stage_places_every_document(results):
    _, before, after = results[4]
    from tests.llm.test_packing import check_places

    rows = after.collect()
    assert {r.doc_id for r in rows} == set(texts(before))
    used = check_places(rows, 2048)
    assert used <= np.ceil(sum(r.length for r in rows) / 2048) * 1.05 + 2


def test_stages_take_empty_tables_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = docs
    for name in ("copies", "_id", "_gone", "_again", "_row_key", "_copy", "kept", "node", "n", "tokens"):
        more = more.withColumn(name, F.lit(7))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).collect() == []
        found = stage(spark, more, SF)
        assert found.columns == more.columns
        assert sorted(r.doc_id for r in found.collect()) == sorted(r.doc_id for r in stage(spark, docs, SF).collect())
    assert corpus_pipeline.best_fit_packing(spark, docs.limit(0), SF).collect() == []
    assert corpus_pipeline.best_fit_packing(spark, more, SF).count() == corpus_pipeline.best_fit_packing(spark, docs, SF).count()


def test_run_and_queries_are_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(QUERIES) < set(names) and names["pipeline"] is corpus_pipeline.run
    assert {re.match(r"op(\d+)_", n)[1] for n in QUERIES} == {str(i) for i in range(1, 14)}


def test_exact_and_warc_queries_equal_their_sql(spark):
    from checks.compare import difference, oracle
    from flagstone.llm.queries import ORACLES

    db = oracle(SF)
    for name in ("op5_exact_dedup", "op9_warc_bundles"):
        assert difference(spark, db, QUERIES[name], ORACLES[name], SF) is None


def test_decisions_fall_on_rows_of_null_and_repeated_keys(spark):
    from pyspark.sql import functions as F

    def words(name, n=40):
        return " ".join(f"{name}{i}" for i in range(n))

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    # A copy of a null or repeated key beside unique texts of that key, rows that repeat all, and copies of null keys only.
    rows = [(1, words("a")), (None, words("a")), (None, words("b")), (2, words("a")), (2, words("c")), (3, words("d")), (3, words("d"))]
    rows += [(None, words("e"))] * 50 + [(4, None), (5, "")]
    docs = spark.createDataFrame([(*r, "en", "web", 100) for r in rows], schema)
    kept = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    wanted = [(1, words("a")), (None, words("b")), (2, words("c")), (3, words("d")), (None, words("e"))]
    assert kept(corpus_pipeline.exact_dedup(spark, docs, SF)) == sorted([*wanted, (4, None)], key=str)
    assert kept(corpus_pipeline.minhash_near_dedup(spark, docs, SF)) == sorted([*wanted, (4, None), (5, "")], key=str)
    # The same by quality and by copies: a decision about one row of a key leaves its other rows alone.
    poor = [r for r in spark.read.parquet(f"{SF}/documents.parquet").join(
        spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 0"), "doc_id").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    good = [r for r in spark.read.parquet(f"{SF}/documents.parquet").join(
        spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1"), "doc_id").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    both = spark.createDataFrame([tuple(r) for r in poor + good] + [(None, *r[1:]) for r in poor + good], schema)
    after = corpus_pipeline.quality_classifier(spark, both, SF)
    by_key = {k: {r.text for r in after.filter(c).collect()} for k, c in (("null", F.col("doc_id").isNull()), ("set", F.col("doc_id").isNotNull()))}
    assert {r.text for r in good} <= by_key["null"] == by_key["set"]
    keyed = corpus_pipeline.with_row_key(docs.filter("doc_id is null or doc_id = 2"), "k")
    mixed = keyed.select("k", F.when(F.col("text").startswith("a0 "), 0).otherwise(2).cast("long").alias("copies"))
    from flagstone.llm.mixing import apply_copies

    got = kept(apply_copies(keyed, mixed, "k"))
    assert got == sorted([(None, words("b"))] * 2 + [(2, words("c"))] * 2 + [(None, words("e"))] * 100, key=str)
