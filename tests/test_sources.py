import pytest
from pyspark.sql import functions as F

from flagstone.functions.text import sentence
from flagstone.operators import attribution as A, columns as C, tokens as N
from flagstone.operators.splits import fraud_split
from flagstone.plans.shared import bounded_rows, scratch_path, shared_folder
from flagstone.sources import events as E, lists as L
from flagstone.streaming.events import stream_events, write_stream

SCHEMA = "row_id long, tmxrc_a int, `tmxrc_b c` int, frd int"


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_csv_types_are_inferred_or_given(spark, tmp_path):
    write(tmp_path / "e.csv", "row_id,tmxrc_a,tmxrc_b c,frd\n1,0,,1\n2,1,1,0\n")
    inferred = E.read_events(spark, str(tmp_path / "e.csv"))
    assert dict(inferred.dtypes)["tmxrc_a"] == "int" and inferred.filter("`tmxrc_b c` is null").count() == 1
    pruned = E.read_events(spark, str(tmp_path / "e.csv"), SCHEMA, ["tmxrc_b c", "frd"])
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<tmxrc_b c:int,frd:int>" in plan


def test_blank_header_becomes_the_key(spark, tmp_path):
    write(tmp_path / "c.csv", ",coefficient\ntmxrc_a,-1.5\ntmxrc_b c,2\n")
    assert [tuple(r) for r in L.read_coefficients(spark, str(tmp_path / "c.csv")).collect()] == [("tmxrc_a", -1.5), ("tmxrc_b c", 2.0)]


def test_tree_of_files(spark, tmp_path):
    write(tmp_path / "x" / "1.csv", "1,2\n3,4\n")
    write(tmp_path / "x" / "y" / "2.csv", "5,6\n")
    write(tmp_path / "x" / "skip.txt", "9,9\n")
    rows = E.read_csv_tree(spark, str(tmp_path / "x"))
    assert sorted((r[0], r.path.rsplit("/", 1)[1]) for r in rows.collect()) == [(1, "1.csv"), (3, "1.csv"), (5, "2.csv")]


def test_feature_list(spark, tmp_path):
    write(tmp_path / "f.txt", "tsrc_a\nother\ntmxrc_b\n")
    rows = L.read_feature_list(spark, str(tmp_path / "f.txt"), C.FLAG_PREFIXES_V2).collect()
    assert [tuple(r) for r in rows] == [(0, "tsrc_a"), (2, "tmxrc_b")]


def test_one_split_reads_its_own_folder(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test")], "row_id long, split string")
    E.write_splits(df, str(tmp_path / "s"))
    test = E.read_snapshot(spark, str(tmp_path / "s")).filter("split = 'test'")
    assert test.first().row_id == 2
    assert "PartitionFilters: [isnotnull(split" in test._jdf.queryExecution().executedPlan().toString()


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    write(tmp_path / "in" / "1.csv", "row_id,tmxrc_a,tmxrc_b c,frd\n1,0,,1\n2,1,1,0\n")
    write(tmp_path / "in" / "2.csv", "row_id,tmxrc_a,tmxrc_b c,frd\n3,1,0,1\n")
    names = ["tmxrc_a", "tmxrc_b_c"]
    ids = N.vocab_ids(N.build_vocab(N.feature_table(spark, names)))

    def work(df):
        df = C.with_label(C.clean_names(df), 1).withColumn("text", sentence(names))
        df = A.scorecard(df, {"tmxrc_a": 1.0, "tmxrc_b_c": 2.0})
        df = N.encode(df, names, ids, keep=["row_id", "text", "score"])
        return N.mask_tokens(df, "row_id", ids, rate=0.5)

    stream = work(stream_events(spark, str(tmp_path / "in"), SCHEMA))
    assert stream.isStreaming
    write_stream(stream, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    batch = work(E.read_events(spark, str(tmp_path / "in"), SCHEMA))
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.count() == 2 and found.exceptAll(batch).isEmpty()


def test_bounded_rows_refuses_large_tables(spark):
    assert len(bounded_rows(spark.range(5), 5)) == 5
    with pytest.raises(ValueError):
        bounded_rows(spark.range(6), 5)


class SetSession:
    """A session whose cluster names a folder."""

    class conf:
        get = staticmethod({"spark.checkpoint.dir": "/shared/place"}.get)

    class sparkContext:
        folder = None

        @classmethod
        def getCheckpointDir(cls):
            return cls.folder

        @classmethod
        def setCheckpointDir(cls, folder):
            cls.folder = folder


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(SetSession) == "/shared/place" == SetSession.sparkContext.folder
    assert scratch_path(SetSession, "x").startswith("/shared/place/x-")
    assert shared_folder(spark)


def test_row_wise_operators_do_not_shuffle(spark):
    df = spark.range(10).select(F.col("id").alias("row_id"), F.lit(1).alias("tmxrc_a"), F.lit(0).alias("frd"))
    ids = N.vocab_ids(N.build_vocab(N.feature_table(spark, ["tmxrc_a"])))
    for made in (
        N.encode(df, ["tmxrc_a"], ids), A.scorecard(df, {"tmxrc_a": 1.0}), A.attributions(df, {"tmxrc_a": 1.0}, df),
        N.mask_tokens(N.encode(df, ["tmxrc_a"], ids, keep=["row_id"]), "row_id", ids),
        fraud_split(df.withColumn("eval", F.lit(False))),
    ):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_damaged_inputs_are_errors(spark, tmp_path):
    from flagstone.operators import policy_graph
    from flagstone.sources import events, lists, runlog

    cut = spark.createDataFrame([('{"log_history": [{"epoch": 1.0',), ('{"best_metric": 1}',)], "value string")
    for i in range(2):
        with pytest.raises(Exception):
            runlog.log_entries(cut.limit(1) if i == 0 else cut.filter("value like '%best%'")).collect()
    for document in ('{"policyVersion": {"rules": {}, "variables": []}}', '{"policyVersion": {"rules": []}}'):
        with pytest.raises(Exception):
            policy_graph.policy_rules(spark.createDataFrame([("p", document)], "policy string, document string")).collect()
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text("x\ny\n")
    with pytest.raises(ValueError):
        lists.read_vocab(spark, str(tmp_path))
    (tmp_path / "bad.csv").write_text("1\nword\n")
    with pytest.raises(Exception):
        events.read_csv_tree(spark, str(tmp_path), "n int").collect()


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from flagstone.plans.shared import shared_folder

    made = []
    context = SimpleNamespace(getCheckpointDir=lambda: made[-1] if made else None, setCheckpointDir=made.append, master="spark://host:7077")
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context)
    with pytest.raises(ValueError):
        shared_folder(session)
    context.master = "local[4]"
    assert shared_folder(session) == made[0]


def test_null_runs_stop_early_too(spark):
    from flagstone.operators.runlog import early_stopping

    log = spark.createDataFrame([(None, e, float(e)) for e in range(10)], "run string, epoch int, eval_loss double")
    assert early_stopping(log, patience=3).count() == 4
