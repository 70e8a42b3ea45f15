import random

import pytest
from pyspark.sql import functions as F

from flagstone.operators import attribution as A, learn as L, metrics as M, runlog as R
from flagstone.plans import ordered as O
from flagstone.sources import events as E, runlog as RS

CARD = {"tmxrc_a": 1.5, "tmxrc_b c": -2.0, "sumrc_d": 0.25}


def flags(spark, n=200):
    rng = random.Random(8)
    rows = [(i, *[rng.choice([0, 1, None]) if k else rng.randint(0, 1) for k in range(3)], rng.randint(0, 1)) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, tmxrc_a int, `tmxrc_b c` int, sumrc_d int, frd int")


def test_attributions_sum_to_the_logit(spark):
    df = flags(spark)
    attributed = A.attributions(df, CARD, df.limit(50), intercept=0.3)
    logits = {r.row_id: r.logit for r in A.scorecard(df, CARD, 0.3).collect()}
    sums = A.attribution_rows(attributed).groupBy("row_id").agg(F.sum("phi") + F.first("base")).collect()
    assert {r[0]: pytest.approx(r[1]) for r in sums} == logits
    last = A.decision_path(attributed).filter("step = 2").collect()
    assert {r.row_id: pytest.approx(r.total) for r in last} == logits
    order = [r.feature for r in A.decision_path(attributed).filter("row_id = 0").orderBy("step").collect()]
    importance = {r.feature: r.importance for r in A.feature_importance(attributed).collect()}
    assert order == sorted(importance, key=importance.get)
    assert A.dependence(attributed, "tmxrc_a", "sumrc_d").filter("value not in (0, 1)").isEmpty()


def test_card_table_equals_dict(spark):
    df = flags(spark)
    coefficients = spark.createDataFrame(list(CARD.items()), "feature string, coefficient double")
    assert A.scorecard(df, coefficients).select("row_id", "logit").exceptAll(
        A.scorecard(df, CARD).select("row_id", "logit")).isEmpty()


def test_fill_masked_forms_agree(spark):
    df = flags(spark)
    wide = {(r.row_id, r["rank"]): (r.candidate, round(r.p, 9)) for r in L.fill_masked(df, "frd", list(CARD)).collect()}
    long = {(r.row_id, r["rank"]): (r.candidate, round(r.p, 9)) for r in L.fill_masked_by_join(df, "frd", list(CARD)).collect()}
    # A row without any known feature value is filled from the priors in both forms.
    assert wide == long and len(wide) == 400


def test_fill_masked_keeps_rows_of_unknown_and_large_values(spark):
    rows = [(i, str(i % 2), None if i % 5 == 0 else 12345678901 * (1 + i % 3)) for i in range(30)] + [(98, None, 777), (99, None, None)]
    df = spark.createDataFrame(rows, "row_id long, t string, n long")
    wide, long = ({(r.row_id, r.candidate): round(r.p, 9) for r in f(df, "t", ["n"]).collect()} for f in (L.fill_masked, L.fill_masked_by_join))
    assert wide == long and len(wide) == 64
    assert wide[98, "0"] == wide[99, "0"] == 0.5


def test_batch_scoring(spark):
    def load():
        return lambda frame: frame.assign(p=frame["tmxrc_a"] * 2.0)[["row_id", "p"]]

    rows = L.score_batches(flags(spark).select("row_id", "tmxrc_a"), load, "row_id long, p double")
    assert rows.filter("p > 1").count() == flags(spark).filter("tmxrc_a = 1").count()


def test_boosted_trees_learn_a_flag(spark):
    df = flags(spark, 400).withColumn("frd", F.col("tmxrc_a"))
    model = L.gbt_baseline(df, list(CARD), maxIter=2, maxDepth=2)
    assert M.auc(L.gbt_score(model, df, list(CARD)), label="frd").first().auc == 1.0
    best, trials = L.search(df, list(CARD), {"maxDepth": [1, 2]}, maxIter=1)
    assert trials.columns == ["trial", "maxDepth", "auc"] and trials.count() == 2


def test_trials_table_is_written(spark, tmp_path):
    trials = spark.createDataFrame([(0, "3", 0.7), (1, "4", 0.8)], "trial int, maxDepth string, auc double")
    E.write_trials(trials, str(tmp_path / "t"))
    assert E.read_events(spark, str(tmp_path / "t"), trials.schema).exceptAll(trials).isEmpty()


# Evaluation losses of a published training run, one per epoch of 4680 steps.
LOSSES = [0.096670, 0.092103, 0.089996, 0.089159, 0.087934, 0.088399, 0.087340, 0.086539, 0.086104, 0.086392, 0.084918,
          0.084623, 0.085000, 0.084436]


def run_file(tmp_path):
    import json
    history = []
    for i, loss in enumerate(LOSSES, 1):
        history += [{"epoch": i - 0.5, "loss": 0.1, "learning_rate": 1e-4, "step": 4680 * i - 100},
                    {"epoch": i, "eval_loss": loss, "eval_runtime": 120.0, "eval_samples_per_second": 1250.0,
                     "eval_steps_per_second": 9.7, "step": 4680 * i}]
    (tmp_path / "state.json").write_text(json.dumps({"best_metric": 0.08, "max_steps": 70200, "log_history": history}, indent=2))
    return str(tmp_path / "state.json")


def test_published_run(spark, tmp_path):
    log = RS.read_run_log(spark, run_file(tmp_path))
    assert log.count() == 28
    best = R.best_checkpoint(log, ["run"]).first()
    assert best.step == 65520 and best.eval_loss == 0.084436
    speed = R.speed_summary(log).first()
    assert speed.evaluations == 14 and speed["rows"] == 150000
    stop = R.stop_points(log.filter("eval_loss is not null"), patience=2).first()
    assert not stop.stopped and stop.best_epoch == 14


def simulate(losses, patience):
    best, counter, out = None, 0, []
    for loss in losses:
        if best is None or loss <= best:
            best, counter = loss, 0
        else:
            counter += 1
        out.append(counter)
        if counter >= patience:
            break
    return out


@pytest.mark.parametrize("patience, range_rows", [(1, 1_000_000), (3, 1_000_000), (3, 11)])
def test_early_stopping_like_a_loop(spark, monkeypatch, patience, range_rows):
    monkeypatch.setattr(O.ranged, "__defaults__", (range_rows,))
    rng = random.Random(6)
    runs = {r: [float(rng.randint(0, 6)) for _ in range(rng.randint(1, 20))] for r in range(40)}
    df = spark.createDataFrame([(r, e, v) for r, vs in runs.items() for e, v in enumerate(vs)], "run int, epoch int, eval_loss double")
    found = {}
    for row in R.early_stopping(df, patience).orderBy("run", "epoch").collect():
        found.setdefault(row.run, []).append(row.counter)
    assert found == {r: simulate(vs, patience) for r, vs in runs.items()}


def test_nan_is_no_improvement(spark):
    df = spark.createDataFrame([("r", 1, 1.0), ("r", 2, float("nan")), ("r", 3, 0.5)], "run string, epoch int, eval_loss double")
    assert [r.improved for r in R.early_stopping(df).orderBy("epoch").collect()] == [True, False, True]
