import math
import random

import pytest
from pyspark.errors import PySparkException

from flagstone.operators import metrics as M
from flagstone.plans import ordered as O


def scored(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = [(i, rng.choice("gh"), int(rng.random() < 0.3), round(rng.random(), 2)) for i in range(n)]
    # A third of all rows share one score.
    rows = [(i, g, y, 0.4 if i % 3 == 0 else s) for i, g, y, s in rows]
    return rows, spark.createDataFrame(rows, "row_id long, g string, y int, score double")


def brute_auc(rows):
    pos, neg = [r[3] for r in rows if r[2]], [r[3] for r in rows if not r[2]]
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("range_rows", [1_000_000, 9])
def test_auc_and_curves(spark, monkeypatch, range_rows):
    monkeypatch.setattr(O.running_totals, "__defaults__", (None, False, range_rows))
    rows, df = scored(spark)
    assert M.auc(df).first().auc == pytest.approx(brute_auc(rows))
    by = {r.g: r.auc for r in M.auc(df, by=["g"]).collect()}
    assert by == {g: pytest.approx(brute_auc([r for r in rows if r[1] == g])) for g in "gh"}
    points = sorted((r.fpr, r.tpr) for r in M.roc(df).collect())
    assert points[0] == (0, 0) and points[-1] == (1, 1)
    assert all(a[1] <= b[1] for a, b in zip(points, points[1:]))
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
    assert area == pytest.approx(brute_auc(rows))


def cells(rows, t):
    tp = sum(r[2] for r in rows if r[3] > t)
    fp = sum(1 - r[2] for r in rows if r[3] > t)
    p = sum(r[2] for r in rows)
    return len(rows) - p - fp, fp, p - tp, tp


def test_thresholds_and_report(spark):
    rows, df = scored(spark)
    n, p = len(rows), sum(r[2] for r in rows)
    def rates(t):
        tp = sum(r[2] for r in rows if r[3] >= t)
        fp = sum(1 - r[2] for r in rows if r[3] >= t)
        return tp, fp

    thresholds = sorted({r[3] for r in rows})
    gmean = {t: math.sqrt(rates(t)[0] / p * (1 - rates(t)[1] / (n - p))) for t in thresholds}
    fscore = {t: 2 * rates(t)[0] / (p + sum(rates(t))) for t in thresholds}
    best_g = max(reversed(thresholds), key=gmean.get)
    best_f = max(thresholds, key=fscore.get)
    assert M.best_gmean(df).first().threshold == best_g
    assert M.best_fscore(df).first().threshold == best_f
    row = M.evaluate(df).first()
    assert row.roc_threshold == best_g and row.pr_threshold == best_f and row.n == n
    for prefix, t in (("half", 0.5), ("roc", best_g), ("pr", best_f)):
        assert tuple(row[f"{prefix}_{c}"] for c in ("tn", "fp", "fn", "tp")) == cells(rows, t)
        assert tuple(M.confusion(df, threshold=t).first()) == cells(rows, t)
    reports = M.evaluation_reports(M.evaluate(df)).collect()
    assert len(reports) == 15 and all(r.support == n for r in reports if "avg" in r.row)


def test_threshold_row_itself_is_negative(spark):
    df = spark.createDataFrame([(1, 0.7), (0, 0.3)], "y int, score double")
    assert M.confusion(df, threshold=0.7).first().tp == 0
    assert M.confusion(df, threshold=0.7, inclusive=True).first().tp == 1


def test_f_score_without_positives_is_zero(spark):
    df = spark.createDataFrame([(0, 0.9), (0, 0.1)], "y int, score double")
    best = M.best_fscore(df).first()
    assert best.fscore == 0 and best.threshold == 0.1
    assert M.auc(df).first().auc is None


def test_bad_scores_are_errors(spark):
    for bad in ([(1, None)], [(1, float("nan"))], [(2, 0.5)]):
        with pytest.raises(PySparkException):
            M.auc(spark.createDataFrame([(0, 0.1), *bad], "y int, score double")).collect()


def test_losses(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 1), rng.uniform(-40, 40)) for i in range(50)]
    df = spark.createDataFrame(rows, "row_id long, y int, logit double")
    def loss(y, z):
        return max(z, 0) - z * y + math.log1p(math.exp(-abs(z)))

    each = [loss(y, z) for _, y, z in rows]
    assert M.bce(df).first().loss == pytest.approx(sum(each) / 50)
    means = [sum(each[i : i + 8]) / 8 for i in range(0, 48, 8)]
    assert M.bce(df, batch=8).first().loss == pytest.approx(sum(means) / 6)


def test_bundle_and_zero_division(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (1, 0)], "y int, predicted int")
    row = M.bundle(df).first()
    assert (row.precision, row.recall, row.f1, row.auc) == (0, 0, 0, 0.5)
    lines = {r.row: r for r in M.report(M.confusion_of_labels(df)).collect()}
    assert lines["1"].precision == 0 and lines["0"].recall == 1 and lines["accuracy"].f1 == pytest.approx(1 / 3)
