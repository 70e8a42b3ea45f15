"""Evaluation of scored tables: exact curves, thresholds, reports and losses.

Every function takes a table with a 0/1 `label` and a `score`, and optional `by` columns for one
result per group. Rows are first counted per distinct score, with partial counts in each task, so
a hot score is one row after the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flagstone.functions.numbers import cross_entropy, f_score, g_mean, label_above, ratio
from flagstone.operators.ranking import batches
from flagstone.plans.ordered import running_totals
from flagstone.plans.shared import measured


def score_counts(df: DataFrame, label: str = "y", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """`n` rows and `p` positives per distinct score. A missing score or other label is an error."""
    given = F.col(score).cast("double")
    checked = F.when(given.isNull() | F.isnan(given), F.raise_error(F.lit("missing score"))).otherwise(given)
    truth = F.when(F.col(label).isin(0, 1), F.col(label).cast("long")).otherwise(
        F.raise_error(F.lit("label is not 0 or 1"))
    )
    rows = df.select(*(by or []), checked.alias("score"), truth.alias("_y"))
    return rows.groupBy(*(by or []), "score").agg(F.sum("_y").alias("p"), F.count(F.lit(1)).alias("n"))


def score_curve(df: DataFrame, label: str = "y", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """Per distinct score as threshold: `p`, `q` (positives and negatives at it), `tp`, `fp` (at or
    above it), and the group's `p_all`, `q_all`."""
    return counts_curve(score_counts(df, label, score, by), by)


def counts_curve(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """`score_curve` from counts `(score, p, n)`, one row per distinct score of a group."""
    # Stored, since ranges, totals and curve all read the counts; there is one row per distinct score.
    counts = measured(counts.withColumn("q", F.col("n") - F.col("p")).drop("n"))
    curve = running_totals(counts, "score", {"tp": "p", "fp": "q"}, by=by, descending=True)
    return curve.withColumnsRenamed({"tp_total": "p_all", "fp_total": "q_all"})


def _rates(curve: DataFrame) -> DataFrame:
    return curve.withColumns({
        "fpr": F.try_divide(F.col("fp").cast("double"), F.col("q_all").cast("double")),
        "tpr": F.try_divide(F.col("tp").cast("double"), F.col("p_all").cast("double")),
    })


def _precision(curve: DataFrame) -> DataFrame:
    return curve.withColumns({
        "precision": F.col("tp") / (F.col("tp") + F.col("fp")),
        "recall": ratio(F.col("tp"), F.col("p_all")),
    })


def _with_extra(curve: DataFrame, by: list[str], point: dict[str, Column], extra: dict[str, Column], wanted: bool):
    """The points, with one more point per group beside its highest threshold."""
    here = F.struct(*[c.alias(n) for n, c in point.items()])
    more = F.struct(*[extra[n].alias(n) for n in point])
    # The highest threshold of a group has nothing above it.
    highest = (F.col("tp") == F.col("p")) & (F.col("fp") == F.col("q"))
    points = F.when(highest & F.lit(wanted), F.array(here, more)).otherwise(F.array(here))
    return curve.select(*by, F.inline(points))


def roc(
    df: DataFrame, label: str = "y", score: str = "score", by: list[str] | None = None, origin: bool = True
) -> DataFrame:
    """ROC points, all thresholds kept. `origin` adds the point (0, 0) at threshold infinity."""
    point = {"threshold": F.col("score"), **{c: F.col(c) for c in ("tp", "fp", "fpr", "tpr")}}
    zero = F.lit(0).cast("long")
    start = {"threshold": F.lit(float("inf")), "tp": zero, "fp": zero, "fpr": F.lit(0.0), "tpr": F.lit(0.0)}
    return _with_extra(_rates(score_curve(df, label, score, by)), by or [], point, start, origin)


def pr(
    df: DataFrame, label: str = "y", score: str = "score", by: list[str] | None = None, end: bool = True
) -> DataFrame:
    """Precision and recall per threshold. `end` adds the point (1, 0) without threshold."""
    point = {"threshold": F.col("score"), "precision": F.col("precision"), "recall": F.col("recall")}
    last = {"threshold": F.lit(None).cast("double"), "precision": F.lit(1.0), "recall": F.lit(0.0)}
    return _with_extra(_precision(score_curve(df, label, score, by)), by or [], point, last, end)


def _auc(curve: DataFrame, by: list[str]) -> DataFrame:
    return curve.groupBy(*by).agg(_auc_column().alias("auc"))


def _auc_column() -> Column:
    """Share of (positive, negative) pairs in the right order, ties counting half."""
    lower = (F.col("q_all") - F.col("fp")).cast("double")
    won = F.col("p") * (lower + F.col("q") / F.lit(2.0))
    pairs = F.first("p_all").cast("double") * F.first("q_all").cast("double")
    return F.try_divide(F.sum(won), pairs)


def auc(df: DataFrame, label: str = "y", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """Exact area under the ROC curve with ties; null where a class is missing."""
    return _auc(score_curve(df, label, score, by), by or [])


def auc_of_counts(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """`auc` from counts `(score, p, n)`."""
    return _auc(counts_curve(counts, by), by or [])


def best_gmean(df: DataFrame, label: str = "y", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """Threshold with the largest geometric mean of TPR and 1 - FPR; the highest one on ties."""
    curve = _rates(score_curve(df, label, score, by))
    curve = curve.withColumn("gmean", g_mean(F.coalesce("tpr", F.lit(0.0)), F.coalesce("fpr", F.lit(0.0))))
    best = F.max_by(F.struct("score", "gmean"), F.struct("gmean", "score"))
    return curve.groupBy(*(by or [])).agg(best.alias("_b")).select(
        *(by or []), F.col("_b.score").alias("threshold"), F.col("_b.gmean").alias("gmean")
    )


def best_fscore(df: DataFrame, label: str = "y", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """Threshold with the largest F-score (0/0 counts as 0); the lowest one on ties."""
    curve = _precision(score_curve(df, label, score, by))
    curve = curve.withColumn("fscore", f_score(F.col("precision"), F.col("recall")))
    best = F.max_by(F.struct("score", "fscore"), F.struct(F.col("fscore"), -F.col("score")))
    return curve.groupBy(*(by or [])).agg(best.alias("_b")).select(
        *(by or []), F.col("_b.score").alias("threshold"), F.col("_b.fscore").alias("fscore")
    )


def no_skill(df: DataFrame, label: str = "y", by: list[str] | None = None) -> DataFrame:
    """Share of positives."""
    return df.groupBy(*(by or [])).agg(F.avg(F.col(label).cast("double")).alias("no_skill"))


def label_counts(df: DataFrame, predicted: str = "predicted") -> DataFrame:
    """Frequency of each predicted label."""
    return df.groupBy(predicted).count()


def confusion_of_labels(
    df: DataFrame, label: str = "y", predicted: str = "predicted", by: list[str] | None = None
) -> DataFrame:
    """`tn`, `fp`, `fn`, `tp` in one row per group."""
    def cell(y: int, p: int) -> Column:
        return F.count_if((F.col(label) == y) & (F.col(predicted) == p))

    return df.groupBy(*(by or [])).agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")
    )


def confusion(
    df: DataFrame, label: str = "y", score: str = "score", threshold: float = 0.5,
    by: list[str] | None = None, inclusive: bool = False,
) -> DataFrame:
    """The confusion cells for labels above a threshold."""
    labelled = df.withColumn("_predicted", label_above(F.col(score), threshold, inclusive))
    return confusion_of_labels(labelled, label, "_predicted", by)


def report(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Classification report from confusion cells: one row per class (0, 1), then `accuracy`,
    `macro avg` and `weighted avg`; a division by zero gives 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n0, n1 = tn + fp, fn + tp
    n = n0 + n1
    per_class = []
    for hit, wrong, missed, support in ((tn, fn, fp, n0), (tp, fp, fn, n1)):
        precision, recall = ratio(hit, hit + wrong), ratio(hit, hit + missed)
        per_class.append((precision, recall, f_score(precision, recall), support))
    share = ratio(tn + tp, n)

    def line(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("row"), precision.alias("precision"), recall.alias("recall"),
            f1.alias("f1"), support.alias("support"),
        )

    def mean(i: int) -> Column:
        return (per_class[0][i] + per_class[1][i]) / F.lit(2.0)

    def weighted(i: int) -> Column:
        return ratio(per_class[0][i] * n0 + per_class[1][i] * n1, n)

    lines = [
        line("0", *per_class[0]),
        line("1", *per_class[1]),
        line("accuracy", share, share, share, n),
        line("macro avg", mean(0), mean(1), mean(2), n),
        line("weighted avg", weighted(0), weighted(1), weighted(2), n),
    ]
    return cells.select(*(by or []), F.inline(F.array(*lines)))


def bundle(df: DataFrame, label: str = "y", predicted: str = "predicted", by: list[str] | None = None) -> DataFrame:
    """Accuracy, F1, precision, recall and the AUC of hard labels, (TPR + TNR) / 2."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return confusion_of_labels(df, label, predicted, by).select(
        *(by or []),
        ratio(tn + tp, tn + fp + fn + tp).alias("accuracy"),
        f_score(precision, recall).alias("f1"),
        precision.alias("precision"),
        recall.alias("recall"),
        ((F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / F.lit(2.0)).alias("auc"),
    )


def bce(
    df: DataFrame, label: str = "y", logit: str = "logit", batch: int | None = None, key: str = "row_id",
    drop_last: bool = True,
) -> DataFrame:
    """Mean cross-entropy of logits over the rows, or the mean of batch means in key order."""
    losses = df.withColumn("_loss", cross_entropy(F.col(label).cast("double"), F.col(logit)))
    if batch is None:
        return losses.agg(F.avg("_loss").alias("loss"))
    placed = batches(losses.select(key, "_loss"), batch, key, drop_last=drop_last)
    means = placed.groupBy("batch").agg(F.avg("_loss").alias("_mean"))
    return means.agg(F.avg("_mean").alias("loss"))


def evaluate(df: DataFrame, label: str = "y", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """One row per group with AUC, share of positives, both best thresholds, and the confusion cells at
    0.5 and strictly above each best threshold.

    Scores are counted once; one pass over the resulting curve gives everything.
    """
    by = by or []
    curve = _precision(_rates(score_curve(df, label, score, by)))
    curve = curve.withColumns({
        "gmean": g_mean(F.coalesce("tpr", F.lit(0.0)), F.coalesce("fpr", F.lit(0.0))),
        "fscore": f_score(F.col("precision"), F.col("recall")),
        # Rows at the threshold itself are not above it.
        "tp_above": F.col("tp") - F.col("p"),
        "fp_above": F.col("fp") - F.col("q"),
    })
    point = ("score", "gmean", "fscore", "tp_above", "fp_above")
    best_roc = F.max_by(F.struct(*point), F.struct("gmean", "score"))
    best_pr = F.max_by(F.struct(*point), F.struct(F.col("fscore"), -F.col("score")))
    high = F.col("score") > 0.5
    found = curve.groupBy(*by).agg(
        _auc_column().alias("auc"),
        F.first("p_all").alias("_p"), F.first("q_all").alias("_q"),
        best_roc.alias("_roc"), best_pr.alias("_pr"),
        F.coalesce(F.sum(F.when(high, F.col("p"))), F.lit(0)).alias("_tp"),
        F.coalesce(F.sum(F.when(high, F.col("q"))), F.lit(0)).alias("_fp"),
    )
    p, q = F.col("_p"), F.col("_q")

    def cells(prefix: str, tp: Column, fp: Column) -> list[Column]:
        return [
            (q - fp).alias(f"{prefix}_tn"), fp.alias(f"{prefix}_fp"),
            (p - tp).alias(f"{prefix}_fn"), tp.alias(f"{prefix}_tp"),
        ]

    return found.select(
        *by,
        (p + q).alias("n"),
        "auc",
        (p / (p + q)).alias("no_skill"),
        F.col("_roc.score").alias("roc_threshold"),
        F.col("_roc.gmean").alias("roc_gmean"),
        F.col("_pr.score").alias("pr_threshold"),
        F.col("_pr.fscore").alias("pr_fscore"),
        *cells("half", F.col("_tp"), F.col("_fp")),
        *cells("roc", F.col("_roc.tp_above"), F.col("_roc.fp_above")),
        *cells("pr", F.col("_pr.tp_above"), F.col("_pr.fp_above")),
    )


def evaluation_reports(evaluation: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Classification reports at 0.5 and at both best thresholds, from an `evaluate` row."""
    by = by or []
    cuts = F.array(*[
        F.struct(F.lit(cut).alias("cut"), *[F.col(f"{cut}_{c}").alias(c) for c in ("tn", "fp", "fn", "tp")])
        for cut in ("half", "roc", "pr")
    ])
    cells = evaluation.select(*by, F.inline(cuts))
    return report(cells, [*by, "cut"])
