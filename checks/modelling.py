"""Tokens, encoding, evaluation, attribution, logs and learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.columns import INTERLEAVED_SQL, VOCAB_SQL
from checks.fixture import (
    CARD, CLEAN_FLAGS, CURVE_SQL, EVENTS_SQL, FLAGS, RUNS_SQL, SCORES_SQL, SPLIT_SQL, brand_features, risk_events,
    run_logs, scores, table,
)
from checks.registry import ORACLES, query
from flagstone.functions import text as X
from flagstone.operators import (
    attribution as A, columns as C, learn as L, metrics as M, ranking as T, runlog as R, splits as S, tokens as N,
)
from flagstone.plans.shared import scratch_path
from flagstone.sources import events as E, runlog as RS

EV = "WITH " + EVENTS_SQL


def clean_events(spark, sf):
    return C.clean_names(risk_events(spark, sf))


def flag_ids():
    """Vocabulary of the fixture's flags."""
    pairs = [f"{f}_{v}" for f in CLEAN_FLAGS for v in (0, 1)]
    return {t: i for i, t in enumerate([*N.SPECIAL_TOKENS, *pairs])}


def joined(ids):
    return F.array_join(F.col(ids).cast("array<string>"), " ")


IDS_SQL = ", ".join(
    f'coalesce({7 + 2 * i} + "{f}", 0)' for i, f in enumerate(FLAGS))
ENCODED = EVENTS_SQL + f""",
encoded AS (SELECT row_id, frd, concat_ws(' ', 3, {IDS_SQL}, 1) AS input_ids, [3, {IDS_SQL}, 1] AS ids FROM risk_events)"""
WORDS_SQL = ", ".join(f"""concat_ws('_', '{g}', "{f}")""" for f, g in zip(FLAGS, CLEAN_FLAGS))


@query("build_vocabulary", INTERLEAVED_SQL)
def _(spark, sf):
    return N.build_vocab(brand_features(spark, sf))


@query("build_blocked_vocabulary", VOCAB_SQL + """sized AS (SELECT count(*) AS n FROM features)
SELECT token, CAST(2 * n + i AS INTEGER) AS id FROM specials, sized
UNION ALL SELECT feature || '_' || v, CAST(v * n + pos AS INTEGER) FROM features, sized, (VALUES (0), (1)) t(v)""")
def _(spark, sf):
    return N.build_vocab(brand_features(spark, sf), "blocked")


@query("flag_tokens", EV + """
SELECT row_id, 'sumrc_Key_Odd_' || "sumrc_Key_Odd" AS token FROM risk_events""")
def _(spark, sf):
    return risk_events(spark, sf).select("row_id", X.token("sumrc_Key_Odd").alias("token"))


@query("row_sentences", EV + f" SELECT row_id, concat_ws(' ', {WORDS_SQL}) AS text FROM risk_events")
def _(spark, sf):
    return clean_events(spark, sf).select("row_id", X.sentence(CLEAN_FLAGS).alias("text"))


@query("masked_sentences", EV + f"""
SELECT row_id, replace(concat_ws(' ', {WORDS_SQL}), 'tmxrc_Weekend_' || "tmxrc_Weekend", '[MASK]') AS text FROM risk_events""")
def _(spark, sf):
    df = clean_events(spark, sf).withColumn("text", X.sentence(CLEAN_FLAGS))
    return N.mask_feature(df, "text", "tmxrc_Weekend").select("row_id", "text")


@query("encode_rows", "WITH " + ENCODED + """
SELECT row_id, frd AS labels, input_ids, '0 0 0 0 0 0 0 0 0 0' AS token_type_ids, '1 1 1 1 1 1 1 1 1 1' AS attention_mask FROM encoded""")
def _(spark, sf):
    rows = N.encode(clean_events(spark, sf), CLEAN_FLAGS, flag_ids(), keep=["row_id"])
    return rows.select("row_id", "labels", *[joined(c).alias(c) for c in ("input_ids", "token_type_ids", "attention_mask")])


@query("encode_large_numbers", """
SELECT event_id, CASE user_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS id FROM events""")
def _(spark, sf):
    rows = table(spark, sf, "events").select("event_id", ((F.col("user_id") % 3) * 12345678901 - 1).alias("n"))
    ids = {"n_-1": 0, "n_12345678900": 1, "n_24691357801": 2, "[UNK]": 9}
    return rows.select("event_id", N.token_id("n", ids, whole=True).alias("id"))


@query("encode_rows_strict", EV + f"""
SELECT row_id, concat_ws(' ', 3, {", ".join(IDS_SQL.split(", ")[:-2])}, 0, 1) AS input_ids FROM risk_events""")
def _(spark, sf):
    rows = N.encode(clean_events(spark, sf), CLEAN_FLAGS, flag_ids(), label=None, keep=["row_id"], strict=True)
    return rows.select("row_id", joined("input_ids").alias("input_ids"))


@query("encode_rows_by_join", EV + f" SELECT row_id, concat_ws(' ', {IDS_SQL}) AS ids FROM risk_events")
def _(spark, sf):
    vocab = N.build_vocab(N.feature_table(spark, CLEAN_FLAGS))
    rows = N.encode_by_join(clean_events(spark, sf), "row_id", CLEAN_FLAGS, vocab)
    return rows.select("row_id", joined("ids").alias("ids"))


@query("saved_encoding", "WITH " + ENCODED + " SELECT row_id, input_ids FROM encoded")
def _(spark, sf):
    path = scratch_path(spark, "encoded")
    E.write_encoded(N.encode(clean_events(spark, sf), CLEAN_FLAGS, flag_ids(), keep=["row_id"]), path)
    return E.read_snapshot(spark, path).select("row_id", joined("input_ids").alias("input_ids"))


@query("encode_sentences", "WITH " + ENCODED + """
SELECT row_id, array_to_string(list_concat(list_slice(ids, 1, 4), ['4'], list_slice(ids, 6, 10)), ' ') AS input_ids FROM
  (SELECT row_id, list_transform(ids, lambda x: CAST(x AS VARCHAR)) AS ids FROM encoded)""")
def _(spark, sf):
    df = N.mask_feature(clean_events(spark, sf).withColumn("text", X.sentence(CLEAN_FLAGS)), "text", CLEAN_FLAGS[3])
    return df.withColumn("input_ids", N.encode_sentence(F.col("text"), flag_ids())).select(
        "row_id", joined("input_ids").alias("input_ids"))


@query("padded_encoding", EV + """
SELECT row_id, concat_ws(' ', 3, CASE WHEN org_id = 'org_1' THEN 0 END, 7 + "tmxrc_Amount_High", 1,
    CASE WHEN org_id <> 'org_1' THEN 2 END) AS input_ids,
  CASE WHEN org_id = 'org_1' THEN '1 1 1 1' ELSE '1 1 1 0' END AS attention_mask FROM risk_events""")
def _(spark, sf):
    from flagstone.functions.arrays import pad_longest
    text = F.concat_ws(" ", F.when(F.col("org_id") == "org_1", "odd"), X.token("tmxrc_Amount_High"))
    df = clean_events(spark, sf).select("row_id", N.encode_sentence(text, flag_ids()).alias("input_ids"))
    return pad_longest(df, "input_ids", flag_ids()["[PAD]"]).select(
        "row_id", joined("input_ids").alias("input_ids"), joined("attention_mask").alias("attention_mask"))


DECODED_SQL = EV + f""" SELECT row_id, concat_ws(' ', '[CLS]', {", ".join(
    f'''CASE WHEN "{f}" IS NULL THEN '[UNK]' ELSE '{g}_' || "{f}" END''' for f, g in zip(FLAGS, CLEAN_FLAGS))}, '[SEP]') AS text
FROM risk_events"""


@query("decode_rows", DECODED_SQL)
def _(spark, sf):
    rows = N.encode(clean_events(spark, sf), CLEAN_FLAGS, flag_ids(), keep=["row_id"])
    return rows.select("row_id", F.array_join(N.decode(F.col("input_ids"), flag_ids()), " ").alias("text"))


@query("decode_rows_by_join", DECODED_SQL)
def _(spark, sf):
    rows = N.encode(clean_events(spark, sf), CLEAN_FLAGS, flag_ids(), keep=["row_id"])
    vocab = N.build_vocab(N.feature_table(spark, CLEAN_FLAGS))
    return N.decode_by_join(rows, "row_id", "input_ids", vocab).select("row_id", F.array_join("tokens", " ").alias("text"))


@query("masked_training_rows", "WITH " + ENCODED + """,
places AS (SELECT row_id, unnest(ids) AS x, unnest(range(10)) AS i, md5(row_id || '|9') AS d FROM encoded),
draws AS (SELECT *, substr(md5(d || '|' || (i // 4)), 1 + 8 * (i % 4), 8) AS g, md5(d || '|' || i || '|x') AS h FROM places),
numbers AS (SELECT *, CAST('0x' || g AS BIGINT) AS a, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS b,
  CAST('0x' || substr(h, 9, 8) AS BIGINT) AS c FROM draws),
chosen AS (SELECT *, x >= 7 AND a < 644245094 AS hit FROM numbers)
SELECT row_id, i, CAST(CASE WHEN NOT hit THEN x WHEN b < 3435973837 THEN 4 WHEN b < 3865470566 THEN c % 23 ELSE x END AS INTEGER) AS input_id,
  CAST(CASE WHEN hit THEN x ELSE -100 END AS INTEGER) AS label FROM chosen""")
def _(spark, sf):
    rows = N.encode(clean_events(spark, sf), CLEAN_FLAGS, flag_ids(), keep=["row_id"])
    masked = N.mask_tokens(rows, "row_id", flag_ids(), seed=9)
    zipped = masked.select("row_id", F.posexplode(F.arrays_zip("input_ids", "labels")).alias("i", "e"))
    return zipped.select("row_id", F.col("i").cast("long").alias("i"), F.col("e.input_ids").alias("input_id"), F.col("e.labels").alias("label"))


@query("mask_named_feature", "WITH " + ENCODED + """
SELECT row_id, array_to_string(list_concat(list_slice(t, 1, 5), ['4'], list_slice(t, 7, 10)), ' ') AS input_ids
FROM (SELECT row_id, list_transform(ids, lambda x: CAST(x AS VARCHAR)) AS t FROM encoded)""")
def _(spark, sf):
    rows = N.encode(clean_events(spark, sf), CLEAN_FLAGS, flag_ids(), keep=["row_id"])
    rows = rows.withColumn("input_ids", N.mask_place(F.col("input_ids"), 5, 4))
    return rows.select("row_id", joined("input_ids").alias("input_ids"))


@query("binary_cross_entropy", "WITH " + SCORES_SQL + """
SELECT round(avg(greatest(logit, 0) - logit * y + ln(1 + exp(-abs(logit)))), 6) AS loss FROM scores""")
def _(spark, sf):
    return M.bce(scores(spark, sf)).select(F.round("loss", 6).alias("loss"))


@query("mean_of_batch_losses", "WITH " + SCORES_SQL + """,
placed AS (SELECT *, (row_number() OVER (ORDER BY row_id) - 1) // 32 AS batch, count(*) OVER () AS n FROM scores),
means AS (SELECT avg(greatest(logit, 0) - logit * y + ln(1 + exp(-abs(logit)))) AS m FROM placed WHERE batch < n // 32 GROUP BY batch)
SELECT round(avg(m), 6) AS loss FROM means""")
def _(spark, sf):
    return M.bce(scores(spark, sf), batch=32).select(F.round("loss", 6).alias("loss"))


@query("no_skill_line", "WITH " + SCORES_SQL + " SELECT round(avg(y), 6) AS no_skill FROM scores")
def _(spark, sf):
    return M.no_skill(scores(spark, sf)).select(F.round("no_skill", 6).alias("no_skill"))


@query("predicted_label_counts", "WITH " + SCORES_SQL + """
SELECT CAST(score > 0.1 AS INTEGER) AS predicted, count(*) AS "count" FROM scores GROUP BY 1""")
def _(spark, sf):
    from flagstone.functions.numbers import label_above
    return M.label_counts(scores(spark, sf).withColumn("predicted", label_above(F.col("score"), 0.1)))


@query("roc_points", "WITH " + CURVE_SQL + """
SELECT score AS threshold, tp, fp, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM rated""")
def _(spark, sf):
    return M.roc(scores(spark, sf), origin=False).select(
        "threshold", "tp", "fp", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query("pr_points", "WITH " + CURVE_SQL + """
SELECT score AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM rated UNION ALL SELECT NULL, 1, 0""")
def _(spark, sf):
    return M.pr(scores(spark, sf)).select(
        "threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


AUC_SQL = "sum(p * (CAST(q_all - fp AS DOUBLE) + q / 2.0)) / (CAST(max(p_all) AS DOUBLE) * max(q_all))"


@query("exact_auc", "WITH " + CURVE_SQL + f" SELECT round({AUC_SQL}, 6) AS auc FROM curve")
def _(spark, sf):
    return M.auc(scores(spark, sf)).select(F.round("auc", 6).alias("auc"))


@query("exact_auc_by_organisation", "WITH " + SCORES_SQL + """,
ranked AS (SELECT org_id, y, rank() OVER (PARTITION BY org_id ORDER BY score)
  + (count(*) OVER (PARTITION BY org_id, score) - 1) / 2.0::DOUBLE AS r FROM scores)
SELECT org_id, round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * sum(1 - y))::DOUBLE, 6) AS auc
FROM ranked GROUP BY 1""")
def _(spark, sf):
    return M.auc(scores(spark, sf), by=["org_id"]).select("org_id", F.round("auc", 6).alias("auc"))


@query("best_gmean_threshold", "WITH " + CURVE_SQL + """
SELECT score AS threshold, round(gmean, 6) AS gmean FROM rated ORDER BY rated.gmean DESC, score DESC LIMIT 1""")
def _(spark, sf):
    return M.best_gmean(scores(spark, sf)).select("threshold", F.round("gmean", 6).alias("gmean"))


@query("best_fscore_threshold", "WITH " + CURVE_SQL + """
SELECT score AS threshold, round(fscore, 6) AS fscore FROM rated ORDER BY rated.fscore DESC, score LIMIT 1""")
def _(spark, sf):
    return M.best_fscore(scores(spark, sf)).select("threshold", F.round("fscore", 6).alias("fscore"))


CELLS_SQL = SCORES_SQL + """,
cells AS (SELECT count(*) FILTER (y = 0 AND NOT score > 0.1) AS tn, count(*) FILTER (y = 0 AND score > 0.1) AS fp,
  count(*) FILTER (y = 1 AND NOT score > 0.1) AS fn, count(*) FILTER (y = 1 AND score > 0.1) AS tp FROM scores)"""


@query("confusion_matrix", "WITH " + CELLS_SQL + " SELECT tn, fp, fn, tp FROM cells")
def _(spark, sf):
    return M.confusion(scores(spark, sf), threshold=0.1)


@query("classification_report", "WITH " + CELLS_SQL + """,
d AS (SELECT tn::DOUBLE AS tn, fp::DOUBLE AS fp, fn::DOUBLE AS fn, tp::DOUBLE AS tp FROM cells),
r AS (SELECT *, tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, tn + fp AS n0, fn + tp AS n1 FROM d),
f AS (SELECT *, 2 * p0 * r0 / (p0 + r0) AS f0, 2 * p1 * r1 / (p1 + r1) AS f1, (tn + tp) / (n0 + n1) AS a FROM r),
lines AS (
  SELECT '0' AS row, p0 AS precision, r0 AS recall, f0 AS f1, n0 AS support FROM f
  UNION ALL SELECT '1', p1, r1, f1, n1 FROM f
  UNION ALL SELECT 'accuracy', a, a, a, n0 + n1 FROM f
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n0 + n1 FROM f
  UNION ALL SELECT 'weighted avg', (p0 * n0 + p1 * n1) / (n0 + n1), (r0 * n0 + r1 * n1) / (n0 + n1), (f0 * n0 + f1 * n1) / (n0 + n1), n0 + n1 FROM f)
SELECT row, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM lines""")
def _(spark, sf):
    lines = M.report(M.confusion(scores(spark, sf), threshold=0.1))
    return lines.select("row", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("metric_bundle", "WITH " + CELLS_SQL + """,
d AS (SELECT tn::DOUBLE AS tn, fp::DOUBLE AS fp, fn::DOUBLE AS fn, tp::DOUBLE AS tp FROM cells)
SELECT round((tn + tp) / (tn + fp + fn + tp), 6) AS accuracy, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
  round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
  round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS auc FROM d""")
def _(spark, sf):
    from flagstone.functions.numbers import arg_max
    # Two logits per row, as a classifier gives them.
    logits = F.array(F.lit(0.1), F.col("score"))
    rows = M.bundle(scores(spark, sf).withColumn("predicted", arg_max(logits)))
    return rows.select(*[F.round(c, 6).alias(c) for c in rows.columns])


@query("evaluation_report", "WITH " + CURVE_SQL + f""",
r AS (SELECT * FROM rated ORDER BY rated.gmean DESC, score DESC LIMIT 1),
f AS (SELECT * FROM rated ORDER BY rated.fscore DESC, score LIMIT 1),
h AS (SELECT CAST(coalesce(sum(p) FILTER (score > 0.5), 0) AS BIGINT) AS tp, CAST(coalesce(sum(q) FILTER (score > 0.5), 0) AS BIGINT) AS fp,
  CAST(max(p_all) AS BIGINT) AS pa, CAST(max(q_all) AS BIGINT) AS qa, {AUC_SQL} AS auc FROM curve)
SELECT pa + qa AS n, round(auc, 6) AS auc, round(pa / (pa + qa), 6) AS no_skill,
  r.score AS roc_threshold, round(r.gmean, 6) AS roc_gmean, f.score AS pr_threshold, round(f.fscore, 6) AS pr_fscore,
  qa - h.fp AS half_tn, h.fp AS half_fp, pa - h.tp AS half_fn, h.tp AS half_tp,
  qa - (r.fp - r.q) AS roc_tn, r.fp - r.q AS roc_fp, pa - (r.tp - r.p) AS roc_fn, r.tp - r.p AS roc_tp,
  qa - (f.fp - f.q) AS pr_tn, f.fp - f.q AS pr_fp, pa - (f.tp - f.p) AS pr_fn, f.tp - f.p AS pr_tp FROM h, r, f""")
def _(spark, sf):
    rows = M.evaluate(scores(spark, sf))
    doubles = ("auc", "no_skill", "roc_gmean", "pr_fscore")
    return rows.select(*[F.round(c, 6).alias(c) if c in doubles else c for c in rows.columns])


LOGIT_SQL = " + ".join(f'{c}::DOUBLE * coalesce("{f}", 0)' for f, c in zip(FLAGS, CARD.values()))


@query("linear_scorecard", EV + f"""
SELECT row_id, round(-1.5::DOUBLE + {LOGIT_SQL}, 6) AS logit, round(1 / (1 + exp(-(-1.5::DOUBLE + {LOGIT_SQL}))), 6) AS score FROM risk_events""")
def _(spark, sf):
    return A.scorecard(clean_events(spark, sf), CARD, -1.5).select(
        "row_id", F.round("logit", 6).alias("logit"), F.round("score", 6).alias("score"))


ATTR_SQL = EVENTS_SQL + """,
filled AS (SELECT row_id, """ + ", ".join(f'coalesce("{f}", 0) AS "{g}"' for f, g in zip(FLAGS, CLEAN_FLAGS)) + """ FROM risk_events),
long AS (SELECT row_id, feature, value FROM (UNPIVOT filled ON """ + ", ".join(f'"{g}"' for g in CLEAN_FLAGS) + """ INTO NAME feature VALUE value)),
card AS (SELECT unnest([""" + ", ".join(f"'{g}'" for g in CLEAN_FLAGS) + "]) AS feature, unnest([" + ", ".join(
    f"{c}::DOUBLE" for c in CARD.values()) + """]) AS c),
means AS (SELECT feature, avg(value) AS m FROM long WHERE row_id IN (SELECT row_id FROM filled ORDER BY row_id LIMIT 100) GROUP BY 1),
base AS (SELECT -1.5::DOUBLE + sum(c * m) AS base FROM card JOIN means USING (feature)),
attr AS (SELECT row_id, feature, value, c * (value - m) AS phi FROM long JOIN card USING (feature) JOIN means USING (feature)),
importance AS (SELECT feature, avg(abs(phi)) AS importance FROM attr GROUP BY 1)"""


def attributed(spark, sf):
    df = clean_events(spark, sf)
    return A.attributions(df, CARD, T.first_rows(df, 100), intercept=-1.5)


@query("row_attributions", "WITH " + ATTR_SQL + """
SELECT row_id, feature, CAST(value AS DOUBLE) AS value, round(phi, 6) AS phi, round(base, 6) AS base FROM attr, base""")
def _(spark, sf):
    return A.attribution_rows(attributed(spark, sf)).select(
        "row_id", "feature", "value", F.round("phi", 6).alias("phi"), F.round("base", 6).alias("base"))


@query("feature_importance", "WITH " + ATTR_SQL + " SELECT feature, round(importance, 9) AS importance FROM importance")
def _(spark, sf):
    return A.feature_importance(attributed(spark, sf)).select("feature", F.round("importance", 9).alias("importance"))


@query("dependence_rows", "WITH " + ATTR_SQL + """
SELECT row_id, CAST(max(value) FILTER (WHERE feature = 'tmxrc_Weekend') AS DOUBLE) AS value,
  round(max(phi) FILTER (WHERE feature = 'tmxrc_Weekend'), 6) AS phi,
  CAST(max(value) FILTER (WHERE feature = 'sumrc_Key_Odd') AS DOUBLE) AS other_value
FROM attr WHERE feature IN ('tmxrc_Weekend', 'sumrc_Key_Odd') GROUP BY 1""")
def _(spark, sf):
    return A.dependence(attributed(spark, sf), "tmxrc_Weekend", "sumrc_Key_Odd").withColumn("phi", F.round("phi", 6))


def card_scores():
    """The card as any scorer: a function from a pandas frame to scores."""
    def load():
        return lambda frame: -1.5 + sum(frame[f].to_numpy() * c for f, c in CARD.items())
    return load


@query("sampled_attributions", "WITH " + ATTR_SQL + """
SELECT row_id, feature, CAST(value AS DOUBLE) AS value, round(phi, 6) AS phi, round(base, 6) AS base FROM attr, base""")
def _(spark, sf):
    df = clean_events(spark, sf)
    base = A.background_means(T.first_rows(df, 100), list(CARD))
    found = A.sampled_attributions(df, card_scores(), list(CARD), base, permutations=2)
    return A.attribution_rows(found).select(
        "row_id", "feature", "value", F.round("phi", 6).alias("phi"), F.round("base", 6).alias("base"))


@query("decision_paths", "WITH " + ATTR_SQL + """
SELECT row_id, feature, round(base + sum(phi) OVER (PARTITION BY row_id ORDER BY importance, feature ROWS UNBOUNDED PRECEDING), 6) AS total
FROM attr JOIN importance USING (feature), base""")
def _(spark, sf):
    return A.decision_path(attributed(spark, sf)).select("row_id", "feature", F.round("total", 6).alias("total"))


@query("fill_masked_feature", "WITH " + EVENTS_SQL + """,
flags AS (SELECT row_id, "sumrc_Key_Odd" AS t, "tmxrc_Amount_High" AS a, "tmxrc_Weekend" AS b, "tmxrc_Possible VPN or Tunnel" AS c FROM risk_events),
long AS (SELECT row_id, t, feature, value FROM (UNPIVOT flags ON a, b, c INTO NAME feature VALUE value)),
priors AS (SELECT t, ln((count(*) + 1) / (sum(count(*)) OVER () + count(*) OVER ())::DOUBLE) AS prior FROM flags GROUP BY t),
pairs AS (SELECT t, feature, value, count(*) AS n FROM long GROUP BY 1, 2, 3),
kinds AS (SELECT feature, count(DISTINCT value) AS k FROM pairs GROUP BY 1),
totals AS (SELECT t, feature, sum(n) AS total FROM pairs GROUP BY 1, 2),
vals AS (SELECT DISTINCT feature, value FROM pairs),
model AS (SELECT tt.t, v.feature, v.value, ln((coalesce(n, 0) + 1) / (total + k)::DOUBLE) AS logp FROM vals v JOIN totals tt USING (feature)
  JOIN kinds USING (feature) LEFT JOIN pairs p ON p.t = tt.t AND p.feature = v.feature AND p.value = v.value),
weights AS (SELECT row_id, m.t, prior + sum(logp) AS w FROM long JOIN model m USING (feature, value) JOIN priors ON priors.t = m.t GROUP BY 1, 2, prior),
chances AS (SELECT row_id, t, exp(w) / sum(exp(w)) OVER (PARTITION BY row_id) AS p FROM weights)
SELECT row_id, CAST(t AS VARCHAR) AS candidate, round(p, 6) AS p FROM chances""")
def _(spark, sf):
    rows = L.fill_masked(clean_events(spark, sf), "sumrc_Key_Odd", ["tmxrc_Amount_High", "tmxrc_Weekend", CLEAN_FLAGS[-1]])
    return rows.select("row_id", "candidate", F.round("p", 6).alias("p"))


@query("fill_masked_feature_by_join", ORACLES["fill_masked_feature"])
def _(spark, sf):
    features = ["tmxrc_Amount_High", "tmxrc_Weekend", CLEAN_FLAGS[-1]]
    rows = L.fill_masked_by_join(clean_events(spark, sf), "sumrc_Key_Odd", features)
    return rows.select("row_id", "candidate", F.round("p", 6).alias("p"))


@query("batch_scored_rows", EV + f"""
SELECT row_id, round({LOGIT_SQL}, 6) AS logit FROM risk_events""")
def _(spark, sf):
    def load():
        weights = dict(CARD)
        def model(frame):
            import pandas as pd
            total = sum(frame[f].fillna(0) * c for f, c in weights.items())
            return pd.DataFrame({"row_id": frame["row_id"], "logit": total.round(6)})
        return model

    df = clean_events(spark, sf).select("row_id", *CLEAN_FLAGS)
    return L.score_batches(df, load, "row_id long, logit double")


@query("boosted_tree_baseline")
def _(spark, sf):
    df = S.fraud_split(clean_events(spark, sf))
    model = L.gbt_baseline(df.filter("split = 'train'"), CLEAN_FLAGS, maxIter=3, maxDepth=3)
    return M.evaluate(L.gbt_score(model, df.filter("split = 'test'"), CLEAN_FLAGS), label="frd")


@query("boosted_tree_scores", "WITH " + SPLIT_SQL + """
SELECT count(*) AS rows, CAST(sum(frd) AS BIGINT) AS positives, TRUE AS in_range, TRUE AS better_than_chance FROM placed WHERE split = 'test'""")
def _(spark, sf):
    df = S.fraud_split(clean_events(spark, sf))
    model = L.gbt_baseline(df.filter("split = 'train'"), CLEAN_FLAGS, maxIter=3, maxDepth=3)
    train = M.auc(L.gbt_score(model, df.filter("split = 'train'"), CLEAN_FLAGS), label="frd").first()["auc"]
    scored = L.gbt_score(model, df.filter("split = 'test'"), CLEAN_FLAGS)
    return scored.agg(F.count(F.lit(1)).alias("rows"), F.sum("frd").alias("positives"), F.bool_and(F.col("score").between(0, 1)).alias("in_range")) \
        .withColumn("better_than_chance", F.lit(train >= 0.5))


@query("boosted_tree_search", """
SELECT CAST(trial AS INTEGER) AS trial, maxDepth, stepSize, TRUE AS in_range
FROM (VALUES (0, '2', '0.03'), (1, '2', '0.2'), (2, '3', '0.03'), (3, '3', '0.2')) t(trial, maxDepth, stepSize)""")
def _(spark, sf):
    train = S.fraud_split(clean_events(spark, sf)).filter("split <> 'test'")
    trials = L.search(train, CLEAN_FLAGS, {"maxDepth": [2, 3], "stepSize": [0.03, 0.2]}, maxIter=2)[1]
    path = scratch_path(spark, "trials")
    E.write_trials(trials, path)
    saved = E.read_events(spark, path, trials.schema)
    return saved.select("trial", "maxDepth", "stepSize", F.col("auc").between(0, 1).alias("in_range"))


@query("best_checkpoints", "WITH " + RUNS_SQL + """
SELECT run, day * 100 AS step, CAST(day AS DOUBLE) AS epoch, loss AS eval_loss
FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY loss, day) AS r FROM days) WHERE r = 1""")
def _(spark, sf):
    return R.best_checkpoint(RS.log_entries(run_logs(spark, sf)), ["run"])


@query("run_speed", "WITH " + RUNS_SQL + """
SELECT run, count(*) AS evaluations, sum(n) * 2.0::DOUBLE AS runtime, round(avg(n / 4.0::DOUBLE), 6) AS samples_per_second,
  round(avg(n * n / 2.0::DOUBLE), 6) AS rows FROM days GROUP BY 1""")
def _(spark, sf):
    rows = R.speed_summary(RS.log_entries(run_logs(spark, sf)), ["run"])
    return rows.select("run", "evaluations", "runtime", F.round("samples_per_second", 6).alias("samples_per_second"),
                       F.round("rows", 6).alias("rows"))


STOP_SQL = RUNS_SQL + """,
a AS (SELECT *, row_number() OVER w AS i, min(loss) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
  FROM days WINDOW w AS (PARTITION BY run ORDER BY day)),
b AS (SELECT *, prev IS NULL OR loss <= prev AS improved FROM a),
c AS (SELECT *, i - max(i) FILTER (improved) OVER (PARTITION BY run ORDER BY day ROWS UNBOUNDED PRECEDING) AS counter,
  min(loss) OVER (PARTITION BY run ORDER BY day ROWS UNBOUNDED PRECEDING) AS best_loss FROM b),
d AS (SELECT *, min(day) FILTER (counter >= 3) OVER (PARTITION BY run) AS stop_day FROM c)"""


@query("early_stopping_rows", "WITH " + STOP_SQL + """
SELECT run, CAST(day AS DOUBLE) AS epoch, loss AS eval_loss, improved, CAST(counter AS INTEGER) AS counter, best_loss, counter >= 3 AS stop
FROM d WHERE stop_day IS NULL OR day <= stop_day""")
def _(spark, sf):
    log = RS.log_entries(run_logs(spark, sf)).filter("eval_loss is not null").select("run", "epoch", "eval_loss")
    return R.early_stopping(log, 3)


@query("early_stopping_points", "WITH " + STOP_SQL + """
SELECT run, count(*) AS epochs, min(best_loss) AS best_loss, CAST(max(day) FILTER (improved) AS DOUBLE) AS best_epoch,
  bool_or(counter >= 3) AS stopped FROM d WHERE stop_day IS NULL OR day <= stop_day GROUP BY 1""")
def _(spark, sf):
    log = RS.log_entries(run_logs(spark, sf)).filter("eval_loss is not null").select("run", "epoch", "eval_loss")
    return R.stop_points(log, 3)


@query("top_two_organisations", EV + """
SELECT frd, org_id, rows, CAST(r AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY frd ORDER BY rows DESC, org_id) AS r FROM (
    SELECT frd, org_id, count(*) AS rows FROM risk_events GROUP BY 1, 2)) WHERE r <= 2""")
def _(spark, sf):
    counts = risk_events(spark, sf).groupBy("frd", "org_id").agg(F.count(F.lit(1)).alias("rows"))
    return T.top_candidates(counts, ["frd"], "rows", "org_id", 2).select("frd", "org_id", "rows", "rank")


@query("train_and_evaluate", "WITH " + SPLIT_SQL + f""",
scored AS (SELECT frd AS y, {LOGIT_SQL} AS s FROM placed WHERE split = 'test'),
ranked AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS r FROM scored)
SELECT sum(y)::BIGINT AS fraud, count(*) AS n,
  round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * sum(1 - y))::DOUBLE, 6) AS auc FROM ranked""")
def _(spark, sf):
    test = S.fraud_split(clean_events(spark, sf)).filter("split = 'test'")
    found = M.evaluate(A.scorecard(test, CARD), label="frd", score="logit")
    return found.select((F.col("half_fn") + F.col("half_tp")).alias("fraud"), "n", F.round("auc", 6).alias("auc"))
