"""Sources, sinks, columns, filters, joins, counts and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixture import (
    CLEAN_FLAGS, EVENTS_SQL, FEATURES_SQL, FLAGS, RUNS_SQL, SPLIT_SQL, brand_features, policy_files, risk_events,
    run_logs, table,
)
from checks.registry import query
from flagstone.functions import text as X
from flagstone.operators import columns as C, splits as S, tokens as N
from flagstone.plans.shared import scratch_path
from flagstone.sources import events as E, lists as L, policies as P, runlog as R
from flagstone.streaming.events import stream_events, write_stream

EV = "WITH " + EVENTS_SQL
QUOTED = ", ".join(f'"{f}"' for f in FLAGS)
CSV_SCHEMA = "row_id bigint, org_id string, datetime timestamp_ntz, frd int, transaction_amount double, policy string"


def event_csv(spark, sf, path=None):
    """The event table as CSV files with header in the shared folder."""
    path = path or scratch_path(spark, "events")
    risk_events(spark, sf).select(*[c.split()[0] for c in CSV_SCHEMA.split(", ")]).write.option("header", True).option(
        "timestampNTZFormat", E.TIME_FORMAT).csv(path)
    return path


CSV_SQL = EV + " SELECT row_id, org_id, datetime, frd, transaction_amount, policy FROM risk_events"


@query("read_events_csv", CSV_SQL)
def _(spark, sf):
    return E.read_events(spark, event_csv(spark, sf), CSV_SCHEMA)


@query("read_events_pruned", EV + " SELECT frd, transaction_amount FROM risk_events")
def _(spark, sf):
    return E.read_events(spark, event_csv(spark, sf), CSV_SCHEMA, ["frd", "transaction_amount"])


@query("read_events_by_plan_path", CSV_SQL)
def _(spark, sf):
    root = scratch_path(spark, "planned")
    plan = {"output_folder": root, "date_range": [(20240101, 20240131)], "event_types": ["login"],
            "primary_industry": ["banking"]}
    event_csv(spark, sf, E.event_path(root, "banking", "login", 20240101, 20240131))
    return E.read_planned_events(spark, plan, CSV_SCHEMA)


@query("stream_dropped_events", EV + " SELECT row_id, frd, 'org_id_' || org_id AS token FROM risk_events")
def _(spark, sf):
    rows = stream_events(spark, event_csv(spark, sf), CSV_SCHEMA).select("row_id", "frd", X.token("org_id").alias("token"))
    out = scratch_path(spark, "streamed")
    write_stream(rows, out, scratch_path(spark, "progress")).awaitTermination()
    return spark.read.parquet(out)


@query("read_csv_tree", EV + """
SELECT row_id, frd, org_id AS folder FROM risk_events""")
def _(spark, sf):
    path = scratch_path(spark, "tree")
    risk_events(spark, sf).select("row_id", "frd", "org_id").write.partitionBy("org_id").csv(path)
    rows = E.read_csv_tree(spark, path, "row_id bigint, frd int")
    return rows.select("row_id", "frd", F.regexp_extract("path", "org_id=([^/]+)", 1).alias("folder"))


@query("read_coefficient_csv", "WITH " + FEATURES_SQL + " SELECT feature, CAST(length(feature) AS DOUBLE) / 8 AS coefficient FROM features")
def _(spark, sf):
    path = scratch_path(spark, "card")
    rows = brand_features(spark, sf).select(
        F.col("feature").alias(""), (F.length("feature") / 8).alias("coefficient"))
    rows.write.option("header", True).csv(path)
    return L.read_coefficients(spark, path)


def feature_file(spark, sf):
    path = scratch_path(spark, "features")
    L.write_vocab(brand_features(spark, sf).select(F.col("pos").alias("id"), F.col("feature").alias("token")), path)
    return path


@query("feature_list_by_prefix", "WITH " + FEATURES_SQL + """
SELECT pos, feature FROM features WHERE feature LIKE 'tsrc%' OR feature LIKE 'tmxrc%'""")
def _(spark, sf):
    return L.read_feature_list(spark, feature_file(spark, sf), C.FLAG_PREFIXES_V2)


@query("split_snapshot", "WITH " + SPLIT_SQL + " SELECT row_id, frd, split FROM placed")
def _(spark, sf):
    path = scratch_path(spark, "splits")
    E.write_splits(S.fraud_split(risk_events(spark, sf)).select("row_id", "frd", "split"), path)
    return E.read_snapshot(spark, path)


VOCAB_SQL = "WITH " + FEATURES_SQL + """,
specials AS (SELECT unnest(['[UNK]', '[SEP]', '[PAD]', '[CLS]', '[MASK]', '[BOS]', '[EOS]']) AS token,
  unnest(range(7)) AS i),
"""
INTERLEAVED_SQL = VOCAB_SQL + """vocab AS (
  SELECT token, CAST(i AS INTEGER) AS id FROM specials
  UNION ALL SELECT feature || '_' || v, CAST(7 + 2 * pos + v AS INTEGER) FROM features, (VALUES (0), (1)) t(v))
SELECT token, id FROM vocab"""


@query("read_vocabulary_file", INTERLEAVED_SQL)
def _(spark, sf):
    path = scratch_path(spark, "vocab")
    L.write_vocab(N.build_vocab(brand_features(spark, sf)), path)
    return L.read_vocab(spark, path)


@query("policy_registry", """
SELECT 'policy_order_set-' || (o_orderkey // 8) AS policy,
  '/policies/shop_policy_Order_Set-' || (o_orderkey // 8) || '_v1.json' AS path
FROM orders GROUP BY ALL""")
def _(spark, sf):
    return P.policy_registry(policy_files(spark, sf), "shop").select("policy", "path")


@query("run_log_entries", "WITH " + RUNS_SQL + """
SELECT run, CAST(day AS DOUBLE) AS epoch, day * 100 AS step, NULL::DOUBLE AS loss, loss AS eval_loss FROM days
UNION ALL SELECT run, day - 0.5::DOUBLE, day * 100 - 50, loss * 2, NULL FROM days""")
def _(spark, sf):
    return R.log_entries(run_logs(spark, sf)).select("run", "epoch", "step", "loss", "eval_loss")


@query("columns_by_prefix", EV + f" SELECT {QUOTED} FROM risk_events")
def _(spark, sf):
    df = risk_events(spark, sf)
    return df.select(*[X.quoted(c) for c in C.columns_with_prefix(df)])


@query("predictor_columns", EV + f" SELECT {QUOTED}, intvar_key, transaction_amount FROM risk_events")
def _(spark, sf):
    df = risk_events(spark, sf)
    return df.select(*[X.quoted(c) for c in C.predictors(df, True, ["transaction_amount"])])


@query("select_wanted_features", EV + """
SELECT "sumrc_Key_Odd", "tmxrc_Weekend", frd, datetime, policy_score, org_id, policy, transaction_amount FROM risk_events""")
def _(spark, sf):
    return C.select_features(risk_events(spark, sf), ["sumrc_Key_Odd", "tmxrc_Absent", "tmxrc_Weekend"])


@query("drop_unselected_flags", EV + """
SELECT row_id, "tmxrc_Weekend", frd FROM risk_events""")
def _(spark, sf):
    df = risk_events(spark, sf).select("row_id", *[X.quoted(f) for f in FLAGS], "frd")
    return C.drop_columns(df, C.columns_to_remove(df, [*FLAGS, "tmxrc_Absent"], ["tmxrc_Weekend"]))


@query("clean_column_names", EV + """
SELECT row_id, "tmxrc_Possible VPN or Tunnel" AS "tmxrc_Possible_VPN_or_Tunnel" FROM risk_events""")
def _(spark, sf):
    return C.clean_names(risk_events(spark, sf).select("row_id", X.quoted("tmxrc_Possible VPN or Tunnel")))


@query("clean_feature_list", "WITH " + FEATURES_SQL + " SELECT pos, replace(feature, ' ', '_') AS feature FROM features")
def _(spark, sf):
    return C.clean_feature_names(brand_features(spark, sf))


@query("positional_columns", EV + " SELECT row_id, org_id, datetime, frd FROM risk_events")
def _(spark, sf):
    return C.column_slice(risk_events(spark, sf), 0, 4)


@query("label_to_number", EV + " SELECT row_id, frd FROM risk_events")
def _(spark, sf):
    text = C.to_text(risk_events(spark, sf).select("row_id", "frd"), ["frd"])
    return C.to_number(text, "frd")


@query("truncate_to_long", EV + """
SELECT row_id, CAST(trunc(policy_score / 7) AS BIGINT) AS policy_score FROM risk_events""")
def _(spark, sf):
    df = risk_events(spark, sf).select("row_id", (F.col("policy_score") / 7).alias("policy_score"))
    return C.to_long(df, ["policy_score"])


@query("flags_as_text", EV + """
SELECT row_id, CAST("sumrc_Key_Odd" AS VARCHAR) AS "sumrc_Key_Odd",
  CAST("tmxrc_Possible VPN or Tunnel" AS VARCHAR) AS "tmxrc_Possible VPN or Tunnel" FROM risk_events""")
def _(spark, sf):
    names = ["sumrc_Key_Odd", "tmxrc_Possible VPN or Tunnel"]
    return C.to_text(risk_events(spark, sf).select("row_id", *[X.quoted(n) for n in names]), names)


@query("fill_nulls_with_zero", EV + """
SELECT row_id, coalesce("tmxrc_Possible VPN or Tunnel", 0) AS "tmxrc_Possible VPN or Tunnel",
  coalesce(policy_score, 0) AS policy_score FROM risk_events""")
def _(spark, sf):
    return C.fill_zero(risk_events(spark, sf).select("row_id", X.quoted(FLAGS[-1]), "policy_score"))


@query("add_constant_column", EV + " SELECT row_id, TRUE AS eval FROM risk_events")
def _(spark, sf):
    return C.add_constant(risk_events(spark, sf).select("row_id"), "eval", True)


@query("flags_long_form", EV + ", flags AS (SELECT row_id, " + QUOTED + """ FROM risk_events)
SELECT row_id, feature, value FROM flags UNPIVOT INCLUDE NULLS (value FOR feature IN (""" + QUOTED + "))")
def _(spark, sf):
    return C.to_long_form(risk_events(spark, sf), ["row_id"], FLAGS)


@query("class_weights", EV + """,
odds AS (SELECT CAST(count(*) FILTER (frd = 0) AS DOUBLE) / count(*) FILTER (frd = 1) AS r FROM risk_events)
SELECT row_id, CASE WHEN frd = 1 THEN round_even(r, 0) ELSE 1.0::DOUBLE END AS weights_column FROM risk_events, odds""")
def _(spark, sf):
    return C.with_class_weights(risk_events(spark, sf)).select("row_id", "weights_column")


@query("attach_labels", EV + ' SELECT row_id, "sumrc_Key_Odd", frd FROM risk_events')
def _(spark, sf):
    df = risk_events(spark, sf)
    return C.attach_labels(df.select("row_id", "sumrc_Key_Odd"), df.select("row_id", "frd"))


@query("features_and_label", EV + f"""
SELECT row_id, CAST(frd AS BIGINT) AS y, concat_ws(',', {", ".join(f'"{f}"' for f in FLAGS[:7])}) AS x FROM risk_events""")
def _(spark, sf):
    made = C.features_and_label(risk_events(spark, sf), FLAGS[:7], others=["row_id"])
    return made.withColumn("x", F.array_join(F.transform("x", lambda v: v.cast("string")), ","))


@query("scored_rows_only", EV + " SELECT row_id, policy_score FROM risk_events WHERE policy_score IS NOT NULL")
def _(spark, sf):
    return C.not_null(risk_events(spark, sf)).select("row_id", "policy_score")


@query("fraud_rows_predictors", EV + f" SELECT {QUOTED} FROM risk_events WHERE frd = 1")
def _(spark, sf):
    return C.with_label(risk_events(spark, sf), 1, FLAGS)


@query("rows_by_flag", EV + """
SELECT row_id, FALSE AS side FROM risk_events WHERE "tmxrc_Possible VPN or Tunnel" = 0
UNION ALL SELECT row_id, TRUE FROM risk_events WHERE "tmxrc_Possible VPN or Tunnel" = 1""")
def _(spark, sf):
    df = risk_events(spark, sf).select("row_id", (X.quoted(FLAGS[-1]) == 1).alias("side"))
    return C.flag_is(df, "side", False).unionByName(C.flag_is(df, "side", True))


LONG_TOKENS = EV + ", flags AS (SELECT row_id, " + QUOTED + """ FROM risk_events),
long AS (SELECT row_id, feature, value FROM flags UNPIVOT INCLUDE NULLS (value FOR feature IN (""" + QUOTED + """))),
names AS (SELECT unnest([""" + ", ".join(f"'{f}'" for f in FLAGS) + "]) AS feature, unnest(range(8)) AS pos)"


@query("token_lookup_join", LONG_TOKENS + """
SELECT row_id, feature, concat_ws('_', feature, value) AS token,
  CAST(CASE WHEN value IS NULL THEN 0 ELSE 7 + 2 * pos + value END AS INTEGER) AS id
FROM long JOIN names USING (feature)""")
def _(spark, sf):
    long = C.to_long_form(risk_events(spark, sf), ["row_id"], FLAGS)
    tokens = long.select("row_id", "feature", F.concat_ws("_", "feature", F.col("value").cast("string")).alias("token"))
    vocab = N.build_vocab(N.feature_table(spark, FLAGS))
    return N.lookup_ids(tokens, vocab, 0).select("row_id", "feature", "token", "id")


@query("rows_outside_sample", EV + """
SELECT row_id, frd FROM risk_events WHERE NOT substr(md5(CAST(row_id AS VARCHAR) || '|1'), 1, 8) < 'cccccccd'""")
def _(spark, sf):
    df = risk_events(spark, sf).select("row_id", "frd")
    return S.complement(df, S.subset(df, "row_id", 0.8, 1))


@query("fraud_cutoff_join", "WITH " + SPLIT_SQL + " SELECT row_id, org_id, datetime FROM held WHERE eval")
def _(spark, sf):
    return S.time_split(risk_events(spark, sf)).filter("eval").select("row_id", "org_id", "datetime")


@query("keep_listed_features", LONG_TOKENS + """
SELECT row_id, feature, value FROM long WHERE feature LIKE 'sumrc%'""")
def _(spark, sf):
    long = C.to_long_form(risk_events(spark, sf), ["row_id"], FLAGS)
    return C.keep_listed(long, L.feature_list(N.feature_table(spark, FLAGS), ("sumrc",))).select("row_id", "feature", "value")


@query("zip_names_and_values", EV + """
SELECT row_id, concat_ws(' ', 'sumrc_Key_Odd_' || "sumrc_Key_Odd", 'tmxrc_Weekend_' || "tmxrc_Weekend") AS text FROM risk_events""")
def _(spark, sf):
    names = ["sumrc_Key_Odd", "tmxrc_Weekend"]
    return risk_events(spark, sf).select("row_id", X.sentence(names).alias("text"))


@query("policy_counts", EV + ' SELECT org_id, frd, count(policy) AS "count" FROM risk_events GROUP BY 1, 2')
def _(spark, sf):
    return C.policy_counts(risk_events(spark, sf))


@query("value_count_matrix", LONG_TOKENS + """
SELECT CAST(value AS VARCHAR) AS value, """ + ", ".join(
    f"""CAST(nullif(count(*) FILTER (feature = '{f}'), 0) AS BIGINT) AS "{f}" """ for f in FLAGS) + " FROM long WHERE value IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return C.value_counts(risk_events(spark, sf), FLAGS)


@query("class_ratio_per_split", "WITH " + SPLIT_SQL + """
SELECT split, round_even(CAST(count(*) FILTER (frd = 0) AS DOUBLE) / count(*) FILTER (frd = 1), 2) AS ratio FROM placed GROUP BY 1""")
def _(spark, sf):
    return C.class_ratio(S.fraud_split(risk_events(spark, sf)))


@query("fraud_time_spans", EV + """
SELECT org_id, min(datetime) FILTER (frd = 1) AS first_fraud, max(datetime) FILTER (frd = 1) AS last_fraud
FROM risk_events GROUP BY 1""")
def _(spark, sf):
    return S.fraud_spans(risk_events(spark, sf))


@query("distinct_organisations", EV + " SELECT DISTINCT org_id FROM risk_events")
def _(spark, sf):
    return risk_events(spark, sf).select("org_id").distinct()


@query("table_shape", EV + " SELECT count(*) AS n_rows, 17 AS n_columns FROM risk_events")
def _(spark, sf):
    return C.shape(risk_events(spark, sf))


@query("mean_pooled_vectors", """
SELECT label, pos, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM (
  SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY 1, 2""")
def _(spark, sf):
    pooled = C.mean_pool(table(spark, sf, "embeddings"), "label", "embedding")
    rows = pooled.select("label", F.posexplode("embedding").alias("pos", "mean"))
    return rows.select("label", F.col("pos").cast("long").alias("pos"), F.round("mean", 6).alias("mean"))


@query("feature_name_difference", "WITH " + FEATURES_SQL + " SELECT feature FROM features WHERE feature NOT LIKE 'tsrc%'")
def _(spark, sf):
    features = brand_features(spark, sf)
    return C.name_difference(features, L.feature_list(features, ("tsrc",)))


@query("feature_name_intersection", "WITH " + FEATURES_SQL + " SELECT feature FROM features WHERE feature LIKE 'tsrc%'")
def _(spark, sf):
    features = brand_features(spark, sf)
    return C.name_intersection(features, L.feature_list(features, ("tsrc", "absent")))


@query("concatenated_batches", EV + """
SELECT row_id, org_id FROM risk_events WHERE frd = 1 UNION ALL SELECT row_id, org_id FROM risk_events WHERE frd = 0""")
def _(spark, sf):
    df = risk_events(spark, sf).select("row_id", "org_id", "frd")
    return C.with_label(df, 1).unionByName(C.with_label(df, 0)).select("row_id", "org_id")


@query("clean_flag_table", EV + " SELECT row_id, " + ", ".join(
    f'coalesce("{f}", 0) AS "{g}"' for f, g in zip(FLAGS, CLEAN_FLAGS)) + " FROM risk_events")
def _(spark, sf):
    df = C.clean_names(risk_events(spark, sf).select("row_id", *[X.quoted(f) for f in FLAGS]))
    return C.fill_zero(df)
