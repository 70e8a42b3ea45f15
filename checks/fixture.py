"""Inputs derived from the given tables, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

FLAGS = [
    "tmxrc_Amount_High", "tmxrc_Amount_Low", "tmxrc_Night_Hour", "tmxrc_Weekend", "tmxrc_Half_Hour",
    "sumrc_Key_Odd", "sumrc_User_Even", "tmxrc_Possible VPN or Tunnel",
]
CLEAN_FLAGS = [f.replace(" ", "_") for f in FLAGS]

# A made-up card for the flags, in the order of FLAGS.
CARD = dict(zip(CLEAN_FLAGS, [1.25, -0.5, 0.75, -0.25, 0.125, 0.5, -1.0, 2.0], strict=True))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def risk_events(spark: SparkSession, sf: str) -> DataFrame:
    """One wide row per event. Every column comes from its own row, so this costs no shuffle."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    def flag(test):
        return F.when(test, 1).otherwise(0)

    flags = [
        flag(F.col("value") > 100), flag(F.col("value") < 10), flag(F.hour("ts") < 6), flag(F.weekday("ts") >= 5),
        flag(F.minute("ts") < 30), k % 2, flag(F.col("user_id") % 2 == 0),
        F.when(k % 13 == 0, F.lit(None).cast("int")).when(k % 5 == 0, 1).otherwise(0),
    ]
    return table(spark, sf, "events").select(
        F.col("event_id").alias("row_id"),
        F.concat(F.lit("org_"), (F.col("user_id") % 10).cast("string")).alias("org_id"),
        F.col("ts").alias("datetime"),
        flag(F.col("event_type") == "error").alias("frd"),
        F.col("value").alias("transaction_amount"),
        F.when(k % 11 != 0, F.col("event_type")).alias("policy"),
        F.when(k % 7 != 0, (k - 50).cast("double")).alias("policy_score"),
        *[c.alias(f) for c, f in zip(flags, FLAGS, strict=True)],
        k.alias("intvar_key"),
        flag(F.col("user_id") % 3 == 0).alias("tsrc_User_Third"),
    )


EVENTS_SQL = """risk_events AS (
  SELECT event_id AS row_id, 'org_' || CAST(user_id % 10 AS VARCHAR) AS org_id, ts AS datetime,
    CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS frd, value AS transaction_amount,
    CASE WHEN k % 11 <> 0 THEN event_type END AS policy,
    CASE WHEN k % 7 <> 0 THEN CAST(k - 50 AS DOUBLE) END AS policy_score,
    CASE WHEN value > 100 THEN 1 ELSE 0 END AS "tmxrc_Amount_High",
    CASE WHEN value < 10 THEN 1 ELSE 0 END AS "tmxrc_Amount_Low",
    CASE WHEN extract(hour FROM ts) < 6 THEN 1 ELSE 0 END AS "tmxrc_Night_Hour",
    CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS "tmxrc_Weekend",
    CASE WHEN extract(minute FROM ts) < 30 THEN 1 ELSE 0 END AS "tmxrc_Half_Hour",
    k % 2 AS "sumrc_Key_Odd",
    CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS "sumrc_User_Even",
    CASE WHEN k % 13 = 0 THEN NULL WHEN k % 5 = 0 THEN 1 ELSE 0 END AS "tmxrc_Possible VPN or Tunnel",
    k AS intvar_key,
    CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS "tsrc_User_Third"
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events))"""

SPLIT_SQL = EVENTS_SQL + """,
spans AS (
  SELECT org_id AS o, min(datetime) AS first_fraud, max(datetime) AS last_fraud
  FROM risk_events WHERE frd = 1 GROUP BY 1),
cutoffs AS (
  SELECT o, last_fraud - to_microseconds(CAST(round_even(
    floor((epoch_us(last_fraud) - epoch_us(first_fraud)) / 86400000000.0) / 5.0 * 86400000000.0, 0) AS BIGINT)) AS cutoff
  FROM spans),
held AS (
  SELECT e.*, CASE WHEN cutoff IS NULL THEN TRUE ELSE datetime > cutoff END AS eval
  FROM risk_events e LEFT JOIN cutoffs ON org_id = o),
placed AS (
  SELECT *, CASE WHEN eval THEN 'test'
    WHEN substr(md5(CAST(row_id AS VARCHAR) || '|1'), 1, 8) < 'cccccccd' THEN 'train' ELSE 'val' END AS split
  FROM held)"""


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scored rows with ties: `(row_id, org_id, y, score, logit)`."""
    return risk_events(spark, sf).select(
        "row_id", "org_id", F.col("frd").alias("y"), (F.col("transaction_amount") / F.lit(500.0)).alias("score"),
        (F.col("transaction_amount") / F.lit(100.0) - F.lit(1.0)).alias("logit"),
    )


SCORES_SQL = EVENTS_SQL + """,
scores AS (
  SELECT row_id, org_id, frd AS y, transaction_amount / 500.0::DOUBLE AS score,
    transaction_amount / 100.0::DOUBLE - 1.0::DOUBLE AS logit FROM risk_events)"""

CURVE_SQL = SCORES_SQL + """,
counts AS (SELECT score, sum(y) AS p, count(*) - sum(y) AS q FROM scores GROUP BY score),
curve AS (
  SELECT score, CAST(p AS BIGINT) AS p, CAST(q AS BIGINT) AS q,
    CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(q) OVER w AS BIGINT) AS fp,
    CAST(sum(p) OVER () AS BIGINT) AS p_all, CAST(sum(q) OVER () AS BIGINT) AS q_all
  FROM counts WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
points AS (
  SELECT *, CAST(fp AS DOUBLE) / q_all AS fpr, CAST(tp AS DOUBLE) / p_all AS tpr,
    CAST(tp AS DOUBLE) / (tp + fp) AS precision, CAST(tp AS DOUBLE) / p_all AS recall FROM curve),
rated AS (
  SELECT *, sqrt(tpr * (1 - fpr)) AS gmean,
    CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS fscore
  FROM points)"""


def brand_features(spark: SparkSession, sf: str) -> DataFrame:
    """A feature list with names from all parts: brand times type, a few hundred at any scale."""
    names = table(spark, sf, "part").select(
        F.concat(
            F.element_at(F.array(F.lit("tmxrc_"), F.lit("tsrc_"), F.lit("sumrc_")), F.length("p_type") % 3 + 1),
            F.replace("p_brand", F.lit("#"), F.lit(" ")), F.lit("_"), F.col("p_type"),
        ).alias("feature")
    ).distinct()
    return names.select((F.row_number().over(Window.orderBy("feature")) - 1).alias("pos"), "feature")


FEATURES_SQL = """names AS (
  SELECT DISTINCT ['tmxrc_', 'tsrc_', 'sumrc_'][length(p_type) % 3 + 1] || replace(p_brand, '#', ' ') || '_' || p_type
    AS feature FROM part),
features AS (SELECT CAST(row_number() OVER (ORDER BY feature) - 1 AS INTEGER) AS pos, feature FROM names)"""


def run_logs(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON log per user `(run, value)`, a day being an epoch and the mean value its loss. A log has
    at most one entry per day, whatever the number of events."""
    days = table(spark, sf, "events").groupBy("user_id", F.dayofmonth("ts").alias("day")).agg(
        F.round(F.avg("value"), 4).alias("loss"), F.count(F.lit(1)).alias("n")
    )
    entry = F.struct(
        F.col("day").cast("double").alias("epoch"), (F.col("day") * 100).alias("step"), F.col("loss").alias("eval_loss"),
        (F.col("n") * 2.0).alias("eval_runtime"), (F.col("n") / 4.0).alias("eval_samples_per_second"),
    )
    plain = F.struct(
        (F.col("day") - 0.5).alias("epoch"), (F.col("day") * 100 - 50).alias("step"), (F.col("loss") * 2).alias("loss")
    )
    logs = days.groupBy(F.col("user_id").alias("run")).agg(
        F.array_sort(F.collect_list(entry)).alias("entries"), F.array_sort(F.collect_list(plain)).alias("others")
    )
    text = F.concat(
        F.lit('{"max_steps":3100,"log_history":['),
        F.concat_ws(",", F.transform("others", lambda e: F.to_json(e)), F.transform("entries", lambda e: F.to_json(e))),
        F.lit("]}"),
    )
    return logs.select("run", text.alias("value"))


RUNS_SQL = """days AS (
  SELECT user_id AS run, CAST(extract(day FROM ts) AS BIGINT) AS day, round(avg(value), 4) AS loss, count(*) AS n
  FROM events GROUP BY 1, 2)"""


def policy_files(spark: SparkSession, sf: str) -> DataFrame:
    """Policy documents `(path, document)`: eight orders make a policy, nested three deep, which calls
    four others, lists dependencies, and makes and uses values of common lists."""
    order = table(spark, sf, "orders").withColumns({
        "idx": F.col("o_orderkey") % 8, "p": F.floor(F.col("o_orderkey") / 8),
    })
    cust, idx, p = F.col("o_custkey"), F.col("idx"), F.col("p")
    callee = F.when(idx == 3, 4 * p + 1).when(idx == 4, 4 * p + 2).when(idx == 5, 4 * p + 3).when(
        idx == 7, 4 * p + 4).when(idx == 6, 4 * p + 1)
    kind = F.when((idx == 6) & (cust % 5 == 0), "SL Execution Policy").when(callee.isNotNull(), "Call Policy").otherwise(
        F.concat(F.lit("Check "), "o_orderstatus"))
    depends = F.when(idx.isin(2, 3, 5), F.concat(F.lit("r"), (idx - 1).cast("string"), F.lit("|r"), (idx - 2).cast("string"))
                     ).when(idx == 7, F.lit("r6|r9"))

    def param(name: str, value):
        return F.when(value.isNotNull(), F.struct(F.lit(name).alias("parameterName"), value.alias("value")))

    params = F.array(
        param("Segment", F.concat(F.lit("a|{"), (cust % 10).cast("string"), F.lit("}<b>"))),
        param("Dependencies", depends),
        param("PolicyName", F.concat(F.lit("Order Set/"), callee.cast("string"))),
        param("Output_To", F.when(cust % 6 == 0, F.concat(F.lit("list_"), (cust % 40).cast("string")))),
        param("Attribute", F.concat(F.lit("list_"), (F.col("o_orderkey") * 7 % 40).cast("string"))),
    )
    rule = F.to_json(F.struct(
        F.concat(F.lit("r"), idx.cast("string")).alias("id"), F.col("o_orderpriority").alias("displayName"),
        kind.alias("ruleDisplayName"),
        F.when(F.col("o_orderstatus") != "P", cust % 21 - 10).alias("riskWeight"),
        F.when(cust % 3 != 0, F.concat(F.lit("priority "), "o_orderpriority")).alias("summary"),
        (cust % 2 == 0).alias("invert"), (cust % 4 == 0).alias("generateReasonCode"),
        F.filter(params, lambda x: x.isNotNull()).alias("parameters"),
    ))
    wide = order.withColumn("rule", rule).groupBy("p").agg(
        *[F.min(F.when(idx == i, F.col("rule"))).alias(f"r{i}") for i in range(8)],
        F.max("o_custkey").alias("top"), F.min("o_custkey").alias("low"),
    )

    def holding(rule, *nested):
        some = F.concat_ws(",", *nested)
        held = F.concat(F.expr(f"left({rule}, length({rule}) - 1)"), F.lit(',"rules":['), some, F.lit("]}"))
        return F.when(some != "", held).otherwise(F.col(rule))

    first, second = holding("r0", holding("r1", F.col("r3")), F.col("r2")), holding("r4", F.col("r5"))
    document = F.concat(
        F.lit('{"policyVersion":{"rules":['), F.concat_ws(",", first, second), F.lit('],"variables":['),
        F.concat_ws(",", "r6", "r7"), F.lit('],"reviewStatus":['), F.col("top").cast("string"), F.lit(","),
        F.col("low").cast("string"), F.lit("]}}"),
    )
    path = F.concat(F.lit("/policies/shop_policy_Order_Set-"), F.col("p").cast("string"), F.lit("_v1.json"))
    return wide.select(path.alias("path"), document.alias("document"))


POLICY_SQL = """marked AS (
  SELECT *, o_orderkey % 8 AS idx, o_orderkey // 8 AS p FROM orders),
called AS (
  SELECT *, CASE idx WHEN 3 THEN 4 * p + 1 WHEN 4 THEN 4 * p + 2 WHEN 5 THEN 4 * p + 3 WHEN 7 THEN 4 * p + 4
    WHEN 6 THEN 4 * p + 1 END AS named,
    CASE idx WHEN 0 THEN '00000000/~' WHEN 1 THEN '00000000/00000000/~' WHEN 2 THEN '00000000/00000001/~'
      WHEN 3 THEN '00000000/00000000/00000000/~' WHEN 4 THEN '00000001/~' WHEN 5 THEN '00000001/00000000/~'
      WHEN 6 THEN '00000002/~' ELSE '00000003/~' END AS local_key,
    CASE WHEN idx IN (1, 2) THEN 0 WHEN idx = 3 THEN 1 WHEN idx = 5 THEN 4 END AS parent,
    CASE WHEN idx IN (1, 2, 5) THEN 1 WHEN idx = 3 THEN 2 ELSE 0 END AS depth FROM marked),
rules AS (
  SELECT 'policy_order_set-' || p AS policy, 'policy_order_set-' || p || '_r' || idx AS node_id,
    'policy_order_set-' || p || '_r' || parent AS parent_id, depth, local_key, idx, p, o_custkey, o_orderkey,
    o_orderpriority AS name, o_orderstatus,
    CASE WHEN idx = 6 AND o_custkey % 5 = 0 THEN 'SL Execution Policy' WHEN named IS NOT NULL THEN 'Call Policy'
      ELSE 'Check ' || o_orderstatus END AS type,
    CASE WHEN idx = 6 AND o_custkey % 5 = 0 THEN NULL ELSE named END AS callee,
    CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey % 21 - 10 AS DOUBLE) ELSE 0 END AS risk_weight,
    CASE WHEN o_custkey % 3 <> 0 THEN 'priority ' || o_orderpriority END AS summary,
    CASE WHEN o_custkey % 6 = 0 THEN 'list_' || (o_custkey % 40) END AS output,
    'list_' || (o_orderkey * 7 % 40) AS attribute, named
  FROM called),
prefixes AS (
  SELECT CAST(0 AS BIGINT) AS p, '00000000' AS key
  UNION ALL
  SELECT c.callee, x.key || '/' || c.local_key FROM prefixes x JOIN (
    SELECT p, callee, min(local_key) AS local_key FROM rules WHERE callee IS NOT NULL GROUP BY 1, 2) c ON c.p = x.p
  WHERE c.callee IN (SELECT p FROM rules)),
loaded AS (SELECT rules.*, key || '/' || local_key AS load_key FROM rules JOIN prefixes USING (p)),
uses AS (
  SELECT node_id, load_key, attribute AS label, NULL::VARCHAR AS producer FROM loaded
  UNION ALL SELECT node_id, load_key, output, node_id FROM loaded WHERE output IS NOT NULL),
latest AS (
  SELECT node_id AS target, producer, last_value(producer IGNORE NULLS) OVER (
    PARTITION BY label ORDER BY load_key RANGE UNBOUNDED PRECEDING) AS source FROM uses),
edges AS (
  SELECT parent_id AS source, node_id AS target, 'parent' AS kind FROM loaded WHERE parent_id IS NOT NULL
  UNION SELECT policy || '_r' || (idx - d), node_id, 'dependency' FROM loaded, (VALUES (1), (2)) v(d) WHERE idx IN (2, 3, 5)
  UNION SELECT policy || '_r' || d, node_id, 'dependency' FROM loaded, (VALUES (6), (9)) v(d) WHERE idx = 7
  UNION SELECT c.node_id, t.node_id, 'call' FROM loaded c JOIN loaded t ON t.p = c.callee AND t.depth = 0
  UNION SELECT source, target, 'output' FROM latest WHERE producer IS NULL AND source IS NOT NULL)"""


def part_edges(spark: SparkSession, sf: str) -> DataFrame:
    """A graph over parts without cycles, one candidate edge per line item: `(source, target, kind)`."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    upper = F.floor(p * (s % 7 + 1) / F.lit(16)).cast("long")
    return table(spark, sf, "lineitem").filter(upper < p).select(
        upper.alias("source"), p.alias("target"), F.when(s % 5 == 0, "call").otherwise("dependency").alias("kind")
    )


PART_EDGES_SQL = """part_edges AS (
  SELECT DISTINCT (l_partkey * (l_suppkey % 7 + 1)) // 16 AS source, l_partkey AS target,
    CASE WHEN l_suppkey % 5 = 0 THEN 'call' ELSE 'dependency' END AS kind
  FROM lineitem WHERE (l_partkey * (l_suppkey % 7 + 1)) // 16 < l_partkey)"""
