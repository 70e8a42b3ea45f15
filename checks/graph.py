"""Rule policies and walks over graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixture import PART_EDGES_SQL, POLICY_SQL, part_edges, policy_files
from checks.registry import query
from flagstone.operators import policy_graph as G
from flagstone.sources.policies import policy_registry

WITH = "WITH RECURSIVE " + POLICY_SQL
ROOT = "policy_order_set-0"


def policies(spark, sf):
    return policy_registry(policy_files(spark, sf), "shop")


def graph(spark, sf):
    """Nodes and edges, built anew by each query that walks them."""
    return G.build_graph(policies(spark, sf), spark.createDataFrame([(ROOT, 0)], "policy string, pos int"))


def nodes(spark, sf):
    return G.flatten_rules(policies(spark, sf))


def picked(rules):
    return rules.filter("is_excluded").select(F.col("node_id").alias("node"))


@query("policy_thresholds", """
SELECT 'policy_order_set-' || (o_orderkey // 8) AS policy, CAST(min(o_custkey) AS DOUBLE) AS review,
  CAST(max(o_custkey) AS DOUBLE) AS reject FROM orders GROUP BY 1""")
def _(spark, sf):
    return G.thresholds(policies(spark, sf))


@query("policy_top_rules", WITH + """
SELECT policy, count(*) AS rules FROM rules WHERE depth = 0 GROUP BY 1""")
def _(spark, sf):
    return G.policy_rules(policies(spark, sf)).groupBy("policy").agg(F.count(F.lit(1)).alias("rules"))


@query("flattened_rules", WITH + """
SELECT policy, node_id, parent_id, CAST(depth AS INTEGER) AS depth, name, type, risk_weight, coalesce(summary, '') AS summary FROM rules""")
def _(spark, sf):
    return nodes(spark, sf).select("policy", "node_id", "parent_id", "depth", "name", "type", "risk_weight", "summary")


@query("rule_parameter_labels", WITH + r"""
SELECT node_id, array_to_string(list_sort(list_filter([
  'Segment:a\|\{' || (o_custkey % 10) || '\}<b>', 'PolicyName:Order Set/' || named, 'Output_To:' || output,
  'Attribute:' || attribute, 'invert:' || CASE WHEN o_custkey % 2 = 0 THEN 'True' ELSE 'False' END,
  'gen_rsn_cd:' || CASE WHEN o_custkey % 4 = 0 THEN 'True' ELSE 'False' END, 'summary:' || coalesce(summary, 'NA')],
  lambda x: x IS NOT NULL)), ';') AS labels FROM rules""")
def _(spark, sf):
    return nodes(spark, sf).select("node_id", F.array_join("parameters", ";").alias("labels"))


@query("rule_call_flags", WITH + """
SELECT node_id, type = 'Call Policy' AS is_call, type = 'SL Execution Policy' AS is_excluded,
  'policy_order_set-' || callee AS calls FROM rules""")
def _(spark, sf):
    return nodes(spark, sf).select("node_id", "is_call", "is_excluded", "calls")


@query("rule_load_order", WITH + """
SELECT node_id, row_number() OVER (ORDER BY load_key) - 1 AS load_pos FROM loaded""")
def _(spark, sf):
    return graph(spark, sf)[0].select("node_id", "load_pos")


for _kind in ("parent", "dependency", "call", "output"):
    @query(f"policy_{_kind}_edges", WITH + f" SELECT source, target, kind FROM edges WHERE kind = '{_kind}'")
    def _(spark, sf, kind=_kind):
        return graph(spark, sf)[1].filter(F.col("kind") == kind).select("source", "target", "kind")


@query("dangling_dependencies", WITH + """
SELECT source, target, kind FROM edges WHERE source NOT IN (SELECT node_id FROM loaded)""")
def _(spark, sf):
    return G.dangling_edges(*graph(spark, sf))


@query("dangling_policy_calls", WITH + """
SELECT node_id, 'policy_order_set-' || callee AS calls FROM rules WHERE callee IS NOT NULL AND callee NOT IN (SELECT p FROM rules)""")
def _(spark, sf):
    return G.dangling_calls(nodes(spark, sf)).select("node_id", "calls")


UP = """,
up AS (SELECT source AS node FROM edges WHERE target IN (SELECT node_id FROM loaded WHERE type = 'SL Execution Policy')
  UNION SELECT e.source FROM up JOIN edges e ON e.target = up.node)"""
DOWN = """,
down AS (SELECT target AS node FROM edges WHERE kind <> 'call' AND source IN (SELECT node_id FROM loaded WHERE type = 'SL Execution Policy')
  UNION SELECT e.target FROM down JOIN edges e ON e.source = down.node AND e.kind <> 'call')"""


@query("rule_ancestors", WITH + UP + " SELECT node FROM up")
def _(spark, sf):
    rules, edges = graph(spark, sf)
    return G.ancestors(edges, picked(rules))


@query("rule_dependents", WITH + """
SELECT DISTINCT target AS node FROM edges WHERE kind IN ('dependency', 'output')
  AND source IN (SELECT node_id FROM loaded WHERE type = 'SL Execution Policy')""")
def _(spark, sf):
    rules, edges = graph(spark, sf)
    return G.dependents(edges, picked(rules))


@query("rule_descendants", WITH + DOWN + " SELECT node FROM down")
def _(spark, sf):
    rules, edges = graph(spark, sf)
    return G.descendants(edges, picked(rules))


MEMBERS = UP + ",\nmembers AS (SELECT node FROM up UNION SELECT node_id FROM loaded WHERE type = 'SL Execution Policy')"


@query("rule_subgraph_nodes", WITH + MEMBERS + r"""
SELECT node_id, node_id || '\n' || name || '\n' || type AS title, 'RiskWeight:' || CAST(risk_weight AS BIGINT) AS weight,
  CASE WHEN risk_weight < 0 THEN 'red' WHEN risk_weight > 0 THEN 'green' ELSE 'white' END AS colour
FROM loaded WHERE node_id IN (SELECT node FROM members)""")
def _(spark, sf):
    rules, edges = graph(spark, sf)
    return G.subgraph(rules, edges, picked(rules))[0].select("node_id", "title", "weight", "colour")


@query("rule_subgraph_edges", WITH + MEMBERS + " SELECT source, target, kind FROM edges WHERE target IN (SELECT node FROM members)")
def _(spark, sf):
    rules, edges = graph(spark, sf)
    return G.subgraph(rules, edges, picked(rules))[1]


@query("part_graph_ancestors", "WITH RECURSIVE " + PART_EDGES_SQL + """,
up AS (SELECT source AS node FROM part_edges WHERE target IN (SELECT p_partkey FROM part WHERE p_size = 7)
  UNION SELECT e.source FROM up JOIN part_edges e ON e.target = up.node) SELECT node FROM up""")
def _(spark, sf):
    start = spark.read.parquet(f"{sf}/part.parquet").filter("p_size = 7").select(F.col("p_partkey").alias("node"))
    return G.ancestors(part_edges(spark, sf), start)


@query("part_graph_descendants", "WITH RECURSIVE " + PART_EDGES_SQL + """,
down AS (SELECT target AS node FROM part_edges WHERE kind <> 'call' AND source IN (SELECT p_partkey FROM part WHERE p_size = 7)
  UNION SELECT e.target FROM down JOIN part_edges e ON e.source = down.node AND e.kind <> 'call') SELECT node FROM down""")
def _(spark, sf):
    start = spark.read.parquet(f"{sf}/part.parquet").filter("p_size = 7").select(F.col("p_partkey").alias("node"))
    return G.descendants(part_edges(spark, sf), start)
