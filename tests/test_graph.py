"""Rule policies on hand-made documents, and walks on random graphs."""

import json
import random

import pytest

from flagstone.operators import policy_graph as G
from flagstone.plans import closure
from flagstone.plans.closure import reachable, walk
from flagstone.plans.shared import SMALL_ROWS
from flagstone.sources.policies import read_policies


def rule(name, kind="Check", nested=(), **params):
    made = {
        "id": name, "displayName": f"rule {name}", "ruleDisplayName": kind, "invert": False, "generateReasonCode": "yes",
        "parameters": [{"parameterName": k.rstrip("_"), "value": v} for k, v in params.items()],
    }
    if nested:
        made["rules"] = list(nested)
    return made


def document(rules, variables=()):
    return json.dumps({"policyVersion": {"rules": list(rules), "variables": list(variables), "reviewStatus": [-90, -50]}})


MAIN = document(
    [
        rule("1", nested=[rule("2", nested=[rule("3", Output_To="early")]), rule("4", Attribute="early")], Output_To="top"),
        rule("5", "Call Policy", PolicyName="Sub One", Dependencies="1|9", Attribute="late"),
        rule("6", Attribute="top", Other="late"),
        rule("7", "SL Execution Policy", PolicyName="Sub One"),
        rule("8", "Call Policy", PolicyName="Sub One"),
    ],
    [rule("v", Attribute="own", Output_Count_To="own")],
)
SUB = document([rule("a", Output_To="late", Attribute="top"), rule("b", nested=[rule("c", Output_To="top")])])


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("policies")
    (folder / "org1_policy_Main_v1.json").write_text(MAIN)
    (folder / "org1_policy_Sub_One_v1.json").write_text("{}")
    (folder / "org1_policy_Sub_One_v2.json").write_text(SUB)
    (folder / "org2_policy_Main_v1.json").write_text("{}")
    (folder / "org1_policy_Unused_v1.json").write_text(document([rule("z")]))
    policies = read_policies(spark, str(folder), "org1").cache()
    roots = spark.createDataFrame([("policy_main", 0)], "policy string, pos int")
    nodes, edges = G.build_graph(policies, roots)
    return policies, nodes, edges


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def short(node):
    return node.replace("policy_main_", "m").replace("policy_sub_one_", "s")


def test_registry_keeps_the_last_file(graph):
    policies = {r.policy: r.path for r in graph[0].collect()}
    assert set(policies) == {"policy_main", "policy_sub_one", "policy_unused"}
    assert policies["policy_sub_one"].endswith("_v2.json")
    row = G.thresholds(graph[0]).filter("policy = 'policy_main'").first()
    assert (row.review, row.reject) == (-50, -90)


def test_nodes_load_nested_first_and_calls_in_place(graph):
    order = [short(r.node_id) for r in graph[1].orderBy("load_pos").collect()]
    assert order == ["m3", "m2", "m4", "m1", "m5", "sa", "sc", "sb", "m6", "m7", "m8", "mv"]


def test_edges(graph):
    found = {(short(r.source), short(r.target), r.kind) for r in graph[2].collect()}
    parents = {("m1", "m2"), ("m2", "m3"), ("m1", "m4"), ("sb", "sc")}
    calls = {(c, s) for c in ("m5", "m8") for s in ("sa", "sb")}
    outputs = {("m3", "m4"), ("m1", "sa"), ("sc", "m6"), ("sa", "m6"), ("mv", "mv")}
    listed = {("m1", "m5"), ("m9", "m5")}
    assert found == (
        {(a, b, "parent") for a, b in parents} | {(a, b, "call") for a, b in calls}
        | {(a, b, "output") for a, b in outputs} | {(a, b, "dependency") for a, b in listed}
    )
    assert [(short(r.source), short(r.target)) for r in G.dangling_edges(graph[1], graph[2]).collect()] == [("m9", "m5")]


def test_labels(graph):
    row = graph[1].filter("node_id = 'policy_main_5'").first()
    assert row.parameters == ["Attribute:late", "PolicyName:Sub One", "gen_rsn_cd:yes", "invert:False", "summary:NA"]
    assert row.is_call and not row.is_excluded and row.calls == "policy_sub_one"
    excluded = graph[1].filter("node_id = 'policy_main_7'").first()
    assert excluded.is_excluded and excluded.calls is None


def test_walks(spark, graph):
    _, nodes, edges = graph
    def up(*names):
        return {short(r.node) for r in G.ancestors(edges, ids(spark, *names)).collect()}

    assert up("policy_sub_one_c") == {"sb", "m5", "m8", "m1", "m9"}
    assert up("policy_main_v") == {"mv"}
    assert {short(r.node) for r in G.dependents(edges, ids(spark, "policy_main_1")).collect()} == {"m5", "sa"}
    down = {short(r.node) for r in G.descendants(edges, ids(spark, "policy_main_1")).collect()}
    assert down == {"m2", "m3", "m4", "m5", "sa", "m6"}
    shown, inner = G.subgraph(nodes, edges, ids(spark, "policy_main_4"))
    assert {short(r.node_id) for r in shown.collect()} == {"m1", "m2", "m3", "m4"}
    assert {(short(r.source), short(r.target)) for r in inner.collect()} == {("m1", "m2"), ("m2", "m3"), ("m1", "m4"), ("m3", "m4")}


def test_deep_nesting_is_an_error_not_a_cut(spark):
    deep = rule("0")
    for i in range(1, 6):
        deep = rule(str(i), nested=[deep])
    policies = spark.createDataFrame([("p", document([deep]))], "policy string, document string")
    assert G.flatten_rules(policies).count() == 6
    with pytest.raises(ValueError):
        G.flatten_rules(policies, max_depth=3)


def test_calls_in_a_ring_end(spark):
    docs = [("policy_a", document([rule("1", "Call Policy", PolicyName="b")])),
            ("policy_b", document([rule("1", "Call Policy", PolicyName="a")]))]
    policies = spark.createDataFrame(docs, "policy string, document string")
    roots = spark.createDataFrame([("policy_a", 0)], "policy string, pos int")
    nodes, edges = G.build_graph(policies, roots)
    assert nodes.count() == 2 and edges.count() == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_reachable_with_cycles_and_diamonds(spark, seed):
    rng = random.Random(seed)
    pairs = {(rng.randrange(60), rng.randrange(60)) for _ in range(90)}
    edges = spark.createDataFrame(sorted(pairs), "a long, b long")
    start = {0, 1, 2}
    seen, todo = set(), list(start)
    while todo:
        node = todo.pop()
        for a, b in pairs:
            if a == node and b not in seen:
                seen.add(b)
                todo.append(b)
    nodes = spark.createDataFrame([(s,) for s in start], "node long")
    found = reachable(edges, nodes, "a", "b")
    assert {r.node for r in found.collect()} == seen and found.count() == len(seen)
    assert {r.node for r in reachable(edges, nodes, "a", "b", include_start=True).collect()} == seen | start


def test_long_chains_take_few_rounds(spark):
    """A chain of 5 000 nodes with a leaf at each, and a cycle behind it."""
    n = 5000
    rows = [(i, i + 1) for i in range(n)] + [(i, 100_000 + i) for i in range(n)] + [(n, n - 3), (200_000, 200_001), (None, 1), (2, None)]
    edges = spark.createDataFrame(rows, "a long, b long")
    start = spark.createDataFrame([(10,)], "node long")
    nodes, rounds = walk(edges, start, "a", "b")
    assert sorted(r.node for r in nodes.collect()) == [*range(11, n + 1), *range(100_010, 100_000 + n)]
    assert rounds < 20


@pytest.mark.parametrize("limit", [SMALL_ROWS, 3])
def test_walks_equal_a_plain_search(spark, monkeypatch, limit):
    """Random graphs with cycles and forks, walked as small and as large ones."""
    monkeypatch.setattr(closure, "SMALL_ROWS", limit)
    rng = random.Random(limit)
    for n, m in ((40, 44), (60, 55)):
        rows = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(100 + i, 101 + i) for i in range(25)]
        beside = {}
        for a, b in rows:
            beside.setdefault(a, set()).add(b)
        for starts in ([0, 100], [5]):
            found, todo = set(), list(starts)
            while todo:
                new = beside.get(todo.pop(), set()) - found
                found |= new
                todo += new
            nodes = closure.reachable(spark.createDataFrame(rows, "a long, b long"), spark.createDataFrame([(s,) for s in starts], "node long"), "a", "b")
            assert sorted(r.node for r in nodes.collect()) == sorted(found)


def test_walks_by_place_equal_a_plain_search(spark):
    """Places cut at random and in order, with cycles, nodes of several places and null nodes."""
    rng = random.Random(3)
    pairs = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(55)} | {(100 + i, 101 + i) for i in range(5)})
    found, todo = set(), [0, 100, 5]
    while todo:
        new = {b for a, b in pairs if a == todo[-1]} - found
        todo.pop()
        found |= new
        todo += new
    nodes = spark.createDataFrame([(s,) for s in (0, 100, 5)], "node long")
    for place in (lambda a, b: rng.randrange(2), lambda a, b: b // 20):
        edges = spark.createDataFrame([(a, b, place(a, b)) for a, b in pairs] + [(None, 999, 1)], "a long, b long, place long")
        assert sorted(r.node for r in reachable(edges, nodes, "a", "b").collect()) == sorted(found)
    more = reachable(edges, nodes, "a", "b", include_start=True)
    assert sorted(r.node for r in more.collect()) == sorted(found | {0, 100, 5})


def test_long_chains_by_place_take_a_round_per_change_of_place(spark):
    """A chain of 3 000 forks over three places takes a round for each."""
    n = 3000
    rows = [(i, i + 1, i // 1000) for i in range(n)] + [(i, i + 2, i // 1000) for i in range(n - 1)]
    edges = spark.createDataFrame(rows, "a long, b long, place long")
    nodes, rounds = closure.walk_by_place(edges, spark.createDataFrame([(10,)], "node long"), "a", "b")
    assert sorted(r.node for r in nodes.collect()) == list(range(11, n + 1)) and rounds <= 3


def test_parameters_of_any_shape(spark):
    """Values that are no text, entries without a name, and one object in place of a list, as JSON reads them."""
    shown = [
        ([{"parameterName": "n", "value": 5}, {"parameterName": "b", "value": True}, {"parameterName": "x", "value": None}], ["b:true", "n:5", "x"]),
        ([{"parameterName": "o", "value": {"a": 1}}, {"parameterName": "d", "value": 1.5}], ["d:1.5", 'o:\\{"a":1\\}']),
        ({"parameterName": "one", "value": "v"}, ["one:v"]),
        ([], []), (None, []),
    ]
    docs = []
    for i, (given, _) in enumerate(shown):
        docs.append((f"p{i}", document([{"id": "1", "parameters": given}])))
    rows = G.flatten_rules(spark.createDataFrame(docs, "policy string, document string")).orderBy("policy").collect()
    extras = ("gen_rsn_cd:", "invert:", "summary:")
    assert [[p for p in r.parameters if not p.startswith(extras)] for r in rows] == [want for _, want in shown]


def test_one_kind_of_edges_starts_no_other_work(spark, graph):
    """Edges are made when they are read, and then only those of the wanted kind."""
    context = spark.sparkContext
    context.setJobGroup("edges", "edges")
    edges = G.policy_edges(graph[1]).filter("kind = 'parent'")
    assert not list(context.statusTracker().getJobIdsForGroup("edges"))
    context.setLocalProperty("spark.jobGroup.id", None)
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "_chunk" not in plan
