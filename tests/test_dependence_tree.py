import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flagstone.operators import dependence_tree as D, learn as L

NAMES = ["t", "a", "b c", "d.e", "f"]
SCHEMA = "row_id long, t string, a int, `b c` string, `d.e` int, f int"


def chained(n, seed=3, nulls=True):
    """Rows where b c follows a, d.e follows b c, a follows t, and f is on its own."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = rng.randint(0, 2)
        a = t if rng.random() < 0.6 else rng.randint(0, 2)
        b = a if rng.random() < 0.95 else rng.randint(0, 2)
        d = b if rng.random() < 0.95 else rng.randint(0, 2)
        row = [f"t{t}", a, f"v{b}", d, rng.randint(0, 1)]
        rows.append((i, *[None if nulls and rng.random() < 0.15 else v for v in row]))
    return rows


def information(rows, x, y):
    """By the definition, over rows where both are known."""
    both = [(r[x], r[y]) for r in rows if r[x] is not None and r[y] is not None]
    n, pair, one, two = len(both), Counter(both), Counter(a for a, _ in both), Counter(b for _, b in both)
    return sum(c / n * math.log(c * n / (one[a] * two[b])) for (a, b), c in pair.items())


def test_information_and_tree(spark):
    rows = chained(300)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = {(r.feature, r.other): r.information for r in D.mutual_information(D.pair_counts(df, D.feature_values(df, NAMES))).collect()}
    place = {n: i + 1 for i, n in enumerate(NAMES)}
    assert set(found) == set(itertools.combinations(sorted(NAMES), 2))
    for (x, y), got in found.items():
        assert got == pytest.approx(information(rows, place[x], place[y]), abs=1e-8)
    tree = {(r.feature, r.other) for r in D.dependence_tree(df, NAMES).collect()}
    trees = [c for c in itertools.combinations(found, 4) if len(reached(c)) == 5]
    assert tree == set(max(trees, key=lambda c: sum(found[e] for e in c)))
    assert {("a", "b c"), ("b c", "d.e"), ("a", "t")} <= tree


def reached(edges):
    seen = {"t"}
    for _ in edges:
        seen |= {n for e in edges if seen & set(e) for n in e}
    return seen


def test_filling_is_exact_inference(spark):
    """Against the sum over all values of all features of the tree's joint distribution."""
    rows = chained(120) + [(900, None, None, None, None, None), (901, None, None, "new", 77, 1), (901, None, 1, None, 2, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    tree = D.strongest_tree(D.mutual_information(D.pair_counts(df.filter("t is not null"), D.feature_values(df.filter("t is not null"), NAMES))))
    learned = [{n: None if v is None else str(v) for n, v in zip(NAMES, r[1:])} for r in rows if r[1] is not None]
    values = {n: sorted({r[n] for r in learned} - {None}) for n in NAMES}
    order = D._from_root(tree, "t")

    def chance(child, x, parent, y):
        known = [r for r in learned if r[child] is not None and r[parent] == y]
        return (sum(r[child] == x for r in known) + 1) / (len(known) + len(values[child]))

    tables = {(c, p): {(x, y): chance(c, x, p, y) for x in values[c] for y in values[p]} for c, p in order}
    prior = {x: (sum(r["t"] == x for r in learned) + 1) / (len(learned) + len(values["t"])) for x in values["t"]}
    got = {}
    for r in D.fill_masked_by_tree(df, "t", NAMES[1:], k=3).collect():
        got.setdefault(r.row_id, []).append((r.candidate, r.p, r["rank"]))
    for i, row in [(r[0], r) for r in rows if r[0] != 901]:
        shown = {n: str(v) if v is not None and str(v) in values[n] else None for n, v in zip(NAMES[1:], row[2:])}
        weight = Counter()
        for point in itertools.product(*(values[n] for n in NAMES)):
            at = dict(zip(NAMES, point))
            if all(shown[n] is None or shown[n] == at[n] for n in NAMES[1:]):
                weight[at["t"]] += prior[at["t"]] * math.prod(tables[c, p][at[c], at[p]] for c, p in order)
        for candidate, p, _ in got[i]:
            assert p == pytest.approx(weight[candidate] / sum(weight.values()), rel=1e-9)
        assert [r for *_, r in got[i]] == [1, 2, 3]
    assert len(got[901]) == 6  # a repeated key: each row has its own candidates


def test_held_out_log_loss_is_below_that_of_independent_features(spark):
    """Features that repeat each other are counted once on the tree, and again and again without it."""
    train, held = (spark.createDataFrame(chained(n, seed, False), SCHEMA) for n, seed in ((600, 5), (400, 6)))
    both = train.unionByName(held.withColumns({"row_id": F.col("row_id") + 1000, "t": F.lit(None).cast("string")}))
    truth = {r.row_id + 1000: r.t for r in held.collect()}

    def loss(fill):
        rows = fill(both, "t", NAMES[1:], k=3).filter("row_id >= 1000").collect()
        return -sum(math.log(r.p) for r in rows if r.candidate == truth[r.row_id]) / len(truth)

    assert loss(D.fill_masked_by_tree) < loss(L.fill_masked) - 0.01


def test_defined_edges(spark):
    df = spark.createDataFrame(chained(20), SCHEMA)
    none = df.withColumn("t", F.lit(None).cast("string"))
    assert D.fill_masked_by_tree(none, "t", NAMES[1:]).collect() == []
    assert D.fill_masked_by_tree(df.limit(0), "t", NAMES[1:]).collect() == []
    assert D.dependence_tree(df.limit(0), NAMES).collect() == []
    # Features never known together make a forest; one that is never known tells nothing.
    apart = spark.createDataFrame([(1, "x", 1, None, None), (2, "y", None, 1, None), (3, "y", None, 2, None)], "row_id int, t string, a int, b int, c int")
    assert {(r.feature, r.other) for r in D.dependence_tree(apart, ["t", "a", "b", "c"]).collect()} == {("a", "t"), ("b", "t")}
    ties = spark.createDataFrame([(1, "y"), (2, "x")], "row_id int, t string")
    assert [(r.candidate, r.p) for r in D.fill_masked_by_tree(ties, "t", [], k=1).collect()] == [("x", 0.5), ("x", 0.5)]
