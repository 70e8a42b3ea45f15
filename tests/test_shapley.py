"""Attributions against brute force over all sets of features, boosting against a plain version, parameter search."""

import math
import random
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flagstone.operators import attribution as A, boosting as B, metrics as M, shapley as H, tuning as U
from flagstone.sources import events as E

NAMES = ["a", "b c", "d", "e"]


def table(spark, n=300, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [rng.randint(0, 1), rng.choice([0, 1, None]), round(rng.random(), 2), rng.randint(0, 5)]
        chance = 0.1 + 0.5 * x[0] * (x[2] > 0.5) + 0.3 * (x[3] == 2)
        rows.append((i, *x, int(rng.random() < chance)))
    return spark.createDataFrame(rows, "row_id long, a int, `b c` int, d double, e int, frd int")


def scorer():
    """What loads a scorer in a task; workers cannot import this module, so it is a function within."""
    return lambda: lambda frame: np.tanh(frame["a"] * frame["d"] - 0.5 * frame["b c"] * frame["e"] + frame["d"]).to_numpy()


def shapley(value, k):
    """Shapley values from the value of a set."""
    out = np.zeros(k)
    for i in range(k):
        rest = [j for j in range(k) if j != i]
        for size in range(k):
            for some in combinations(rest, size):
                weight = math.factorial(size) * math.factorial(k - size - 1) / math.factorial(k)
                out[i] += weight * (value({*some, i}) - value({*some}))
    return out


def plain(df):
    return {r[0]: np.array([0.0 if v is None else float(v) for v in r[1:]]) for r in df.select("row_id", *[f"`{c}`" for c in NAMES]).collect()}


def test_background_attributions_equal_brute_force(spark):
    df = table(spark, 60)
    background = df.filter("row_id < 25")
    rows, back = plain(df), np.array(list(plain(background).values()))
    f = scorer()()
    found = {r.row_id: r for r in H.background_attributions(df, scorer(), NAMES, background).collect()}
    for key, own in rows.items():
        def value(known):
            mixed = back.copy()
            for i in known:
                mixed[:, i] = own[i]
            return f(pd.DataFrame(mixed, columns=NAMES)).mean()

        r = found[key]
        assert np.allclose(r.phis, shapley(value, 4)) and r.base == pytest.approx(value(set()))
        assert r.base + sum(r.phis) == pytest.approx(value({0, 1, 2, 3})) and r.features == NAMES


def test_a_linear_scorer_has_the_attributions_of_its_card(spark):
    df = table(spark, 80)
    card = {"a": 1.5, "b c": -2.0, "d": 0.25, "e": 0.5}
    background = df.filter("row_id % 3 = 0")
    wanted = {r.row_id: r for r in A.attributions(df, card, background, intercept=0.3).collect()}
    load = lambda: lambda frame: 0.3 + sum(frame[f] * c for f, c in card.items()).to_numpy()
    for most in (2048, 9):  # all sets, and drawn ones
        for r in H.background_attributions(df, load, list(card), background, most_sets=most).collect():
            assert r.base == pytest.approx(wanted[r.row_id].base) and np.allclose(r.phis, wanted[r.row_id].phis)


def test_drawn_sets_come_close_and_keep_the_sum(spark):
    k = 11
    rng = np.random.default_rng(3)
    names = [f"f{i}" for i in range(k)]
    df = spark.createDataFrame([(i, *map(int, x)) for i, x in enumerate(rng.integers(0, 2, (12, k)))], "row_id long, " + ", ".join(f"{n} int" for n in names))
    load = lambda: lambda frame: np.tanh(frame[names[0]] * frame[names[1]] + frame[names].sum(axis=1) / 5).to_numpy()
    exact, drawn = ({r.row_id: r for r in H.background_attributions(df, load, names, df, most_sets=m).collect()} for m in (2046, 400))
    for key, r in exact.items():
        assert sum(drawn[key].phis) == pytest.approx(sum(r.phis)) and np.abs(np.subtract(drawn[key].phis, r.phis)).max() < 0.03
    sets, weights = H.coalitions(k, 2046)
    assert len(sets) == 2**k - 2 and len({tuple(x) for x in sets}) == len(sets)
    assert len(H.coalitions(40, 500)[0]) <= 500


def test_background_edges(spark):
    df = table(spark, 10)
    one = H.background_attributions(df, lambda: lambda frame: frame["a"].to_numpy() * 2.0, ["a"], df.filter("row_id = 0")).collect()
    assert all(r.base + r.phis[0] == pytest.approx(2 * r["values"][0]) for r in one)
    assert H.background_attributions(df.limit(0), scorer(), NAMES, df).collect() == []
    with pytest.raises(ValueError):
        H.background_attributions(df, scorer(), NAMES, df, most_background=3)
    with pytest.raises(ValueError):
        H.background_attributions(df, scorer(), NAMES, df.limit(0))
    keys = df.withColumn("row_id", F.when(F.col("row_id") > 3, F.col("row_id"))).withColumn("base", F.lit("x"))
    assert H.background_attributions(keys, scorer(), NAMES, df).count() == 10


def tree_value(model, own, known):
    """A tree ensemble's value of a set: nodes of unknown features send a row both ways."""
    def walk(tree, at):
        n = tree[at]
        if n.feature is None:
            return n.value
        i = NAMES.index(n.feature)
        if i in known:
            return walk(tree, 2 * at if own[i] <= n.threshold else 2 * at + 1)
        return sum((tree[c].rows / n.rows if n.rows else 0.5) * walk(tree, c) for c in (2 * at, 2 * at + 1))

    trees = {}
    for n in model.nodes:
        trees.setdefault(n.tree, {})[n.node] = n
    return model.base + sum(walk(t, 1) for t in trees.values())


@pytest.mark.parametrize("symmetric", [False, True])
def test_tree_attributions_equal_brute_force(spark, symmetric):
    df = table(spark, 120)
    model = B.boost(df, NAMES, settings=B.Settings(trees=2, depth=3, rate=0.5, bins=8, symmetric=symmetric))
    margins = {r.row_id: r.logit for r in B.boosted_scores(df, model).collect()}
    rows = plain(df)
    for r in H.tree_attributions(df, model.nodes, NAMES, model.base).collect():
        own = rows[r.row_id]
        assert np.allclose(r.phis, shapley(lambda known: tree_value(model, own, known), 4))
        assert r.base + sum(r.phis) == pytest.approx(margins[r.row_id]) == pytest.approx(tree_value(model, own, {0, 1, 2, 3}))
    assert H.tree_attributions(df.limit(0), model.nodes, NAMES, model.base).collect() == []
    assert {(n.tree, n.node): n.rows for n in B.with_rows(df, model.nodes)} == {(n.tree, n.node): n.rows for n in model.nodes}


def plain_trees(x, y, edges, s):
    """Boosting row by row in numpy, with the same order of splits."""
    base = math.log(y.mean() / (1 - y.mean()))
    margin, out = np.full(len(y), base), []

    def quality(g, h):
        return max(0.0, abs(g) - s.l1) ** 2 / (h + s.l2)

    for tree in range(s.trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = np.round(p - y, 12), np.round(p * (1 - p), 12)

        def grow(node, rows, depth):
            best = (s.min_gain, None)
            if depth:
                for f in range(x.shape[1]):
                    for edge in edges[f]:
                        left = rows & (x[:, f] <= edge)
                        right = rows & ~left
                        if min(left.sum(), right.sum()) < s.min_rows:
                            continue
                        gain = round((quality(g[left].sum(), h[left].sum()) + quality(g[right].sum(), h[right].sum()) - quality(g[rows].sum(), h[rows].sum())) / 2, 9)
                        if gain > best[0]:
                            best = (gain, (f, edge, left, right))
            if best[1] is None:
                value = -s.rate * math.copysign(max(0.0, abs(g[rows].sum()) - s.l1), g[rows].sum()) / (h[rows].sum() + s.l2)
                out.append((tree, node, None, None, value, int(rows.sum())))
                margin[rows] += value
                return
            f, edge, left, right = best[1]
            out.append((tree, node, NAMES[f], edge, None, int(rows.sum())))
            grow(2 * node, left, depth - 1)
            grow(2 * node + 1, right, depth - 1)

        grow(1, np.ones(len(y), dtype=bool), s.depth)
    return base, sorted(out, key=lambda n: n[:2])


@pytest.mark.parametrize("settings", [
    B.Settings(trees=2, depth=3, rate=0.3, bins=200), B.Settings(trees=9, depth=2, rate=0.5, l1=0.7, l2=0.1, min_rows=15, bins=200)])
def test_boosting_equals_a_plain_version_in_any_partitioning(spark, settings):
    df = table(spark, 400)
    x = np.array([plain(df)[i] for i in range(400)])
    y = np.array([r.frd for r in df.orderBy("row_id").collect()], dtype=float)
    edges = B.bin_edges(df, NAMES, settings.bins)
    assert [e for e in edges] == [sorted(set(x[:, f]))[:-1] for f in range(4)]
    base, wanted = plain_trees(x, y, edges, settings)
    for parts in (1, 7):
        model = B.boost(df.repartition(parts), NAMES, settings=settings)
        found = [(n.tree, n.node, n.feature, n.threshold, n.value, n.rows) for n in model.nodes]
        assert model.base == pytest.approx(base) and [f[:4] + f[5:] for f in found] == [w[:4] + w[5:] for w in wanted]
        assert [f[4] for f in found if f[4] is not None] == pytest.approx([w[4] for w in wanted if w[4] is not None])


def test_boosting_ranks_held_out_rows_and_handles_edges(spark):
    df = table(spark, 3000, 9)
    train, test = df.filter("row_id % 4 <> 0"), df.filter("row_id % 4 = 0")
    model = B.boost(train, NAMES, settings=B.Settings(trees=5, depth=3, rate=0.4, min_rows=10, bins=16))
    auc = lambda m, rows: M.auc(B.boosted_scores(rows, m), label="frd").first()["auc"]
    stump = B.boost(train, NAMES, settings=B.Settings(trees=1, depth=1))
    assert auc(model, test) > max(0.7, auc(stump, test))
    shares = B.Settings(trees=4, depth=2, feature_share=0.5, row_share=0.6, min_rows=5)
    a, b = (B.boost(train.repartition(p), NAMES, settings=shares, key="row_id") for p in (2, 5))
    assert a.nodes == b.nodes and {n.rows for n in a.nodes if n.node == 1} != {train.count()}
    with pytest.raises(ValueError):
        B.boost(train, NAMES, settings=shares)
    for rows in (train.limit(0), train.filter("frd = 1")):
        with pytest.raises(ValueError):
            B.boost(rows, NAMES)
    lone = B.boost(train.select("frd", F.lit(1).alias("a"), F.lit(None).cast("int").alias("b c")), ["a", "b c"], settings=B.Settings(trees=1))
    assert [n.node for n in lone.nodes] == [1] and abs(lone.nodes[0].value) < 1e-9
    assert {n.feature for n in B.boost(train, NAMES, settings=B.Settings(trees=1, depth=2, symmetric=True)).nodes if n.node in (2, 3)} != set()


SPACE = {"x": U.Between(0.01, 100, log=True), "y": U.Between(0, 10, step=0.5), "kind": U.OneOf(("p", "q", "r"))}


def surface(p):
    return -abs(math.log10(p["x"]) - 1) - abs(p["y"] - 7) / 4 - (p["kind"] != "q")


def test_search_goes_on_where_it_stopped_and_is_read_back(spark, tmp_path):
    whole, table_whole = U.search(spark, surface, str(tmp_path / "whole"), SPACE, trials=22, per_round=4, startup=6)
    U.search(spark, surface, str(tmp_path / "parts"), SPACE, trials=12, per_round=4, startup=6)
    asked = []
    parts, table_parts = U.search(spark, lambda p: asked.append(p) or surface(p), str(tmp_path / "parts"), SPACE, trials=22, per_round=4, startup=6)
    assert parts == whole and len(asked) == 10
    assert sorted(table_parts.collect()) == sorted(table_whole.collect()) and table_whole.count() == 22
    E.write_trials(table_whole, str(tmp_path / "csv"))
    assert sorted(E.read_events(spark, str(tmp_path / "csv"), table_whole.schema).collect()) == sorted(table_whole.collect())
    for r in table_whole.collect():
        assert 0.01 <= float(r.x) <= 100 and float(r.y) * 2 == int(float(r.y) * 2) and 0 <= float(r.y) <= 10 and r.kind in "pqr"
    with pytest.raises(ValueError):
        U.search(spark, lambda p: float("nan"), str(tmp_path / "bad"), SPACE, trials=2)


def test_proposals_beat_random_draws():
    def best(seed, startup, n=40):
        trials = []
        for number in range(n):
            p = U.propose(SPACE, trials, number, seed, startup)
            trials.append((number, p, surface(p)))
        return max(t[2] for t in trials)

    model, chance = ([best(seed, startup) for seed in range(25)] for startup in (10, 1000))
    assert np.mean(model) > np.mean(chance) + 0.1 and np.median(model) > np.median(chance)


def test_the_space_fits_the_trees(spark):
    rng = np.random.default_rng(1)
    p = {name: kind.draw(rng) for name, kind in U.SPACE.items()}
    s = B.searched_settings(p, trees=2)
    assert s.trees == 2 and 0.03 <= s.rate <= 0.2 and s.depth in range(3, 8) and s.min_rows in (200, 600, 1000)
    assert len(B.boost(table(spark, 500), NAMES, settings=s, key="row_id").nodes) >= 2


def test_sums_of_halves_are_exact(spark):
    """Sums of whole units, below zero and across the halves, as the level sums make them."""
    numbers = [-1.0, -1e-12, -0.123456789012, 0.0, 1e-12, 0.25, 0.999999999999, 1.0] * 500
    df = spark.createDataFrame([(x,) for x in numbers], "x double").repartition(7).select(*B.halves(F.col("x"), "x"))
    assert all(t == "bigint" for _, t in df.dtypes)
    units = sum(round(x * 1e12) for x in numbers)
    assert int(df.agg(B.exact_sum("x")).first()[0].scaleb(12)) == units
