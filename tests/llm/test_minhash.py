import random
import re

import numpy as np
import pytest

from flagstone.llm.components import Forest, components
from flagstone.llm.minhash import Sketcher, near_duplicates
from flagstone.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows, width, percent):
    """Components of `(doc_id, text)` by comparing all pairs."""
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        k = min(width, len(w))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def found(df):
    rows = df.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def test_sketch_coordinates_agree_with_the_probability_of_the_similarity():
    rng = np.random.default_rng(1)
    sketch, agree = Sketcher(64), []
    for _ in range(60):
        x = rng.integers(0, 2**63, 120).astype(np.uint64)
        agree.append(np.mean(sketch(np.unique(x[:100])) == sketch(np.unique(x[20:]))))
    assert abs(np.mean(agree) - 80 / 120) < 0.03
    assert (sketch(np.array([7], dtype=np.uint64)) == sketch(np.array([7], dtype=np.uint64))).all()


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert found(QUERIES["op6_minhash_near_dedup"](spark, SF)) == brute(rows, 3, 85)


def test_groups_of_near_copies_equal_brute_force(spark):
    rng, rows = random.Random(5), []
    base = [[rng.choice("abcdefgh") + str(rng.randrange(400)) for _ in range(60)] for _ in range(6)]
    passage = [f"p{i}" for i in range(45)]
    for i in range(150):
        words = list(base[i % 6])
        for _ in range(rng.randrange(5)):
            words[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(words)))
    # Documents that share a passage but are no copies meet in buckets and must stay apart.
    rows += [(200 + i, " ".join(passage + [f"own{i}_{j}" for j in range(rng.randrange(5, 20))])) for i in range(60)]
    rows += [(300, None), (301, ""), (302, "Two words"), (303, "two  WORDS"), (304, " \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (80, 60):
        got = near_duplicates(df, width=5, percent=percent, rows=5 if percent == 80 else 2)
        assert found(got) == brute(rows, 5, percent)


@pytest.mark.parametrize("rounds", [0, 3])
def test_all_pairs_in_blocks_when_hubs_do_not_settle_a_bucket(spark, rounds):
    rng, rows = random.Random(8), []
    common = [f"c{i}" for i in range(40)]
    for i in range(120):  # 40 little groups that share a long passage
        own = [f"g{i % 40}_{j}" for j in range(25)]
        own[rng.randrange(25)] = f"z{i}"
        rows.append((i, " ".join(common + own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(near_duplicates(df, width=1, percent=90, bands=24, rows=2, rounds=rounds, block_bytes=8 * 65 * 8)) == brute(rows, 1, 90)


def test_a_set_is_made_once_for_rows_that_repeat(spark):
    from flagstone.llm.minhash import _sets, _sketched

    rows = [(1, "one two three four")] * 40 + [(None, "five six seven eight")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    wanted = _sketched(docs, 2, 4, 2).select("node", "doc_id").distinct()
    assert _sets(docs, wanted, 2).count() == 2


def test_nulls_repeats_clashing_columns_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, 5, 0), (1, text, 6, 0), (None, text, 7, 0), (None, None, 8, 0), (4, "a b", 9, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node int, component_id int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 26, 1, True), (1, 26, 1, True), (None, 26, 1, False), (None, 0, None, True), (4, 1, 4, True)], key=str)
    assert near_duplicates(df.limit(0)).collect() == []


def test_components_of_long_chains(spark):
    order = list(range(300))
    random.Random(2).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(299)] + [(1000, 1001), (1001, 1002), (7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = sorted((r.node, r.root) for r in components(df).collect())
    assert got == [*((i, 0) for i in range(1, 300)), (1001, 1000), (1002, 1000)]


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    rng, held = random.Random(seed), Forest()
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)]
    for a, b in edges:
        held.join(a, b)
    nodes = {n for e in edges for n in e if held.root(n) != n}
    got = sorted((r.node, r.root) for r in components(spark.createDataFrame(edges, "a int, b int").repartition(9)).collect())
    assert got == sorted((n, held.root(n)) for n in nodes)
