import math

import numpy as np
import pytest

from flagstone.llm import pivots
from flagstone.llm.pivots import near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.98):
    """Links and components by comparing all pairs."""
    root = list(range(len(rows)))
    links = [0] * len(rows)
    good = [v is not None and len(v) > 0 and l is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, l in rows]

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    as_float = [np.array(v, dtype=np.float32).astype(float) if g else None for (_, v, _), g in zip(rows, good)]
    for x in range(len(rows)):
        for y in range(x + 1, len(rows)):
            if good[x] and good[y] and rows[x][2] == rows[y][2] and len(as_float[x]) == len(as_float[y]):
                a, b = as_float[x], as_float[y]
                if a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= least:
                    links[x] += 1
                    links[y] += 1
                    root[max(top(x), top(y))] = min(top(x), top(y))
    ids = [i for i, *_ in rows]
    least_id = {}
    for x in range(len(rows)):
        t = top(x)
        known = [i for i in (least_id.get(t), ids[x]) if i is not None]
        least_id[t] = min(known) if known else None
    return sorted(((ids[x], links[x], least_id[top(x)]) for x in range(len(rows))), key=str)


def found(df):
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in df.collect()), key=str)


def some(seed, n=300, width=64):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(60, width))
    rows = []
    for i in range(n):
        v = base[rng.integers(60)] + rng.normal(size=width) * rng.choice([0, 0.01, 0.1, 0.17, 0.5])
        rows.append((i, [float(x) for x in v * rng.choice([0.5, 1, 30])], int(rng.integers(3))))
    return rows


@pytest.mark.parametrize("block", [16, 1024])
def test_links_and_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(pivots, "BLOCK", block)
    rows = some(3) + [(1000 + i, r[1], r[2]) for i, r in enumerate(some(3)[:50])]
    assert found(near_vectors(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_recall_on_pairs_at_the_bound(spark):
    rng, rows = np.random.default_rng(9), []
    for i in range(600):
        x = rng.normal(size=64)
        x /= np.linalg.norm(x)
        z = rng.normal(size=64)
        z -= (z @ x) * x
        y = 0.9801 * x + math.sqrt(1 - 0.9801**2) * z / np.linalg.norm(z)
        rows += [(2 * i, x.tolist(), 1), (2 * i + 1, y.tolist(), 1)]
    got = near_vectors(spark.createDataFrame(rows, SCHEMA)).filter("n_links > 0").count()
    assert got >= 0.98 * len(rows)


def test_odd_vectors_nulls_and_empty_tables(spark):
    v = [1.0, 2.0, 0.0]
    rows = [(1, v, 1), (2, v, 1), (2, v, 1), (None, v, 1), (5, v, None), (6, None, 1), (7, [0.0] * 3, 1), (8, [1.0, None, 0.0], 1),
            (9, [1.0, float("nan"), 0.0], 1), (10, [float("inf"), 1.0, 1.0], 1), (11, [], 1), (12, [1.0, 2.0], 1), (13, [1e-30, 2e-30, 0.0], 1),
            (14, v, 2), (None, None, 3)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as node", "2 as n_links")
    assert found(near_vectors(df)) == brute(rows)
    assert near_vectors(df.limit(0)).collect() == []


def test_one_long_vector_widens_no_other(spark, monkeypatch):
    """Vectors of several lengths beside one of 50 000 numbers: the links are those of all pairs."""
    monkeypatch.setattr(pivots, "STEP_NUMBERS", 1000)
    rng = np.random.default_rng(4)
    long = [float(x) for x in rng.normal(size=50_000)]
    rows = some(5, 80) + [(2000 + i, r[1][:40], r[2]) for i, r in enumerate(some(5, 80))] + [(5000, long, 1), (5001, [2 * x for x in long], 1), (5002, long[:64], 1)]
    assert found(near_vectors(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
