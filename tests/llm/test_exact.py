import hashlib

import numpy as np

from flagstone.llm.exact_dedup import build_filter, exact_groups, merge_filters, read_filter, repeated_fingerprints


def test_filters_merge_without_loss():
    rng = np.random.default_rng(2)
    low = 50
    parts = [np.unique(rng.integers(0, 1 << low, n).astype(np.uint64), return_counts=True) for n in (1, 7, 5000)]
    shared = parts[2][0][::3]
    parts.append((shared, np.full(len(shared), 300)))
    filters = [build_filter(v, c, low) for v, c in parts]
    for (v, c), f in zip(parts, filters):
        got = read_filter(f)
        assert (got[0] == v).all() and (got[1] == c).all()
    values, counts = merge_filters(filters)
    wanted = {}
    for v, c in parts:
        for x, n in zip(v.tolist(), c.tolist()):
            wanted[x] = wanted.get(x, 0) + n
    assert dict(zip(values.tolist(), counts.tolist())) == wanted and (np.diff(values.astype(np.int64)) > 0).all()


def test_repeated_fingerprints(spark):
    rows = [(i,) for i in range(-50, 50)] + [(i,) for i in range(-10, 10)] + [(2**63 - 1,), (-(2**63),), (-(2**63),)]
    got = repeated_fingerprints(spark.createDataFrame(rows, "fp long").repartition(5))
    assert sorted(r.fp for r in got.collect()) == [-(2**63), *range(-10, 10)]


def test_groups_ties_nulls_and_clashing_columns(spark):
    rows = [
        (1, "a b", 1, 1), (2, "ab", 1, 1), (3, " a\tb\n", 1, 1), (4, "a b", 1, 1), (5, None, 1, 1), (6, "", 1, 1), (7, " \x0b\x0c\r", 1, 1),
        (None, "zz", 1, 1), (9, "zz", 1, 1), (9, "zz", 1, 1), (None, "yy", 1, 1), (8, "x" * 100_000, 1, 1), (10, " " + "x" * 100_000, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, group_size int, norm int")
    got = sorted(map(tuple, exact_groups(df).collect()), key=str)

    def row(i, keep, size, text):
        return i, keep, size, i == keep, hashlib.sha256(text.encode()).hexdigest()

    assert got == sorted([
        row(1, 3, 3, "ab"), row(2, 3, 3, "ab"), row(3, 3, 3, "ab"), row(4, 4, 1, "a b"), row(5, 7, 3, ""), row(6, 7, 3, ""), row(7, 7, 3, ""),
        row(None, 9, 3, "zz"), row(9, 9, 3, "zz"), row(9, 9, 3, "zz"), row(None, None, 1, "yy"), row(8, 10, 2, "x" * 100_000), row(10, 10, 2, "x" * 100_000)], key=str)
    assert exact_groups(df.limit(0)).collect() == []
