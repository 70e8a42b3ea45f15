import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from flagstone.llm import lm
from flagstone.llm.lm import END, ORDER, held_out_by_key, score_documents
from flagstone.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def trie(texts):
    nodes = defaultdict(Counter)
    for text in texts:
        symbols = [*text, END]
        padded = bytes(ORDER) + text
        for i, s in enumerate(symbols):
            for k in range(ORDER + 1):
                nodes[padded[i + ORDER - k:i + ORDER]][s] += 1
    return nodes


def probability(nodes, context, symbol):
    p, gone = 1.0, set()
    for k in range(ORDER, -1, -1):
        node = nodes.get(context[ORDER - k:])
        if not node:
            continue
        left = {s: n for s, n in node.items() if s not in gone}
        whole = 2 * sum(left.values())
        if symbol in left:
            return p * (2 * left[symbol] - 1) / whole
        if left:
            p *= len(left) / whole
        gone |= set(node)
    return p / (257 - len(gone))


def brute(nodes, text):
    padded = bytes(ORDER) + text
    return sum(math.log10(probability(nodes, padded[i:i + ORDER], s)) for i, s in enumerate([*text, END]))


def test_probabilities_sum_to_one():
    nodes = trie([b"abracadabra", b"abba", b""])
    for context in (b"\0\0\0\0a", b"cadab", b"zzzzz", bytes(5)):
        assert math.isclose(sum(probability(nodes, context, s) for s in range(257)), 1)


@pytest.mark.parametrize("block_bytes", [40, 10**6])
def test_scores_equal_a_trie_walked_byte_by_byte(spark, block_bytes):
    texts = ["the cat sat on the mat", "The hat", "", None, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "thé ñandú\n\n the", "zebra the", "\0\0 x"] * 3
    rows = [(i, t, i % 5 == 1, 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held boolean, score int").repartition(3)
    nodes = trie([(t or "").encode() for _, t, h, _ in rows if not h])
    got = {r.doc_id: r for r in score_documents(df, F.col("held"), block_bytes=block_bytes, step=16, salt_blocks=2).collect()}
    assert len(got) == len(rows)
    for i, t, h, _ in rows:
        data = (t or "").encode()
        assert got[i].held_out == h and got[i].n_bytes == len(data)
        assert math.isclose(got[i].score, brute(nodes, data), rel_tol=1e-5)


def test_many_shards_of_a_suffix_and_rounds_of_merging_change_no_score(spark, monkeypatch):
    """Third bytes deal a hot suffix to several shards, salts are merged two by two, and models are sent to several salts."""
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("ab "), 40)) + "the end" * (i % 3) for i in range(60)]
    df = spark.createDataFrame([(i, t, i % 7 == 0) for i, t in enumerate(texts)], "doc_id long, text string, held boolean").repartition(5)
    wanted = {r.doc_id: r.score for r in score_documents(df, F.col("held")).collect()}
    nodes = trie([t.encode() for i, t in enumerate(texts) if i % 7])
    monkeypatch.setattr(lm, "SUFFIX_GROUPS", 3)
    monkeypatch.setattr(lm, "SHARD_BYTES", 100)
    monkeypatch.setattr(lm, "FAN_IN", 2)
    got = {r.doc_id: r.score for r in score_documents(df, F.col("held"), block_bytes=120, step=50, salt_blocks=1).collect()}
    for i, t in enumerate(texts):
        assert math.isclose(got[i], wanted[i], rel_tol=1e-5) and math.isclose(got[i], brute(nodes, t.encode()), rel_tol=1e-5)


def test_shards_grow_with_the_text_and_split_suffixes():
    assert lm.shards_for(16) == (16, 1) and lm.shards_for(640) == (64, 10)
    assert math.prod(lm.shards_for(10**9)) == lm.MOST_SHARDS
    keys = np.unique(np.random.default_rng(1).integers(0, 2**49, 5000).astype(np.uint64))
    own = lm.shard_of(keys, 64, 10)
    pairs = lm.hashed(lm.at_order(keys, 2) >> np.uint64(lm.SYMBOL_BITS), 64)
    assert (own // 10 == pairs).all() and len(np.unique(own)) > 600
    assert sorted(i for _, mine in lm.parted(own) for i in mine) == list(range(len(keys)))


def test_query_base_and_held_out_texts(spark):
    rows = QUERIES["op1_ppm_scoring"](spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    split = {i: re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\0end"] for i, t in docs.items()}
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    counts = Counter(w for i, ws in split.items() if not out[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    assert {r.doc_id for r in rows} == set(docs)
    for r in rows:
        assert (r.held_out, r.train_tokens, r.n_tokens) == (out[r.doc_id], n, len(split[r.doc_id]))
        assert r.n_known == sum(counts[w] > 0 for w in split[r.doc_id])
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in split[r.doc_id])
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    held = [r for r in rows if r.held_out]
    # Bits a byte on texts that the model has not seen.
    assert -sum(r.score for r in held) * math.log2(10) / sum(r.n_bytes for r in held) < 3


def test_held_out_texts_are_likelier_than_under_the_base(spark):
    rows = QUERIES["op1_ppm_scoring"](spark, "/root/testdata/sf0.1").filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_nulls_no_training_texts_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "ab"), (3, None), (3, None)], "doc_id long, text string")
    got = score_documents(df, F.lit(True)).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 2] and {r.train_tokens for r in got} == {0}
    for r in got:
        assert math.isclose(r.score, -(r.n_bytes + 1) * math.log10(257), rel_tol=1e-6) and r.base_score == 0
    assert score_documents(df.limit(0), held_out_by_key()).collect() == []
    assert {r.held_out for r in score_documents(df.filter("doc_id is null"), held_out_by_key()).collect()} == {True}


def test_sorted_numbers_survive_packing():
    x = np.unique(np.random.default_rng(1).integers(0, 2**49, 5000).astype(np.uint64))
    assert (lm.sorted_from(lm._split(lm.pack_sorted(x))[0]) == x).all()
