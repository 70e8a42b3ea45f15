import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from flagstone.llm.alignment import Csr, Words, alignments, packed, row_products, token_links, unpacked
from flagstone.llm.queries import QUERIES, tokenizer_file

SF = "/root/testdata/sf0.001"
A, B = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    words = Tokenizer.from_file(A)
    words.encode_special_tokens = True
    byte_of = {}
    spare = 256
    for b in range(256):  # the published map of bytes to characters
        if 33 <= b < 127 or 161 <= b < 173 or 174 <= b:
            byte_of[chr(b)] = b
        else:
            byte_of[chr(spare)] = b
            spare += 1
    return words, sentencepiece.SentencePieceProcessor(model_file=B), byte_of


def tokens(libraries, text):
    """`(id, begin, end)` of both sides, none where the bytes differ."""
    words, pieces, byte_of = libraries
    out = []
    if not text:
        return [], []
    a = [(i, bytes(byte_of[c] for c in words.id_to_token(i))) for i in words.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(pieces.id_to_piece(i)[1:-1], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode())
         for i in pieces.encode(text)]
    for side in (a, b):
        if b"".join(x for _, x in side) != (" " + text).encode():
            return [], []
        at, spans = 0, []
        for i, x in side:
            spans.append((i, at, at + len(x)))
            at += len(x)
        out.append(spans)
    return out


def brute(libraries, rows):
    """The contract, from the definition: all pairs of tokens of a text."""
    found, count = [], Counter()
    for key, text in rows:
        a, b = tokens(libraries, text)
        links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, low = [], 0
        for end in ends:
            groups.append(",".join(str(i) for i, s, e in a if low < e <= end) + "|" + ",".join(str(i) for i, s, e in b if low < e <= end))
            low = end
        count.update(set(links))
        found.append((key, a, b, groups, links))
    top = {}
    for (i, _), n in count.items():
        top[i] = max(n, top.get(i, 0))
    return Counter(
        (key, len(a), len(b), len(groups), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "")
        for key, a, b, groups, links in found)


def test_products_equal_dense_ones():
    rng = np.random.default_rng(1)
    for held in (1, 7, 1 << 20):
        x, y = (rng.random((6, 9)) < 0.3).astype(int), (rng.random((9, 5)) < 0.4).astype(int)

        def csr(m):
            return Csr(np.concatenate([[0], m.sum(1).cumsum()]), np.nonzero(m)[1], m.shape[1])

        out = np.zeros((6, 5), dtype=int)
        for r, c, v in row_products(csr(x), csr(y), held):
            out[r, c] = v
        assert (out == x @ y).all()
        t = csr(x).transposed()
        assert (np.array([np.isin(np.arange(6), t.columns[a:b]) for a, b in zip(t.starts, t.starts[1:])]) == x.T.astype(bool)).all()


def test_word_ids_are_those_of_the_file(libraries):
    rng, words, byte_of = random.Random(5), Words(A), libraries[2]
    parts = [" ", "  ", "\n", "\t", "a", "the", "'s", "'", "12", "é", "日本", "\x1c", "\x85", "\xa0", "　", "!", "...", "<|endoftext|>", "👍", "İ", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(5000)] + ["x" * 30000]
    for token in libraries[0].get_vocab():  # what the vocabulary itself spells
        if all(c in byte_of for c in token):
            texts.append(bytes(byte_of[c] for c in token).decode("utf-8", "replace"))
    wanted = libraries[0].encode_batch([" " + t for t in texts], add_special_tokens=False)
    assert [ids.tolist() for ids in words.encode(texts)] == [e.ids for e in wanted]


def test_packing_round_trip():
    x, y = np.array([0, 5, 2**32 - 1]), np.array([1, 2, 3])
    assert (unpacked(packed([x, y]), 2) == [x, y]).all()
    assert unpacked(packed([x[:0], y[:0]]), 2).shape == (2, 0)


@pytest.mark.parametrize("block", [1, 300, 1 << 24])
def test_alignments_equal_brute_force(spark, libraries, block):
    texts = ["", None, "one two three", "ﬁne  words\n\n here", "with ▁ mark", "日本語 text é", "<|endoftext|> <s>", "   ", "\x00x", "one two three", "don't 12,345.67"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "same key"), (3, "same key"), (None, "no key " * 30)]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, n_a int, block string").repartition(3)
    found = alignments(docs, A, B, block_bytes=block)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, found.collect())) == brute(libraries, rows)


def test_query_equals_brute_force(spark, libraries):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = Counter(map(tuple, QUERIES["op12_token_alignment"](spark, SF).collect()))
    short = [r for r in rows if len(r[1] or "") < 2000]  # the definition compares all pairs of tokens
    assert sum(found.values()) == len(rows)
    # Counts are of the whole corpus: links by position, then one count for all.
    count, per = Counter(), {}
    for key, text in rows:
        a, b = tokens(libraries, text)
        links, j = [], 0
        for i, s, e in a:
            while j and b[j - 1][2] > s:
                j -= 1
            while j < len(b) and b[j][1] < e:
                if b[j][2] > s:
                    links.append((i, b[j][0]))
                j += 1
        per[key] = (len(a), len(b), links)
        count.update(set(links))
    top = {}
    for (i, _), n in count.items():
        top[i] = max(n, top.get(i, 0))
    for r in found:
        n_a, n_b, links = per[r[0]]
        assert r[1:3] + r[4:7] == (n_a, n_b, len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links))
    digests = {x[0]: (x[3], x[7]) for x in brute(libraries, short[:40])}
    assert all(digests[r[0]] == (r[3], r[7]) for r in found if r[0] in digests)


def test_links_of_bytes_and_groups(spark, libraries):
    text = "unbelievable don't 日本"
    docs = spark.createDataFrame([(1, text), (2, None), (3, text)], "doc_id long, text string")
    a, b = tokens(libraries, text)
    wanted = {(x, y, i[0], j[0], min(i[2], j[2]) - max(i[1], j[1])) for x, i in enumerate(a) for y, j in enumerate(b) if i[1] < j[2] and j[1] < i[2]}
    found = token_links(docs, A, B).collect()
    for key in (1, 3):
        assert {tuple(r)[1:] for r in found if r.doc_id == key} == wanted
    assert {r.doc_id for r in found} == {1, 3}
    ends = sorted({e for *_, e in a} & {e for *_, e in b})
    group = lambda end: sum(e < end for e in ends)
    same = {(x, y) for x, i in enumerate(a) for y, j in enumerate(b) if group(i[2]) == group(j[2])}
    assert {(r.a_place, r.b_place) for r in token_links(docs, A, B, "groups").collect() if r.doc_id == 1} == same
    assert alignments(docs.limit(0), A, B).collect() == [] and token_links(docs.limit(0), A, B).collect() == []
