import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from flagstone.llm.pieces import Memory, decode_pieces, encode_pieces, piece_digests, pieces_of
from flagstone.llm.queries import QUERIES, tokenizer_file

SF = "/root/testdata/sf0.001"
FILE = tokenizer_file("piece_bpe_32k.model")
PARTS = ["a", "b", "t", "h", "e", "in", "the ", " ", "  ", "   ", "▁", "\n", "\t", ".", ",", "'s", "(", "1", "23", "é", "日", "本",
         "👍", "\x00", "\x1c", "ing", "tion", "://", "==", "--", "__", "<0x41>", "<s>", "</s>", "<unk>", " " * 17, "ß", "i̇", "A"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=FILE)


def ids(text):
    return np.frombuffer(pieces_of(FILE).encode(text), "<i4").tolist()


def test_random_texts_have_the_ids_and_the_text_of_the_library(library):
    rng = random.Random(3)
    for i in range(20000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(14)))
        if i % 4 == 0:
            text = "".join(chr(rng.choice([rng.randrange(1, 128), rng.randrange(1, 0x3000), rng.randrange(0x10000, 0x1ffff)])) for _ in range(rng.randrange(12)))
        wanted = library.encode(text)
        assert ids(text) == wanted, text
        assert pieces_of(FILE).decode(wanted) == library.decode(wanted), text


def test_long_texts_are_encoded_in_linear_time(library):
    text = "ab" * 200_000 + " " * 100_000 + "日本" * 50_000
    assert ids(text) == library.encode(text)


def test_query_equals_the_library(spark, library):
    found = {r.doc_id: r for r in QUERIES["op13_prefix_table_pieces"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(found) == len(docs)
    for r in docs:
        wanted = library.encode(r.text or "", add_eos=True)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, wanted)), library.decode(wanted))]
        assert (found[r.doc_id].n_tokens, [found[r.doc_id].ids_sha256, found[r.doc_id].decoded_sha256]) == (len(wanted), sha)


def test_nulls_repeats_and_clashing_names(spark, library):
    rows = [(1, None, 5), (1, "", 6), (None, "twice", 7), (None, "twice", 7), (2, "x " * 5000, 8)]
    docs = spark.createDataFrame(rows, "key long, body string, ids int")
    out = decode_pieces(encode_pieces(docs, FILE, "key", "body"), FILE).collect()
    assert sorted((str(r.key), r.ids, r.decoded) for r in out) == sorted(
        (str(k), library.encode(t or "", add_eos=True), t or "") for k, t, _ in rows)
    assert piece_digests(docs.limit(0), FILE, "key", "body").collect() == []
    strange = spark.createDataFrame([([],), (None,), ([3, 200 + 3, 2],)], "ids array<int>")
    assert [r.decoded for r in decode_pieces(strange, FILE).collect()] == ["", None, library.decode([3, 203, 2])]


def test_memory_forgets_and_asks_again():
    asked = []
    memory = Memory(lambda keys: asked.append(list(keys)) or [k * 2 for k in keys], size=4)
    for keys in ([1, 2, 1], [3, 4], [5, 1], [6, 7, 8, 9, 10, 11], [1, 5]):
        assert memory(keys) == [k * 2 for k in keys]
    assert len(asked) >= 4
