import os
import random
import subprocess
import sys
import zlib

import numpy as np
import pytest

from flagstone.llm import packing
from flagstone.llm.packing import Encoder, encode_texts, pack, plan_sequences, sequences, tokenize
from flagstone.llm.queries import QUERIES, tokenizer_file

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def check_places(rows, capacity):
    """Sequences have no overlap, no hole and nothing beyond the capacity; returns their number."""
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_query_equals_the_tokenizer_and_fills_sequences(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    rows = QUERIES["op4_best_fit_packing"](spark, SF).collect()
    wanted = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        for p, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s:s + 2048]
            wanted[r.doc_id, p] = (s, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == wanted
    used = check_places(rows, 2048)
    assert used <= best_fit_decreasing([r.length for r in rows], 2048)


def test_words_apart_have_the_ids_of_the_whole_text():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    texts = ["", " \t\x0b\x0c\r\n", "It's  I'll 12 3a!!! <|endoftext|>x<|startoftext|>", "É́ ́e a b c ΟΔΟΣ ΣΑΣ", "日本 語123 ﬁ İx \x1c y\x85z 👍🏽 '''s"]
    got = encode_texts(tokenizer_file(), [x.encode() for x in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_random_words_have_the_ids_of_the_tokenizer():
    from tokenizers import Tokenizer

    t, rng = Tokenizer.from_file(tokenizer_file()), random.Random(11)
    parts = ["İ", "i", "B", "LG", "é", "e\u0301", "\u0301", "\u0958", "ﬁ", "Σ", "ß", "日", "ǅ", "a", "don", "'s", "1", "\u05e9\u05bc", "\ufb2a", "ª", "ʰ", "각"]
    tails = ["", "", ";", ".", "!!", ")", ",\"", "%", "]}"]
    texts = ["İ;", "BİLGİ.", "iİ)"]
    for i in range(100_000):
        if i % 5 == 0:
            word = "".join(chr(rng.choice([rng.randrange(0x21, 0x250), rng.randrange(0x300, 0x2000), rng.randrange(0x3040, 0xd7ff)])) for _ in range(rng.randrange(1, 5)))
        else:
            word = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 5)))
        texts.append(word + rng.choice(tails))
    got = encode_texts(tokenizer_file(), [x.encode() for x in texts])
    wanted = t.encode_batch(texts, add_special_tokens=False)
    assert [x for x, g, w in zip(texts, got, wanted) if np.frombuffer(g, "<u4").tolist() != w.ids] == []


def test_a_known_word_with_other_marks_costs_no_python_step(monkeypatch):
    calls, looked = 0, packing.all_letters

    def counted(body):
        nonlocal calls
        calls += 1
        return looked(body)

    monkeypatch.setattr(packing, "all_letters", counted)
    encoder = Encoder(tokenizer_file())
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)]
    encoder([" ".join(words).encode()])
    text = " ".join(w + mark for w in words for mark in (",", ".", "!?", ")", ";", "\"")).encode()
    got, = encoder([text])
    assert np.frombuffer(got, "<u4").tolist() == encoder.tokenizer.encode(text.decode(), add_special_tokens=False).ids
    assert calls <= 500


def test_forgotten_words_are_encoded_again(monkeypatch):
    monkeypatch.setattr(packing, "KNOWN_WORDS", 20)
    rng, encoder = random.Random(5), Encoder(tokenizer_file())
    words = ["a", "b,", "it's", "don't!", "1,2", "é,", "où", "Σ;", "\x1c", "...", "x" * 300 + ",", "<|endoftext|>,"] + [f"n{chr(97 + i)}." for i in range(26)]
    for _ in range(60):
        texts = [rng.choice(["", " ", "\n"]) + rng.choice([" ", "\t\r", "\x0b\x0c"]).join(rng.choices(words, k=rng.randrange(12))) for _ in range(rng.randrange(6))]
        got = encoder([t.encode() for t in texts])
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(encoder.known) == len(encoder.sizes) <= 20
    bad, = encoder([b"\xff, a\xff"])  # bytes that are no UTF-8 count as U+FFFD
    assert np.frombuffer(bad, "<u4").tolist() == encoder.tokenizer.encode("\ufffd, a\ufffd", add_special_tokens=False).ids


HELD = """
import random, re, sys
import pyarrow as pa
from pyspark.sql import types as T
from flagstone.llm import packing
from flagstone.llm.queries import tokenizer_file

def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

class Docs:  # runs a mapInArrow where it stands
    schema = T.StructType([T.StructField("doc_id", T.LongType())])
    def select(self, *columns):
        return self
    def mapInArrow(self, run, schema):
        return run

def batches():
    rng = random.Random(7)
    for k in range(2):
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(100_000)]
        texts = [" ".join(rng.choices(words, k=300)) for _ in range(6_000)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])

packing.F.col = lambda name: type("Column", (), {"alias": lambda self, name: self})()  # columns need a session
data = list(batches())
packing.encode_texts(tokenizer_file(), [b"a"])
before = held()
rows = sum(b.num_rows for b in packing.tokenize(Docs(), tokenizer_file())(iter(data)))
print(rows, round(held() - before))
"""


def test_a_worker_gives_memory_back_after_its_texts():
    got = subprocess.run([sys.executable, "-c", HELD], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(got[0]) == 12_000
    assert int(got[1]) < 50  # MB


@pytest.mark.parametrize("seed", range(6))
def test_plans_place_each_piece_once_and_pack_like_best_fit_decreasing(seed):
    rng, capacity = random.Random(seed), 100
    lengths = [min(capacity, max(1, int(rng.expovariate(1 / rng.choice([8, 30, 60]))))) for _ in range(1500)]
    counts = {n: lengths.count(n) for n in set(lengths)}
    used, ranks = {}, {n: [] for n in counts}
    for length, first, n, sequence, offset, per in plan_sequences(counts, capacity):
        ranks[length] += range(first, first + n)
        for i in range(n):
            used.setdefault(sequence + i // per, []).append((offset + i % per * length, length))
    assert all(sorted(ranks[n]) == list(range(counts[n])) for n in counts)
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(used) == best_fit_decreasing(lengths, capacity)


def test_sequences_hold_the_ids_of_their_pieces(spark):
    docs = spark.createDataFrame(
        [(1, "one two three " * 9, 1), (2, None, 2), (None, "", 3), (2, "same key", 4), (2, "same key", 4)],
        "doc_id long, text string, length int")
    pieces = tokenize(docs, tokenizer_file(), 16)
    rows = pack(pieces, 16).collect()
    check_places(rows, 16)
    assert len(rows) == 2 + 1 + 1 + 2
    whole = {r.sequence_id: bytes(r.ids) for r in sequences(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long")).collect()}
    for r in rows:
        assert whole[r.sequence_id][4 * r.offset:4 * (r.offset + r.length)] == bytes(r.ids)
    assert pack(tokenize(docs.limit(0), tokenizer_file(), 16), 16).collect() == []
    with pytest.raises(ValueError):
        pack(pieces, 8)
