"""Bulk-synchronous best-fit packing of tokenized documents into sequences of bounded length.

A length is a whole number of at most `capacity`, so pieces of one length are interchangeable and so are sequences
with the same free room: both are held as runs, intervals of ranks and of sequence numbers. Spark sorts the pieces by
length and ranks them within it; the sweeps match whole runs, which keeps their state bounded by the capacity,
whatever the number of documents.

A superstep takes all pieces of one length, from long to short, and sweeps over the gaps from small to large. Pieces go to
the smallest gaps that are large enough (their successors), as many to each as fit; the rank of a piece says which
gap of a run it gets, so no two pieces want one place. Then the gaps are updated, and the next superstep begins. Pieces
that fit nowhere open new sequences. The result is that of best-fit decreasing, piece by piece.
"""

from __future__ import annotations

import json
import os
import unicodedata
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from flagstone.llm.common import released, stored, texts
from flagstone.plans.ordered import dense_positions

# Parts of words whose ids a worker remembers, and their bytes; beyond either, those not seen for long are forgotten.
KNOWN_WORDS, KNOWN_BYTES = 250_000, 16_000_000
# Parts longer than this many bytes are forgotten first.
LONG_WORD = 64
# Bytes of text that are encoded at a time (or one text, if that is longer). A worker's memory goes with it: 285 MB at 4 MB, 225 at 2.
STEP_BYTES = 2_000_000
# ASCII marks that are tokens of their own behind a word.
TAIL = b",.;:!?*%#&$|)]}\""
_ENCODERS: dict[str, "Encoder"] = {}


def all_letters(body: bytes) -> bool:
    """Whether a word is letters only, also as the tokenizer sees it (composed, in lower case): marks behind it are then
    tokens of their own."""
    if body.isascii():
        return body.isalpha()
    text = body.decode("utf-8", "replace")
    return text.isalpha() and unicodedata.normalize("NFC", text).lower().isalpha()


def letters_only(words: pa.Array) -> np.ndarray:
    """`all_letters` of each of some distinct words."""
    found = pc.ascii_is_alpha(words).to_numpy(zero_copy_only=False).copy()
    other = np.flatnonzero(~pc.string_is_ascii(words).to_numpy(zero_copy_only=False))
    found[other] = [all_letters(w) for w in words.take(pa.array(other)).view(pa.large_binary()).to_pylist()]
    return found


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places `start`, `start + 1`, ... of each of some spans, one span behind the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


class Encoder:
    """Ids of texts, word by word; a word that is letters and then marks is two parts, and each distinct part is encoded
    once while it is remembered.

    The tokenizer must drop white space before it looks for tokens and not look at a word's neighbours, as
    `word_bpe_49k.json` does: no token then crosses ASCII white space, and a text's ids are those of its words in order.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            suffix = json.load(f)["model"].get("end_of_word_suffix")
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        if suffix:
            self.ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        # The i-th known part has `sizes[i]` ids from `ids[starts[i]]` on and was last seen in call `seen[i]`.
        self.known = pa.array([], pa.large_string())
        self.starts, self.sizes, self.seen = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.ids = np.zeros(0, dtype="<u4")
        self.calls = 0

    def _one_by_one(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _letters(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of letters only, many in one call: a token with the word-end suffix ends each."""
        joined = b" ".join(words).decode()
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):  # a letter that is no letter in lower case, say
            return self._one_by_one(words)
        data, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def _learn(self, new: pa.Array) -> None:
        """Add the ids of parts that `known` has behind all others."""
        words, letters = new.view(pa.large_binary()).to_pylist(), letters_only(new)
        found = [b""] * len(words)
        for make, some in ((self._letters, np.flatnonzero(letters).tolist()), (self._one_by_one, np.flatnonzero(~letters).tolist())):
            for i in range(0, len(some), 5000):
                at = some[i:i + 5000]
                for k, data in zip(at, make([words[k] for k in at])):
                    found[k] = data
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), dtype="<u4")])
        self.seen = np.concatenate([self.seen, np.zeros(len(sizes), dtype=np.int64)])

    def _forget(self) -> None:
        """Keep those of the short parts that were seen last."""
        short = np.flatnonzero(pc.binary_length(self.known).to_numpy() <= LONG_WORD)
        keep = short[np.argsort(self.seen[short], kind="stable")[-KNOWN_WORDS // 2:]]
        self.known = self.known.take(pa.array(keep))
        self.ids = self.ids[spans(self.starts[keep], self.sizes[keep])]
        self.sizes, self.seen = self.sizes[keep], self.seen[keep]
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _parts(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
        """First parts of words, the places of words that have a second one, and these second parts."""
        bodies = pc.ascii_rtrim(words, characters=TAIL.decode())
        cut = np.flatnonzero(pc.not_equal(bodies, words).to_numpy(zero_copy_only=False))
        cut = cut[letters_only(bodies.take(pa.array(cut)))]
        whole = np.ones(len(words), dtype=bool)
        whole[cut] = False
        sizes = pc.binary_length(bodies).to_numpy()[cut]
        offsets = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset:]
        lengths = offsets[cut + 1] - offsets[cut] - sizes
        marks = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[spans(offsets[cut] + sizes, lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        tails = pa.LargeStringArray.from_buffers(len(cut), pa.py_buffer(ends), pa.py_buffer(marks))
        return pc.if_else(pa.array(whole), words, bodies), cut, tails

    def __call__(self, batch: list[bytes]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit numbers."""
        split = pc.ascii_split_whitespace(pa.array(batch, pa.large_binary()).view(pa.large_string()))
        words = split.flatten().dictionary_encode()
        heads, cut, tails = self._parts(words.dictionary)
        n, held = len(heads), len(self.known)
        coded = pa.concat_arrays([self.known, heads, tails]).dictionary_encode()
        self.known = coded.dictionary
        self._learn(self.known[held:])
        codes = coded.indices.to_numpy()[held:]
        self.calls += 1
        self.seen[codes] = self.calls
        parts = np.zeros((n, 2), dtype=np.int64)
        parts[:, 0], parts[cut, 1] = codes[:n], codes[n:]
        sizes = self.sizes[parts]
        second = np.zeros(n, dtype=bool)
        second[cut] = True
        sizes[~second, 1] = 0
        ids = self.ids[spans(self.starts[parts].ravel(), sizes.ravel())]
        sizes = sizes.sum(axis=1)
        starts, at = np.cumsum(sizes) - sizes, words.indices.to_numpy()
        data = ids[spans(starts[at], sizes[at])].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes[at])])
        cuts = (4 * ends[split.offsets.to_numpy()]).tolist()
        if len(self.known) > KNOWN_WORDS or self.known.nbytes > KNOWN_BYTES:
            self._forget()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]


def encode_texts(path: str, batch: list[bytes]) -> list[bytes]:
    """The ids of each text by the tokenizer of a file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path](batch)


def _pieces(batches, path: str, capacity: int, end: bytes):
    """Pieces of the texts of `batches (doc_id, text)`."""
    for batch in batches:
        ids = batch.column(0)
        at, held, size = 0, [], 0
        for n, t in enumerate(texts(batch.column(1)), 1):
            held.append(t)
            size += len(t)
            if size < STEP_BYTES and n < batch.num_rows:
                continue
            places, pieces, starts, parts = [], [], [], []
            for i, data in enumerate(encode_texts(path, held), at):
                data += end
                for piece, start in enumerate(range(0, len(data), 4 * capacity)):
                    places.append(i)
                    pieces.append(piece)
                    starts.append(start // 4)
                    parts.append(data[start:start + 4 * capacity])
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(places)), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()),
                 pa.array([len(p) // 4 for p in parts], pa.int64()), pa.array(parts, pa.binary())],
                names=["doc_id", "piece", "start", "length", "ids"])
            at, held, size = n, [], 0


def tokenize(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces `(doc_id, piece, start, length, ids)` of at most `capacity` ids; `ids` holds little-endian 32-bit numbers.

    A document is its ids and then `end_id`; null text counts as empty. Only longer documents are cut.
    """
    end = np.array([end_id], dtype="<u4").tobytes()
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        lambda batches: released(_pieces(batches, path, capacity, end)), f"doc_id {kind}, piece int, start long, length long, ids binary")


def plan_sequences(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs `(length, first rank, pieces, first sequence, offset, per sequence)` that place all pieces; `counts` has the
    pieces by length. The i-th piece of a run lies in sequence `first + i // per`, `i % per` lengths behind the offset."""
    runs, sequences = [], 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # free room: runs (first sequence, sequences)
    rooms: list[int] = []  # the keys of gaps, sorted

    def add(room: int, sequence: int, n: int) -> None:
        if room and n:
            if room not in gaps:
                insort(rooms, room)
            gaps.setdefault(room, []).append((sequence, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):  # the smallest room that is large enough
                room = rooms[at]
                sequence, n = gaps[room].pop()
                if not gaps[room]:
                    del gaps[room], rooms[at]
            else:
                room, sequence, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            per = room // length
            full = min(n, left // per)
            if full:
                take, used = full * per, full
                add(room - per * length, sequence, full)
            else:  # the last few pieces share one sequence
                take, used, per = left, 1, left
                add(room - left * length, sequence, 1)
            add(room, sequence + used, n - used)
            runs.append((length, rank, take, sequence, capacity - room, per))
            rank, left = rank + take, left - take
    return runs


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add `sequence_id` and `offset` to a stored table with `doc_id`, `piece` and `length` (1 to `capacity`).

    Every piece gets a place of its own; repeated rows are pieces of their own. Pieces are range-sorted by length, key and
    number, so a common length is spread over many tasks, and a piece's rank is its place less that of its length.
    An empty table gives no rows; a piece beyond the capacity is an error.
    """
    # At most `capacity` rows, whatever the input.
    sizes = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    if sizes and not 1 <= min(sizes) <= max(sizes) <= capacity:
        raise ValueError("a piece has no tokens or more than a sequence")
    runs = np.array(sorted(plan_sequences(sizes, capacity)), dtype=np.int64).reshape(-1, 6)
    keys = (runs[:, 0] << 44) + runs[:, 1]
    begin = np.zeros(capacity + 2, dtype=np.int64)
    for size, n in sizes.items():
        begin[size + 1] = n
    begin = np.cumsum(begin)
    ranked = dense_positions(pieces.withColumn("_order", F.struct("length", "doc_id", "piece")), "_order", "_place")
    names = pieces.columns

    def run(batches):
        for batch in batches:
            length, place = (batch.column(c).to_numpy() for c in ("length", "_place"))
            rank = place - begin[length]
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            sequence, behind = np.divmod(rank - runs[at, 1], runs[at, 5])
            places = [pa.array(runs[at, 3] + sequence), pa.array(runs[at, 4] + behind * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *places], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.select(*names, "_place").mapInArrow(run, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """`(sequence_id, length, ids)`: the token ids of each sequence, from packed pieces that kept their `ids`."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # a sequence holds `capacity` pieces at most
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts")).select(
        "sequence_id", "length", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def packed_digest(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """Tokenize and pack documents; one row per piece, with the CRC-32 of its ids instead of the ids."""
    pieces = tokenize(docs, path, capacity).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(stored(pieces, "pieces"), capacity)
