"""Alignment of two tokenizers by products of sparse incidence matrices.

A text's tokens under each tokenizer are a matrix of tokens by bytes, held in compressed rows (CSR). The row products of one
with the transpose of the other link all pairs of tokens that share bytes. Byte offsets at which tokens of both sides
end cut a text into groups; the products of the matrices of tokens by groups link all pairs within a group.

For corpus counts, texts are taken in blocks of bounded size. A block has a dictionary of its distinct id pairs, and a
document of the block is kept as its places in that dictionary. Dictionaries are added up to counts by pair, and each
block gets back the counts of its own pairs: what is shuffled is one row per block and pair, not one per link.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from flagstone.llm.common import stored, texts
from flagstone.llm.pieces import spelled_pieces

# Bytes of text whose tokens are multiplied at a time, and in a block (at least one document each).
SLICE, BLOCK = 1 << 20, 1 << 24
# Numbers that a product holds at a time (at least those of one row).
HELD = 1 << 22
# Fixed value: the words that byte-level tokenizers of this kind merge within.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SIDES: dict[tuple[str, str], object] = {}


@dataclass
class Csr:
    """A matrix in compressed rows: row i has ones in the columns `columns[starts[i]:starts[i + 1]]`."""

    starts: np.ndarray
    columns: np.ndarray
    width: int

    def transposed(self) -> "Csr":
        rows = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        order = np.argsort(self.columns, kind="stable")
        counts = np.bincount(self.columns, minlength=self.width)
        return Csr(np.concatenate([[0], np.cumsum(counts)]), rows[order], len(self.starts) - 1)


def row_products(a: Csr, b: Csr, held: int = HELD) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The nonzero cells `(row, column, value)` of the product of two matrices, in the order of rows and columns.

    Gustavson's way: a row of the product is the sum of the rows of `b` that the row of `a` names. As many rows are
    summed at a time as name `held` cells together.
    """
    sizes = b.starts[a.columns + 1] - b.starts[a.columns]
    cells = np.concatenate([[0], np.cumsum(sizes)])  # before each nonzero of a
    before = cells[a.starts]  # before each row of a
    row, rows = 0, len(a.starts) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(before, before[row] + held, side="right")) - 1)
        some = slice(a.starts[row], a.starts[end])
        n = sizes[some]
        places = np.repeat(b.starts[a.columns[some]] - (cells[some] - before[row]), n) + np.arange(before[end] - before[row])
        owners = np.repeat(np.repeat(np.arange(row, end), np.diff(a.starts[row:end + 1])), n)
        keys = owners * b.width + b.columns[places]
        if (keys[1:] < keys[:-1]).any():
            keys.sort(kind="stable")
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
        found, values = keys[first], np.diff(np.append(first, len(keys)))
        yield found // b.width, found % b.width, values
        row = end


class Words:
    """A byte-level merge tokenizer, from the vocabulary and merges of a `tokenizers` file."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        # Bytes that print stand for themselves in the file; the others are numbered from 256 on.
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printed]
        byte_of = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(others)}
        names = {i: token for token, i in model["vocab"].items()}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        if any(names.get(256 + i) != token for i, token in enumerate(merged)):
            raise ValueError("the ids of the vocabulary are not in the order of its merges")
        self.spelled = [b""] * (max(names) + 1)
        for i in range(256 + len(merged)):  # tokens beyond are marks that no text has
            self.spelled[i] = bytes(byte_of[c] for c in names[i])
        ranks = {token: i for i, token in enumerate(self.spelled) if token}
        self.tokenizer = tiktoken.Encoding("words", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of a blank and each text."""
        return [np.array(self.tokenizer.encode_ordinary(" " + t), dtype=np.int32) for t in texts]


class PieceIds:
    """A SentencePiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.spelled = spelled_pieces(self.model)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, dtype=np.int32) for ids in self.model.encode(texts, num_threads=1)]


def side(kind: str, path: str):
    """The tokenizer of a file (`words` or `pieces`), loaded once in a worker."""
    if (kind, path) not in _SIDES:
        _SIDES[kind, path] = {"words": Words, "pieces": PieceIds}[kind](path)
    return _SIDES[kind, path]


class Spelling:
    """The bytes of each id of a vocabulary, one behind the other, and its ids in decimal before each mark."""

    def __init__(self, spelled: list[bytes], marks: tuple[str, ...]):
        self.size = np.array([len(x) for x in spelled], dtype=np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(spelled), np.uint8)
        self.printed = [f"{i}{mark}" for mark in marks for i in range(len(spelled))]

    def bytes_of(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        ends = np.cumsum(sizes)
        return self.data[np.repeat(self.begin[ids] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]


MARKS = (",", "|", ";")
_SPELLED: dict[tuple[str, str], Spelling] = {}
_PRINTED: dict[tuple[str, str], list[str]] = {}


def spelling(kind: str, path: str) -> Spelling:
    if (kind, path) not in _SPELLED:
        _SPELLED[kind, path] = Spelling(side(kind, path).spelled, MARKS)
    return _SPELLED[kind, path]


@dataclass
class Aligned:
    """Tokens of several texts under both tokenizers, one text behind the other."""

    ids: tuple[np.ndarray, np.ndarray]
    matrices: tuple[Csr, Csr]  # tokens by bytes
    text_of: tuple[np.ndarray, np.ndarray]  # of tokens
    ends: np.ndarray  # byte offsets at which tokens of both sides end
    texts: int

    def groups(self) -> tuple[Csr, Csr]:
        """The matrices of tokens by groups."""
        found = [np.searchsorted(self.ends, m.starts[1:]) for m in self.matrices]
        return tuple(Csr(np.arange(len(g) + 1), g, len(self.ends)) for g in found)

    def links(self, shared: str = "bytes") -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Linked tokens of both sides, and how many bytes (or groups) they share."""
        a, b = self.matrices if shared == "bytes" else self.groups()
        return row_products(a, b.transposed())


def align(batch: list[bytes], path_a: str, path_b: str) -> Aligned:
    """Both tokenizations of texts. An empty text, and one that the tokens do not spell, has no tokens."""
    kinds = ("words", path_a), ("pieces", path_b)
    spelled = [spelling(*k) for k in kinds]
    places = np.array([i for i, data in enumerate(batch) if data], dtype=np.int64)
    strings = [batch[i].decode("utf-8", "replace") for i in places]
    tokens = [side(*k).encode(strings) for k in kinds]
    whole = np.frombuffer(b"".join(b" " + batch[i] for i in places), np.uint8)
    span = np.array([len(batch[i]) + 1 for i in places], dtype=np.int64)

    def laid(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, their sizes, and how many each text has."""
        ids = np.concatenate([np.zeros(0, dtype=np.int32), *tokens[k]])
        return ids, spelled[k].size[ids], np.array([len(t) for t in tokens[k]], dtype=np.int64)

    sides = [laid(0), laid(1)]
    same = np.ones(len(places), dtype=bool)
    for k, (ids, sizes, n) in enumerate(sides):
        owner = np.repeat(np.arange(len(places)), n)
        fits = np.bincount(owner, weights=sizes, minlength=len(places)).astype(np.int64) == span
        if fits.all():
            other = spelled[k].bytes_of(ids, sizes) != whole
            if other.any():
                fits[np.repeat(np.arange(len(places)), span)[other]] = False
        else:  # lengths differ somewhere: text by text
            cuts, at = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(span))
            for i in np.flatnonzero(fits):
                some = slice(cuts[i], cuts[i + 1])
                fits[i] = np.array_equal(spelled[k].bytes_of(ids[some], sizes[some]), whole[at[i]:at[i + 1]])
        same &= fits
    if not same.all():
        places, tokens = places[same], [[t for t, s in zip(side_tokens, same) if s] for side_tokens in tokens]
        sides = [laid(0), laid(1)]
    starts = [np.append(0, np.cumsum(sizes)) for _, sizes, _ in sides]
    width = int(starts[0][-1])
    return Aligned(
        tuple(ids for ids, *_ in sides), tuple(Csr(s, np.arange(width), width) for s in starts),
        tuple(np.repeat(places, n) for *_, n in sides),
        np.intersect1d(starts[0][1:], starts[1][1:], assume_unique=True), len(batch))


def printed_groups(found: Aligned, path_a: str, path_b: str) -> list[str]:
    """Each text's groups as `a1,a2|b1;a3|b2,b3`, ids in decimal."""
    groups = [g.columns for g in found.groups()]
    tables = spelling("words", path_a).printed, spelling("pieces", path_b).printed
    n = [len(t) // len(MARKS) for t in tables]
    group, sides = np.concatenate(groups), np.repeat([0, 1], [len(groups[0]), len(groups[1])])
    order = np.argsort(2 * group + sides, kind="stable")
    text = np.concatenate(found.text_of)[order]
    group, sides, ids = group[order], sides[order], np.concatenate(found.ids)[order]
    follows = np.where(np.append(group[1:] != group[:-1], True), 2, np.append(sides[1:] != sides[:-1], False))[:len(ids)]
    codes = (follows * np.where(sides, n[1], n[0]) + ids + sides * len(tables[0])).tolist()
    if (path_a, path_b) not in _PRINTED:
        _PRINTED[path_a, path_b] = tables[0] + tables[1]
    printed = _PRINTED[path_a, path_b].__getitem__
    cuts = np.searchsorted(text, np.arange(found.texts + 1)).tolist()
    return ["".join(map(printed, codes[x:y]))[:-1] for x, y in zip(cuts, cuts[1:])]


def _slices(batches) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Keys and texts of some documents at a time."""
    for batch in batches:
        at, held, size = 0, [], 0
        for n, data in enumerate(texts(batch.column(1)), 1):
            held.append(data)
            size += len(data)
            if size >= SLICE or n == batch.num_rows:
                yield batch.column(0)[at:n], held
                at, held, size = n, [], 0


def packed(numbers: list[np.ndarray]) -> bytes:
    """Arrays of equal length of numbers below 2**32, compressed byte by byte."""
    data = np.concatenate(numbers).astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(data).tobytes())


def unpacked(blob: bytes, arrays: int) -> np.ndarray:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(data.reshape(4, -1).T).view("<u4").reshape(arrays, -1).astype(np.int64)


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _blocks(rows: DataFrame, path_a: str, path_b: str, block_bytes: int) -> DataFrame:
    """Rows of two kinds, by block: one per document (doc_id, counts, groups_sha256, `places` in the dictionary with how often), and
    one per block with its dictionary: `a` and `b`, ids of the distinct pairs, and `docs`, the documents that link them."""
    def run(batches):
        kind = None
        sizes = [len(spelling(*k).size) for k in (("words", path_a), ("pieces", path_b))]
        span = sizes[1]
        block, held, size = TaskContext.get().partitionId() << 32, [], 0

        def closed():
            """The rows of a block."""
            pairs = [p for *_, p, _ in held]
            dictionary, places, docs = np.unique(np.concatenate(pairs), return_inverse=True, return_counts=True)
            cuts = np.cumsum([len(p) for p in pairs])[:-1]
            steps = [packed([np.diff(x, prepend=0), times]) for x, (*_, times) in zip(np.split(places, cuts), held)]
            n = len(held)
            columns = [pa.array([block] * n, pa.int64()), pa.array([h[0] for h in held], kind)]
            columns += [pa.array([h[1][c] for h in held], pa.int64()) for c in range(4)]
            columns += [pa.array([h[2] for h in held], pa.string()), pa.array(steps, pa.binary()), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])
            book = packed([dictionary // span, dictionary % span, docs])
            columns = [pa.array([block], pa.int64()), pa.nulls(1, kind), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string()),
                       pa.nulls(1, pa.binary()), pa.array([book], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

        for keys, batch in _slices(batches):
            kind = keys.type
            schema = pa.schema([("block", pa.int64()), ("doc_id", kind), *[(c, pa.int64()) for c in COUNTS], ("groups_sha256", pa.string()),
                                ("places", pa.binary()), ("dictionary", pa.binary())])
            found = align(batch, path_a, path_b)
            n = found.texts
            tokens = [np.bincount(o, minlength=n) for o in found.text_of]
            # A group ends with a token of the first side.
            last = np.isin(found.matrices[0].starts[1:], found.ends)
            groups = np.bincount(found.text_of[0][last], minlength=n)
            linked = [(found.text_of[0][x], found.ids[0][x].astype(np.int64) * span + found.ids[1][y]) for x, y, _ in found.links()]
            texts_of = np.concatenate([t for t, _ in linked]) if linked else np.zeros(0, dtype=np.int64)
            pairs = np.concatenate([p for _, p in linked]) if linked else np.zeros(0, dtype=np.int64)
            links = np.bincount(texts_of, minlength=n)
            every = sizes[0] * span
            distinct, times = np.unique(texts_of * every + pairs, return_counts=True)
            cuts = np.searchsorted(distinct, np.arange(1, n) * every)
            each = zip(np.split(distinct % every, cuts), np.split(times, cuts))
            digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in printed_groups(found, path_a, path_b)]
            counts = zip(*(x.tolist() for x in (*tokens, groups, links)))
            held += [(k, c, d, p, t) for k, c, d, (p, t) in zip(keys.to_pylist(), counts, digests, each)]
            size += sum(map(len, batch))
            if size >= block_bytes:
                yield from closed()
                block, held, size = block + 1, [], 0
        if held:
            yield from closed()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"block long, doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, places binary, dictionary binary")


def _entries(books: DataFrame) -> DataFrame:
    """`(block, place, a, b, docs)`: the entries of the blocks' dictionaries."""
    def run(batches):
        for batch in batches:
            for block, book in zip(batch.column(0).to_pylist(), batch.column(1)):
                a, b, docs = unpacked(book.as_py(), 3)
                for at in range(0, len(a), 1 << 16):
                    some = slice(at, at + (1 << 16))
                    n = len(a[some])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, block)), pa.array(np.arange(at, at + n, dtype=np.int32)), *[pa.array(x[some].astype(np.int32)) for x in (a, b)],
                         pa.array(docs[some])], names=["block", "place", "a", "b", "docs"])

    return books.mapInArrow(run, "block long, place int, a int, b int, docs long")


def alignments(
    docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK,
) -> DataFrame:
    """One row per document: key, n_a, n_b (tokens), n_groups, n_links (pairs of tokens that share bytes), n_best (links whose id pair
    is linked in as many documents as any pair of its first id), count_sum (documents of the pair, over links), groups_sha256.

    `path_a` is a byte-level merge tokenizer (`tokenizers` file) over a blank and the text, `path_b` a SentencePiece model over the
    text. Null and empty texts, and those that the tokens do not spell byte by byte, have zeros and an empty digest. Repeated
    rows and null keys are documents of their own. A text of any length is aligned whole, in one task; its products are made some
    rows at a time. Other columns are left out. An empty table gives no rows.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    blocks = stored(_blocks(rows, path_a, path_b, block_bytes), "aligned-blocks")
    entries = _entries(blocks.filter("dictionary is not null").select("block", "dictionary"))
    counts = entries.groupBy("a", "b").agg(F.sum("docs").alias("docs"))
    counts = stored(counts, "pair-counts")
    # One row per id of the first vocabulary at most.
    top = counts.groupBy("a").agg(F.max("docs").alias("most"))
    ranked = counts.join(F.broadcast(top), "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("best"))
    answers = entries.drop("docs").join(ranked, ["a", "b"]).select("block", "place", "docs", "best")
    members = blocks.filter("dictionary is null").drop("dictionary")

    def run(own: pa.Table, answered: pa.Table) -> pa.Table:
        size = answered.num_rows
        place = answered.column("place").to_numpy()
        docs_of, best = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        docs_of[place], best[place] = answered.column("docs").to_numpy(), answered.column("best").to_numpy()
        n_best, count_sum = [], []
        for blob in own.column("places"):
            steps, times = unpacked(blob.as_py(), 2)
            at = steps.cumsum()
            n_best.append(int((times * best[at]).sum()))
            count_sum.append(int((times * docs_of[at]).sum()))
        names = ["doc_id", *COUNTS, "groups_sha256"]
        return pa.table([*[own.column(c) for c in names], pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())], names=[*names, "n_best", "count_sum"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = members.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        run, f"doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, n_best long, count_sum long")
    return out.select(F.col("doc_id").alias(key), *COUNTS, "n_best", "count_sum", "groups_sha256")


def token_links(docs: DataFrame, path_a: str, path_b: str, shared: str = "bytes", key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per linked pair of tokens: key, a_place, b_place (of the tokens in the text), a_id, b_id, shared (bytes, or groups with
    `shared="groups"`); texts as in `alignments`."""
    def run(batches):
        for keys, batch in _slices(batches):
            found = align(batch, path_a, path_b)
            begin = [np.searchsorted(o, np.arange(found.texts)) for o in found.text_of]
            for x, y, n in found.links(shared):
                owner = found.text_of[0][x]
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(owner)), *[pa.array(p.astype(np.int32)) for p in (
                        x - begin[0][owner], y - begin[1][owner], found.ids[0][x], found.ids[1][y], n)]],
                    names=["doc_id", "a_place", "b_place", "a_id", "b_id", "shared"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, a_place int, b_place int, a_id int, b_id int, shared int").withColumnRenamed("doc_id", key)
