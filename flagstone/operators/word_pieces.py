"""Word pieces: words cut into the longest tokens of a vocabulary, from left to right."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flagstone.plans.shared import bounded_rows

# The mark of a piece inside a word, and the longest word that is cut.
INSIDE, LONGEST_WORD = "##", 100
VOCABULARY_ROWS, KNOWN_WORDS = 5_000_000, 500_000


class Cutter:
    """Pieces of words by longest prefix. Tokens are looked up by the lengths that tokens of the same first character have, so
    a step takes as many look-ups as there are such lengths, whatever the size of the vocabulary."""

    def __init__(self, ids: dict[str, int], unknown: str, longest: int):
        self.ids, self.unknown, self.longest = ids, unknown, longest
        self.known: dict[str, tuple[list[str], list[int]]] = {}
        lengths: dict[tuple[bool, str], set[int]] = {}
        for token in ids:
            inside = token.startswith(INSIDE) and len(token) > len(INSIDE)
            if inside:
                lengths.setdefault((True, token[len(INSIDE)]), set()).add(len(token) - len(INSIDE))
            if token:  # a token that begins with the mark may also begin a word
                lengths.setdefault((False, token[0]), set()).add(len(token))
        self.lengths = {k: sorted(v) for k, v in lengths.items()}

    def cut(self, word: str) -> list[str]:
        if len(word) > self.longest:
            return [self.unknown]
        pieces, at = [], 0
        while at < len(word):
            mark, sizes = (INSIDE if at else ""), self.lengths.get((at > 0, word[at]), [])
            for size in reversed(sizes[:bisect_right(sizes, len(word) - at)]):
                piece = mark + word[at:at + size]
                if piece in self.ids:
                    break
            else:
                return [self.unknown]
            pieces.append(piece)
            at += size
        return pieces

    def __call__(self, text: str) -> tuple[list[str], list[int]]:
        pieces, numbers = [], []
        for word in text.split():
            found = self.known.get(word)
            if found is None:
                if len(self.known) >= KNOWN_WORDS:
                    self.known.clear()
                cut = self.cut(word)
                found = self.known[word] = (cut, [self.ids[p] for p in cut])
            pieces += found[0]
            numbers += found[1]
        return pieces, numbers


def word_pieces(df: DataFrame, text: str, vocab: DataFrame, unknown: str = "[UNK]", longest: int = LONGEST_WORD) -> DataFrame:
    """Add `pieces` and `ids`: the pieces of the blank-separated words of `text`, and their ids in `vocab (token, id)`.

    A word begins with the longest token that it starts with; the rest goes on with tokens that have `##` before them. A word
    that no tokens make up, or that has more than `longest` characters, is `unknown`, which must be a token. Specials such as
    `[MASK]` are words like others. Null text gives nulls, text without words gives empty arrays. The vocabulary goes to
    each executor once (`VOCABULARY_ROWS` tokens at most); rows are not shuffled and keep all their columns.
    """
    ids = {r["token"]: r["id"] for r in bounded_rows(vocab.select("token", "id"), VOCABULARY_ROWS)}
    if unknown not in ids:
        raise ValueError(f"{unknown} is not in the vocabulary")
    shared = df.sparkSession.sparkContext.broadcast(ids)
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(shared.value, unknown, longest)
        for batch in batches:
            found = [(None, None) if t is None else cutter(t) for t in batch.column(place).to_pylist()]
            more = [pa.array([f[0] for f in found], pa.list_(pa.string())), pa.array([f[1] for f in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "pieces", "ids"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kept}, pieces array<string>, ids array<int>")
