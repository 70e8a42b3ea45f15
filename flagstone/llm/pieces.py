"""SentencePiece (merge type) encoding by a table of last tokens, and decoding.

The merges of a text end with one token sequence, and so do those of each of its prefixes. The last token of a prefix is the
one match of an automaton over all pieces that ends there and whose two neighbours fit: the last token of the prefix
before it, and itself, stay as they are when only the two of them are merged. So a table with one token per prefix is
filled from left to right in time linear in the matches, and the ids are read from it backwards.

A text is walked by units that no piece crosses (a word with the blanks before it); the ids of units are remembered.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flagstone.llm.common import texts

BLANK = "\u2581"
# Distinct units, and distinct pairs of tokens, that a worker remembers (units in each of two generations).
KNOWN_UNITS, KNOWN_PAIRS = 250_000, 2_000_000
_VOCABULARIES: dict[str, "Pieces"] = {}


class Memory:
    """Answers by key, of which the latest `size` to twice as many are remembered."""

    def __init__(self, make, size: int = KNOWN_UNITS):
        self.make, self.size = make, size
        self.young: dict = {}
        self.old: dict = {}

    def __call__(self, keys: list) -> list:
        """The answers for `keys`; `make` is asked once for the list of all new ones."""
        found = list(map(self.young.get, keys))
        if None not in found:
            return found
        new = {k for k, answer in zip(keys, found) if answer is None}
        if len(self.young) + len(new) > self.size:
            self.old, self.young, new = self.young, {}, set(keys)
        unknown = [k for k in new if k not in self.old]
        self.young.update((k, self.old[k]) for k in new if k in self.old)
        self.young.update(zip(unknown, self.make(unknown)))
        return [self.young[k] for k in keys]


def spelled_pieces(model) -> list[bytes]:
    """What each id of a SentencePiece model adds to a decoded text; marks such as the end add nothing."""
    out = []
    for i in range(model.get_piece_size()):
        name = model.id_to_piece(i)
        if model.is_byte(i):
            out.append(bytes([int(name[1:-1], 16)]))
        else:
            out.append(b"" if model.is_control(i) or model.is_unknown(i) else name.replace(BLANK, " ").encode())
    return out


class Pieces:
    """The pieces of a model file: merge type, byte fallback, no rewriting of the text but blanks and a first blank."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        reserved = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in every]
        names = [model.id_to_piece(i) for i in every]
        self.end_id = model.eos_id()
        self.scores = {names[i]: model.get_score(i) for i in every if not reserved[i]}
        self.ids = {names[i]: i for i in every if not reserved[i]}
        self.names, self.sizes = names, [len(n) for n in names]
        self.bytes = {int(names[i][1:-1], 16): i for i in every if model.is_byte(i)}
        self.spelled = spelled_pieces(model)
        probe = " Ab  c\t\u00c5\ufb01 "
        shown = "".join(model.id_to_piece(i) if not model.is_byte(i) else "" for i in model.encode(probe))
        kept = (BLANK + probe.replace(" ", BLANK))
        if len(self.bytes) != 256 or shown != "".join(c for c in kept if c in self.ids) or any(model.is_unused(i) for i in every):
            raise ValueError("the model rewrites texts or has no byte pieces")
        characters = {c for n in self.ids for c in n}
        if not characters <= self.ids.keys():
            raise ValueError("a character of a piece is no piece itself")
        self.automaton = ahocorasick.Automaton()
        for name, i in self.ids.items():
            if self.merged(name) == [name]:  # others are never the end of a prefix
                self.automaton.add_word(name, i)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.units = self._units(characters)
        self.remembered = Memory(lambda units: [np.array(self.encode_unit(u), dtype="<i4").tobytes() for u in units])

    def _units(self, characters: set[str]) -> re.Pattern:
        """Matches the units of a text: a cut lies before blanks that follow anything else, around characters of no piece, and
        between a letter and a mark that follows a letter in no piece."""
        if any(re.search(f"[^{BLANK}]{BLANK}", n) for n in self.ids):
            raise ValueError("a piece goes on over a blank")
        letters = {c for c in characters if c.isalpha()}
        marks = characters - letters - {BLANK}
        bound = {b for n in self.ids for a, b in zip(n, n[1:]) if a in letters and b in marks}
        one = lambda some: "[" + "".join(map(re.escape, sorted(some))) + "]"
        known = f"(?:{one(marks)}+{one(letters)}*|{one(letters)}+)"
        rest = f"(?:{one(bound)}{one(marks)}*{one(letters)}*)*" if bound else ""
        return re.compile(f"{BLANK}*{known}{rest}|{BLANK}+|.", re.DOTALL)

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by its merges: the best score first, then the leftmost."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fit(self, a: int, b: int) -> bool:
        """Whether the merges of two tokens' text leave these two."""
        if len(self.pairs) > KNOWN_PAIRS:
            self.pairs.clear()
        x, y = self.names[a], self.names[b]
        answer = self.pairs[a << 32 | b] = self.merged(x + y) == [x, y]
        return answer

    def encode_unit(self, unit: str) -> list[int]:
        """The ids of a unit."""
        if unit in self.automaton:
            return [self.ids[unit]]
        if len(unit) == 1:
            return [self.bytes[b] for b in unit.encode()]
        n = len(unit)
        # Prefixes go by the place of their last character; what comes before the first stands at place -1.
        last, sizes, pairs = [-1] * n, self.sizes, self.pairs
        for end, token in self.automaton.iter(unit):
            if last[end] >= 0:
                continue
            start = end - sizes[token]
            if start >= 0:
                before = last[start]
                if before < 0:
                    continue
                fits = pairs.get(before << 32 | token)
                if not (self.fit(before, token) if fits is None else fits):
                    continue
            last[end] = token
        ids = []
        end = n - 1
        while end >= 0:
            ids.append(last[end])
            end -= sizes[last[end]]
        ids.reverse()
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text, without an end, as little-endian 32-bit numbers."""
        return b"".join(self.remembered(self.units.findall(BLANK + text.replace(" ", BLANK)))) if text else b""

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the first blank is that of encoding and goes."""
        data = b"".join(map(self.spelled.__getitem__, ids))
        return data[data.startswith(b" "):].decode("utf-8", "replace")


def id_lists(ids: list[bytes]) -> pa.ListArray:
    """Packed ids as a column of lists."""
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))


def pieces_of(path: str) -> Pieces:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Pieces(path)
    return _VOCABULARIES[path]


def encode_pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: bool = True) -> DataFrame:
    """One row per document: key and ids (array<int>), with an end id behind them if `end`.

    Null text counts as empty and has the end id alone. Repeated rows and null keys are rows of their own. A text of any
    length is encoded whole, in time linear in its length. Other columns are left out. An empty table gives no rows.
    """
    def run(batches):
        vocabulary = pieces_of(path)
        last = np.array([vocabulary.end_id] if end else [], dtype="<i4").tobytes()
        for batch in batches:
            at, held, size = 0, [], 0
            for n, data in enumerate(texts(batch.column(1)), 1):
                held.append(vocabulary.encode(data.decode("utf-8", "replace")) + last)
                size += len(data)
                if size > 1 << 21 or n == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0)[at:n], id_lists(held)], names=["doc_id", "ids"])
                    at, held, size = n, [], 0

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>").withColumnRenamed("doc_id", key)


def decode_pieces(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of a column of ids (null for null ids). Bytes that are no UTF-8 become U+FFFD."""
    def run(batches):
        vocabulary = pieces_of(path)
        for batch in batches:
            lists = batch.column(place)
            ends, numbers = lists.offsets.to_numpy(), lists.values.to_numpy()
            found = [
                vocabulary.decode(numbers[a:b].tolist()) if known else None
                for a, b, known in zip(ends, ends[1:], lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, out])

    place = encoded.columns.index(ids)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{schema}, `{out}` string")


def piece_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_tokens, ids_sha256 (of decimal ids joined by a space), decoded_sha256; see `encode_pieces`."""
    round_trip = decode_pieces(encode_pieces(docs, path, key, text), path)
    return round_trip.select(
        key, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
